"""The count baseline against dense numpy."""

import numpy as np
import pytest

from spotweave.operators import hvg


@pytest.fixture(scope="module")
def cohort(spark):
    """Four slides of 40 spots and 30 genes; one gene is missing from a slide; some spots have no counts."""
    rng = np.random.default_rng(2)
    rate = rng.gamma(0.6, 3, size=30) * (1 + 4 * (np.arange(30)[None] % 5 == rng.integers(0, 5, 160)[:, None]))
    x = rng.poisson(rate).astype(float)
    x[120:, 7] = 0
    x[10:14] = 0
    rows = [(f"s{i // 40}", i, f"g{j:02d}", int(x[i, j])) for i in range(160) for j in range(30) if x[i, j]]
    counts = spark.createDataFrame(rows, "sample_id string, spot long, gene string, count long").repartition(6)
    spots = spark.createDataFrame([(f"s{i // 40}", i, "extra") for i in range(160)], "sample_id string, spot long, places string").withColumnRenamed("places", "note")
    return x, counts, spots


def dense(x, n_top, k):
    ok = (x.sum(axis=1) > 0) & (np.arange(160) < 120)
    shared = [j for j in range(30) if all((x[s * 40 : s * 40 + 40, j] > 0).any() for s in range(4))]
    y = x[ok][:, shared]
    n = len(y)
    mean, var = y.mean(axis=0), y.var(axis=0, ddof=1)
    c = np.polyfit(np.log10(mean), np.log10(var), 2)
    sd = np.sqrt(10 ** np.polyval(c, np.log10(mean)))
    z = np.minimum((y - mean) / sd, np.sqrt(n))
    score = (z**2).sum(axis=0) / (n - 1)
    keep = np.sort(np.argsort(-score, kind="stable")[:n_top])
    genes = [shared[j] for j in keep]
    total = x.sum(axis=1, keepdims=True)
    v = np.log1p(x / np.where(total > 0, total, 1) * 1e4)[:, genes]
    m, s = v[ok].mean(axis=0), v[ok].std(axis=0)
    u = (v - m) / s
    cov = np.cov(u[ok].T)
    w, e = np.linalg.eigh(cov)
    e = e[:, np.argsort(w)[::-1][:k]]
    e = e * np.sign(e[np.abs(e).argmax(axis=0), np.arange(k)])
    return [f"g{j:02d}" for j in genes], score[keep], m, s, np.where(x.sum(axis=1, keepdims=True) > 0, u @ e, 0), ok.sum()


def test_equals_dense_numpy(spark, cohort):
    x, counts, spots = cohort
    genes, score, m, s, z, n = dense(x, 12, 3)
    model = hvg.HvgPca(12, 3).fit(counts, spots.where("spot < 120"))
    kept = model.genes.orderBy("place").collect()
    assert [r.gene for r in kept] == genes and [r.score for r in kept] == pytest.approx(score.tolist())
    assert model.mean == pytest.approx(m) and model.sd == pytest.approx(s)
    assert model.history["n_fit_spots"] == n == 116 and model.history["n_fit_spots_unresolved"] == 4 and model.history["n_shared_genes"] == 29
    got = model.embed(counts, spots).orderBy("spot").collect()
    assert len(got) == 160 and np.array([r.z for r in got]) == pytest.approx(z, abs=1e-8)
    assert [r.spot for r in got if not r.found] == [10, 11, 12, 13] and got[0].note == "extra"


def test_components_are_capped(spark, cohort):
    _, counts, spots = cohort
    model = hvg.HvgPca(5, 128, scale=False).fit(counts, spots)
    assert model.history["n_components"] == 5 and model.history["explained_variance_ratio"] == pytest.approx(1) and (model.sd == 1).all()


def test_blocks_of_the_gramian(spark, cohort, monkeypatch):
    x, counts, spots = cohort
    monkeypatch.setattr(hvg, "BLOCK", 5)
    genes = hvg.ranked_genes(counts, spots, 12)
    rows = hvg.sparse_rows(counts, genes)
    total = x.sum(axis=1, keepdims=True)
    v = np.log1p(x / np.where(total > 0, total, 1) * 1e4)[:, [int(r.gene[1:]) for r in genes.orderBy("place").collect()]]
    assert hvg.sparse_gramian(rows, 12) == pytest.approx(v.T @ v)


def test_too_few_fit_spots(spark, cohort):
    _, counts, spots = cohort
    with pytest.raises(ValueError, match="0 of the fit spots"):
        hvg.HvgPca(5, 2).fit(counts, spots.where("spot in (10, 11)"))
