"""Canonical correlations from moments against plain numpy."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotweave.operators import canonical
from spotweave.operators.linalg import moments_of


def cohort(spark, n=240, dx=9, dy=7):
    rng = np.random.default_rng(6)
    t = rng.normal(size=(n, 2))
    x = t @ rng.normal(size=(2, dx)) + rng.normal(size=(n, dx)) + (np.arange(n) % 6)[:, None]
    y = t @ rng.normal(size=(2, dy)) + rng.normal(size=(n, dy)) * 0.5
    rows = [(f"k{i:03d}", f"s{i % 6}", f"p{i % 6 // 2}" if i % 6 < 4 else f"q{i % 6}", [float(v) for v in x[i]], [float(v) for v in y[i]]) for i in range(n)]
    return x, y, spark.createDataFrame(rows, "key string, slide string, patient string, x array<double>, y array<double>").repartition(5)


def plain_reduce(x, k):
    c = x - x.mean(axis=0)
    _, _, vt = np.linalg.svd(c, full_matrices=False)
    return c @ vt[: min(k, x.shape[1], max(2, len(x) // 5))].T


def plain_rho(x, y, ridge):
    x, y = x - x.mean(axis=0), y - y.mean(axis=0)
    n = len(x)

    def root(s):
        w, v = np.linalg.eigh(s)
        return (v / np.sqrt(np.maximum(w, 0) + ridge * w.max())) @ v.T

    return np.clip(np.linalg.svd(root(x.T @ x / (n - 1)) @ (x.T @ y / (n - 1)) @ root(y.T @ y / (n - 1)))[1], 0, 1)


@pytest.mark.parametrize("bundle", [8192, 50])
def test_spectrum(spark, bundle):
    x, y, df = cohort(spark)
    got = canonical.spectrum(df, "x", "y", "slide", "key", dim=4, report=3, permutations=6, seed=5, bundle=bundle)
    u, v = plain_reduce(x, 4), plain_reduce(y, 4)
    assert got["observed"] == pytest.approx(plain_rho(u, v, 1e-4)[:3])
    for name, group in (("global", None), ("within_slide", "slide")):
        g = F.lit("all") if group is None else F.col(group)
        at = {r.key: (r.g, r.b) for r in df.withColumn("g", g).join(df.withColumn("g", g).groupBy("g").agg(F.ceil(F.count(F.lit(1)) / bundle).alias("parts")), "g").select("key", "g", F.pmod(F.xxhash64("key"), F.col("parts")).alias("b")).collect()}
        null = []
        for p in range(6):
            w = np.empty_like(v)
            for b in set(at.values()):
                own = np.array([i for i in range(240) if at[f"k{i:03d}"] == b])
                w[own] = v[own[np.random.default_rng([5, zlib.crc32(f"{b[0]}|{b[1]}".encode()), p]).permutation(len(own))]]
            null.append(plain_rho(u, w, 1e-4)[:3])
        assert got[f"{name}_mean"] == pytest.approx(np.mean(null, axis=0)) and got[f"{name}_q95"] == pytest.approx(np.percentile(null, 95, axis=0))
    shared = (got["observed"] ** 2).sum()
    assert got["spot_level_mean"] == pytest.approx((shared - (got["within_slide_mean"] ** 2).sum()) / shared) and 0 < got["spot_level_q95"] < got["spot_level_mean"] < 1


def test_reduction_keeps_a_fifth_of_the_rows(spark):
    _, _, df = cohort(spark, n=240)
    few = moments_of(df.where("key < 'k020'"), "x", "y")
    assert canonical.Reduction(few, 50).vx.shape == (9, 4) and canonical.Reduction(moments_of(df, "x", "y"), 50).vy.shape == (7, 7)


def test_held_out_slides_and_the_gap(spark):
    x, y, df = cohort(spark)
    r = canonical.ceiling(df, "x", "y", "slide", "patient", "key", dim=4, permutations=3).first()
    u, v = plain_reduce(x, 4), plain_reduce(y, 4)
    test = []
    for s in range(6):
        out = np.arange(240) % 6 == s
        a, b = u[~out], v[~out]

        def root(m):
            w, e = np.linalg.eigh(m)
            return (e / np.sqrt(np.maximum(w, 0) + 1e-4 * w.max())) @ e.T

        ca, cb = a - a.mean(axis=0), b - b.mean(axis=0)
        wa, wb = root(ca.T @ ca / (len(a) - 1)), root(cb.T @ cb / (len(b) - 1))
        p, _, q = np.linalg.svd(wa @ (ca.T @ cb / (len(a) - 1)) @ wb)
        test.append(abs(np.corrcoef((u[out] @ wa @ p)[:, 0], (v[out] @ wb @ q.T)[:, 0])[0, 1]))
    assert (r.n_spots, r.n_slides, r.n_held_out) == (240, 6, 6) and r.rho1_test == pytest.approx(np.mean(test))
    assert r.rho1_paired == pytest.approx(np.mean(test[:4])) and r.patient_gap == pytest.approx(np.mean(test[:4]) - np.mean(test[4:])) and r.note is None
    lone = canonical.ceiling(df.withColumn("patient", F.col("slide")), "x", "y", "slide", "patient", "key", dim=4, permutations=2).first()
    assert lone.patient_gap is None and "no held-out slide" in lone.note
    with pytest.raises(ValueError):
        canonical.spectrum(df.limit(2), "x", "y", "slide", "key")
