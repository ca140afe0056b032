"""Reporting, contrasts, geometry and integration metrics on own data, against plain Python and numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotweave.functions import geometry
from spotweave.operators import contrasts, expression, integration, reporting, results, silhouette


def test_affine_map(spark):
    rng = np.random.default_rng(1)
    m = np.array([[3.0, -1.0, 40.0], [0.5, 2.0, -7.0]])
    at = rng.uniform(0, 80, (30, 2))
    image = np.c_[at, np.ones(30)] @ m.T
    rows = [(*map(float, a), *map(float, i)) for a, i in zip(at, image, strict=True)]
    kind = "col double, row double, image_x double, image_y double"
    marks = spark.createDataFrame([*rows, (1.0, None, 2.0, 3.0)], kind)
    assert geometry.fit_affine(marks) == pytest.approx(m)
    for bad in (rows[:2], [(x, 2 * x, x, x) for x in (1.0, 2.0, 3.0, 4.0)], [(x, y, x, 2 * x) for x, y in ((1.0, 2.0), (2.0, 7.0), (5.0, 1.0))]):
        with pytest.raises(ValueError):
            geometry.fit_affine(spark.createDataFrame(bad, kind))
    pixels = geometry.spot_pixels(spark.createDataFrame([(5.0, 9.0)], "x_pixel double, y_pixel double")).first()
    assert (pixels.image_x, pixels.image_y, pixels.array_col) == (9.0, 5.0, 0)
    with pytest.raises(KeyError):
        geometry.first_present(marks, ("nothing",))


def test_widths_and_names():
    assert geometry.layer_widths(1000, 30, 1) == [1000, 30]
    inner = geometry.layer_widths(1000, 30, 3)
    assert inner[0] == 1000 and inner[-1] == 30 and all(w & (w - 1) == 0 for w in inner[1:-1]) and inner == sorted(inner, reverse=True)
    assert geometry.scope_name(["b", "a"]) == "a-b" and geometry.scope_name([]) == "all"
    with pytest.raises(ValueError):
        geometry.layer_widths(4, 2, 0)


def test_wide_scopes_and_gene_places():
    assert reporting.wide_scopes(["f1/z/l", "f1/global/l", "f1/a/l_lo", "batch/x"]) == ["global", "a", "z"]
    assert reporting.wide_scopes(["f1/l"]) == ["global"] and reporting.wide_scopes(["x"]) == []
    assert expression.gene_places(["a", "b", "a"], ["a", "c"]) == [0, -1]


def test_runs_are_checked_together(spark):
    def scores(value, stage="eval", model="pca"):
        rows = [(stage, f"{stage}.csv", model, "f1_score", value)]
        return results.score_frame(spark.createDataFrame(rows, "stage string, source string, model string, metric string, value double"))

    same = results.union_scores(scores(0.5), scores(0.5, "integrate", "plain"))
    aliases = {("integrate", "plain"): "pca"}
    out = results.check_runs({"b": same, "a": same}, aliases=aliases)
    assert out.count() == 4 and {r.run_name for r in out.collect()} == {"a", "b"}
    assert results.check_runs({"a": scores(0.5), "b": scores(0.9)}).count() == 2  # two runs may differ
    with pytest.raises(results.Refused):
        results.check_runs({"a": results.union_scores(scores(0.5), scores(0.6, "integrate", "plain"))}, aliases=aliases)
    with pytest.raises(results.Refused):
        results.check_runs({"a": scores(0.5)}, aliases=aliases)
    with pytest.raises(results.Refused):
        results.check_runs({"a": scores(0.5).limit(0)})


def test_contrasts(spark):
    df = spark.createDataFrame([(1, 0.5, 0.2), (2, None, 0.1), (3, 0.4, float("nan"))], "target long, r2_refined double, r2_frozen double")
    assert [(r.contrast, r.target) for r in contrasts.rankings(df, ["guided_vs_frozen", "guided_vs_capacity"]).collect()] == [("guided_vs_frozen", "1")]
    assert contrasts.rankings(df, ["capacity_vs_frozen"]).count() == 0
    with pytest.raises(results.Refused):
        contrasts.rankings(df, ["of_my_own"])


def test_pooled_expression(spark):
    df = spark.createDataFrame([("a", 1, "G1.4", 2), ("a", 1, "G1.5", 3), ("a", 2, "G2", 1), ("b", 1, "G1", 4)], "sample_id string, spot long, gene string, count long")
    assert sorted(map(tuple, expression.pooled_slides(df).select("sample_id", "gene", "count").collect())) == [("a", "G1", 5), ("b", "G1", 4)]
    with pytest.raises(ValueError):
        expression.pooled_slides(df.where("gene <> 'G1'  and gene not like 'G1.%'").unionByName(df.where("sample_id = 'b'")))
    with pytest.raises(KeyError):
        expression.reindexed(df, spark.createDataFrame([("zz",)], "sample_id string"), "sample_id")


def labelled(n=90, d=5, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) + np.arange(n)[:, None] % 3
    return x, np.array([f"l{i % 3}" for i in range(n)]), np.array([f"b{i % 7 % 3}" for i in range(n)])


def plain_silhouette(x, labels, between=min):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = []
    for i in range(len(x)):
        own = (labels == labels[i]) & (np.arange(len(x)) != i)
        b = between([d[i, labels == k].mean() for k in set(labels) - {labels[i]}])
        a = d[i, own].mean() if own.any() else b
        out.append((b - a) / max(a, b) if own.any() else 0.0)
    return np.array(out)


@pytest.mark.parametrize("chunk", [16, 4096])
def test_silhouettes(spark, chunk):
    x, labels, batches = labelled()
    df = spark.createDataFrame([(i, labels[i], batches[i], x[i].tolist()) for i in range(len(x))], "key long, label string, batch string, x array<double>")
    assert silhouette.silhouette_label(df, "key", "label", "x", chunk).first()[0] == pytest.approx((plain_silhouette(x, labels).mean() + 1) / 2)
    mean = lambda v: sum(v) / len(v)
    want = np.mean([(1 - np.abs(plain_silhouette(x[labels == k], batches[labels == k], mean))).mean() for k in set(labels)])
    assert silhouette.bras(df, "key", "batch", "label", "x", chunk).first()[0] == pytest.approx(want)


def test_lisi_kbet_and_connectivity(spark):
    x, labels, batches = labelled(60)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :12]
    edges = spark.createDataFrame([(i, int(j), float(d[i, j])) for i in range(60) for j in near[i]], "key long, other long, dist double")
    own = lambda v: spark.createDataFrame([(i, str(k)) for i, k in enumerate(v)], "key long, label string")
    got = {r.key: r.lisi for r in integration.lisi(edges, own(batches), 4).collect()}
    for i in range(60):
        low, high = 1e-9, 1e9
        for _ in range(200):
            beta = np.sqrt(low * high)
            p = np.exp(-(d[i, near[i]] - d[i, near[i]].min()) * beta)
            p /= p.sum()
            low, high = (beta, high) if -(p[p > 0] * np.log(p[p > 0])).sum() > np.log(4) else (low, beta)
        assert got[i] == pytest.approx(1 / sum(p[batches[near[i]] == b].sum() ** 2 for b in set(batches)), abs=1e-4)
    got = {r.label: r.acceptance for r in integration.kbet(edges, own(batches).withColumnRenamed("label", "batch"), own(labels)).collect()}
    for k in set(labels):
        fine = []
        for i in np.flatnonzero(labels == k):
            some = [j for j in near[i] if labels[j] == k]
            if some:
                share = {b: (batches[labels == k] == b).mean() for b in set(batches[labels == k])}
                stat = sum(((batches[some] == b).sum() - len(some) * s) ** 2 / (len(some) * s) for b, s in share.items())
                fine.append(integration.chi_square_tail(stat, len(share) - 1) >= 0.05)
        assert got[k] == pytest.approx(np.mean(fine))
    share = []
    for k in sorted(set(labels)):
        part = {i: i for i in np.flatnonzero(labels == k)}
        for _ in range(60):
            for i in part:
                for j in near[i]:
                    if j in part:
                        part[i] = part[j] = min(part[i], part[j])
        share.append(max(list(part.values()).count(v) for v in set(part.values())) / len(part))
    assert integration.graph_connectivity(edges, own(labels)).first()[0] == pytest.approx(np.mean(share))
    assert integration.pcr_comparison(0.4, 0.1) == pytest.approx(0.75) and integration.pcr_comparison(0.1, 0.4) == 0 and integration.pcr_comparison(0, 1) == 0


def test_panels_drop_composites(spark):
    names = ["Kmeans NMI", "BRAS", "total", "Bio conservation", "n_spots", "own_metric"]
    got = {r.metric: r.panel for r in integration.split_panels(spark.createDataFrame([(n,) for n in names], "metric string")).collect()}
    assert got == {"Kmeans NMI": "bio", "BRAS": "batch", "own_metric": "other"}


def test_moments_of_ragged_and_null_vectors(spark):
    from spotweave.operators.probes import moments

    rows = [("a", 1, [1.0, 2.0]), ("a", 1, [3.0, None, 5.0]), ("b", None, [4.0]), (None, 1, None), ("b", None, [])]
    df = spark.createDataFrame(rows, "g string, h int, z array<float>").repartition(2)
    got = sorted(map(tuple, moments(df, ["g", "h"]).select("g", "h", "pos", "n", "s", "q").collect()), key=repr)
    assert got == sorted([("a", 1, 0, 2, 4.0, 10.0), ("a", 1, 1, 1, 2.0, 4.0), ("a", 1, 2, 1, 5.0, 25.0), ("b", None, 0, 1, 4.0, 16.0)], key=repr)
    assert moments(df.where(F.lit(False)), ["g"]).count() == 0


def test_conditions_are_summed_before_scopes_are_compared(spark):
    rows = [("p", "x", s, c, v) for s in ("global", "a", "b") for c, v in (("none", 1.0), ("shuffled", 3.0), ("none", 2.0))]
    df = spark.createDataFrame(rows, "protocol string, level string, scope string, condition string, f1_score double")
    out = reporting.condition_summary(df, ["none", "shuffled"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Aggregate")  # the one task over all sees means, not rows
    assert sorted(map(tuple, out.collect())) == [("p", "x", "a", 1.5, 3.0), ("p", "x", "b", 1.5, 3.0)]
    alone = reporting.condition_summary(df.where("scope = 'global'"), ["none", "shuffled"])
    assert [tuple(r) for r in alone.collect()] == [("p", "x", "global", 1.5, 3.0)]
