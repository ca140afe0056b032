"""Operators on literal fixtures and against numpy."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotweave.functions import ids, labels
from spotweave.operators import biosignal, bootstrap, correction, counts, diagnostics, folds, integration, knn, linalg, models, probes, results, sampling, tables
from spotweave.sources import tables as sources
from spotweave.streaming import r2


def vectors(spark, n=60, d=4, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    rows = [(i, f"s{i % 3}", f"d{i % 2}", [float(v) for v in x[i]], [float(v) for v in (x[i, :2] * 2 + rng.normal(size=2) * 0.1)]) for i in range(n)]
    return x, spark.createDataFrame(rows, "key long, sample_id string, donor string, z array<double>, y array<double>")


def test_labels_and_ids(spark):
    df = spark.createDataFrame([(" tum ",), ("Tumor",), ("unassigned",), (None,), (" mixed ",), ("TLS",)], "a string")
    got = df.select(labels.canonical("a"), labels.is_labelled("a")).collect()
    assert [tuple(r) for r in got] == [("Tumor", True), ("Tumor", True), ("unassigned", False), (None, False), ("mixed", False), ("TLS", True)]
    df = spark.createDataFrame([("Q-7-30-4",), ("ZZ12",), ("MW-X-9",)], "sample_id string")
    got = df.select(*ids.parsed(), ids.fallback_tissue()).collect()
    assert [tuple(r) for r in got] == [("Q-7", 30, 4, "Q-7-30-4"), ("ZZ12", -1, -1, "ZZ"), ("MW-X-9", -1, -1, "MW-X")]


def test_floor_names_spots_before_slides(spark):
    # organ o has class k on (k + 1) slides with 2k spots each: small classes fail by spots, and one with many spots by its one slide
    rows = [("o1", f"c{k}", f"p{s}") for k in range(1, 4) for s in range(k + 1) for _ in range(2 * k)] + [("o2", "wide", "q0")] * 50 + [("o2", "rare", "q1")] * 3
    df = spark.createDataFrame(rows, "tissue string, annotation string, sample_id string")
    below = {(r.tissue, r.annotation): r.below for r in labels.class_support(df, 10, 2).collect()}
    assert below == {("o1", "c1"): "spots", ("o1", "c2"): None, ("o1", "c3"): None, ("o2", "wide"): "slides", ("o2", "rare"): "spots"}
    assert {r.annotation for r in labels.apply_floor(df, 0, 0).collect()} == {"c1", "c2", "c3", "wide", "rare"}


def test_benjamini_hochberg_and_strata(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.5, 0.002, None])], "k int, p double")
    got = {r.k: r.padj for r in biosignal.benjamini_hochberg(df, "p").collect()}
    assert [None if got[k] is None else round(got[k], 6) for k in range(6)] == [0.025, 0.05, 0.05, 0.5, 0.01, None]
    df = spark.range(23).select(F.col("id").alias("k"), (F.col("id") * 2.0).alias("b"))
    sizes = [r["count"] for r in biosignal.strata(df, "b", "k", 5).groupBy("stratum").count().orderBy("stratum").collect()]
    assert sizes == [5, 5, 5, 4, 4]
    assert biosignal.strata(df, "b", "k", 50).where("stratum is not null").count() == 0


def test_sampling_hits_the_cap(spark):
    df = spark.createDataFrame([(i, "abc"[min(i % 7, 2)]) for i in range(100)], "k long, s string")
    assert sampling.stratified_sample(df, "k", "s", 37).count() == 37
    assert sampling.stratified_sample(df, "k", "s", 500).count() == 100
    assert sampling.train_validation(df, "k", 0.001).where("part = 'val'").count() == 2
    moved = sampling.permuted(df.withColumn("v", F.col("k")), "k", "v", ["s"])
    assert sorted(r.v for r in moved.collect()) == list(range(100))


def test_folds_do_not_leak(spark):
    slides = spark.createDataFrame([(f"{d}-{r}-{p}", "skin" if d < "C" else "lung", d, r, p) for d in "ABC" for r in (1, 2) for p in (1, 2)] + [("X9", "lung", "X9", -1, -1)], "sample_id string, tissue string, donor string, region int, replicate int")
    rows = folds.generate(slides)
    both = rows.where("role = 'train'").join(rows.where("role = 'eval'"), ["level", "fold", "sample_id"])
    assert both.count() == 0
    n = {r.level: r.n for r in rows.groupBy("level").agg(F.countDistinct("fold").alias("n")).collect()}
    assert n == {"cross_replicate": 12, "cross_region": 6, "cross_donor": 4, "cross_slide": 13}


def test_knn_matches_brute_force(spark):
    x, df = vectors(spark, 80)
    a = df.where("key < 20").select(F.lit("f").alias("fold"), "key", F.col("z").alias("x"))
    b = df.where("key >= 20").select(F.lit("f").alias("fold"), "key", F.col("donor").alias("label"), F.col("z").alias("x"))
    got = {}
    for r in knn.nearest(a, b, 3, chunk=16).orderBy("key", "rank").collect():
        got.setdefault(r.key, []).append(r.other)
    d = ((x[:20, None] - x[None, 20:]) ** 2).sum(axis=2)
    assert got == {i: (np.argsort(d[i], kind="stable")[:3] + 20).tolist() for i in range(20)}


def test_knn_ties_go_to_the_smaller_key(spark):
    rng = np.random.default_rng(3)
    copies = rng.normal(size=(2, 4)) * 100
    y = np.concatenate([copies[rng.integers(0, 2, 400)], rng.normal(size=(20, 4)) + 1e4])
    x = np.concatenate([copies, y[-2:] + 0.1])
    row = lambda keys, m: [("f", int(i), str(int(i) % 3), v.tolist()) for i, v in zip(keys, m, strict=True)]
    kind = "fold string, key long, label string, x array<double>"
    keys = rng.permutation(len(y))
    a, b = spark.createDataFrame(row(range(len(x)), x), kind).drop("label"), spark.createDataFrame(row(keys, y), kind)
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    want = {i: [int(keys[j]) for j in np.lexsort((keys, d[i]))[:5]] for i in range(len(x))}
    for chunk in (64, 4096):
        got = {}
        for r in knn.nearest(a, b, 5, chunk=chunk).orderBy("key", "rank").collect():
            got.setdefault(r.key, []).append(r.other)
        assert got == want


def test_knn_rows_travel_to_a_few_sides(spark):
    rng = np.random.default_rng(5)
    n, k = 3000, 4
    x = np.round(rng.normal(size=(n, 3)), 1)  # many ties
    name = [f"r{i:05d}" for i in rng.permutation(n)]
    fold = rng.integers(0, 2, n)
    df = spark.createDataFrame([(f"f{f}", m, f"l{i % 3}" if i % 5 else None, v.tolist()) for i, (f, m, v) in enumerate(zip(fold, name, x, strict=True))], "fold string, key string, label string, x array<double>").repartition(6)
    sides = 4 * spark.sparkContext.defaultParallelism
    work = knn._work(df.drop("label"), df, "fold", 32).select("fold", "_a", "_c").collect()
    assert len({(r["fold"], r["_a"]) for r in work}) <= sides + 1
    assert len(work) <= (sides + 1) * (n // 32 // 2 + 10)  # chunks grow with the rows, sides do not
    got = {}
    for r in knn.nearest(df.drop("label"), df, k, chunk=32, self_join=True).collect():
        got.setdefault(r.key, {})[r["rank"]] = (r.other, r.label, r.dist)
    label = {m: f"l{i % 3}" if i % 5 else None for i, m in enumerate(name)}
    for i in range(0, n, 37):
        own = [j for j in range(n) if fold[j] == fold[i] and j != i]
        d = {j: np.sqrt(((x[i] - x[j]) ** 2).sum()) for j in own}
        want = sorted(own, key=lambda j: (d[j], name[j]))[:k]
        assert got[name[i]] == {r + 1: (name[j], label[name[j]], d[j]) for r, j in enumerate(want)}


def test_padded_graph_of_few_rows(spark):
    df = spark.createDataFrame([(i, "b", [float(i), 0.0]) for i in range(3)], "key long, batch string, x array<double>")
    got = sorted((r.key, r["rank"], r.other, r.dist) for r in knn.padded_graph(df, 4).collect())
    inf = float("inf")
    assert got[:5] == [(0, 0, 0, 0.0), (0, 1, 1, 1.0), (0, 2, 2, 2.0), (0, 3, 0, inf), (0, 4, 0, inf)] and len(got) == 15


def test_metrics(spark):
    pred = spark.createDataFrame([("A", "A"), ("A", "B"), ("B", "B"), ("C", "B")], "y_true string, y_pred string").withColumn("g", F.lit(1))
    m = probes.macro_metrics(probes.class_metrics(probes.class_counts(probes.confusion(pred, ["g"]), ["g"])), ["g"]).first()
    assert (m.n_classes_scored, m.accuracy, m.n_test) == (3, 0.5, 4)
    assert m.f1_score == pytest.approx((2 / 3 + 0.5 + 0) / 3)


def test_bootstrap_needs_two_donors(spark):
    pred = spark.createDataFrame([("t", "d1", "s", "A", "A"), ("t", "d1", "s", "B", "A")], "tissue string, donor string, sample_id string, y_true string, y_pred string")
    rows = bootstrap.bootstrap_rows(pred, 20).collect()
    assert rows and all(r.ci_lo is None for r in rows)
    two = pred.unionByName(pred.withColumn("donor", F.lit("d2")))
    assert all(r.ci_lo is not None for r in bootstrap.bootstrap_rows(two, 20).collect())


def test_linear_algebra_against_numpy(spark):
    x, df = vectors(spark)
    c = x - x.mean(axis=0)
    s = np.linalg.svd(c, compute_uv=False) ** 2
    assert linalg.effective_rank(df, "z") == pytest.approx(linalg.entropy_rank(s))
    p = linalg.PCA(2).fit(df, "z")
    z = np.array([r.z for r in p.transform(df.withColumnRenamed("z", "v"), "v").orderBy("key").collect()])
    u, sv, vt = np.linalg.svd(c, full_matrices=False)
    assert np.abs(z) == pytest.approx(np.abs(c @ vt[:2].T))
    m = linalg.moments_of(df, "z", "y")
    y = np.array([r.y for r in df.orderBy("key").collect()])
    assert linalg.ridge(m, 2.0) == pytest.approx(np.linalg.solve(x.T @ x + 2 * np.eye(4), x.T @ y))
    w, chosen = linalg.ridge_gcv(m, np.array([0.1, 10.0, 1000.0]))
    for t in range(2):
        scores = []
        for a in (0.1, 10.0, 1000.0):
            h = x @ np.linalg.solve(x.T @ x + a * np.eye(4), x.T)
            scores.append(((y[:, t] - h @ y[:, t]) ** 2).mean() / (1 - np.trace(h) / len(x)) ** 2)
        assert chosen[t] == (0.1, 10.0, 1000.0)[int(np.argmin(scores))]
    r, wx, wy = linalg.cca(m, 1e-9)
    assert r[:2] == pytest.approx(np.abs([np.corrcoef(c @ wx[:, k], (y - y.mean(0)) @ wy[:, k])[0, 1] for k in range(2)]), abs=1e-6)


def test_controls_take_one_worker_a_task(spark, monkeypatch):
    """The ranks are those of the controls made one by one; no pass embeds rows in a worker before it sums them in another."""
    x, df = vectors(spark)
    df = df.select("key", F.when(F.col("key") != 3, F.col("z")).alias("z"))  # a row without a vector
    made = {"gaussian": diagnostics.gaussian(df, "z", "key"), "shuffled": diagnostics.shuffled_columns(df, "z", "key"), "pca2": models.pca_embedding(df, "z", 2, out="z")}
    want = {k: linalg.effective_rank(v, "z") for k, v in made.items()}
    passes, sums = [], linalg.cross_moments
    monkeypatch.setattr(linalg, "cross_moments", lambda frame, *rest: passes.append(frame) or sums(frame, *rest))
    got = {r.variant: r.eff_rank for r in diagnostics.control_ranks(df, "z", "key", 2).collect()}
    assert got == pytest.approx(want)
    assert len(passes) == 2 and not any("EvalPython" in p._jdf.queryExecution().executedPlan().toString() for p in passes)


def test_variance_and_cosine(spark):
    x, df = vectors(spark)
    r = diagnostics.variance_split(df, "z", "sample_id").first()
    means = np.array([x[k::3].mean(axis=0) for k in range(3)])
    assert r.total_ss == pytest.approx(((x - x.mean(0)) ** 2).sum())
    assert r.between_ss == pytest.approx(sum(20 * ((m - x.mean(0)) ** 2).sum() for m in means))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    g = u @ u.T
    assert diagnostics.mean_pairwise_cosine(df, "z").first().mean_pairwise_cosine == pytest.approx((g.sum() - np.trace(g)) / (60 * 59))


def test_counts(spark):
    rng = np.random.default_rng(8)
    table = {f"t{s}": rng.poisson(3, size=(7, 6)) for s in range(3)}
    table["t1"][:, 2] = 0  # g2 is silent on one slide
    table["t0"][:, 3] = [1, 0, 0, 0, 0, 0, 0]
    table["t1"][:, 3] = table["t2"][:, 3] = 0  # g3 occurs once in all
    rows = [(s, i, f"g{g}", float(m[i, g])) for s, m in table.items() for i in range(7) for g in range(6) if not (s == "t2" and g == 5)]  # g5 is unknown to t2
    df = spark.createDataFrame(rows, "sample_id string, spot long, gene string, count double")
    seen = sum((m > 0).sum(axis=0) for m in table.values())
    vocabulary = counts.vocabulary(df, 2)
    assert sorted(r.gene for r in vocabulary.collect()) == [f"g{g}" for g in range(5) if seen[g] >= 2]
    x = counts.expression(spark.createDataFrame([("t0", 4), ("t9", 4)], "sample_id string, spot long"), df, vocabulary).orderBy("sample_id").collect()
    whole = table["t0"][4].sum()  # the library counts genes that the vocabulary lacks
    assert x[0].found and x[0].genes["g0"] == pytest.approx(np.log1p(table["t0"][4, 0] / whole * 1e4)) and not x[1].found and x[1].genes is None
    loud = [g for g in range(6) if all(m[:, g].any() for s, m in table.items() if not (s == "t2" and g == 5))]
    assert {r.gene for r in counts.nonzero_everywhere(df, "sample_id").select("gene").distinct().collect()} == {f"g{g}" for g in loud} - {"g5"}


def test_correction_moves_batches_together(spark):
    _, df = vectors(spark, 90)
    off = df.withColumn("z", F.when(F.col("sample_id") == "s1", F.transform("z", lambda v: v + 5)).otherwise(F.col("z")))
    before = diagnostics.variance_split(off, "z", "sample_id").first().between_fraction
    for done in (correction.combat(off, "sample_id", "z", "w"), correction.harmony(off, "key", "sample_id", "z", clusters=3, rounds=3, theta=1.0, out="w")):
        assert diagnostics.variance_split(done, "w", "sample_id").first().between_fraction < before / 2


def test_integration_helpers(spark):
    assert integration.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert integration.chi_square_tail(18.307038053275146, 10) == pytest.approx(0.05)
    assert integration.graph_plan({"a": 50, "b": 3, "c": 10}, 15, 5) == (9, ["a", "c"])
    same = spark.createDataFrame([("x", "p", 5), ("y", "q", 7)], "a string, b string, n long")
    r = integration.contingency_scores(same).first()
    assert (r.nmi, r.ari) == (pytest.approx(1), pytest.approx(1))


def test_results_refuse_conflicts(spark):
    rows = [("a.csv", "m", "f1_score", 0.5), ("b.csv", "m", "f1_score", 0.6)]
    df = results.score_frame(spark.createDataFrame(rows, "source string, model string, metric string, value double"))
    assert tuple(df.columns) == results.SCHEMA
    with pytest.raises(results.Refused):
        results.refuse_conflicts(df)
    assert results.refuse_conflicts(df, tolerance=0.2).count() == 2
    assert "toprule" in tables.latex(df.select("model", "value"))


def test_models(spark):
    _, df = vectors(spark, 200)
    net = models.Autoencoder(latent=3, hidden=16, epochs=8).fit(df, "z", "y", "key")
    assert net.history[-1] < net.history[0] and net.transform(df, "z", "key").count() == 200
    m = models.transform_patches(df, "within_sample", "y", "sample_id", "key")
    a = sorted(map(str, (r.y for r in m.where("sample_id = 's1'").collect())))
    assert a == sorted(map(str, (r.y for r in df.where("sample_id = 's1'").collect())))


def test_sources(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"datasets": [{"name": "d1", "tissue": "skin", "donor_pattern": "^(.)", "subdir": "x", "samples": [{"id": "A-1-1", "split": "test"}, {"id": "B", "split": "train", "donor_pattern": "^(B)"}]}]}))
    got = sources.read_registry(spark, str(tmp_path / "r.json")).orderBy("sample_id").collect()
    assert [(r.sample_id, r.donor_pattern, r.split) for r in got] == [("A-1-1", "^(.)", "test"), ("B", "^(B)", "train")]
    f = spark.createDataFrame([("d", "s", "b1", [1.0, 2.0]), ("d", "s", "b2", [3.0, 4.0])], "dataset_id string, sample_id string, spot_id string, v array<double>")
    sources.write_features(f, str(tmp_path / "f"), 2)
    assert sorted((r.spot_id, r.v) for r in sources.read_features(spark, str(tmp_path / "f")).collect()) == [("b1", [1.0, 2.0]), ("b2", [3.0, 4.0])]
    assert sources.read_optional(spark, str(tmp_path / "none"), "a int").count() == 0
    with pytest.raises(FileNotFoundError):
        sources.write_manifest(str(tmp_path / "m.json"), "m", [("d", "s", str(tmp_path / "gone"))])
    assert sources.frame_digest(f) == sources.frame_digest(f.orderBy(F.desc("spot_id")))


def test_r2_streams_like_the_batch(spark, tmp_path):
    df = spark.createDataFrame([("g", float(i), float(i) + (i % 2)) for i in range(20)], "gene string, truth double, guess double")
    df.repartition(3).write.parquet(str(tmp_path / "p"))
    r2.run_to_memory(r2.r2_stream(spark, str(tmp_path / "p"), "gene string, truth double, guess double", ["gene"]), "r2_now")
    assert spark.table("r2_now").first().r2 == pytest.approx(biosignal.r2_by_target(df, ["gene"], "truth", "guess").first().r2)
