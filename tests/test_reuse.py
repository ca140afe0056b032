"""Stored results, corrected arms and the panel of one graph."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotweave.functions.lineage import shared_dir
from spotweave.operators import arms, correction, integration, knn, reuse
from spotweave.operators.results import Refused


@pytest.fixture
def store(spark, tmp_path):
    return reuse.ResultStore(spark, f"file://{tmp_path}/results")


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(i, f"g{i % 3}", [float(i), -1.0]) for i in range(40)] + [(7, "g1", [7.0, -1.0])], "key long, g string, v array<double>")


def test_fingerprints(spark, rows):
    own = reuse.fingerprint(rows)
    assert own == reuse.fingerprint(rows.repartition(5).orderBy(F.desc("key"))) == reuse.fingerprint(rows.select("v", "key", "g"))
    assert len({own, reuse.fingerprint(rows.distinct()), reuse.fingerprint(rows.withColumn("key", F.col("key").cast("int"))), reuse.fingerprint(rows.where("key <> 3")), reuse.fingerprint(rows.withColumnRenamed("g", "h"))}) == 5
    assert reuse.fingerprint(rows, ["key"]) == reuse.fingerprint(rows.drop("v", "g"))
    assert reuse.fingerprint(rows.where("false")) != own


def test_a_result_is_made_once(store, rows):
    made = []

    def make():
        made.append(1)
        return rows.groupBy("g").count()

    one, old = store.reuse("counts", {"by": "g"}, "f1", make)
    two, again = store.reuse("counts", {"by": "g"}, "f1", make)
    assert (old, again, len(made)) == (False, True, 1) and sorted(one.collect()) == sorted(two.collect()) == sorted(rows.groupBy("g").count().collect())
    store.reuse("counts", {"by": "g"}, "f2", make)
    store.reuse("counts", {"by": "other"}, "f1", make)
    assert len(made) == 3 and sorted(store.require("counts", {"by": "g"}, "f1").collect()) == sorted(one.collect())


def test_what_was_made_of_other_rows_is_refused(store, rows):
    with pytest.raises(Refused, match="nothing is stored"):
        store.require("panel", {"seed": 1}, "f1")
    store.put("panel", {"seed": 1}, "f1", rows)
    with pytest.raises(Refused, match="none was made with"):
        store.require("panel", {"seed": 2}, "f1")
    with pytest.raises(Refused, match="made of .'f1'., and these rows are f2"):
        store.require("panel", {"seed": 1}, "f2")
    store.put("panel", {"seed": 3}, None, rows)
    with pytest.raises(Refused, match="does not record"):
        store.require("panel", {"seed": 3}, "f1")
    assert store.require("panel", {"seed": 1}, "f1").count() == 41


def test_a_second_writer_leaves_the_entry(store, rows, tmp_path):
    store.put("x", {}, "f", rows)
    again = store.put("x", {}, "f", rows.where("false"))
    assert again.count() == 41 and not [p for p in (tmp_path / "results").rglob("*") if "aside" in p.name]


def test_differing_rows(rows, spark):
    other = rows.where("key <> 5").withColumn("g", F.when(F.col("key") == 9, "zz").otherwise(F.col("g")))
    assert sorted(r.key for r in reuse.differing_rows(rows.dropDuplicates(["key"]), other.dropDuplicates(["key"]), ["key"]).collect()) == [5, 9]


def test_arm_names():
    assert [arms.arm(n) for n in ("harmony_ae", "combat_pca", "pca", "hvg_pca", "pca_oracle", "harmony_", "combat_harmony_ae")] == [("harmony", "ae"), ("combat", "pca"), None, None, None, None, ("combat", "harmony_ae")]
    assert [arms.arm_reference(n) for n in ("harmony_ae", "harmony_pca", "ae")] == ["harmony_pca", None, None]
    arms.check_arms(["pca", "harmony_ae", "hvg_pca"])
    for bad in ("harmony_hvg_pca", "combat_pca_oracle", "combat_harmony_ae"):
        with pytest.raises(Refused):
            arms.check_arms([bad])


def cohort(spark, n=120, d=6):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, d)) + (np.arange(n) % 3)[:, None] * 2
    return x, spark.createDataFrame([(i, f"s{i % 3}", i < 80, f"l{i % 4}", [float(v) for v in r], [float(i)]) for i, r in enumerate(x)], "key long, slide string, fit boolean, label string, gene array<double>, patch array<double>")


def test_the_block_is_replaced_and_nothing_else(spark, store):
    x, df = cohort(spark)
    got, model, method = arms.resolved(df, "combat_ae", "key", "gene", "slide", F.col("fit"), store=store)
    assert (model, method, got.columns) == ("ae", "combat", df.columns)
    assert sorted(got.drop("gene").collect()) == sorted(df.drop("gene").collect())
    want = {r.key: r.z for r in correction.combat(df, "slide", "gene").collect()}
    assert all(r.gene == pytest.approx(want[r.key]) for r in got.collect())
    plain, model, method = arms.resolved(df, "pca", "key", "gene", "slide", F.col("fit"))
    assert plain is df and (model, method) == ("pca", "none")


def test_components_are_of_fit_rows(spark):
    x, df = cohort(spark)
    got = arms.corrected_block(df, "combat", "key", "gene", "slide", F.col("fit"), components=3)
    fit = x[:80] - x[:80].mean(axis=0)
    _, _, vt = np.linalg.svd(fit, full_matrices=False)
    v = vt[:3].T * np.sign(vt[:3].T[np.abs(vt[:3]).argmax(axis=1), np.arange(3)])
    z = (x - x[:80].mean(axis=0)) @ v
    frame = spark.createDataFrame([(i, f"s{i % 3}", [float(a) for a in r]) for i, r in enumerate(z)], "key long, slide string, v array<double>")
    want = {r.key: r.z for r in correction.combat(frame, "slide", "v").collect()}
    assert all(len(r.gene) == 3 and r.gene == pytest.approx(want[r.key]) for r in got.collect())
    again = arms.FitRowsPCA.of(arms.FitRowsPCA(3, F.col("fit")).fit(df, "gene").state()).apply(df, "gene", "z")
    assert np.array([r.z for r in again.orderBy("key").collect()]) == pytest.approx(z)


def test_a_stored_block_is_taken_for_the_same_rows_only(spark, store, monkeypatch):
    _, df = cohort(spark)
    calls = []
    own = correction.combat
    monkeypatch.setattr(arms.correction, "combat", lambda *a: calls.append(1) or own(*a))
    one = arms.corrected_block(df, "combat", "key", "gene", "slide", F.col("fit"), store=store)
    two = arms.corrected_block(df.repartition(4), "combat", "key", "gene", "slide", F.col("fit"), store=store, seed=7)  # it has no seed
    assert sorted(one.collect()) == sorted(two.collect()) and len(calls) == 1
    arms.corrected_block(df.where("key > 2"), "combat", "key", "gene", "slide", F.col("fit"), store=store)
    assert len(calls) == 2
    with pytest.raises(Refused):
        arms.corrected_block(df, "scvi", "key", "gene", "slide", F.col("fit"))


def test_one_graph_many_sizes(spark):
    x, df = cohort(spark)
    rows = df.select("key", F.col("slide").alias("batch"), "label", F.col("gene").alias("x"))
    graph = knn.padded_graph(rows.select("key", "batch", "x"), 89)
    got = {r.metric: r.score for r in integration.graph_panel(graph, rows).collect()}
    order = np.argsort(((x[:, None] - x[None]) ** 2).sum(axis=2), axis=1, kind="stable")
    near = [[j for j in row.tolist() if j != i][:14] for i, row in enumerate(order)]
    share = []
    for lab in range(4):
        own = [i for i in range(120) if i % 4 == lab]
        part = {i: i for i in own}
        for _ in own:
            for i in own:
                for j in near[i]:
                    if j % 4 == lab:
                        part[i] = part[j] = min(part[i], part[j])
        share.append(max(list(part.values()).count(p) for p in part.values()) / len(own))
    assert got["graph_connectivity"] == pytest.approx(np.mean(share)) and set(got) == set(integration.GRAPH_SIZES)
    direct = integration.scaled_lisi(integration.lisi(integration.graph_at(graph, 90), rows.select("key", F.col("batch").alias("label")), 30), 3, True).first()[0]
    assert got["ilisi"] == pytest.approx(direct)
    with pytest.raises(Refused, match="15 neighbours"):
        integration.graph_panel(graph.where("rank < 15"), rows)
    with pytest.raises(Refused, match="same rows"):
        integration.graph_panel(graph, rows.where("key > 0"))


def test_ten_metrics(spark):
    _, df = cohort(spark)
    done = correction.combat(df, "slide", "gene")
    got = {(r.metric, r.panel): r.score for r in integration.panel(done, "key", "slide", "label", "z", before="gene").collect()}
    assert len(got) == 10 and all(0 <= v <= 1 for (m, _), v in got.items() if m != "kmeans_ari") and {p for _, p in got} == {"batch", "bio"}
    assert got["pcr_comparison", "batch"] > 0.9
    one = integration.panel(done.withColumn("slide", F.lit("s")), "key", "slide", "label", "z")
    assert {r.panel for r in one.where("metric <> 'graph_connectivity'").collect()} == {"bio"}
