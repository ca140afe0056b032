"""Runs that are half done or half broken: pending and refused tables, methods that crash, the driver over representations."""

import os

import pytest
from pyspark.sql import functions as F

from spotweave.operators import attempts, integration
from spotweave.operators.results import Refused
from spotweave.sources.artefacts import Artefacts


@pytest.fixture
def run(spark, tmp_path):
    return Artefacts(spark, f"file://{tmp_path}/run")


def test_a_stage_that_has_not_begun_is_pending(spark, run, tmp_path):
    assert run.read("score", "scores", "the scores") is None
    (tmp_path / "run" / "score").mkdir(parents=True)  # a stage that died on its first line
    assert run.read("score", "scores", "the scores", required=False) is None
    assert [r.what for r in run.pending_table().collect()] == ["the scores"] * 2


def test_what_a_stage_left_out_is_refused_unless_it_may(spark, run):
    run.write(spark.range(3), "score", "scores")
    assert run.read("score", "scores", "the scores").count() == 3 and not run.pending
    with pytest.raises(Refused, match="no deltas"):
        run.read("score", "deltas", "the deltas")
    assert run.read("score", "deltas", "the deltas", required=False) is None and len(run.pending) == 1
    assert Artefacts(spark, run.path).pending_table().count() == 0


def test_a_table_without_rows_is_refused_and_one_is_replaced_whole(spark, run):
    run.write(spark.range(0), "score", "scores")
    for required in (True, False):
        with pytest.raises(Refused, match="no rows"):
            run.read("score", "scores", "the scores", required)
    run.write(spark.range(2).withColumn("x", F.lit(None).cast("string")), "score", "scores")
    assert run.read("score", "scores", "the scores").columns == ["id", "x"]


def test_a_write_that_fails_leaves_the_table_as_it_was(spark, run):
    run.write(spark.range(2), "score", "scores")
    with pytest.raises(Exception, match="broken"):
        run.write(spark.range(5).select(F.raise_error(F.lit("broken")).cast("long").alias("id")), "score", "scores")
    assert run.read("score", "scores", "the scores").count() == 2


def test_a_crash_becomes_a_row_and_the_comparison_is_refused(spark):
    x, kept = spark.range(6).toDF("v"), []

    def dies(batches):
        os._exit(7)
        yield from batches

    methods = {"dies": lambda: x.mapInArrow(dies, "v long"), "plain": lambda: x, "twice": lambda: x.select((F.col("v") * 2).alias("v"))}
    score = lambda df: df.agg(F.sum("v").alias("total"))
    with pytest.raises(Refused, match="dies"):
        attempts.compared(spark, methods, score, lambda rows: kept.extend(rows.collect()))
    rows = {r.method: r for r in kept}
    assert rows["dies"].crash and rows["dies"].total is None
    assert (rows["plain"].total, rows["twice"].total, rows["twice"].crash) == (15, 30, None)
    del methods["dies"]
    assert sorted((r.method, r.total) for r in attempts.compared(spark, methods, score).collect()) == [("plain", 15), ("twice", 30)]
    assert attempts.compared(spark, {}, score).count() == 0


def test_an_ordinary_error_is_no_crash(spark):
    broken = {"broken": lambda: spark.range(2).select(F.raise_error(F.lit("a plain error")).cast("long").alias("v"))}
    with pytest.raises(Exception, match="a plain error"):
        attempts.compared(spark, broken, lambda df: df)

    def missing():
        raise ImportError("no such library")

    with pytest.raises(ImportError):
        attempts.compared(spark, {"missing": missing}, lambda df: df)


def test_representations_are_marked_and_none_is_left_out(spark):
    rows = [(i, [float(i), float(i % 3)], [float(i), float(i % 3)], [0.0, float(i)]) for i in range(12)]
    df = spark.createDataFrame(rows, "key long, a array<double>, b array<double>, c array<double>")
    first = lambda d, c: d.agg(F.sum(F.col(c)[0]).alias("score"))
    got = {r.representation: r for r in attempts.scored_representations(df, "key", {"a": "a", "m (seed 1)": "b", "m (seed 2)": "c"}, first).collect()}
    assert got["a"].embedding == got["m (seed 1)"].embedding != got["m (seed 2)"].embedding
    assert got["a"].n_rows == 12 and got["m (seed 2)"].score == 0
    shuffled = attempts.scored_representations(df.repartition(3).orderBy(F.desc("key")), "key", {"a": "a"}, first).first()
    assert shuffled.embedding == got["a"].embedding

    def score(d, c):
        return first(d, c) if c == "a" else d.select(F.raise_error(F.lit("singular")).alias("score"))

    with pytest.raises(Refused, match=r"m \(seed 2\).*singular"):
        attempts.scored_representations(df, "key", {"a": "a", "m (seed 2)": "c"}, score)
    with pytest.raises(Refused, match="no column"):
        attempts.scored_representations(df, "key", {"d": "d"}, first)
    with pytest.raises(Refused, match="none was named"):
        attempts.scored_representations(df, "key", {}, first)


def test_the_whole_panel_for_two_representations(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(i, f"b{i % 2}", f"l{i % 3}", (rng.normal(size=3) + 6 * (i % 3)).tolist(), rng.normal(size=3).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "key long, batch string, label string, good array<double>, noise array<double>")
    panel = lambda d, c: integration.panel(d, "key", "batch", "label", c)
    got = attempts.scored_representations(df, "key", {"good": "good", "noise": "noise"}, panel).collect()
    score = {(r.representation, r.metric): r.score for r in got}
    assert len(score) == len(got) == 20 and {r.panel for r in got} == {"batch", "bio"}
    for metric in ("silhouette_label", "kmeans_nmi", "kmeans_ari", "clisi"):
        assert score["good", metric] > score["noise", metric]
