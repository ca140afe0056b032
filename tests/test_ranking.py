"""Ranks over ranges against sorting, and plans without a task that holds all rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotweave.operators import biosignal, contrasts, expression, ranking, sampling


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def rows(spark):
    rng = random.Random(3)
    data = [(i, rng.choice([None, "a", "b", "c"]), rng.choice([0.5, 0.25, rng.random(), None])) for i in range(500)]
    return data, spark.createDataFrame(data, "k long, g string, v double").repartition(7)


def least_first(data):
    return sorted(data, key=lambda r: (r[2] is not None, r[2] or 0, r[0]))  # Spark has nulls first


def test_global_rank(rows):
    data, df = rows
    got, n = ranking.global_rank(df, ["v", "k"])
    assert n == 500 and {r.k: r["rank"] for r in got.collect()} == {r[0]: i + 1 for i, r in enumerate(least_first(data))}
    assert "SinglePartition" not in plan(got)


def test_rank_within_groups(rows):
    data, df = rows
    got = {r.k: (r["rank"], r._n) for r in ranking.rank_within(df, ["g"], ["v", "k"]).collect()}
    for g in (None, "a", "b", "c"):
        own = least_first([r for r in data if r[1] == g])
        assert all(got[r[0]] == (i + 1, len(own)) for i, r in enumerate(own))


@pytest.mark.parametrize("by", [[], ["g"]])
def test_adjusted_p_values(rows, by):
    data, df = rows
    got = {r.k: r.padj for r in biosignal.benjamini_hochberg(df, "v", by).collect()}
    assert len(got) == 500
    for g in {r[1] if by else 0 for r in data}:
        own = sorted([(r[2], r[0]) for r in data if r[2] is not None and (not by or r[1] == g)])
        p = np.array([x[0] for x in own])
        want = np.minimum(1, np.minimum.accumulate((p * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1])
        assert [got[k] for _, k in own] == pytest.approx(want.tolist())
    assert all(got[r[0]] is None for r in data if r[2] is None)
    assert "SinglePartition" not in plan(biosignal.benjamini_hochberg(df, "v", by))


@pytest.mark.parametrize("n,bins", [(23, 5), (20, 4), (7, 7), (6, 7), (9, 1)])
def test_strata_are_those_of_ntile(spark, n, bins):
    from pyspark.sql import Window

    df = spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 3).cast("double").alias("b"))
    got = {r.k: r.stratum for r in biosignal.strata(df, "b", "k", bins).collect()}
    want = {r.k: r.t - 1 if 2 <= bins <= n else None for r in df.withColumn("t", F.ntile(bins).over(Window.orderBy("b", "k"))).collect()}
    assert got == want


def test_no_window_over_all_rows(spark):
    df = spark.range(100).select(F.col("id").alias("k"), F.rand(1).alias("v"), F.rand(2).alias("b"))
    s, base = df.select(F.col("k").alias("target"), F.col("v").alias("value")), df.select(F.col("k").alias("target"), F.col("b").alias("baseline"))
    made = [
        biosignal.detrended(df, "b", "v", "k", 4), expression.at_places(df, ["v"], spark.range(3).select(F.col("id").alias("place"))), expression.every_nth(df, ["v"], 7), sampling.permuted(df, "k", "v", []),
        sampling.train_validation(df, "k", 0.1), contrasts.enrichment_order(df.select(F.col("k").alias("source"), F.col("v").alias("padj"), F.col("b").alias("pval"), F.col("v").alias("norm"))),
    ]
    for x in made:
        assert "Window" not in plan(x)
    assert "Window" not in plan(contrasts.matched_strata(s, base, 4))


def test_every_nth(rows):
    data, df = rows
    order = least_first(data)
    got = sorted((r.place, r.k) for r in expression.every_nth(df, ["v", "k"], 40, 3).collect())
    assert got == [(i, order[i][0]) for i in range(3, 500, 40)]


def test_shuffles_stay_in_their_groups(rows):
    data, df = rows
    got = sampling.permuted(df.withColumn("w", F.col("k")), "k", "w", ["g"]).collect()
    group = {r[0]: r[1] for r in data}
    assert sorted(r.w for r in got) == list(range(500)) and all(group[r.w] == r.g for r in got) and sum(r.w != r.k for r in got) > 400


def test_empty_and_tiny_tables(spark):
    none = spark.createDataFrame([], "k long, v double")
    got, n = ranking.global_rank(none, ["v"])
    assert n == 0 and got.count() == 0
    assert biosignal.benjamini_hochberg(none, "v").count() == 0 and biosignal.strata(none, "v", "k", 3).count() == 0
    one = spark.createDataFrame([(1, 0.3)], "k long, v double")
    assert biosignal.benjamini_hochberg(one, "v").first().padj == 0.3
    same = spark.createDataFrame([(1, 0.3)] * 50, "k long, v double")
    assert {r.padj for r in biosignal.benjamini_hochberg(same, "v").collect()} == {0.3}
