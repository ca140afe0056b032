"""Samples of exact size, replayable: the order is an md5 of seed, purpose and key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotweave.functions.keys import digest
from spotweave.operators.ranking import global_rank


def uniform_sample(df: DataFrame, key: str, cap: int, seed: int = 42, purpose: str = "uniform") -> DataFrame:
    """At most `cap` rows without replacement."""
    return df.withColumn("_d", digest(seed, purpose, key)).orderBy("_d", key).limit(cap).drop("_d")


def stratum_quotas(counts: DataFrame, by: str, cap: int, seed: int = 42) -> DataFrame:
    """(by, n) to (by, n, quota): floor shares, then the largest remainders, so the quotas sum to the cap.

    Where all rows fit under the cap, every stratum keeps all. Remainder ties go by digest.
    """
    every = Window.partitionBy()  # one row per stratum
    x = counts.withColumn("total", F.sum("n").over(every))
    exact = F.col("n") * F.lit(cap) / F.col("total")
    x = x.withColumn("share", F.floor(exact)).withColumn("rest", exact - F.floor(exact)).withColumn("_d", digest(seed, "remainder", by))
    x = x.withColumn("short", F.lit(cap) - F.sum("share").over(every))
    x = x.withColumn("r", F.row_number().over(Window.orderBy(F.desc("rest"), "_d")))
    quota = F.when(F.col("total") <= cap, F.col("n")).otherwise(F.col("share") + F.when(F.col("r") <= F.col("short"), 1).otherwise(0))
    return x.select(by, "n", quota.cast("long").alias("quota"))


def stratified_sample(df: DataFrame, key: str, by: str, cap: int, seed: int = 42) -> DataFrame:
    """At most `cap` rows with every stratum of `by` in proportion."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    quota = stratum_quotas(counts, by, cap, seed).select(by, "quota")
    rank = Window.partitionBy(by).orderBy(digest(seed, "stratified", key), key)
    return df.withColumn("_r", F.row_number().over(rank)).join(quota, by).where(F.col("_r") <= F.col("quota")).drop("_r", "quota")


def proportional_cap(df: DataFrame, key: str, by: str, fraction: float, seed: int = 42) -> DataFrame:
    """max(1, round(n * fraction)) rows of every group; halves round to even."""
    n = df.groupBy(by).agg(F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * F.lit(fraction)).cast("long")).alias("quota"))
    rank = Window.partitionBy(by).orderBy(digest(seed, "cap", key), key)
    return df.withColumn("_r", F.row_number().over(rank)).join(n, by).where(F.col("_r") <= F.col("quota")).drop("_r", "quota")


def train_validation(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """Adds `part`: max(2, int(fraction * n)) rows are `val`, the others `train`."""
    ranked, n = global_rank(df.withColumn("_d", digest(seed, "validation", key)), ["_d", key], "_r")
    return ranked.withColumn("part", F.when(F.col("_r") <= max(2, int(fraction * n)), "val").otherwise("train")).drop("_d", "_r")


def permuted(df: DataFrame, key: str, value: str, by: list[str], seed: int = 42, purpose: str = "permute") -> DataFrame:
    """`value` shuffled among the rows of each group; with no groups, among all rows.

    Both orders have the groups first, so rows of equal rank are of one group, and one join on the rank moves the values.
    """
    a, _ = global_rank(df, [*by, key], "_r")
    b, _ = global_rank(df.select(*by, F.col(key).alias("_k"), F.col(value).alias("_v"), digest(seed, purpose, key).alias("_d")), [*by, "_d", "_k"], "_r")
    return a.join(b.select("_r", "_v"), "_r").withColumn(value, F.col("_v")).drop("_r", "_v")


def top_n(df: DataFrame, score: str, key: str, n: int) -> DataFrame:
    """The n highest scores, ties to the smaller key, returned in key order."""
    return df.orderBy(F.desc(score), key).limit(n).orderBy(key)
