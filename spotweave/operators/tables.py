"""Report tables over result frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotweave.functions.keys import ratio


def headline(results: DataFrame) -> DataFrame:
    """Seed mean, sample deviation and count of the pooled macro F1 by model, protocol and scope."""
    return results.groupBy("model", "protocol", "scope").agg(F.avg("f1_score").alias("mean"), F.stddev_samp("f1_score").alias("sd"), F.count("f1_score").alias("n"))


def annotation_table(results: DataFrame, intervals: DataFrame) -> DataFrame:
    """By model: seed mean and population deviation of the pooled row, spread over folds, mean interval."""
    pool, fold = F.col("fold").isNull(), F.col("fold").isNotNull()
    f = F.col("f1_score")
    x = results.groupBy("model", "scope").agg(F.avg(F.when(pool, f)).alias("mean"), F.stddev_pop(F.when(pool, f)).alias("sd"), F.avg(F.when(fold, f)).alias("fold_mean"), F.min(F.when(fold, f)).alias("fold_min"), F.max(F.when(fold, f)).alias("fold_max"))
    ci = intervals.where("class = 'macro'").groupBy("model", "scope").agg(F.avg("ci_lo").alias("ci_lo"), F.avg("ci_hi").alias("ci_hi"))
    return x.join(ci, ["model", "scope"], "left")


def per_organ(results: DataFrame, scopes: list[str]) -> DataFrame:
    """Models by organ: mean F1 and the largest number of donors behind it."""
    x = results.groupBy("model").pivot("scope", scopes).agg(F.avg("f1_score").alias("f1"), F.max("n_donors").alias("donors"))
    return x


def delta_table(deltas: DataFrame) -> DataFrame:
    """By model and scope: mean delta, interval and the largest p."""
    return deltas.groupBy("model", "scope").agg(F.avg("delta").alias("delta"), F.avg("ci_lo").alias("ci_lo"), F.avg("ci_hi").alias("ci_hi"), F.max("p_two_sided").alias("p_two_sided"))


def by_condition(df: DataFrame, conditions: list[str]) -> DataFrame:
    """Conditions as columns of the mean F1 of every class."""
    return df.groupBy("scope", "class").pivot("condition", conditions).agg(F.avg("f1_score"))


def micro_pooled(per_class: DataFrame, keys: list[str]) -> DataFrame:
    """Exact pooling of F1 over scopes from precision, recall and support: counts per seed, then their mean."""
    s, r, p = F.col("support"), F.col("recall"), F.col("precision")
    tp = r * s
    x = per_class.withColumn("_tp", tp).withColumn("_fn", s - tp).withColumn("_fp", F.when(p > 0, tp / p - tp).otherwise(0.0))
    x = x.groupBy(*keys, "seed", "class").agg(F.sum("_tp").alias("tp"), F.sum("_fn").alias("fn"), F.sum("_fp").alias("fp"))
    x = x.withColumn("f", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fn") + F.col("fp")))
    return x.groupBy(*keys, "class").agg(F.avg("f").alias("f1_score"), F.count(F.lit(1)).alias("n_seeds"))


def preferred(frame: DataFrame, names: list[str], by: str) -> DataFrame:
    """The pooled column where the group has any pooled value, else the per-seed one."""
    w = Window.partitionBy(by)
    out = frame
    for n in names:
        any_pooled = F.bool_or(F.col(f"{n}_pooled").isNotNull()).over(w)
        out = out.withColumn(n, F.when(any_pooled, F.col(f"{n}_pooled")).otherwise(F.col(n)))
    return out


def seed_collapse(wide: DataFrame, numbers: list[str], texts: list[str]) -> DataFrame:
    """One row per method over its seeds: mean of numbers, first text in seed order."""
    return wide.groupBy("method").agg(*[F.avg(n).alias(n) for n in numbers], *[F.min_by(t, "seed").alias(t) for t in texts])


def integration_table(wide: DataFrame, deltas: DataFrame, numbers: list[str]) -> DataFrame:
    """Collapsed panel with each method's mean paired delta."""
    d = deltas.groupBy("method").agg(F.avg("delta_f1").alias("delta_f1"), F.max("p_two_sided").alias("p_two_sided"))
    return seed_collapse(wide, numbers, []).join(d, "method", "left")


def model_order(df: DataFrame, order: list[str], column: str = "model") -> DataFrame:
    """Listed models first in their order, the others after them by name."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.when(at > 0, at).otherwise(F.lit(99)), column)))


def organ_donors(results: DataFrame) -> DataFrame:
    """Largest number of donors of every organ scope."""
    return results.where("scope <> 'global'").groupBy("scope").agg(F.max("n_donors").alias("n_donors"))


def set_counts(table: DataFrame, fdr: float = 0.05) -> DataFrame:
    """How many sets are tested and significant, and how many of these go up."""
    s = F.col("padj") < fdr
    return table.agg(F.count(F.lit(1)).alias("n_sets"), F.count_if(s).alias("n_significant"), F.count_if(s & (F.col("mean_delta") > 0)).alias("n_up"))


def latex_escaped(c: Column) -> Column:
    """Characters that LaTeX reads, escaped."""
    return F.regexp_replace(c, r"([&%$#_{}])", r"\\$1")


def latex(df: DataFrame, most: int = 10_000) -> str:
    """A small frame as the body of a LaTeX tabular."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for a printed table")
    cell = lambda v: "--" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")
    lines = [" & ".join(cell(c) for c in df.columns) + r" \\", r"\midrule", *[" & ".join(cell(v) for v in r) + r" \\" for r in rows]]
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", r"\toprule", *lines, r"\bottomrule", r"\end{tabular}"])
