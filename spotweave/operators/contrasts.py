"""Rankings for enrichment: contrasts of per-target R2, their detrended reading, matched strata, and what is drawn of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotweave.operators import biosignal
from spotweave.operators.ranking import global_rank
from spotweave.operators.results import refuse

# Each contrast is the first column less the second.
CONTRASTS = {
    "guided_vs_frozen": ("r2_refined", "r2_frozen"),
    "capacity_vs_frozen": ("r2_pca_control", "r2_frozen"),
    "guided_vs_capacity": ("r2_refined", "r2_pca_control"),
}


def rankings(df: DataFrame, names: list[str], bins: int = 0, key: str = "target") -> DataFrame:
    """(contrast, detrended, target, value) of the contrasts whose columns there are; an unknown one is refused.

    Targets that lack a column of the contrast or r2_frozen are left out. With two bins or more each contrast
    is there once more, less the mean of its stratum of r2_frozen.
    """
    unknown = sorted(set(names) - set(CONTRASTS))
    if unknown:
        refuse(f"contrasts {unknown}", "no such difference is defined", f"any of {sorted(CONTRASTS)}")
    out = None
    for name in names:
        high, low = CONTRASTS[name]
        if not {high, low} <= set(df.columns):
            continue
        used = [F.col(c) for c in dict.fromkeys((high, low, "r2_frozen"))]
        some = df.where(F.array_max(F.array(*[(c.isNull() | F.isnan(c)).cast("int") for c in used])) == 0)
        x = some.select(F.lit(name).alias("contrast"), F.lit(False).alias("detrended"), F.col(key).cast("string").alias("target"), (F.col(high) - F.col(low)).alias("value"), F.col("r2_frozen").alias("_base"))
        if bins >= 2:
            flat = biosignal.detrended(x, "_base", "value", "target", bins).withColumn("value", F.col("detrended")).withColumn("detrended", F.lit(True))
            x = x.unionByName(flat.select(*x.columns))
        out = x if out is None else out.unionByName(x)
    if out is None:
        return df.sparkSession.createDataFrame([], "contrast string, detrended boolean, target string, value double")
    return out.drop("_base")


def matched_strata(statistic: DataFrame, baseline: DataFrame, bins: int) -> DataFrame:
    """The statistic (target, value) with the stratum of its baseline (target, baseline); null for all if one target has no baseline."""
    x = statistic.join(baseline.select("target", "baseline"), "target", "left")
    short = x.agg(F.bool_or(F.col("baseline").isNull() | F.isnan("baseline")).alias("_short"))
    ranked = biosignal.strata(x, "baseline", "target", bins).join(F.broadcast(short))  # one row
    return ranked.withColumn("stratum", F.when(~F.col("_short"), F.col("stratum"))).drop("_short")


def enrichment_order(table: DataFrame, ties: str = "source") -> DataFrame:
    """The table with its rank by adjusted p, p and normalised score, missing values last."""
    last = [F.when(F.isnan(c), F.lit(None)).otherwise(F.col(c)).asc_nulls_last() for c in ("padj", "pval", "norm")]
    return global_rank(table, [*last, ties])[0].withColumn("rank", F.col("rank").cast("int"))


def levels_to_draw(scored: DataFrame, wanted: list[str]) -> DataFrame:
    """(level, place): the wanted levels that were scored, in the order wanted; with none wanted all, by name."""
    x = scored.select("level").distinct()
    if not wanted:
        return x.withColumn("place", F.row_number().over(Window.orderBy("level")))
    place = F.array_position(F.array(*map(F.lit, wanted)), F.col("level"))
    kept = x.where(F.col("level").isin(*wanted)).withColumn("_p", place)
    return kept.withColumn("place", F.row_number().over(Window.orderBy("_p"))).drop("_p")
