"""Ranks over whole tables, without a task that holds the whole table.

Rows are dealt in ranges of the order by Spark's sampled range partitioning and sorted inside
them; a row's rank is its place in its range plus the rows of the ranges before. Only a count for each
range reaches the driver. Ranks inside groups come from the same ranks with the group first in the
order, so a group of any size spreads over ranges too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotweave.functions.lineage import cut

#: Places inside a range stand in the lower bits of Spark's increasing ids.
_PLACE_BITS = 33


def in_ranges(df: DataFrame, order: list) -> DataFrame:
    """The rows, written once, with the range (_range) and the place in it (_at, from 0) of a total order."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    return cut(dealt.withColumn("_range", F.shiftright(place, _PLACE_BITS).cast("int")).withColumn("_at", place.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))))


def _offsets(dealt: DataFrame) -> tuple[DataFrame, int]:
    """(_range, _before): the rows before each range, and the rows of all."""
    sizes = {r["_range"]: r["count"] for r in dealt.groupBy("_range").count().collect()}  # a row per range
    rows, before = [], 0
    for k in sorted(sizes):
        rows.append((k, before))
        before += sizes[k]
    return dealt.sparkSession.createDataFrame(rows, "_range int, _before long"), before


def global_rank(df: DataFrame, order: list, out: str = "rank", keep: bool = False) -> tuple[DataFrame, int]:
    """The rows with their rank (long, from 1) in a total order, and how many rows there are.

    Ties of the order get different ranks in no stated order. With keep the columns _range and _at stay.
    """
    dealt = in_ranges(df, order)
    before, total = _offsets(dealt)
    ranked = dealt.join(F.broadcast(before), "_range").withColumn(out, F.col("_before") + F.col("_at") + 1).drop("_before")  # a row per range
    return (ranked if keep else ranked.drop("_range", "_at")), total


def rank_within(df: DataFrame, by: list[str], order: list, out: str = "rank") -> DataFrame:
    """The rows with their rank (from 1) inside the group `by`, and the group's rows as _n."""
    if not by:
        ranked, total = global_rank(df, order, out)
        return ranked.withColumn("_n", F.lit(total).cast("long"))
    ranked, _ = global_rank(df, [*by, *order], "_g")
    groups = ranked.groupBy(*by).agg(F.min("_g").alias("_first"), F.count(F.lit(1)).alias("_n"))
    same = [F.col(f"_by{i}").eqNullSafe(F.col(c)) for i, c in enumerate(by)]
    groups = groups.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], "_first", "_n")
    out_rows = ranked.join(groups, same).withColumn(out, F.col("_g") - F.col("_first") + 1)
    return out_rows.drop("_g", "_first", *[f"_by{i}" for i in range(len(by))])


def suffix_minimum(ranked: DataFrame, value: str, by: list[str] = (), out: str = "_least") -> DataFrame:
    """For rows with _range and _at: the least value among the row and those after it, of its own group.

    Inside a range by a window over (group, range); across ranges by the least value of every group and range.
    """
    by = list(by)
    own = Window.partitionBy(*by, "_range").orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0)
    local = ranked.withColumn("_own", F.min(value).over(own))
    least = ranked.groupBy(*by, "_range").agg(F.min(value).alias("_m"))
    if by:
        later = Window.partitionBy(*by).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
        rest = least.withColumn("_later", F.min("_m").over(later)).drop("_m")
        return local.join(rest, [*by, "_range"]).withColumn(out, F.least("_own", "_later")).drop("_own", "_later")
    rows, now = [], None
    for r in sorted(least.collect(), key=lambda r: -r["_range"]):  # a row per range
        rows.append((r["_range"], now))
        now = r["_m"] if now is None else min(now, r["_m"])
    rest = ranked.sparkSession.createDataFrame(rows, f"_range int, _later {ranked.schema[value].dataType.simpleString()}")
    return local.join(F.broadcast(rest), "_range").withColumn(out, F.least("_own", "_later")).drop("_own", "_later")


def equal_parts(rank, total, parts: int):
    """The part (from 0) of a rank when `total` rows are cut in `parts` whose sizes differ by one at most, the larger ones first."""
    total = total if not isinstance(total, int) else F.lit(total)
    size, rest, at = F.floor(total / parts), total % parts, rank - 1
    wide = rest * (size + 1)
    return F.when(at < wide, F.floor(at / (size + 1))).otherwise(rest + F.floor((at - wide) / F.greatest(size, F.lit(1)))).cast("int")
