"""Connected parts of an edge table, by stars that are redrawn until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.functions.lineage import cut, drop_cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(hi, lo))"), F.expr("sum(cast(xxhash64(lo, hi) as decimal(38, 0)))")).first())


def connected_parts(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """(key, part) for every end of an edge to another key; part is the least key that can be reached.

    Each round hangs all larger neighbours of a key on its least neighbour, then all smaller ones; the number of rounds grows
    with the logarithm of the rows. Neighbours are never gathered: minima are aggregated and joined back. Raises if it does not settle.
    """
    now = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    state = _state(now)
    for _ in range(rounds):
        turned = now.select(F.col("lo").alias("k"), F.col("hi").alias("o")).unionByName(now.select(F.col("hi").alias("k"), F.col("lo").alias("o")))
        least = turned.groupBy("k").agg(F.min("o").alias("m")).select("k", F.least("k", "m").alias("m"))
        up = turned.where("o > k").join(least, "k").select(F.col("o").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        least = up.groupBy("hi").agg(F.min("lo").alias("m"))
        down = up.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()
        after = cut(down)
        drop_cut(now)
        now, before, state = after, state, _state(after)
        if state == before:
            return now.select(F.col("hi").alias("key"), F.col("lo").alias("part")).unionByName(now.select(F.col("lo").alias("key"), F.col("lo").alias("part")).distinct())
    raise RuntimeError(f"connected parts did not settle in {rounds} rounds")
