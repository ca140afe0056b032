"""Connected components of an edge table by alternating large and small stars.

Each round replaces edges by stars around smaller neighbours: minima are aggregated
(map-side first) and joined back, so a node with very many neighbours is never
collected; its rows stay apart and skewed joins can be split. Rounds are written to
the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def _sum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.expr("cast(u as decimal(38,0))"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Edges with columns a, b (long; self-loops and repeats allowed) to (node, component).

    component is the smallest node reachable. Nodes without an edge to another node are
    not returned. An empty edge table gives an empty result.
    """
    now = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    seen = _sum(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = stored(small, "edges")
        forget(now)
        now, before = after, seen
        seen = _sum(now)
        if seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
