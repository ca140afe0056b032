"""Exact top-k by inner product as a Voronoi kNN join.

Vectors become integers, floor(1024 x). Pivots of a bounded sample make Voronoi cells (see
vectors.py), summarised by their pivot, the least and greatest distance to it, how near the nearest rows surely are,
and the number of rows. For a query q and a vector v of a cell with pivot p, q.v lies within |q| |v - p| of q.p: the
summaries alone give a score that enough rows surely reach, and how far from the pivot a row must lie to
have it. Queries are packed in groups whose pivots are neighbours and go only to the nodes that hold a cell some of them need; a
join sends them on to the blocks of those groups of a large cell's shells that reach so far. A block goes once to every
bundle of query groups that need it, each pair of block and bundle is a task's key, and inside it every query
looks at the cells it needs. Their k best are merged by query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, stored
from .vectors import Layout, PivotTree, block_of, by_length, finite, sample

SCALE = 1024.0
TOP = 10
EVERY = 100
#: Rows of a block, queries of a group, and groups that share a copy of a block.
BLOCK_ROWS, QUERY_ROWS, BUNDLE = 4096, 512, 16
#: Integer sums up to here are exact in double precision.
_EXACT = float(1 << 53)


def integers(rows) -> np.ndarray:
    """floor(1024 x) of each component, x as double; kept in doubles."""
    return np.floor(SCALE * np.asarray(rows, np.float64))


def scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products as longs: in doubles where they are exact there, else in Python's integers. Raises if one is no long."""
    most = np.sqrt((q * q).sum(axis=1).max(initial=0)) * np.sqrt((v * v).sum(axis=1).max(initial=0))
    wide = np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * max(1, q.shape[1])
    if most < _EXACT / 2 and wide < _EXACT:
        return (q @ v.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m], dtype=object)
    found = whole(q) @ whole(v).T
    if any(not -(1 << 63) <= x < 1 << 63 for r in found for x in r):
        raise OverflowError("an inner product exceeds the range of long")
    return found.astype(np.int64)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= least)
    else:
        some = np.arange(len(score))
    return some[np.lexsort((ids[some], ~score[some]))][:k]


class Bounds:
    """What the summaries of cells of one length say about queries."""

    def __init__(self, cells, enough: int):
        self.cells, self.enough = cells, enough
        #: Cells are ordered by node: the first cell of each.
        self.first = np.flatnonzero(np.diff(cells.node, prepend=-1))
        self.step = max(1, (1 << 21) // len(cells.number))

    def need(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For queries and cells: how far from the pivot one of the best rows lies at least (inf where the cell can have none), and the score that `enough` rows surely reach."""
        c = self.cells
        size = np.sqrt((q * q).sum(axis=1))[:, None]
        mid = q @ c.pivot.T
        slack = 1e-9 * (1 + np.abs(mid) + size * c.high[None])
        # one row of a cell lies at its least distance, the inner ones no farther than they do, the others at most at its greatest
        one, inner = np.minimum(c.rows, 1), np.minimum(c.inner_rows, c.rows)
        sure = np.concatenate([mid - size * far[None] - slack for far in (c.low, c.inner, c.high)], axis=1)
        rows = np.concatenate([one, inner - one, c.rows - inner])
        order = np.argsort(-sure, axis=1)
        at = (np.cumsum(rows[order], axis=1) < self.enough).sum(axis=1)
        floor = np.full(len(q), -np.inf)
        some = at < len(rows)
        floor[some] = np.take_along_axis(sure, order, axis=1)[some, at[some]]
        gap = floor[:, None] - mid - slack
        least = np.where(gap > 0, gap / np.maximum(size, 1e-300), -np.inf)
        return np.where(least <= c.high[None], least, np.inf), floor


_DATA = pa.schema([("block", pa.int64()), ("dim", pa.int64()), ("cells", pa.binary()), ("starts", pa.binary()), ("highs", pa.binary()), ("ids", pa.binary()), ("v", pa.binary())])
_DATA_SQL = "block long, dim long, cells binary, starts binary, highs binary, ids binary, v binary"
_QUERY = pa.schema([("node", pa.int64()), ("bundle", pa.int64()), ("dim", pa.int64()), ("least", pa.float64()), ("floors", pa.binary()), ("q_ids", pa.binary()), ("q", pa.binary())])
_QUERY_SQL = "node long, bundle long, dim long, least double, floors binary, q_ids binary, q binary"
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _pack(table: pa.Table) -> pa.Table:
    """The rows of a block by cell, and where each cell begins and how far it reaches there."""
    order = np.argsort(table.column("cell").to_numpy(), kind="stable")
    v = np.array(table.column("v").to_pylist(), np.float64)[order]
    cells, starts = np.unique(table.column("cell").to_numpy()[order], return_index=True)
    highs = np.maximum.reduceat(table.column("far").to_numpy()[order], starts)
    row = (table.column("block")[0].as_py(), v.shape[1], cells.tobytes(), starts.astype(np.int64).tobytes(), highs.tobytes(), table.column("vec_id").to_numpy()[order].tobytes(), v.tobytes())
    return pa.table([[x] for x in row], schema=_DATA)


def visit(pivots, starts, highs, ids, v, q_ids, q, floors, k: int):
    """The k best rows of a block for each query: query_id, vec_id, score. A cell's part of the block is looked at by the queries that need it."""
    cuts, out = np.append(starts, len(ids)), []
    for a in range(0, len(q_ids), 64):
        part, own = q[a : a + 64], q_ids[a : a + 64]
        size = np.sqrt((part * part).sum(axis=1))[:, None]
        mid = part @ pivots.T
        need = mid + size * highs + 1e-9 * (1 + np.abs(mid) + size * highs) >= floors[a : a + 64, None]
        score, seen = np.zeros((len(part), len(ids)), np.int64), np.repeat(need, np.diff(cuts), axis=1)
        seen &= ids[None] != own[:, None]
        if need.all():
            score = scores(part, v)
        else:
            for n, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                asking = np.flatnonzero(need[:, n])
                if len(asking):
                    score[asking, lo:hi] = scores(part[asking], v[lo:hi])
        for i in range(len(part)):
            some = np.flatnonzero(seen[i])
            top = some[best(score[i, some], ids[some], k)]
            out.append((np.full(len(top), own[i]), ids[top], score[i, top]))
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3


def top_k(vectors: DataFrame, is_query, k: int = TOP, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The k best rows for every query: query_id, rank (from 1), vec_id, score.

    vectors needs vec_id and embedding; is_query is a condition on them. Candidates are all rows
    but those of the query's own vec_id; ties go to the smaller vec_id, then to the earlier of equal rows. Vectors that are
    null, empty, or hold null or non-finite components take no part, nor do rows with a null
    vec_id; vectors of different lengths are no candidates for each other. A row repeated among
    the data counts each time; a repeated query is answered once. With fewer than k candidates all are returned. An
    empty table gives none. Scores are exact; one beyond the range of long raises OverflowError.
    """
    spark = vectors.sparkSession
    good = F.col("vec_id").isNotNull() & finite()
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"), F.lit(is_query).alias("asked")).where(good)
    rows = rows.select("vec_id", F.col("embedding").alias("v"), "asked")
    total, longest = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    tree = PivotTree([integers(r) for r in sample(rows, "vec_id", total, longest)], math.isqrt(total - 1) + 1)
    shared = spark.sparkContext.broadcast(tree)  # rows ** 0.5 pivots, within SENT bytes
    schema = pa.schema([("vec_id", pa.int64()), ("cell", pa.int64()), ("far", pa.float64()), ("asked", pa.bool_()), ("v", pa.list_(pa.float64()))])

    def assign(batches):
        for batch in batches:
            found = batch.column("v").to_pylist()
            cell, far, v = np.zeros(len(found), np.int64), np.zeros(len(found)), [None] * len(found)
            for at, x in by_length(found):
                x = integers(x)
                cell[at], far[at] = shared.value.assign(x)
                for i, r in zip(at.tolist(), x, strict=True):
                    v[i] = r
            yield batch_of(schema, batch.column("vec_id"), pa.array(cell), pa.array(far), batch.column("asked"), pa.array(v, pa.list_(pa.float64())))

    dealt = stored(rows.mapInArrow(assign, "vec_id long, cell long, far double, asked boolean, v array<double>"), "cells")
    layout = Layout(dealt, "vec_id", tree, block_rows)
    asked = stored(dealt.where("asked").groupBy("vec_id").agg(F.first("v").alias("v"), F.first("cell").alias("cell")), "queries")
    own_rows = dealt.join(asked.select("vec_id"), "vec_id", "left_semi").groupBy("vec_id").count()
    enough = k + (own_rows.agg(F.max("count")).first()[0] or 0)  # none of a query's own rows is a candidate
    layout.measure_inner(enough)
    known = spark.sparkContext.broadcast({d: Bounds(c, enough) for d, c in layout.cells.items()})  # pivots: their size is bounded

    def ask(table: pa.Table) -> pa.Table:
        """A group of queries to the nodes that some of them need, each with those that need it."""
        ids, out = table.column("vec_id").to_numpy(), []
        bundle = table.column("g")[0].as_py() // BUNDLE
        for every, vectors in by_length(table.column("v").to_pylist()):
            bounds = known.value[vectors.shape[1]]
            nodes, large = bounds.cells.node[bounds.first], bounds.cells.large[bounds.first]
            for lo in range(0, len(every), bounds.step):
                at, q = every[lo : lo + bounds.step], vectors[lo : lo + bounds.step]
                least, floor = bounds.need(q)
                least = np.minimum.reduceat(least, bounds.first, axis=1)
                for n in np.flatnonzero((least < np.inf).any(axis=0)).tolist():
                    some = np.flatnonzero(least[:, n] < np.inf)
                    far = float(least[some, n].min()) if large[n] else -math.inf
                    out.append((int(nodes[n]), bundle, q.shape[1], far, floor[some].tobytes(), ids[at[some]].tobytes(), q[some].tobytes()))
        return pa.table(list(map(list, zip(*out, strict=True))) or [[] for _ in _QUERY], schema=_QUERY)

    places, g, held = [], 0, 0
    for r in sorted(asked.groupBy("cell").count().collect()):  # a row per cell; neighbouring cells share a group
        if held and held + r["count"] > query_rows:
            g, held = g + 1, 0
        pieces = -(-r["count"] // query_rows)
        places.append((r["cell"], g, pieces))
        g, held = g + pieces - 1, held + r["count"] if pieces == 1 else query_rows
    groups = g + 1
    where = spark.createDataFrame(places, "cell long, first long, pieces long")
    split = asked.join(F.broadcast(where), "cell").withColumn("g", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("pieces")))
    packed = stored(split.select("vec_id", "v", "g").groupBy("g").applyInArrow(ask, _QUERY_SQL), "asked-nodes")
    parts = layout.groups().groupBy("node", "group").agg(F.max("high").alias("high"), F.max("pieces").alias("pieces"))

    def at_blocks(asking: DataFrame) -> DataFrame:
        """What is asked of a node, for each block of its groups that reach far enough."""
        x = asking.join(parts, "node").where("high >= least").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
        return x.withColumn("block", block_of(F.col("group"), F.col("piece"))).drop("node", "least", "group", "high", "pieces", "piece")

    blocks = layout.place(dealt).select("block", "cell", "far", "vec_id", "v").groupBy("block").applyInArrow(_pack, _DATA_SQL)
    wanted = at_blocks(spark.read.schema(packed.schema).parquet(packed.stored_path).select("node", "bundle", "least")).distinct()
    data = blocks.join(wanted, "block")

    def local(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            v = np.frombuffer(row["v"], np.float64).reshape(-1, row["dim"])
            c = known.value[row["dim"]].cells
            pivots = c.pivot[np.searchsorted(c.number, np.frombuffer(row["cells"], np.int64))]
            part = pivots, np.frombuffer(row["starts"], np.int64), np.frombuffer(row["highs"], np.float64), np.frombuffer(row["ids"], np.int64), v
            for ask in right.to_pylist():
                q = np.frombuffer(ask["q"], np.float64).reshape(-1, row["dim"])
                made = visit(*part, np.frombuffer(ask["q_ids"], np.int64), q, np.frombuffer(ask["floors"], np.float64), k)
                out.append(batch_of(_FOUND, *map(pa.array, made)))
        return pa.Table.from_batches(out, schema=_FOUND)

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(4096, layout.blocks * -(-groups // BUNDLE)))
    left, right = data.repartition(tasks, "block", "bundle").groupBy("block", "bundle"), at_blocks(packed).repartition(tasks, "block", "bundle").groupBy("block", "bundle")
    merged = left.cogroup(right).applyInArrow(local, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_top_k(spark, sf_dir) -> DataFrame:
    """The 10 best of all other embeddings for every hundredth."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % EVERY == 0)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
