"""Hard negatives by Kronecker-packed products.

Components become integers, floor(scale x). The integers of a block of candidates are biased to be
non-negative and put side by side in fields of one wide integer for each component, wide
enough that a whole inner product fits a field. One multiplication by an anchor's (biased) component
then multiplies all candidates of the wide integer; the products are added over the components
and the fields are cut apart again. What the biases add is known from the sums of the components
and is taken off, so scores are exact. Where two fields or more fit 53 bits, the wide integers are whole numbers in
doubles, and all anchors of a group are one matrix product; elsewhere a block is one long Python integer for
each component, with fields of whole bytes.

Anchors meet all rows in tiles of a block and a bundle of anchor groups. A first pass keeps each
anchor's best rows of its own label, a second one, with the windows that these set, the best rows of other
labels inside each window. What a tile returns is bounded by its anchors, and Spark merges it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, forget, stored
from .vectors import finite

SCALE = 256.0
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is this share of the positive's, in hundredths.
LOW, HIGH = 50, 95
EVERY = 50
#: Rows of a block, anchors of a group, and groups of a bundle.
BLOCK_ROWS, GROUP_ROWS, BUNDLE = 4096, 256, 16
#: Whole numbers up to here are exact in doubles.
_DOUBLE_BITS = 53


def integers(rows, scale: float = SCALE) -> np.ndarray:
    """floor(scale x) of each component, x as double; kept in doubles. Raises if that leaves the doubles."""
    with np.errstate(over="ignore"):
        out = np.floor(np.float64(scale) * np.asarray(rows, np.float64))
    if not np.isfinite(out).all():
        raise OverflowError("a scaled component exceeds the range of double")
    return out


class Packed:
    """A block of candidates (rows of whole numbers in doubles) as wide integers, one or more for each component."""

    def __init__(self, v: np.ndarray):
        self.rows, self.dim = v.shape
        self.low = min(0, int(v.min(initial=0)))
        self.top = max(0, int(v.max(initial=0))) - self.low
        self.v = v
        self._made: dict = {}

    def _sums(self) -> np.ndarray:
        """Of each candidate's biased components."""
        if "sums" not in self._made:
            self._made["sums"] = (self.v - float(self.low)).sum(axis=1).astype(np.int64)
        return self._made["sums"]

    def _doubles(self, bits: int) -> np.ndarray:
        """(components, wide integers): each holds 53 // bits candidates."""
        if bits not in self._made:
            fields = _DOUBLE_BITS // bits
            width = -(-self.rows // fields)
            padded = np.zeros((fields * width, self.dim))
            padded[: self.rows] = self.v - float(self.low)
            self._made[bits] = sum(padded[f * width : (f + 1) * width].T * float(1 << (f * bits)) for f in range(fields))
        return self._made[bits]

    def _integers(self, size: int) -> list[int]:
        """A wide integer for each component that holds all candidates, `size` bytes each."""
        if -size not in self._made:
            self._made[-size] = [int.from_bytes(b"".join((int(x) - self.low).to_bytes(size, "little") for x in column), "little") for column in self.v.T]
        return self._made[-size]

    def scores(self, a: np.ndarray) -> np.ndarray:
        """Inner products of anchors with all candidates, as longs. Raises if one is no long."""
        low = min(0, int(a.min(initial=0)))
        top = max(0, int(a.max(initial=0))) - low
        bits = max(1, (self.top * top * self.dim).bit_length())
        if 2 * bits <= _DOUBLE_BITS and (max(self.top, -self.low) * max(top, -low) * self.dim).bit_length() <= 60:
            return self._by_doubles(a - float(low), bits, low)
        return self._by_integers(a, bits, low)

    def _by_doubles(self, a: np.ndarray, bits: int, low: int) -> np.ndarray:
        wide = (a @ self._doubles(bits)).astype(np.int64)
        mask = (1 << bits) - 1
        cut = np.concatenate([(wide >> (f * bits)) & mask for f in range(_DOUBLE_BITS // bits)], axis=1)[:, : self.rows]
        # (v - p)(a - q) sums to v.a - q sum(v) - p sum(a) + d p q
        own = a.sum(axis=1).astype(np.int64) + self.dim * low
        return cut + low * (self._sums() + self.dim * self.low)[None] + self.low * own[:, None] - self.dim * self.low * low

    def _by_integers(self, a: np.ndarray, bits: int, low: int) -> np.ndarray:
        size = -(-bits // 8)
        wide = self._integers(size)
        sums = [sum(map(int, r)) for r in self.v]
        out = []
        for r in a:
            own = [int(x) for x in r]
            total = sum(w * (x - low) for w, x in zip(wide, own, strict=True)).to_bytes(size * self.rows + 1, "little")
            shift = self.low * sum(own) - self.dim * self.low * low
            out.append([int.from_bytes(total[i * size : (i + 1) * size], "little") + low * s + shift for i, s in enumerate(sums)])
        if any(not -(1 << 63) <= x < 1 << 63 for r in out for x in r):
            raise OverflowError("an inner product exceeds the range of long")
        return np.array(out, np.int64).reshape(len(a), self.rows)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(score) > 4 * k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        some = np.arange(len(score))
    return some[np.lexsort((ids[some], ~score[some]))][:k]


_BLOCK = pa.schema([("block", pa.int64()), ("dim", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("v", pa.binary()), ("narrow", pa.bool_())])
_BLOCK_SQL = "block long, dim long, ids binary, labels binary, v binary, narrow boolean"
_FOUND = pa.schema([("anchor_id", pa.int64()), ("place", pa.int64()), ("positive_score", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_FOUND_SQL = "anchor_id long, place long, positive_score long, vec_id long, score long"


def _packed_rows(block: int, ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> tuple:
    narrow = bool((np.abs(v) < 1 << 31).all())
    return block, v.shape[1], ids.astype(np.int64).tobytes(), labels.astype(np.int64).tobytes(), (v.astype(np.int32) if narrow else v).tobytes(), narrow


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = np.frombuffer(row["v"], np.int32 if row["narrow"] else np.float64).reshape(-1, row["dim"]).astype(np.float64)
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), v


def _by_length(column: pa.Array):
    """(rows, matrix) for every length among lists of doubles without nulls."""
    size, flat = pc.list_value_length(column).to_numpy(), column.flatten().to_numpy()
    start = np.cumsum(size) - size
    for d in np.unique(size).tolist():
        own = np.flatnonzero(size == d)
        yield own, flat[start[own][:, None] + np.arange(d)[None]]


def blocked(rows: DataFrame, scale: float, block_rows: int) -> DataFrame:
    """Rows (vec_id, label, v) as rows of up to block_rows vectors of one length, with a number for each."""

    def run(batches):
        from pyspark import TaskContext

        at, held = TaskContext.get().partitionId() << 32, {}
        for batch in batches:
            ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
            for own, x in _by_length(batch.column("v")):
                d, more = x.shape[1], (ids[own], labels[own], integers(x, scale))
                if d in held:
                    more = tuple(np.concatenate(c) for c in zip(held[d], more, strict=True))
                start = 0
                while len(more[0]) - start >= block_rows:
                    yield batch_of(_BLOCK, *([x] for x in _packed_rows(at, *(c[start : start + block_rows] for c in more))))
                    at, start = at + 1, start + block_rows
                held[d] = tuple(c[start:] for c in more)
        for rest in held.values():
            if len(rest[0]):
                yield batch_of(_BLOCK, *([x] for x in _packed_rows(at, *rest)))
                at += 1

    return rows.mapInArrow(run, _BLOCK_SQL)


def _tile(left: pa.Table, right: pa.Table, work) -> pa.Table:
    """Anchors and blocks of a tile by `work`, which gives anchor_id, place, positive_score, vec_id, score."""
    out = []
    for row in left.to_pylist():
        ids, labels, v = _unpacked(row)
        block = Packed(v)
        for ask in right.to_pylist():
            if ask["dim"] == row["dim"]:
                a_ids, a_labels, a = _unpacked(ask)
                found = list(work(ask, a_ids, a_labels, block.scores(a), ids, labels))
                if found:
                    out.append(batch_of(_FOUND, *(pa.array(np.concatenate(c)) for c in zip(*found, strict=True))))
    return pa.Table.from_batches(out, schema=_FOUND)


def _positives(k: int):
    def work(ask, a_ids, a_labels, score, ids, labels):
        for i, anchor in enumerate(a_ids.tolist()):
            some = np.flatnonzero((labels == a_labels[i]) & (ids != anchor))
            top = some[best(score[i, some], ids[some], k)]
            n = len(top)
            yield np.full(n, anchor), np.zeros(n, np.int64), np.zeros(n, np.int64), ids[top], score[i, top]

    return work


def _negatives(k: int, low: int, high: int):
    def work(ask, a_ids, a_labels, score, ids, labels):
        places = np.frombuffer(ask["places"], np.int64).reshape(-1, 3)  # the anchor's position in the group, the positive's rank and score
        for i, place, own in places.tolist():
            # 50 p <= 100 s <= 95 p in whole numbers
            least, most = -(-low * own // 100), high * own // 100
            some = np.flatnonzero((score[i] >= least) & (score[i] <= most) & (labels != a_labels[i])) if least <= most else ()
            if len(some):
                top = some[best(score[i, some], ids[some], k)]
                n = len(top)
                yield np.full(n, a_ids[i]), np.full(n, place), np.full(n, own), ids[top], score[i, top]

    return work


def _tiles(blocks: DataFrame, groups: DataFrame, bundle: int, work) -> DataFrame:
    """Every block with every group: a task's key is a bundle of about `bundle` blocks and one of as many groups."""
    spark = blocks.sparkSession
    side, asks = (max(1, -(-x.count() // bundle)) for x in (blocks, groups))
    dealt = lambda n: F.pmod(F.xxhash64("block"), F.lit(n))
    left = blocks.withColumn("i", dealt(side)).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(asks - 1))))
    right = groups.withColumn("j", dealt(asks)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(side - 1))))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(8192, side * asks))
    left, right = (x.withColumns({c: F.col(c).cast("long") for c in "ij"}).repartition(tasks, "i", "j").groupBy("i", "j") for x in (left, right))
    return left.cogroup(right).applyInArrow(lambda a, b: _tile(a, b, work), _FOUND_SQL)


def hard_negatives(
    rows: DataFrame, is_anchor, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: float = SCALE,
    block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS, bundle: int = BUNDLE,
) -> DataFrame:
    """Hard negatives of every anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows needs vec_id, label and embedding; is_anchor is a condition on them. An anchor's positives are its
    best other rows of the same label; the negatives of a positive are the best rows of another label with low
    to high hundredths of its score. Higher scores come first, then smaller ids. Rows with a null vec_id, label
    or vector, an empty vector or a null or non-finite component take no part; vectors of another length are no
    candidates. Rows of the anchor's own vec_id are none of its positives; an anchor id that is repeated is asked once,
    as its row of the smallest label and components. A repeated row among the others counts each time. Positives without a negative give no
    row; an empty table gives none. Other columns are ignored. Scores are exact; one beyond long raises OverflowError.
    """
    spark = rows.sparkSession
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite()
    own = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"), F.lit(is_anchor).alias("_asked")).where(good)
    own = own.select("vec_id", "label", F.col("embedding").alias("v"), "_asked")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = stored(blocked(own.drop("_asked"), scale, block_rows), "blocks")
    asked = own.where("_asked").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")
    groups = stored(blocked(asked, scale, group_rows), "anchors")
    found = _tiles(blocks, groups, bundle, _positives(positives))
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    top = stored(found.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= positives).select("anchor_id", "place", F.col("vec_id").alias("positive_id"), "score"), "positives")

    # each group gets the places and scores of its anchors' positives
    members = groups.select("block", "ids").mapInArrow(_members, "block long, at long, anchor_id long")
    windows = members.join(top, "anchor_id").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "place", "score"))).alias("p"))  # group_rows x positives at most
    asking = groups.join(windows, "block").mapInArrow(_with_places, _BLOCK_SQL + ", places binary")
    below = _tiles(blocks, asking, bundle, _negatives(negatives, low, high))
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id")
    below = below.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    below = below.select("anchor_id", "place", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    out = below.join(top.select("anchor_id", "place", "positive_id"), ["anchor_id", "place"])
    out = stored(out.repartition(parts, "anchor_id").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    for x in (blocks, groups, top):
        forget(x)
    return out


def _members(batches):
    for batch in batches:
        for row in batch.to_pylist():
            ids = np.frombuffer(row["ids"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), row["block"])), pa.array(np.arange(len(ids))), pa.array(ids)], names=["block", "at", "anchor_id"])


def _with_places(batches):
    schema = pa.schema([*_BLOCK, ("places", pa.binary())])
    for batch in batches:
        for row in batch.to_pylist():
            places = np.array([[x["at"], x["place"], x["score"]] for x in row["p"]], np.int64)
            yield batch_of(schema, *([row[c]] for c in schema.names[:-1]), [places.tobytes()])


def op13_hard_negatives(spark, sf_dir) -> DataFrame:
    """Hard negatives for every fiftieth embedding; the label of every seventh is moved by one first."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % EVERY == 0)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, list_inner_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
