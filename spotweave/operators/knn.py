"""Exact nearest neighbours inside folds, in blocks of bounded size.

A fold's test rows are dealt to a few sides, a few tasks for every core; each side meets all training rows of its fold, which come to
it in chunks, one after another. A task keeps the k nearest rows of each of its queries so far: the last of them
bounds what the next chunk can add, so that one matrix product and one comparison rule out nearly all pairs. Training rows
travel once for each side, and the sides do not grow with the rows until a side would be too large; answers are k rows a query. No side is collected or broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Training rows of a chunk; components of a chunk and of a side's queries at most; queries that a side has at least before there are more sides.
CHUNK, CHUNK_COMPONENTS, SIDE_COMPONENTS, ASKED = 4096, 1 << 19, 1 << 21, 256
#: Components of differences that are held at once; products of a strip of queries and a chunk.
PAIRS = 1 << 22
STRIP = 1 << 20


def _chunks(df: DataFrame, fold: str, columns: list[str], name: str, chunk: int) -> DataFrame:
    n = df.groupBy(fold).agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).alias("_n"))
    dealt = df.join(n, fold).withColumn("_c", F.pmod(F.xxhash64(columns[0]), F.col("_n")))
    return dealt.groupBy(fold, "_c").agg(F.collect_list(F.struct(*columns)).alias(name))


def _matrix(cell) -> np.ndarray:
    x = cell.field("x")
    flat = x.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(x), -1)


def _least(x: np.ndarray, y: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, distance) of the k nearest columns of every row, ties to the smaller column; d has squared distances up to rounding, inf for none.

    Every column that rounding could place among the k is measured again without cancellation.
    """
    slack = 8 * (x.shape[1] + 8) * np.finfo(float).eps * ((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None])
    near = np.isfinite(d)
    if k < len(y):
        reach = np.partition(d + slack, k - 1, axis=1)[:, k - 1]
        near &= d - slack <= np.where(np.isfinite(reach), reach, np.inf)[:, None]
    row, col = np.nonzero(near)
    dist, step = np.empty(len(row)), max(1, PAIRS // max(1, x.shape[1]))
    for lo in range(0, len(row), step):
        i, j = row[lo : lo + step], col[lo : lo + step]
        dist[lo : lo + step] = np.sqrt(((x[i] - y[j]) ** 2).sum(axis=1))
    order = np.lexsort((col, dist, row))
    first = np.searchsorted(row, np.arange(len(x)))
    order = order[np.arange(len(row)) - first[row] < k]
    return row[order], col[order], dist[order]


def _ceil(x):
    return F.greatest(F.ceil(x).cast("long"), F.lit(1).cast("long"))


def _work(test: DataFrame, train: DataFrame, fold: str, chunk: int) -> DataFrame:
    """Packed rows (fold, _a, _c, keys, labels, x): for each side of a fold its queries (_c is -1), then the fold's training chunks."""
    tasks = 4 * test.sparkSession.sparkContext.defaultParallelism
    n = train.groupBy(fold).agg(F.count(F.lit(1)).alias("_train"), F.max(F.size("x")).alias("_wide")).join(test.groupBy(fold).agg(F.count(F.lit(1)).alias("_test")), fold)
    pairs = F.col("_train").cast("double") * F.col("_test")
    sides = F.greatest(_ceil(F.col("_test") * F.col("_wide") / SIDE_COMPONENTS), F.least(_ceil(F.col("_test") / ASKED), _ceil(tasks * pairs / F.col("_pairs"))))
    chunks = F.greatest(_ceil(F.col("_train") / chunk), _ceil(F.col("_train") * F.col("_wide") / CHUNK_COMPONENTS))
    n = F.broadcast(n.join(F.broadcast(n.agg(F.sum(pairs).alias("_pairs")))).select(fold, sides.alias("_sides"), chunks.alias("_chunks")))  # a row per fold
    dealt = lambda df, parts: F.pmod(F.xxhash64("key"), F.col(parts))
    left = test.select(fold, "key", F.lit(None).cast("string").alias("label"), "x").join(n, fold).withColumn("_a", dealt(test, "_sides")).withColumn("_c", F.lit(-1).cast("long"))
    right = train.select(fold, "key", F.col("label").cast("string").alias("label"), "x").join(n, fold).withColumn("_a", F.lit(-1).cast("long")).withColumn("_c", dealt(train, "_chunks"))
    kinds = f"`{fold}` {test.schema[fold].dataType.simpleString()}, _a long, _c long, keys array<{test.schema['key'].dataType.simpleString()}>, labels array<string>, x binary"

    def pack(table: pa.Table) -> pa.Table:
        key, label, x = (table.column(c).combine_chunks() for c in ("key", "label", "x"))
        whole = [pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), v) for v in (key, label)]
        flat = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
        return pa.table([*(table.column(c).slice(0, 1) for c in (fold, "_a", "_c")), *whole, pa.array([flat.tobytes()], pa.binary())], names=[fold, "_a", "_c", "keys", "labels", "x"])

    packed = lambda df: df.select(fold, "_a", "_c", "key", "label", F.col("x").cast("array<double>").alias("x")).groupBy(fold, "_a", "_c").applyInArrow(pack, kinds)
    every = packed(right).join(n, fold).withColumn("_a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_sides") - 1)))
    columns = [F.col(fold).alias("fold"), "_a", "_c", "keys", "labels", "x"]
    return packed(left).select(*columns).unionByName(every.select(*columns)).repartition(8 * tasks, "fold", "_a").sortWithinPartitions("fold", "_a", "_c")


class _Side:
    """The queries of a side and the k nearest rows that each has met so far."""

    def __init__(self, keys: pa.Array, x: np.ndarray, k: int, self_join: bool):
        self.keys, self.x, self.k, self.self_join = keys, x, k, self_join
        self.key_type = keys.type
        self.own = self._values(keys)
        self.square = (x * x).sum(axis=1)
        self.wide = np.concatenate([x, np.ones((len(x), 1))], axis=1)
        self.n = np.zeros(len(x), np.int64)  # neighbours so far
        self.dist = np.full((len(x), k), np.inf)
        self.other = np.zeros((len(x), k), self.own.dtype)
        self.label = np.zeros((len(x), k), np.int32)

    @staticmethod
    def _values(keys: pa.Array) -> np.ndarray:
        return keys.to_numpy(zero_copy_only=False) if pa.types.is_integer(keys.type) else np.array(keys.to_pylist(), object)

    def meet(self, keys: pa.Array, label: np.ndarray, y: np.ndarray) -> None:
        names = self._values(keys)
        order = np.argsort(names, kind="stable")
        names, label, y = names[order], label[order], y[order]
        square = (y * y).sum(axis=1)
        less = 1 - 8 * (y.shape[1] + 8) * np.finfo(float).eps  # room for rounding, as `_least` has it
        tall = np.concatenate([y, -square[:, None] * (less / 2)], axis=1).T
        for lo in range(0, len(self.x), step := max(1, STRIP // len(y))):
            some, at = slice(lo, lo + step), 0
            if self.n[some].min() < self.k:  # the first rows are measured by themselves: they give the bound
                at = min(len(y), max(1024, 4 * (self.k + 1)))
                part, z = self.x[some], y[:at]
                d = np.maximum(0, self.square[some, None] - 2 * part @ z.T + square[:at][None])
                self._take(lo, *_least(part, z, d, min(at, self.k + self.self_join)), names, label)
            if at < len(y):
                bound = np.where(self.n[some] < self.k, np.inf, self.dist[some, -1] ** 2 * (1 + 1e-12))
                good = self.wide[some] @ tall[:, at:] >= ((self.square[some] * less - bound) / 2)[:, None]
                row, col = np.divmod(np.flatnonzero(good.ravel()), len(y) - at)
                col += at
                dist, most = np.empty(len(row)), max(1, PAIRS // max(1, y.shape[1]))
                for i in range(0, len(row), most):
                    dist[i : i + most] = np.sqrt(((self.x[lo + row[i : i + most]] - y[col[i : i + most]]) ** 2).sum(axis=1))
                self._take(lo, row, col, dist, names, label)

    def _take(self, lo: int, row: np.ndarray, col: np.ndarray, dist: np.ndarray, names: np.ndarray, label: np.ndarray) -> None:
        """Pairs of queries (from lo) and training rows join what the queries have; the k nearest stay, ties to the smaller key."""
        real = np.isfinite(dist)
        if self.self_join:
            real &= self.own[lo + row] != names[col]
        row, col, dist = lo + row[real], col[real], dist[real]
        if not len(row):
            return
        hit = np.unique(row)
        held = np.arange(self.k)[None] < self.n[hit, None]
        old = np.repeat(hit, self.n[hit])
        at, far = np.concatenate([old, row]), np.concatenate([self.dist[hit][held], dist])
        who, what = np.concatenate([self.other[hit][held], names[col]]), np.concatenate([self.label[hit][held], label[col]])
        order = np.lexsort((who if who.dtype != object else np.unique(who, return_inverse=True)[1], far, at))
        at, far, who, what = at[order], far[order], who[order], what[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        keep = place < self.k
        at, place = at[keep], place[keep]
        self.dist[at, place], self.other[at, place], self.label[at, place] = far[keep], who[keep], what[keep]
        self.n[hit] = np.bincount(at, minlength=len(self.x))[hit]

    def answers(self, fold, kind: pa.DataType, labels: list, pad: bool):
        """Batches (fold, key, other, label, dist, rank); padded, each query is there itself at rank 0 and, at infinity, at the ranks that lack a row."""
        names, first = pa.array(labels or [None], pa.string()), 1
        if pad:
            first, own = 0, self.own[:, None]
            held = np.arange(self.k)[None] < self.n[:, None]
            self.other = np.concatenate([own, np.where(held, self.other, own)], axis=1)
            self.dist, self.label = (np.pad(v, ((0, 0), (1, 0))) for v in (self.dist, self.label))
        for lo in range(0, len(self.x), step := max(1, (1 << 16) // self.k)):
            held = np.arange(self.other.shape[1])[None] < (self.n[lo : lo + step, None] if not pad else self.k + 1)
            row, place = np.nonzero(np.broadcast_to(held, (len(self.n[lo : lo + step]), self.other.shape[1])))
            if not len(row):
                continue
            other = self.other[lo + row, place]
            other = pa.array(other if other.dtype != object else other.tolist(), self.key_type)
            yield pa.RecordBatch.from_arrays(
                [pa.array([fold] * len(row), kind), self.keys.take(pa.array(lo + row)), other, names.take(pa.array(self.label[lo + row, place])), pa.array(self.dist[lo + row, place]), pa.array((place + first).astype(np.int32))],
                names=["fold", "key", "other", "label", "dist", "rank"],
            )


def nearest(test: DataFrame, train: DataFrame, k: int, fold: str = "fold", chunk: int = CHUNK, self_join: bool = False, pad: bool = False) -> DataFrame:
    """(fold, key, rank, other, label, dist): the k nearest training rows of every test row of its fold.

    test: fold, key, x; train: fold, key, label, x (x array<double>). Ties go to the smaller key.
    self_join leaves out the row itself; pad puts it at rank 0 and, at infinity, at the ranks for which there is no row (labels mean nothing then).
    """
    key_type, fold_type = test.schema["key"].dataType.simpleString(), test.schema[fold].dataType.simpleString()

    def run(batches):
        side, now, codes = None, None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                name, keys = batch.column("fold")[i].as_py(), batch.column("keys")[i].values
                x = np.frombuffer(batch.column("x")[i].as_buffer(), np.float64).reshape(len(keys), -1)
                if batch.column("_c")[i].as_py() < 0:
                    if side is not None:
                        yield from side.answers(now, batch.schema.field("fold").type, list(codes), pad)
                    side, now, codes = _Side(keys, x, k, self_join), name, {}
                    kind = batch.schema.field("fold").type
                    continue
                label = batch.column("labels")[i].values.dictionary_encode()
                code = np.array([codes.setdefault(v, len(codes)) for v in label.dictionary.to_pylist()] + [codes.setdefault(None, len(codes)) if label.null_count else 0], np.int32)
                side.meet(keys, code[label.indices.fill_null(len(label.dictionary)).to_numpy(zero_copy_only=False)], x)
        if side is not None:
            yield from side.answers(now, kind, list(codes), pad)

    return _work(test, train, fold, chunk).mapInArrow(run, f"fold {fold_type}, key {key_type}, other {key_type}, label string, dist double, rank int").withColumnRenamed("fold", fold)


def vote(neighbours: DataFrame, fold: str = "fold") -> DataFrame:
    """The commonest label among a query's neighbours; ties go to the smallest label."""
    n = neighbours.groupBy(fold, "key", "label").count()
    return n.groupBy(fold, "key").agg(F.min_by("label", F.struct(-F.col("count"), F.col("label"))).alias("y_pred"))


def padded_graph(spots: DataFrame, k: int, by_batch: bool = False) -> DataFrame:
    """Neighbour rows (key, rank, other, dist), self first at rank 0; missing ranks are the row itself at infinity.

    spots: key, batch, x. by_batch asks for k neighbours in every batch, the row itself not among them.
    """
    one = F.lit("all") if not by_batch else F.col("batch")
    train = spots.select(one.cast("string").alias("fold"), "key", F.col("batch").cast("string").alias("label"), "x")
    if not by_batch:
        return nearest(spots.select(F.lit("all").alias("fold"), "key", "x"), train, k, self_join=True, pad=True).select("key", "rank", "other", "dist")
    test = spots.select("key", "x").join(spots.select(F.col("batch").cast("string").alias("fold")).distinct())
    found = nearest(test, train, k, self_join=True)
    rank = Window.partitionBy("key").orderBy("dist", "other")
    edges = found.select("key", F.row_number().over(rank).alias("rank"), "other", "dist")
    return edges.unionByName(spots.select("key", F.lit(0).alias("rank"), F.col("key").alias("other"), F.lit(0.0).alias("dist")))
