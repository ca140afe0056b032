"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are computed where the text is read; equal fingerprints collapse to one row
before anything is compared. The distinct ones are sorted by Gray rank and split into ranges,
the index's upper nodes. Every node, a range or a group below it, holds the mask of the bits that
its fingerprints share and their pattern under it. Two nodes differ at least in the jointly shared
bits that differ; going down, only the bits that become shared are compared and the differences are
accumulated. A pair of nodes that differs in more than the allowed bits is cut with all below it:
pairs of ranges before they are sent anywhere, pairs of groups in the task that has both ranges.
Pairs that cannot differ in more are linked as a whole, and pairs already in one component are
skipped. What leaves a task is one edge per linked fingerprint, not all pairs.

Among n evenly spread fingerprints about sum(C(log2 n, i), i <= 4) partners of each are reached, so
the work of one grows with the fourth power of log n, and no fingerprint is replicated by itself: a range
goes once to each range it is not cut from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batch_of, blocks, forget, joined, ragged, stored
from .components import connected_components

MAX_BITS = 4
SHINGLE = 4
SEED = 42
FANOUT = 4
#: Fingerprints of a range: a 64th of all within these bounds.
LEAST_RANGE, MOST_RANGE = 1 << 15, 1 << 21

_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(data: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the lower-cased text's word shingles, repeats included; no words (or null): 0."""
    words = (data or b"").lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return digest(text, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    first = starts[: len(words) - shingle + 1]
    last = (starts + sizes)[shingle - 1 :]
    hashes = np.array([digest(text[a:b], SEED) for a, b in zip(first.tolist(), last.tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, th) with fp as the signed long of the 64 bits and th a hash of the text, which tells rows of one id apart."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("th", pa.int64())])

    def run(batches):
        for batch in blocks(batches, "text"):
            fps = np.array([fingerprint(t, shingle) for t in as_bytes(batch.column("text"))], np.uint64)
            yield batch_of(schema, batch.column("doc_id"), pa.array(fps.view(np.int64)), batch.column("th"))

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("th", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, fp long, th long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the Gray sequence."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """A tree over the fingerprints of each key, all of one height. Keys are ranges of fingerprints.

    visited and pruned count the pairs of nodes that were compared and those cut.
    """

    def __init__(self, keys: np.ndarray, codes: np.ndarray, fanout: int = FANOUT):
        order = np.lexsort((gray_rank(codes), keys))
        self.codes, keys, self.fanout = codes[order], keys[order], fanout
        n = len(codes)
        self.new = np.ones(n, bool)
        self.new[1:] = keys[1:] != keys[:-1]
        root = np.cumsum(self.new) - 1
        count = np.bincount(root)
        place = np.arange(n) - np.flatnonzero(self.new)[root]
        #: Per level: shared mask, pattern, first child (and one end), first leaf (and one end).
        self.levels = [(np.full(n, _FULL), self.codes, None, np.arange(n + 1))]
        low, high, group, leaf = self.codes, self.codes, root, np.arange(n)
        while len(low) > len(count):
            up = place // fanout
            cut = np.ones(len(low), bool)
            cut[1:] = (group[1:] != group[:-1]) | (up[1:] != up[:-1])
            first = np.flatnonzero(cut)
            low, high = np.bitwise_and.reduceat(low, first), np.bitwise_or.reduceat(high, first)
            shared = ~(low ^ high)
            leaf = leaf[first]
            self.levels.append((shared, low & shared, np.append(first, len(cut)), np.append(leaf, n)))
            group, place = group[first], up[first]
        self.visited = self.pruned = 0

    def links(self, most: int = MAX_BITS, pairs: list[tuple[int, int]] | None = None, chunk: int = 1 << 13) -> np.ndarray:
        """Component label of each fingerprint, in index order, by links of at most `most` bits inside the pairs of keys (default: each with itself)."""
        n = len(self.codes)
        labels = np.arange(n)
        segment = np.cumsum(self.new)
        pairs = [(k, k) for k in range(int(segment[-1]))] if pairs is None else pairs
        if all(a == b for a, b in pairs):
            for step in (1, 2, 3):  # neighbours in Gray order first: most of a dense group joins here
                if n > step:
                    a = np.arange(n - step)
                    near = (segment[:-step] == segment[step:]) & (np.bitwise_count(self.codes[:-step] ^ self.codes[step:]) <= most)
                    labels = joined(labels, a[near], a[near] + step)
        top = len(self.levels) - 1
        a, b = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        shared, pattern = self.levels[top][:2]
        both = shared[a] & shared[b]
        stack = [(top, *self._kept(labels, a, b, both, np.bitwise_count((pattern[a] ^ pattern[b]) & both).astype(np.uint8), most))]
        uniform, settled = self._uniform(labels), 0
        while stack:
            level, a, b, both, apart = stack.pop()
            if not len(a):
                continue
            if level == 0:
                labels = joined(labels, a, b)
                continue
            if len(a) > chunk:
                half = len(a) // 2
                stack += [(level, a[half:], b[half:], both[half:], apart[half:]), (level, a[:half], b[:half], both[:half], apart[:half])]
                continue
            same = uniform[level]
            open_ = (same[a] < 0) | (same[a] != same[b])
            whole = open_ & (apart + np.bitwise_count(~both) <= most)
            if whole.any():
                leaf = self.levels[level][3]
                for side in (a[whole], b[whole]):
                    labels = joined(labels, np.repeat(leaf[a[whole]], leaf[side + 1] - leaf[side]), ragged(leaf[side], leaf[side + 1] - leaf[side]))
                open_ &= ~whole
            settled += 1
            if settled % 64 == 0:
                uniform = self._uniform(labels)
            stack.append((level - 1, *self._below(level, a[open_], b[open_], both[open_], apart[open_], most)))
        return labels

    def _kept(self, labels, a, b, both, apart, most):
        keep = apart <= most
        self.visited += len(keep)
        self.pruned += int(len(keep) - keep.sum())
        return a[keep], b[keep], both[keep], apart[keep]

    def _below(self, level, a, b, both, apart, most):
        """The children's pairs of pairs of nodes that do not differ too much: the differences so far and those in bits that become shared."""
        first, (shared, pattern) = self.levels[level][2], self.levels[level - 1][:2]
        k = np.arange(self.fanout)
        ia, ib = (np.minimum(first[x][:, None] + k, first[x + 1][:, None] - 1) for x in (a, b))
        known = (k < (first[a + 1] - first[a])[:, None])[:, :, None] & (k < (first[b + 1] - first[b])[:, None])[:, None, :]
        if level > 1:
            joint = shared[ia][:, :, None] & shared[ib][:, None, :]
            fresh = joint & ~both[:, None, None]
        else:
            joint = fresh = ~both[:, None, None]
        differ = apart[:, None, None] + np.bitwise_count((pattern[ia][:, :, None] ^ pattern[ib][:, None, :]) & fresh)
        known &= (a != b)[:, None, None] | (k[:, None] <= k if level > 1 else k[:, None] < k)[None]
        self.visited += int(known.sum())
        p, i, j = np.nonzero(known & (differ <= most))
        self.pruned += int(known.sum()) - len(p)
        return ia[p, i], ib[p, j], joint[p, i, j] if level > 1 else np.full(len(p), _FULL), differ[p, i, j]

    def _uniform(self, labels: np.ndarray) -> list[np.ndarray]:
        """Per node the one component that all its fingerprints are in, or -1."""
        out = [labels]
        low = high = labels
        for _, _, first, _ in self.levels[1:]:
            low, high = np.minimum.reduceat(low, first[:-1]), np.maximum.reduceat(high, first[:-1])
            out.append(np.where(low == high, low, -1))
        return out


_RANGE = pa.schema([("range", pa.int64()), ("shared", pa.int64()), ("pattern", pa.int64()), ("codes", pa.binary())])
_RANGE_SQL = "range long, shared long, pattern long, codes binary"
_TILE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("range", pa.int64()), ("codes", pa.binary())])
_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def ranked(distinct: DataFrame) -> DataFrame:
    """Fingerprints (column fp) with their Gray rank, as a long in the same order."""
    out = distinct.select("fp", F.col("fp").alias("rank"))
    for shift in (1, 2, 4, 8, 16, 32):
        out = out.withColumn("rank", F.col("rank").bitwiseXOR(F.shiftrightunsigned("rank", shift)))
    return out.withColumn("rank", F.col("rank").bitwiseXOR(F.lit(-(1 << 63))))


def gray_ranges(distinct: DataFrame, rows: int, total: int) -> DataFrame:
    """The fingerprints (column fp) in ranges of about `rows` in Gray order: range, shared mask, pattern, codes; stored."""

    def pack(batches):
        number, held = TaskContext.get().partitionId() << 24, []

        def full(codes):
            low, high = np.bitwise_and.reduce(codes), np.bitwise_or.reduce(codes)
            mask = ~(low ^ high)
            return batch_of(_RANGE, [number], [int(mask.view(np.int64))], [int((low & mask).view(np.int64))], [codes.tobytes()])

        for batch in batches:
            held.append(batch.column("fp").to_numpy().view(np.uint64))
            if sum(map(len, held)) >= rows:
                yield full(np.concatenate(held))
                number, held = number + 1, []
        if held and sum(map(len, held)):
            yield full(np.concatenate(held))

    dealt = ranked(distinct).repartitionByRange(max(1, -(-total // rows)), "rank").sortWithinPartitions("rank")
    return stored(dealt.select("fp").mapInArrow(pack, _RANGE_SQL), "gray-ranges")


def near_edges(distinct: DataFrame, most: int = MAX_BITS, range_rows: int | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that span all links of at most `most` bits."""
    spark = distinct.sparkSession
    total = distinct.count()
    ranges = gray_ranges(distinct, range_rows or max(LEAST_RANGE, min(MOST_RANGE, total // 64)), total)
    nodes = ranges.select("range", "shared", "pattern").toArrow()  # a row per range
    name, shared, pattern = (nodes.column(c).to_numpy() for c in ("range", "shared", "pattern"))
    upper = spark.sparkContext.broadcast((name, shared.view(np.uint64), pattern.view(np.uint64)))

    def send(batches):
        """A range to every pair of ranges that is not cut."""
        name, shared, pattern = upper.value
        for batch in batches:
            for k in range(batch.num_rows):
                own, codes = batch.column("range")[k].as_py(), batch.column("codes").slice(k, 1)
                at = int(np.flatnonzero(name == own)[0])
                near = np.bitwise_count((pattern ^ pattern[at]) & shared & shared[at]) <= most
                for other in name[near].tolist():
                    yield pa.RecordBatch.from_arrays([pa.array([min(own, other)]), pa.array([max(own, other)]), pa.array([own]), codes], schema=_TILE)

    def walk(table: pa.Table) -> pa.Table:
        codes = [np.frombuffer(c, np.uint64) for _, c in sorted(zip(table.column("range").to_pylist(), table.column("codes").to_pylist(), strict=True))]
        index = GrayIndex(np.repeat(np.arange(len(codes)), [len(c) for c in codes]), np.concatenate(codes))
        labels = index.links(most, [(0, len(codes) - 1)])
        moved = np.flatnonzero(labels != np.arange(len(labels)))
        return pa.Table.from_batches([batch_of(_EDGE, pa.array(index.codes[moved].view(np.int64)), pa.array(index.codes[labels[moved]].view(np.int64)))])

    # a task for every pair of ranges or so, as long as there are no more than 4096
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(4096, len(name) * (len(name) + 1) // 2))
    tiles = ranges.select("range", "codes").mapInArrow(send, "a long, b long, range long, codes binary").repartition(tasks, "a", "b")
    out = stored(tiles.groupBy("a", "b").applyInArrow(walk, "a long, b long"), "near-edges")
    forget(ranges)
    return out


def near_duplicates(docs: DataFrame, most: int = MAX_BITS, shingle: int = SHINGLE, range_rows: int | None = None) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, kept, part, text_hash.

    part names the component whatever the ids: a fingerprint of it. text_hash is xxhash64 of the text.

    docs needs doc_id and text; other columns are ignored. Null text counts as no words.
    Documents without words share fingerprint zero and link like any other. A null doc_id
    gets a fingerprint and its component, but never names a component unless no document
    of it has an id (then null). Repeated rows give repeated result rows. A text of any length is
    hashed whole; an empty table gives an empty result. kept: the document
    with the smallest id of its component.
    """
    prints = stored(fingerprints(docs, shingle), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    parts = connected_components(near_edges(distinct.select("fp"), most, range_rows))
    named = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("part"))
    named = stored(named, "parts")
    small = named.groupBy("part").agg(F.min("rep").alias("component_id"))
    label = named.join(small, "part").select("fp", "component_id", "part")
    return prints.join(label, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        (F.col("doc_id") == F.col("component_id")).alias("kept"),
        "part",
        F.col("th").alias("text_hash"),
    )


def op4_simhash(spark, sf_dir) -> DataFrame:
    """Fingerprints and near-duplicate components of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("part", "text_hash")
