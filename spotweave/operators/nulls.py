"""Null distributions of sets of targets, thousands of permutations at a time.

Replicates are keys of one plan: each key's task gets the statistic in packed rows of its order, and what it
needs of the sets, and works off its replicates in numpy. A replicate costs a sort of the statistic (set means, where
one shuffle serves all sets) or as many draws as the set has members (running-sum scores, which change at hits
only). Shuffles inside strata are dealt by strata too: a task holds a slice of whole strata, and sums of sets add over
slices. Nothing of the statistic or of the sets passes through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotweave.operators.ranking import global_rank

#: Rows of a packed row, and rows of a statistic that a task holds at most.
PACK, MOST = 16384, 1 << 26
#: Slices that strata are dealt to, and members of sets whose values are taken at a time.
SLICES, STRIP = 16, 1 << 17
#: Replicates that one digest serves: it has four numbers of 32 bits.
PER_DIGEST = 4
#: Texts that are digested at a time: enough to hide what a call costs, few enough for the cache.
LANES = 16384
#: Hits from which a random set is scored in blocks.
MANY = 8192


def _packed(df: DataFrame, place: str, columns: dict[str, str], by: list[str] = ()) -> DataFrame:
    """Rows in binaries of up to PACK places each: the columns, by their numpy types, in order of the place (from 1); text as its bytes and their ends, runs as (long, times)."""
    x = df.withColumn("_part", F.floor((F.col(place) - 1) / PACK))
    kinds = ", ".join(f"{c} binary" for c in columns)

    def pack(table: pa.Table) -> pa.Table:
        rows = table.sort_by(place)
        out = [rows.column(c).slice(0, 1) for c in (*by, "_part")]
        for c, kind in columns.items():
            v = rows.column(c).combine_chunks()
            if kind == "text":
                raw = [t.encode() for t in v.to_pylist()]
                out.append(pa.array([np.array([len(raw), *map(len, raw)], np.int32).tobytes() + b"".join(raw)], pa.binary()))
            elif kind == "runs":
                runs = v.to_numpy(zero_copy_only=False).astype(np.int64)
                at = np.flatnonzero(np.diff(runs, prepend=~runs[0]))
                out.append(pa.array([np.stack([runs[at], np.diff(at, append=len(runs))], axis=1).tobytes()], pa.binary()))
            else:
                out.append(pa.array([v.to_numpy(zero_copy_only=False).astype(kind).tobytes()], pa.binary()))
        return pa.table(out, names=[*by, "_part", *columns])

    head = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)
    return x.select(*by, "_part", *dict.fromkeys([place, *columns])).groupBy(*by, "_part").applyInArrow(pack, f"{head}_part long, {kinds}")


def _to_every(df: DataFrame, keys: int) -> DataFrame:
    """The rows for every key, dealt so that keys seldom share a task."""
    return df.withColumn("_key", F.explode(F.sequence(F.lit(0), F.lit(keys - 1)))).repartition(8 * keys, "_key")


def _column(table: pa.Table, name: str, kind: str) -> np.ndarray:
    """A packed column, in order of the parts."""
    order = np.argsort(table.column("_part").to_numpy(), kind="stable")
    cells = [table.column(name)[i].as_buffer() for i in order.tolist()]
    return np.concatenate([np.frombuffer(c, kind) for c in cells]) if cells else np.zeros(0, kind)


def ended(raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts that follow each other in `raw` as rows of bytes, each ended by 0x80 and then zeros, and their lengths."""
    out = np.zeros((len(sizes), int(sizes.max(initial=0)) + 1), np.uint8)
    start = np.cumsum(sizes, dtype=np.int64) - sizes
    for k in range(out.shape[1] - 1):
        some = np.flatnonzero(sizes > k)
        out[some, k] = raw[start[some] + k]
    out[np.arange(len(sizes)), sizes] = 0x80
    return out, sizes


def _keys(df: DataFrame, times: int, share: float = 1.0) -> int:
    """Tasks that share the replicates of this share of the statistic: a few for every core, as each is sent all of the share."""
    return max(1, min(times, math.ceil(4 * share) * df.sparkSession.sparkContext.defaultParallelism))


_SHIFTS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).reshape(4, 4, 4).reshape(64).astype(np.uint32)
_SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(np.uint32)
_START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)


def digest_numbers(head: bytes, text: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(PER_DIGEST, texts) uint32: the digests md5(head + text) as big-endian numbers, whole arrays at a time; texts as `ended` gives them.

    A text that does not fit in one block of md5 with the head is digested by the library.
    """
    out, h = np.empty((PER_DIGEST, len(sizes)), np.uint32), len(head)
    for lo in range(0, len(sizes), LANES):
        part, size = text[lo : lo + LANES, : max(0, 56 - h)], sizes[lo : lo + LANES]
        n = len(size)
        used = max(1, min(14, -(-(h + part.shape[1]) // 4)))
        block = np.zeros((n, 4 * used), np.uint8)
        block[:, : min(h, 56)] = np.frombuffer(head[:56], np.uint8)
        block[:, h : h + part.shape[1]] = part
        words = dict(enumerate(np.ascontiguousarray(block.view("<u4").T)))
        words[14] = ((size + h) * 8).astype(np.uint32)
        a, b, c, d = (np.full(n, v, np.uint32) for v in _START)
        f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
        for i in range(64):
            if i < 16:
                g = i
                np.bitwise_xor(c, d, out=f)
                f &= b
                f ^= d
            elif i < 32:
                g = (5 * i + 1) % 16
                np.bitwise_xor(b, c, out=f)
                f &= d
                f ^= c
            elif i < 48:
                g = (3 * i + 5) % 16
                np.bitwise_xor(b, c, out=f)
                f ^= d
            else:
                g = (7 * i) % 16
                np.invert(d, out=f)
                f |= b
                f ^= c
            f += a
            f += _SINES[i]
            if g in words:
                f += words[g]
            np.left_shift(f, _SHIFTS[i], out=t)
            f >>= np.uint32(32) - _SHIFTS[i]
            f |= t
            f += b
            a, d, c, b, f = d, c, b, f, a
        for k, v in enumerate((a, b, c, d)):
            v += _START[k]
            out[k, lo : lo + n] = v.byteswap()
        for i in np.flatnonzero(size + h > 55).tolist():
            out[:, lo + i] = np.frombuffer(md5(head + text[lo + i, : size[i]].tobytes()).digest(), ">u4")
    return out


def _sliced(batches: Iterator[pa.RecordBatch], n: int) -> tuple[list, np.ndarray, list[int], pa.Array, np.ndarray, np.ndarray]:
    """What packed rows hold of a slice of n targets: texts (one pair of `ended` a packed row), values, the bounds of strata, the sets, their sizes and places.

    All is copied out, so no batch is kept. A long text widens the texts of its own packed row only.
    """
    value, texts, runs, own, kind = np.empty(n), {}, {}, {}, pa.null()
    for batch in batches:
        kind = batch.schema.field("source").type
        for i, (part, source) in enumerate(zip(batch.column("_part").to_pylist(), batch.column("source").to_pylist())):
            name, values, strata, places = (batch.column(c)[i].as_buffer() for c in ("name", "value", "stratum", "own"))
            if places is not None:
                own.setdefault(source, []).append((part, np.frombuffer(places, np.int32).copy()))
                continue
            m = int(np.frombuffer(name, np.int32, 1)[0])
            texts[part] = ended(np.frombuffer(name, np.uint8, -1, 4 * (m + 1)), np.frombuffer(name, np.int32, m, 4).copy())
            value[part * PACK : part * PACK + m] = np.frombuffer(values)
            runs[part] = np.frombuffer(strata, np.int64).reshape(-1, 2).copy()
    run = np.concatenate([np.zeros((0, 2), np.int64), *(runs[k] for k in sorted(runs))])
    last = np.flatnonzero(np.diff(run[:, 0], append=~run[-1:, 0]))
    cuts = [0, *np.cumsum(run[:, 1])[last].tolist()]
    sizes = np.array([sum(len(x) for _, x in p) for p in own.values()], np.int64)
    places, at = np.empty(sizes.sum(), np.int32), 0
    for p in own.values():
        for _, x in sorted(p, key=lambda e: e[0]):
            places[at : at + len(x)] = x
            at += len(x)
    return [texts[k] for k in sorted(texts)], value, cuts, pa.array(own, kind), sizes, places


def shuffled_sums(texts: list, value: np.ndarray, cuts: list[int], sizes: np.ndarray, places: np.ndarray, replicates: list[int], seed) -> Iterator[tuple[int, np.ndarray]]:
    """(replicate, sums of the sets' values after shuffling them inside strata); targets are in order of stratum and target, sets hold places one set after another.

    A target takes four numbers and one place to sort; what members need is taken a strip at a time.
    """
    n, ends, strips = len(value), np.cumsum(sizes), []
    for lo in range(0, len(places), STRIP):
        hi = min(lo + STRIP, len(places))
        some = slice(int(np.searchsorted(ends, lo, "right")), int(np.searchsorted(ends - sizes, hi, "left")))
        strips.append((lo, hi, some, np.maximum((ends - sizes)[some] - lo, 0)))
    numbers, at, lane, block = np.empty((PER_DIGEST, n), np.uint32), np.empty(n, np.uint64), np.arange(PACK, dtype=np.uint64), None
    for r in replicates:
        if r // PER_DIGEST != block:
            block, lo = r // PER_DIGEST, 0
            for text, length in texts:
                numbers[:, lo : lo + len(length)] = digest_numbers(f"{seed}|null|{block}|".encode(), text, length)
                lo += len(length)
        # a number above its place: sorting puts places in the order of their numbers, ties by place
        for lo in range(0, n, PACK):
            a = at[lo : lo + PACK]
            a[:] = numbers[r % PER_DIGEST, lo : lo + PACK]
            a <<= np.uint64(32)
            a |= lane[: len(a)] + np.uint64(lo)
        for lo, hi in pairwise(cuts):
            at[lo:hi].sort()
        out = np.zeros(len(sizes))
        for lo, hi, some, starts in strips:
            i = at.take(places[lo:hi], mode="clip")
            i &= np.uint64(0xFFFFFFFF)
            out[some] += np.add.reduceat(value.take(i.view(np.int64), mode="clip"), starts)
        yield r, out


def permutation_null(members: DataFrame, statistic: DataFrame, times: int, seed: int = 42, stratum: str | None = None) -> DataFrame:
    """(source, replicate, value): set means after shuffling the statistic, the same shuffle for all sets.

    members: source, target (those of the statistic); statistic: target, value. With a stratum the shuffle stays inside it (rows without one are a stratum of
    their own). Replicate r orders targets by number r % 4 of md5(seed|null|r // 4|target), ties by target.
    """
    group = F.coalesce(F.col(stratum).cast("long"), F.lit(-1)) if stratum else F.lit(0).cast("long")
    rows = statistic.select("target", F.col("value").cast("double").alias("value"), group.alias("stratum"), F.pmod(group, F.lit(SLICES)).cast("int").alias("_slice"))
    ranked, total = global_rank(rows, ["_slice", "stratum", "target"], "place")
    slices = {r["_slice"]: r for r in ranked.groupBy("_slice").agg(F.count(F.lit(1)).alias("n"), (F.min("place") - 1).alias("_before")).collect()}  # SLICES rows at most
    if any(s["n"] > MOST for s in slices.values()):
        raise ValueError(f"more than {MOST} targets in a slice of strata")
    spark, blocks, jobs = statistic.sparkSession, -(-times // PER_DIGEST), []
    for k, s in sorted(slices.items()):
        keys = _keys(statistic, blocks, s["n"] / total)
        jobs += [(k, s["n"], range(i, blocks, keys)) for i in range(keys)]
    before = spark.createDataFrame([(k, s["_before"]) for k, s in slices.items()], "_slice int, _before long")
    ranked = ranked.join(F.broadcast(before), "_slice").withColumn("place", F.col("place") - F.col("_before"))  # a row per slice
    left = _packed(ranked.withColumn("name", F.col("target").cast("string")), "place", {"name": "text", "value": "f8", "stratum": "runs"}, ["_slice"])
    own = members.select("source", "target").distinct().join(ranked.select("target", "_slice", "place"), "target")
    right = _packed(own.withColumn("own", F.col("place") - 1), "place", {"own": "i4"}, ["_slice", "source"])
    dealt = spark.createDataFrame([(job[0], i) for i, job in enumerate(jobs)], "_slice int, _key int")
    rows = left.unionByName(right, allowMissingColumns=True).join(F.broadcast(dealt), "_slice")  # a row per task
    kind = members.schema["source"].dataType.simpleString()

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, n, own_blocks = jobs[key[0].as_py()]
        texts, value, cuts, sources, sizes, places = _sliced(batches, n)
        replicates = [r for b in own_blocks for r in range(b * PER_DIGEST, min(times, (b + 1) * PER_DIGEST))] if len(sources) else []
        for r, sums in shuffled_sums(texts, value, cuts, sizes, places, replicates, seed):
            yield pa.RecordBatch.from_arrays([sources, pa.array(np.full(len(sums), r, np.int32)), pa.array(sums), pa.array(sizes)], names=["source", "replicate", "total", "size"])

    sums = rows.repartitionById(max(1, len(jobs)), "_key").groupBy("_key").applyInArrow(run, f"source {kind}, replicate int, total double, size long")
    if stratum:
        sums = sums.groupBy("source", "replicate").agg(F.sum("total").alias("total"), F.sum("size").alias("size"))
    return sums.select("source", "replicate", (F.col("total") / F.col("size")).alias("value"))


def ranking_hits(statistic: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Where sets stand in the ranking: the ranked targets (rank, weight), the hits (source, rank, weight), and the number of targets.

    Targets are ranked by value, highest first, ties by target; those without a value are left out. A weight is the size of the value.
    """
    some = statistic.where(F.col("value").isNotNull() & ~F.isnan("value")).select("target", F.col("value").cast("double").alias("value"))
    ranked, total = global_rank(some, [F.desc("value"), "target"], "rank")
    ranked = ranked.select("target", "rank", F.abs("value").alias("weight"))
    hits = members.select("source", "target").distinct().join(ranked, "target").select("source", "rank", "weight")
    return ranked, hits, total


def running_scores(hits: DataFrame, total: int) -> DataFrame:
    """(source, set_size, es): the extreme of each set's running sum, which rises by a hit's share of the weights and falls between hits.

    The sum has its highest and lowest values right at and right before hits, so only the set's own rows are looked at. Of equal
    extremes the first in the ranking counts. A set whose weights are all zero has equal shares.
    """
    by, way = Window.partitionBy("source"), Window.partitionBy("source").orderBy("rank")
    x = hits.withColumns({"_k": F.count(F.lit(1)).over(by), "_all": F.sum("weight").over(by), "_i": F.row_number().over(way), "_sum": F.sum("weight").over(way.rowsBetween(Window.unboundedPreceding, 0))})
    share = lambda weight, count: F.when(F.col("_all") > 0, weight / F.col("_all")).otherwise(count / F.col("_k"))
    missed = (F.col("rank") - F.col("_i")) / F.greatest(F.lit(total) - F.col("_k"), F.lit(1))
    before = share(F.col("_sum") - F.col("weight"), F.col("_i") - 1) - missed
    after = share(F.col("_sum"), F.col("_i")) - missed
    points = x.select("source", "_k", F.explode(F.array(F.struct(before.alias("v"), (2 * F.col("rank")).alias("at")), F.struct(after.alias("v"), (2 * F.col("rank") + 1).alias("at")))).alias("p"))
    return points.groupBy("source").agg(F.max("_k").alias("set_size"), F.max_by("p.v", F.struct(F.abs("p.v"), -F.col("p.at"))).alias("es"))


def _first_extreme(before: np.ndarray, after: np.ndarray) -> float:
    """The value furthest from zero among those right before and right after hits; of equal extremes the first counts."""
    i, j = np.abs(before).argmax(), np.abs(after).argmax()
    first, second = float(before[i]), float(after[j])
    return first if (abs(first), -i) >= (abs(second), -j) else second


def drawn_scores(weight: np.ndarray, size: int, replicate: int, seed: int) -> float:
    """The running-sum score of `size` hits drawn at random from the ranking.

    Many hits are summed in blocks: in a block the sum stays between its start less all misses there and its end without them, so only blocks
    that may hold the extreme are walked.
    """
    n = len(weight)
    at, misses = np.random.default_rng([seed, size, replicate]).choice(n, size, replace=False, shuffle=False).astype(np.int32), max(1, n - size)
    at.sort()
    w = weight.take(at, mode="clip")
    if size < MANY:
        total = w.sum()
        up = np.cumsum(w) / total if total > 0 else np.arange(1, size + 1) / size
        missed = (at - np.arange(size)) / misses
        return _first_extreme(np.concatenate([[0.0], up[:-1]]) - missed, up - missed)
    start = np.arange(0, size, 1 << int(np.log2(np.sqrt(size) / 8)))
    step, end = int(start[1]), np.append(start[1:], size) - 1
    sums = np.add.reduceat(w, start)
    if not sums.sum() > 0:
        w = np.ones(size)
        sums = np.add.reduceat(w, start)
    up = np.concatenate([[0.0], np.cumsum(sums)])
    total = up[-1]
    up /= total
    low, high = (at[start] - start) / misses, (at[end] - end) / misses
    found = max(np.abs(up[:-1] - low).max(), np.abs(up[1:] - high).max())
    look = np.flatnonzero(np.maximum(up[1:] - low, high - up[:-1]) >= found - 1e-9)  # far more than sums are off
    i = start[look][:, None] + np.arange(step)
    part = np.where(i < size, w.take(i, mode="clip"), 0.0)
    i = np.minimum(i, size - 1)
    rest = up[look][:, None] - (at[i] - i) / misses
    run = np.cumsum(part, axis=1)
    return _first_extreme(((run - part) / total + rest).ravel(), (run / total + rest).ravel())


def score_null(ranked: DataFrame, sizes: DataFrame, times: int, seed: int = 42) -> DataFrame:
    """(set_size, replicate, null_es) for every size: running-sum scores of random hits. Sets of one size share their null."""
    keys = _keys(ranked, times)
    left = _packed(ranked, "rank", {"weight": "f8"})
    right = sizes.select("set_size").distinct()

    def run(key, data: pa.Table, asked: pa.Table) -> pa.Table:
        weight = _column(data, "weight", "f8")
        if len(weight) > MOST:
            raise ValueError(f"more than {MOST} targets")
        found = [(k, r, drawn_scores(weight, k, r, seed)) for k in sorted(asked.column("set_size").to_pylist()) if k <= len(weight) for r in range(int(key[0].as_py()), times, keys)]
        k, r, es = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"set_size": pa.array(k, pa.int64()), "replicate": pa.array(r, pa.int32()), "null_es": pa.array(es, pa.float64())})

    sides = [_to_every(x, keys).groupBy("_key") for x in (left, right)]
    return sides[0].cogroup(sides[1]).applyInArrow(run, "set_size long, replicate int, null_es double")
