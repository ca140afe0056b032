"""Batch corrections: DataFrame to DataFrame, keyed by an id."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.functions.lineage import cut, drop_cut
from spotweave.operators.knn import padded_graph
from spotweave.operators.linalg import summed_arrays
from spotweave.operators.probes import moments


def combat(df: DataFrame, batch: str, vector: str, out: str = "z", rounds: int = 100, tolerance: float = 1e-4) -> DataFrame:
    """Location and scale by batch, shrunk by empirical Bayes; the shrinkage runs on batch x dimension moments only."""
    rows = df.select(F.col(batch).cast("string").alias("b"), F.col(vector).alias("z"))
    table = moments(rows, ["b"]).collect()  # a row per batch and dimension
    names, dims = sorted({r["b"] for r in table}), 1 + max(r["pos"] for r in table)
    n, s, q = np.zeros((len(names), 1)), np.zeros((len(names), dims)), np.zeros((len(names), dims))
    for r in table:
        i = names.index(r["b"])
        n[i], s[i, r["pos"]], q[i, r["pos"]] = r["n"], r["s"], r["q"]
    total = n.sum()
    grand = s.sum(axis=0) / total
    mean = s / n
    pooled = np.maximum((q - n * mean**2).sum(axis=0) / total, 1e-12)
    gamma = (mean - grand) / np.sqrt(pooled)
    delta = np.maximum((q - n * mean**2) / np.maximum(n - 1, 1) / pooled, 1e-12)
    g0, t2 = gamma.mean(axis=1, keepdims=True), np.maximum(gamma.var(axis=1, ddof=1, keepdims=True), 1e-12)
    m, v = delta.mean(axis=1, keepdims=True), np.maximum(delta.var(axis=1, ddof=1, keepdims=True), 1e-12)
    a, b = (2 * v + m**2) / v, (m * v + m**3) / v
    ss = (q - 2 * s * grand + n * grand**2) / pooled  # about the grand mean, standardised
    sz = (s - n * grand) / np.sqrt(pooled)
    g, d = gamma.copy(), delta.copy()
    for _ in range(rounds):
        ng = (t2 * n * gamma + d * g0) / (t2 * n + d)
        nd = (0.5 * (ss - 2 * ng * sz + n * ng**2) + b) / (n / 2 + a - 1)
        change = max(np.abs(ng - g).max() / max(np.abs(g).max(), 1e-12), np.abs(nd - d).max() / max(np.abs(d).max(), 1e-12))
        g, d = ng, nd
        if change < tolerance:
            break
    scale = 1 / np.sqrt(d)
    shift = grand - scale * (grand + np.sqrt(pooled) * g)
    fix = df.sparkSession.createDataFrame([(k, [float(x) for x in scale[i]], [float(x) for x in shift[i]]) for i, k in enumerate(names)], "_b string, _scale array<double>, _shift array<double>")
    x = df.join(F.broadcast(fix), F.col(batch).cast("string") == F.col("_b"))  # a row per batch
    done = F.zip_with(F.zip_with(F.col(vector), F.col("_scale"), lambda a, b: a.cast("double") * b), F.col("_shift"), lambda a, b: a + b)
    return x.withColumn(out, done).drop("_b", "_scale", "_shift")


def bbknn(df: DataFrame, key: str, batch: str, vector: str, per_batch: int = 3) -> DataFrame:
    """Batch-balanced neighbour graph: `per_batch` nearest rows of every batch, self first."""
    x = df.select(F.col(key).alias("key"), F.col(batch).cast("string").alias("batch"), F.col(vector).cast("array<double>").alias("x"))
    return padded_graph(x, per_batch, by_batch=True)


class _Soft:
    """Soft assignments of rows to centres under the diversity penalty, from parameters alone: any pass can make them again."""

    def __init__(self, centres, seen, expected, theta: float, sigma: float):
        # seen, expected: blocks x clusters x batches; a block is judged by the other blocks' sums
        self.centres, self.theta, self.sigma = centres, theta, sigma
        rest, due = seen.sum(axis=0)[None] - seen, expected.sum(axis=0)[None] - expected
        self.penalty = ((np.maximum(due, 0) + 1) / (np.maximum(rest, 0) + 1)) ** theta

    def of(self, u: np.ndarray, batch: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(assignments, distances) of unit vectors."""
        far = 2 * (1 - u @ self.centres.T)
        w = np.exp(-(far - far.min(axis=1, keepdims=True)) / self.sigma) * self.penalty[block, :, batch]
        return w / np.maximum(w.sum(axis=1, keepdims=True), 1e-300), far


def _units(z: np.ndarray) -> np.ndarray:
    size = np.sqrt((z * z).sum(axis=1, keepdims=True))
    return z / np.where(size > 0, size, 1)


def _vectors(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def harmony(
    df: DataFrame, key: str, batch: str, vector: str, clusters: int | None = None, rounds: int = 20, theta: float = 2.0, sigma: float = 0.1, ridge: float = 1.0, out: str = "z", seed: int = 42,
    inner: int = 20, blocks: int = 20, tolerance: float = 1e-4, inner_tolerance: float = 1e-5, history: list | None = None,
) -> DataFrame:
    """Soft clusters penalised for batch imbalance, then a ridge regression on the batches in every cluster, until the objective settles.

    At most `rounds` rounds of at most `inner` passes; both end when the objective's relative change is under its tolerance.
    A pass is one job: rows are assigned block by block (blocks by a hash of the key, each judged by the sums of the other
    blocks in the passes before, of which the latest counts 1 / (1 + theta)), and tasks send the sums of clusters, batches and blocks, from which the driver has the next centres and the objective
    (distance, entropy and diversity terms). Only these sums leave the tasks. Offsets are taken off the original vectors in every round. clusters: a
    thirtieth of the rows by default, 100 at most. Centres start from rows in digest order. `history` gets the objective of every pass.
    """
    import pyarrow as pa

    from spotweave.functions.keys import digest

    spark = df.sparkSession
    rows = df.withColumn("_b", F.col(batch).cast("string")).withColumn("_z", F.col(vector).cast("array<double>"))
    shares = {r["_b"]: r["n"] for r in rows.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per batch
    names, total = sorted(shares, key=lambda x: (x is not None, x or "")), sum(shares.values())
    if not total:
        return df.withColumn(out, F.col(vector).cast("array<double>"))
    count = clusters or max(1, min(100, round(total / 30)))
    share = np.array([shares[b] / total for b in names])
    first = rows.select("_z", digest(seed, "harmony", key).alias("d")).orderBy("d").limit(count).collect()
    centres = _units(np.array([r["_z"] for r in first], float))
    count, dims = centres.shape
    now = cut(rows.select(F.col(key).alias("_key"), "_b", "_z", F.col("_z").alias("_now"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("_block")))
    shape = (blocks, count, len(names))

    def parts(column):
        return np.array([names.index(b) for b in column.to_pylist()])

    def summed(soft: _Soft, whole: bool):
        """One pass: cluster x batch sums by block, sums of unit vectors, distance and entropy terms; with `whole` the sums of the original vectors by cluster and batch."""

        def run(batches):
            seen, unit, terms = np.zeros(shape), np.zeros((count, dims)), np.zeros(2)
            offsets = np.zeros((count, len(names), dims) if whole else (1,))
            for x in batches:
                if not x.num_rows:
                    continue
                b, block, u = parts(x.column("_b")), x.column("_block").to_numpy(), _units(_vectors(x.column("_now")))
                r, far = soft.of(u, b, block)
                np.add.at(seen, (block, slice(None), b), r)
                unit += r.T @ u
                terms += (r * far).sum(), (r * np.log(np.maximum(r, 1e-300))).sum()
                if whole:
                    z = _vectors(x.column("_z"))
                    for i in np.unique(b):
                        offsets[:, i] += r[b == i].T @ z[b == i]
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (seen, unit, terms, offsets)], names=["seen", "unit", "terms", "offsets"])

        seen, unit, terms, offsets = summed_arrays(now.select("_b", "_block", "_z", "_now").mapInArrow(run, "seen binary, unit binary, terms binary, offsets binary"))
        return seen.reshape(shape), unit.reshape(count, dims), terms, offsets

    zero = np.zeros(shape)
    plain = _Soft(centres, zero, zero, 0.0, sigma)
    held, unit, terms, _ = summed(plain, False)
    step = 1 / (1 + theta)  # all blocks move at once, and a full step would overshoot by the penalty's power
    due = lambda s: s.sum(axis=2, keepdims=True) * share
    last_round = None
    for _ in range(rounds):
        last = None
        for _ in range(inner):
            centres = _units(unit)
            soft = _Soft(centres, held, due(held), theta, sigma)
            seen, unit, terms, offsets = summed(soft, True)
            held = held + step * (seen - held)
            o, e = seen.sum(axis=0), due(seen).sum(axis=0)
            objective = float(terms[0] + sigma * terms[1] + sigma * theta * (o * np.log((o + 1) / (e + 1))).sum())
            if history is not None:
                history.append(objective)
            if last is not None and abs(last - objective) < inner_tolerance * abs(last):
                break
            last = objective
        # ridge regression of the original vectors on the batches, weighted by each cluster's assignments; the intercept stays
        offsets, weights = offsets.reshape(count, len(names), dims), np.zeros((count, len(names), dims))
        o = seen.sum(axis=0)
        for k in range(count):
            a = np.zeros((len(names) + 1, len(names) + 1))
            a[0, 0], a[0, 1:], a[1:, 0] = o[k].sum(), o[k], o[k]
            a[1:, 1:] = np.diag(o[k] + ridge)
            y = np.concatenate([offsets[k].sum(axis=0)[None], offsets[k]])
            weights[k] = np.linalg.lstsq(a, y, rcond=None)[0][1:]

        def moved(batches, soft=soft, weights=weights):
            for x in batches:
                if not x.num_rows:
                    continue
                b, z = parts(x.column("_b")), _vectors(x.column("_z"))
                r, _ = soft.of(_units(_vectors(x.column("_now"))), b, x.column("_block").to_numpy())
                for i in np.unique(b):
                    z = np.where((b == i)[:, None], z - r @ weights[:, i], z)
                made = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, dims).astype(np.int32)), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([x.column("_key"), x.column("_b"), x.column("_z"), made, x.column("_block")], names=["_key", "_b", "_z", "_now", "_block"])

        kind = df.schema[key].dataType.simpleString()
        after = cut(now.mapInArrow(moved, f"_key {kind}, _b string, _z array<double>, _now array<double>, _block int"))
        drop_cut(now)
        now = after
        if last_round is not None and abs(last_round - objective) < tolerance * abs(last_round):
            break
        last_round = objective
    return df.join(now.select(F.col("_key").alias(key), F.col("_now").alias(out)), key)


def none(df: DataFrame, vector: str, out: str = "z") -> DataFrame:
    return df.withColumn(out, F.col(vector).cast("array<double>"))


METHODS = {"none": none, "combat": combat, "harmony": harmony, "bbknn": bbknn}
