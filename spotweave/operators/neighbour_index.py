"""Leave-one-out neighbours over one index per domain, without a copy of the rows for each fold.

A domain (a tissue) holds units (donors, slides). A row's candidates are the rows of its domain in other
units, in coordinates scaled by the mean and deviation of those rows. The scaling of every fold is the domain's
additive moments less the unit's own. One Voronoi index serves all folds of a domain: rows lie in cells around
pivots of a bounded sample, in coordinates scaled by the whole domain. A fold's metric differs from that by a factor
for each dimension, so distances of the index, times the least and greatest factor, bound the fold's own. The index knows
how many rows of each unit a cell has and how far they lie from its pivot: that gives every query a distance that k of its
candidates surely keep, and the cells that may hold a nearer one. Queries travel to those cells, a row of the
table stays in one; what a cell answers is k rows a query. A cell of many rows is dealt in pieces.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotweave.functions.lineage import cut
from spotweave.operators.knn import STRIP, _least

#: Pivots come from at most SAMPLE_MOST rows; a piece of a cell has about PIECE rows, a group of queries ASKED.
SAMPLE_LEAST, SAMPLE_MOST, PIECE, ASKED = 1024, 1 << 16, 4096, 512
#: Bytes of pivots and cell counts that are sent to every task.
SENT = 1 << 28
#: Bytes of queries that a group of them sends out at most, however many cells they go to.
OUT = 1 << 25
TINY = 1e-8


def unit_moments(rows: DataFrame) -> DataFrame:
    """(domain, unit, n, s, q): sums of every dimension of z as arrays, added in batches before they are shuffled."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            z = batch.column("z").flatten().to_numpy().reshape(batch.num_rows, -1)
            code = pa.StructArray.from_arrays([batch.column(c) for c in ("domain", "unit")], names=["d", "u"])
            names = {}
            at = np.array([names.setdefault((x["d"], x["u"]), len(names)) for x in code.to_pylist()])
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.diff(at[order], prepend=-1))
            s, q = (np.add.reduceat(v[order], first, axis=0) for v in (z, z * z))
            keys = list(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(np.bincount(at).astype(np.int64)), pa.array(list(s), pa.list_(pa.float64())), pa.array(list(q), pa.list_(pa.float64()))],
                names=["domain", "unit", "n", "s", "q"],
            )

    part = rows.select("domain", "unit", "z").mapInArrow(run, "domain string, unit string, n long, s array<double>, q array<double>")
    return added(part, ["domain", "unit"])


def added(part: DataFrame, by: list[str]) -> DataFrame:
    """Sums n, s, q (arrays) added by keys."""
    one = part.groupBy(*by).agg(F.sum("n").alias("n"))
    long = part.select(*by, F.posexplode(F.arrays_zip("s", "q")).alias("pos", "e")).groupBy(*by, "pos").agg(F.sum("e.s").alias("s"), F.sum("e.q").alias("q"))
    whole = long.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "s", "q"))).alias("a"))
    return whole.join(one, by).select(*by, "n", F.col("a.s").alias("s"), F.col("a.q").alias("q"))


def _mean_sd(n, s, q):
    mean = F.transform(s, lambda v: v / n)
    sd = F.transform(F.arrays_zip(q.alias("q"), mean.alias("m")), lambda e: F.sqrt(F.greatest(e["q"] / n - e["m"] * e["m"], F.lit(0.0))))
    return mean, F.transform(sd, lambda d: F.when(d < TINY, 1.0).otherwise(d))


def fold_scaling(own: DataFrame) -> DataFrame:
    """(domain, unit, n_train, mean, sd, whole_sd) of the rows of a domain that are not the unit's; domains of one unit have none."""
    total = added(own, ["domain"]).select("domain", F.col("n").alias("_n"), F.col("s").alias("_s"), F.col("q").alias("_q"))
    x = own.join(total, "domain").where("_n > n")
    less = lambda a, b: F.zip_with(a, b, lambda p, r: p - r)
    x = x.select("domain", "unit", (F.col("_n") - F.col("n")).alias("n_train"), less("_s", "s").alias("s"), less("_q", "q").alias("q"), "_n", "_s", "_q")
    mean, sd = _mean_sd(F.col("n_train"), F.col("s"), F.col("q"))
    whole = _mean_sd(F.col("_n"), F.col("_s"), F.col("_q"))[1]
    return x.select("domain", "unit", "n_train", mean.alias("mean"), sd.alias("sd"), whole.alias("whole_sd"))


def _pivots(rows: DataFrame, scale: dict[str, np.ndarray], total: int) -> dict[str, np.ndarray]:
    """Scaled pivots of each domain: farthest-first in a sample by hash of the key, about rows ** 0.5 of all domains together."""
    want = min(SAMPLE_MOST, max(SAMPLE_LEAST, 4 * math.isqrt(total)))
    if total > 4 * want:
        rows = rows.where(F.xxhash64("key") < -(2**63) + int(2.0 * want / total * 2**64))
    found: dict[str, list] = {}
    for r in rows.select("domain", "z", F.xxhash64("key").alias("h")).orderBy("h").limit(want).collect():
        found.setdefault(r["domain"], []).append(r["z"])
    out = {}
    for d, sd in scale.items():
        x = np.array(found.get(d, [np.zeros(len(sd))])) / sd
        take, far = [0], ((x - x[0]) ** 2).sum(axis=1)
        most = max(1, round(math.sqrt(total) * len(x) / max(1, sum(map(len, found.values())))))
        while len(take) < min(most, len(x)) and far.max() > 0:
            take.append(int(far.argmax()))
            far = np.minimum(far, ((x - x[take[-1]]) ** 2).sum(axis=1))
        out[d] = x[take]
    return out


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * x @ y.T + (y * y).sum(axis=1)[None]))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


class Domain:
    """What every task knows of one domain: scaled pivots, and rows and reach of each unit in each cell."""

    def __init__(self, sd: np.ndarray, pivots: np.ndarray):
        self.sd, self.pivots = sd, pivots
        self.n, self.reach = {}, {}

    def close(self) -> None:
        cells = len(self.pivots)
        self.total = sum(self.n.values(), np.zeros(cells))
        names = list(self.reach)
        every = np.array([self.reach[u] for u in names]).reshape(len(names), cells)
        order = np.sort(every, axis=0)
        self.most, self.second = order[-1], order[-2] if len(names) > 1 else np.full(cells, -np.inf)

    def need(self, z: np.ndarray, unit: str, sd: np.ndarray, k: int) -> np.ndarray:
        """For queries of a unit and the cells: True where one of the k nearest rows of other units may lie."""
        none = np.zeros(len(self.pivots))
        rows = self.total - self.n.get(unit, none)
        # the reach of a cell over the other units' rows
        reach = np.where(self.reach.get(unit, none - 1) >= self.most, self.second, self.most)
        factor = self.sd / sd
        low, high = factor.min(), factor.max()
        apart = _apart(z / self.sd, self.pivots)
        slack = 1e-6 * (1 + apart)
        least, most = low * np.maximum(0, apart - reach - slack), high * (apart + reach + slack)
        some = rows > 0
        most, least = np.where(some, most, np.inf), np.where(some, least, np.inf)
        order = np.argsort(most, axis=1)
        held = np.cumsum(np.where(some, rows, 0)[order], axis=1)
        at = np.minimum((held < k).sum(axis=1), len(self.pivots) - 1)
        sure = np.take_along_axis(most, order, axis=1)[np.arange(len(z)), at]
        sure = np.where(held[:, -1] < k, np.inf, sure)
        return some & (least <= sure[:, None])


_ASKED = pa.schema([("domain", pa.string()), ("cell", pa.int64()), ("unit", pa.string()), ("keys", pa.binary()), ("z", pa.binary()), ("mean", pa.binary()), ("sd", pa.binary())])
_ASKED_SQL = "domain string, cell long, unit string, keys binary, z binary, mean binary, sd binary"
_PIECE = pa.schema([("domain", pa.string()), ("cell", pa.int64()), ("piece", pa.int64()), ("keys", pa.binary()), ("units", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("z", pa.binary())])
_PIECE_SQL = "domain string, cell long, piece long, keys binary, units array<string>, labels array<string>, z binary"


def leave_one_out_neighbours(rows: DataFrame, k: int, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """The k nearest rows of other units of the same domain for every row, and the folds.

    rows: key (long, unique), domain, unit, label (strings), z. Returns (domain, key, rank, other, label, dist), ties to the
    smaller key, and fold_scaling's (domain, unit, n_train, ...). Rows of a domain with one unit have no neighbours; rows with
    fewer than k candidates have those. Vectors of a domain have one length, without nulls. The result does not depend on the index.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col("key").cast("long").alias("key"), *[F.col(c).cast("string").alias(c) for c in ("domain", "unit", "label")], F.col("z").cast("array<double>").alias("z"))
    folds = cut(fold_scaling(unit_moments(rows)))
    total = rows.count()
    scale = {r["domain"]: np.array(r["whole_sd"]) for r in folds.select("domain", "whole_sd").dropDuplicates(["domain"]).collect()}  # a row per domain
    found = "domain string, key long, other long, label string, dist double"
    if not scale:
        return spark.createDataFrame([], "domain string, key long, rank int, other long, label string, dist double"), folds
    index = {d: Domain(scale[d], p) for d, p in _pivots(rows, scale, total).items()}
    if sum(x.pivots.nbytes for x in index.values()) > SENT:
        raise ValueError("the pivots are too large to send to every task")
    cells = spark.sparkContext.broadcast(index)  # its size is checked
    schema = pa.schema([("key", pa.int64()), ("domain", pa.string()), ("unit", pa.string()), ("label", pa.string()), ("z", pa.list_(pa.float64())), ("cell", pa.int64()), ("far", pa.float64())])

    def assign(batches):
        for batch in batches:
            domains = np.array(batch.column("domain").to_pylist(), object)
            cell, far = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for d in set(domains.tolist()):
                own = np.flatnonzero(domains == d)
                x, pivots = _matrix(batch.column("z").take(pa.array(own))) / cells.value[d].sd, cells.value[d].pivots
                for lo in range(0, len(own), step := max(1, STRIP // len(pivots))):
                    cell[own[lo : lo + step]] = _apart(x[lo : lo + step], pivots).argmin(axis=1)
                far[own] = np.sqrt(((x - cells.value[d].pivots[cell[own]]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(schema.field(c).type) for c in schema.names[:5]), pa.array(cell), pa.array(far)], schema=schema)

    with_folds = rows.join(F.broadcast(folds.select("domain").distinct()), "domain", "left_semi")  # a row per domain
    dealt = cut(with_folds.select(*schema.names[:5]).mapInArrow(assign, "key long, domain string, unit string, label string, z array<double>, cell long, far double"))
    stats = dealt.groupBy("domain", "unit", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("reach"))
    most = SENT // 64
    counted = stats.limit(most + 1).collect()  # cells and units, checked
    if len(counted) > most:
        raise ValueError("the index has too many cells and units to send to every task")
    for r in counted:
        d = index[r["domain"]]
        n = d.n.setdefault(r["unit"], np.zeros(len(d.pivots)))
        reach = d.reach.setdefault(r["unit"], np.full(len(d.pivots), -np.inf))
        n[r["cell"]], reach[r["cell"]] = r["n"], r["reach"]
    for d in index.values():
        d.close()
    full = spark.sparkContext.broadcast(index)
    pieces = {}
    for r in counted:
        pieces[r["domain"], r["cell"]] = pieces.get((r["domain"], r["cell"]), 0) + r["n"]
    where = spark.createDataFrame([(d, c, -(-n // piece)) for (d, c), n in pieces.items()], "domain string, cell long, pieces long")

    def pack(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, sort_keys=[("key", "ascending")])
        t = table.take(order)
        return pa.table([[t.column("domain")[0]], [t.column("cell")[0]], [t.column("piece")[0]], [t.column("key").to_numpy().tobytes()], [t.column("unit").to_pylist()], [t.column("label").to_pylist()], [_matrix(t.column("z")).tobytes()]], schema=_PIECE)

    def ask(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _ASKED.empty_table()
        domain, unit = key[0].as_py(), key[1].as_py()
        ids, z = left.column("key").to_numpy(), _matrix(left.column("z"))
        mean, sd = _matrix(right.column("mean"))[0], _matrix(right.column("sd"))[0]
        need, out = full.value[domain].need(z, unit, sd, k), []
        for c in np.flatnonzero(need.any(axis=0)).tolist():
            some = np.flatnonzero(need[:, c])
            out.append((domain, c, unit, ids[some].tobytes(), z[some].tobytes(), mean.tobytes(), sd.tobytes()))
        return pa.table(list(map(list, zip(*out, strict=True))) or [[] for _ in _ASKED], schema=_ASKED)

    def local(batches):
        """Pieces, each followed by the queries that need it: one piece is held, its queries pass."""
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                z = np.frombuffer(row["z"], np.float64)
                own = np.frombuffer(row["keys"], np.int64)
                if row["units"] is not None:
                    held, keys, units, labels = z.reshape(len(own), -1), own, np.array(row["units"], object), np.array(row["labels"], object)
                    continue
                mean, sd = np.frombuffer(row["mean"], np.float64), np.frombuffer(row["sd"], np.float64)
                other = np.flatnonzero(units != row["unit"])
                if not len(other):
                    continue
                x, y = (z.reshape(len(own), -1) - mean) / sd, (held[other] - mean) / sd
                r, c, dist = _least(x, y, _apart(x, y) ** 2, k)
                yield pa.RecordBatch.from_arrays([pa.array([row["domain"]] * len(r), pa.string()), pa.array(own[r]), pa.array(keys[other][c]), pa.array(labels[other][c].tolist(), pa.string()), pa.array(dist)], names=["domain", "key", "other", "label", "dist"])

    group = ["domain", "unit", "_g"]
    widest = max(x.pivots.size for x in index.values()) * 8
    sizes = stats.groupBy("domain", "unit").agg(F.ceil(F.sum("n") / max(1, min(ASKED, OUT // widest))).cast("long").alias("_parts"))
    asking = dealt.join(F.broadcast(sizes), ["domain", "unit"]).withColumn("_g", F.pmod(F.xxhash64("key"), F.col("_parts")))
    scaled = folds.join(F.broadcast(sizes), ["domain", "unit"]).withColumn("_g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    asked = asking.select(*group, "key", "z").groupBy(*group).cogroup(scaled.select(*group, "mean", "sd").groupBy(*group)).applyInArrow(ask, _ASKED_SQL)
    asked = asked.join(F.broadcast(where), ["domain", "cell"]).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))).drop("pieces")
    tile = ["domain", "cell", "piece"]
    held = dealt.join(F.broadcast(where), ["domain", "cell"]).withColumn("piece", F.pmod(F.xxhash64("key"), F.col("pieces")))
    packed = held.select(*tile, "key", "unit", "label", "z").groupBy(*tile).applyInArrow(pack, _PIECE_SQL)
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    held_rows = packed.select(*tile, F.lit(0).alias("_asks"), "keys", "z", "units", "labels", none("unit", "string"), none("mean", "binary"), none("sd", "binary"))
    asks = asked.select(*tile, F.lit(1).alias("_asks"), "keys", "z", none("units", "array<string>"), none("labels", "array<string>"), "unit", "mean", "sd")
    met = held_rows.unionByName(asks).repartition(*tile).sortWithinPartitions(*tile, "_asks")
    answers = met.mapInArrow(local, found)
    order = Window.partitionBy("domain", "key").orderBy("dist", "other")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), folds
