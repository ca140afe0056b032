"""What the vector operators share: usable rows, a tree of pivots, and the layout of rows in blocks.

Pivots come from a bounded sample and form two levels: about rows ** 0.25 top pivots, and under them
about rows ** 0.5 leaf pivots in all. A row goes down to a leaf's cell and keeps its distance to the
leaf pivot. Small cells that follow each other in the tree share a block. A cell with more rows than a
block is cut into shells by that distance; shells that follow each other are a group, and a group that is still too
large is dealt in pieces by a hash. All bounds come from pivots and the true least and greatest distances of cells and groups.

The driver and the tasks know the cells: never more than the sample has rows, nor more pivots than SENT bytes. Shells, groups
and blocks grow with the rows; they are tables that are joined, and never come to the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, stored

#: Bounds of the sample that pivots are chosen from: at least this many rows, 8 a pivot, and never more than the second.
SAMPLE_ROWS, SAMPLE_MOST = 2048, 1 << 17
#: Shells of equal width that a large cell is cut into at first.
SHELLS = 64
#: Bytes of pivots (and of their sample on the driver), and rows of the table of shells, that are sent to every task.
SENT, PLACES_SENT = 1 << 28, 1 << 20


def finite(column: str = "embedding") -> F.Column:
    """True for vectors that are not null or empty and have only finite components."""
    c = F.col(column)
    good = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & good, F.lit(False))


def sample(df: DataFrame, id_column: str, total: int, longest: int) -> list:
    """Vectors (column v) for pivots by a hash of the id: 8 for each of rows ** 0.5 pivots, within SAMPLE_ROWS and SAMPLE_MOST and at most SENT bytes of vectors of the longest length."""
    rows = max(1, min(SAMPLE_MOST, max(SAMPLE_ROWS, 8 * math.isqrt(total)), SENT // (8 * longest)))
    if total > 8 * rows:  # the smallest hashes come from a thin slice of the hash's range
        share = int(4.0 * rows / total * 2**64)
        df = df.where(F.xxhash64(id_column) < -(2**63) + share)
    return [r["v"] for r in df.select("v", F.xxhash64(id_column).alias("_h"), F.col(id_column).alias("_i")).orderBy("_h", "_i").limit(rows).collect()]


def farthest_first(x: np.ndarray, count: int) -> np.ndarray:
    """Up to `count` distinct rows: the first, then always the one farthest from those before it."""
    take, far = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(take) < min(count, len(x)) and far.max() > 0:
        take.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[take[-1]]) ** 2).sum(axis=1))
    return x[take]


def _nearest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return ((pivots * pivots).sum(axis=1)[None] - 2 * x @ pivots.T).argmin(axis=1)


def by_length(vectors: list):
    """(rows, matrix) for every length among the vectors."""
    sizes = np.fromiter(map(len, vectors), np.int64, len(vectors))
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, np.array([vectors[i] for i in rows], np.float64)


class PivotTree:
    """Two levels of pivots for each vector length; lengths that the sample lacks have one cell around zero."""

    def __init__(self, rows: list[np.ndarray], count: int):
        self.tops: dict[int, np.ndarray] = {}
        self.first: dict[int, np.ndarray] = {}
        self.pivots: dict[int, np.ndarray] = {}
        cells = 0
        for _, x in by_length(rows):
            d, share = x.shape[1], len(x) / len(rows)
            own = max(1, min(round(count * share), int(SENT * share / (8 * d))))
            tops = farthest_first(x[:4096], math.isqrt(own - 1) + 1)
            side = _nearest(x, tops)
            leaves = [farthest_first(np.concatenate([t[None], x[side == j][:4096]]), max(1, round(own * (side == j).mean()))) for j, t in enumerate(tops)]
            self.tops[d], self.pivots[d] = tops, np.concatenate(leaves)
            self.first[d] = cells + np.concatenate([[0], np.cumsum([len(p) for p in leaves])])
            cells += len(self.pivots[d])

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and distance to its pivot for rows of one length."""
        d = x.shape[1]
        if d not in self.tops:
            return np.full(len(x), -d), np.sqrt((x * x).sum(axis=1))
        first, base = self.first[d], self.first[d][0]
        top, cell = _nearest(x, self.tops[d]), np.zeros(len(x), np.int64)
        for j in np.unique(top):
            own = top == j
            cell[own] = _nearest(x[own], self.pivots[d][first[j] - base : first[j + 1] - base]) + first[j]
        return cell, np.sqrt(((x - self.pivots[d][cell - base]) ** 2).sum(axis=1))

    def pivot(self, cell: int) -> np.ndarray:
        if cell < 0:
            return np.zeros(-cell)
        for d, first in self.first.items():
            if first[0] <= cell < first[-1]:
                return self.pivots[d][cell - first[0]]
        raise KeyError(cell)


@dataclass
class Cells:
    """Cells of one vector length: pivot, least and greatest distance to it, rows, and the node they lie in.

    A node is a block of small cells, or one large cell. `inner_rows` of the rows are no farther than `inner`.
    """

    number: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray
    node: np.ndarray
    large: np.ndarray
    inner: np.ndarray
    inner_rows: np.ndarray


_SHELLS_SQL = "cell long, node long, shell int, n long, low double, high double, group long, pieces long"
_GROUPS_SQL = "node long, group long, cell long, low double, high double, pieces long"


class Layout:
    """Nodes, groups and blocks of dealt rows (columns cell, far and an id), one at least."""

    def __init__(self, dealt: DataFrame, id_column: str, tree: PivotTree, block_rows: int):
        self.id, self.spark = id_column, dealt.sparkSession
        span = F.count(F.lit(1)).alias("n"), F.min("far").alias("low"), F.max("far").alias("high")
        stats = sorted(dealt.groupBy("cell").agg(*span).collect())  # as many as pivots
        cell, n, low, high = (np.array(c) for c in zip(*stats, strict=True))
        dims, nodes, node, held, dim = [len(tree.pivot(c)) for c in cell.tolist()], [], -1, block_rows, None
        large = n > block_rows
        for own, rows, alone in zip(dims, n.tolist(), large.tolist(), strict=True):
            if alone or held + rows > block_rows or own != dim:
                node, held, dim = node + 1, 0, own
            held = block_rows if alone else held + rows
            nodes.append(node)
        nodes, dims = np.array(nodes, np.int64), np.array(dims, np.int64)
        #: Blocks, or a few less.
        self.blocks = len(np.unique(nodes[~large])) + int((-(-n[large] // block_rows)).sum())
        self.cells: dict[int, Cells] = {}
        for d in np.unique(dims).tolist():
            at = np.flatnonzero(dims == d)
            self.cells[d] = Cells(cell[at], np.array([tree.pivot(c) for c in cell[at].tolist()]), low[at], high[at], n[at], nodes[at], large[at], high[at].copy(), n[at].copy())
        width = [h / SHELLS if alone else None for h, alone in zip(high.tolist(), large.tolist(), strict=True)]
        self._nodes = self.spark.createDataFrame(list(zip(cell.tolist(), nodes.tolist(), width, strict=True)), "cell long, node long, width double")  # a row per cell
        small = np.flatnonzero(~large)
        self._small = self.spark.createDataFrame([(int(nodes[i]), int(nodes[i]) * SHELLS, int(cell[i]), float(low[i]), float(high[i]), 1) for i in small], _GROUPS_SQL)
        self._large, self._shells = int(large.sum()), None
        if self._large:
            shells = self._shelled(dealt).where("shell >= 0").groupBy("cell", "node", "shell").agg(*span)
            self._shells = stored(shells.groupBy("cell").applyInArrow(_grouped(block_rows), _SHELLS_SQL), "shells")

    def _shelled(self, dealt: DataFrame) -> DataFrame:
        """Rows with their node and shell, -1 in cells that are no larger than a block."""
        shell = F.when(F.col("width").isNull(), -1).when(F.col("width") == 0, 0).otherwise(F.least(F.floor(F.col("far") / F.col("width")), F.lit(SHELLS - 1)))
        return dealt.join(F.broadcast(self._nodes), "cell").withColumn("shell", shell.cast("int")).drop("width")  # a row per cell

    def place(self, dealt: DataFrame) -> DataFrame:
        """The rows with their block, which is a group and a piece of it."""
        rows, group, pieces = self._shelled(dealt), F.col("node") * SHELLS, F.lit(1)
        if self._shells is not None:
            where = self._shells.select("cell", "shell", "group", "pieces")
            # SHELLS rows per large cell; where they are many, a plain join, whose large keys Spark can split
            rows = rows.join(F.broadcast(where) if self._large * SHELLS <= PLACES_SENT else where, ["cell", "shell"], "left")
            group, pieces = F.coalesce("group", group), F.coalesce("pieces", pieces)
        return rows.withColumn("block", block_of(group, F.pmod(F.xxhash64(self.id), pieces))).drop("node", "shell", "group", "pieces")

    def groups(self) -> DataFrame:
        """(node, group, cell, low, high, pieces): a row per small cell and per group of shells of a large one."""
        if self._shells is None:
            return self._small
        large = self._shells.groupBy("node", "group", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("pieces").alias("pieces"))
        return self._small.unionByName(large)

    def measure_inner(self, rows: int) -> None:
        """Find for every large cell how near its nearest `rows` rows surely are, in whole shells."""
        if self._shells is None:
            return
        order = Window.partitionBy("cell").orderBy("shell")  # SHELLS rows
        x = self._shells.select("cell", F.sum("n").over(order).alias("n"), F.max("high").over(order).alias("high")).where(F.col("n") >= rows)
        found = sorted(x.groupBy("cell").agg(F.min("n"), F.min("high")).collect())  # a row per large cell
        if found:
            cell, n, high = map(np.array, zip(*found, strict=True))
            for c in self.cells.values():
                here = np.flatnonzero(np.isin(c.number, cell))
                at = np.searchsorted(cell, c.number[here])
                c.inner_rows[here], c.inner[here] = n[at], high[at]

    def near_groups(self, reach: float) -> DataFrame:
        """(group, pieces, other, other_pieces): both directions of all pairs of groups, each with itself too, that may hold rows at most `reach` apart."""
        cells = self.spark.sparkContext.broadcast(self.cells)  # pivots: their size is bounded
        step = {d: max(1, (1 << 20) // len(c.number)) for d, c in self.cells.items()}
        slices = [(d, lo) for d, c in self.cells.items() for lo in range(0, len(c.number), step[d])]

        def near(batches):
            for batch in batches:
                for d, lo in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    c = cells.value[d]
                    i = np.arange(lo, min(lo + step[d], len(c.number)))
                    apart, close = within_reach(c, i, reach)
                    a, b = np.nonzero(close & (i[:, None] <= np.arange(len(c.number))[None]))
                    apart = np.where(i[a] == b, 0.0, apart[a, b])
                    yield pa.RecordBatch.from_arrays([pa.array(c.number[i[a]]), pa.array(c.number[b]), pa.array(apart)], names=["cell", "other_cell", "apart"])

        found = self.spark.createDataFrame(slices, "d long, lo long").repartition(len(slices)).mapInArrow(near, "cell long, other_cell long, apart double")
        one = self.groups().drop("node")
        other = one.toDF("other", "other_cell", "other_low", "other_high", "other_pieces")
        room = F.lit(reach) + 1e-6 * (1 + F.col("apart"))
        close = (F.col("apart") - F.col("high") - F.col("other_high") <= room) & (F.col("low") - F.col("apart") - F.col("other_high") <= room) & (F.col("other_low") - F.col("apart") - F.col("high") <= room)
        pairs = found.join(one, "cell").join(other, "other_cell").where(close).select("group", "pieces", "other", "other_pieces")
        turned = pairs.select(F.col("other").alias("group"), F.col("other_pieces").alias("pieces"), F.col("group").alias("other"), F.col("pieces").alias("other_pieces"))
        return pairs.unionByName(turned).distinct()

    def close(self) -> None:
        """Delete the table of shells; no later plan may read it."""
        if self._shells is not None:
            forget(self._shells)


def block_of(group, piece):
    """The block of a piece of a group; columns."""
    return group * F.lit(1 << 32) + piece


def _grouped(block_rows: int):
    def run(table: pa.Table) -> pa.Table:
        """The shells of a cell in groups of about a block's rows: as many neighbours as fit, or one shell that has more."""
        t = table.sort_by("shell")
        group, held, size = [], 0, []
        for n in t.column("n").to_pylist():
            if not group or held + n > block_rows:
                size.append(0)
                held = 0
            held += n
            size[-1] += n
            group.append(len(size) - 1)
        base = t.column("node")[0].as_py() * SHELLS
        return t.append_column("group", pa.array([base + g for g in group], pa.int64())).append_column("pieces", pa.array([-(-size[g] // block_rows) for g in group], pa.int64()))

    return run


def within_reach(c: Cells, i: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """For cells i and all cells: how far the pivots are apart, and True where a pair of rows may be at most `reach` apart."""
    apart = np.sqrt(np.maximum(0, (c.pivot[i] ** 2).sum(axis=1)[:, None] + (c.pivot**2).sum(axis=1)[None] - 2 * c.pivot[i] @ c.pivot.T))
    room = reach + 1e-6 * (1 + apart)
    low, high = c.low[i][:, None], c.high[i][:, None]
    return apart, (apart - high - c.high[None] <= room) & (low - apart - c.high[None] <= room) & (c.low[None] - apart - high <= room)
