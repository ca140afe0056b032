"""Near-duplicate vectors by dual traversal of cover trees.

Equal vectors collapse to one weighted row. The others are unit vectors under the chord
distance. Their tree's upper levels are pivots of a bounded sample (see vectors.py); units below
them are cells and shells of true radii, packed into blocks of about BLOCK_ROWS rows, and every
block has a cover tree of its own: nested levels of centres with halving radii, each node with
its true covering radius. Pairs of cells within reach are joined with their groups, and those within reach with
their blocks. Blocks are dealt to a few sides, a task gets the blocks of two sides and walks the pairs among them. Both trees of a pair are walked together, a level at a time: a pair of nodes is
cut when the centres are farther apart than the threshold plus both radii, and linked as a whole
when they are closer than the threshold minus both. Single points are decided by their cosine in
double precision, so pairs are exact. No list of pairs outlives a step: linked points are counted
and joined as they are found, and what leaves a task is a count and a component for each point.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, forget, joined, ragged, stored
from .components import connected_components
from .vectors import Layout, PivotTree, block_of, by_length, finite, sample

COSINE = 0.9
BLOCK_ROWS = 4096
#: Radii of the levels below the root; points are the last level.
RADII = tuple(2.0**-k for k in range(0, 7))
#: Pairs that a step of a walk looks at together, and centres whose balls are filled together.
STEP, BALLS = 1 << 20, 1024
#: Blocks of a side, of which a task holds two.
SIDE_BLOCKS = 64
_SLACK = 1e-9


class CoverTree:
    """Nested levels over unit vectors. Points are reordered so that a node's points are a range.

    levels[k] holds start and stop of each node's points, its centre (a position), its covering radius
    (the largest distance from the centre to a point of the node) and the first of its children in
    level k + 1 (one more entry ends the last). Level 0 is the root, the last level the points.
    A node's centre is the centre of its first child.
    """

    def __init__(self, levels: list[tuple]):
        self.levels = levels

    @classmethod
    def build(cls, x: np.ndarray, radii: tuple = RADII) -> tuple[CoverTree, np.ndarray]:
        """The tree, and the order of the points in it."""
        n = len(x)
        narrow = x.astype(np.float32)
        order, sizes, centre, levels = np.arange(n), np.array([n]), np.array([0]), []
        for r in (*radii, None):
            start = np.cumsum(sizes) - sizes
            dist = np.sqrt(((x[order] - x[np.repeat(centre, sizes)]) ** 2).sum(axis=1))
            radius = np.maximum.reduceat(dist, start)
            children, parts, heads, kept = np.ones(len(sizes), np.int64), [], [], []
            for k, (a, m) in enumerate(zip(start.tolist(), sizes.tolist(), strict=True)):
                own = order[a : a + m]
                if m == 1 or (r is not None and radius[k] <= r):
                    groups = [(int(centre[k]), own)]
                elif r is None:  # the last level: points, the centre first
                    groups = [(i, np.array([i])) for i in [int(centre[k]), *own[own != centre[k]].tolist()]]
                else:
                    groups = cls._cover(narrow, own, int(centre[k]), r)
                children[k] = len(groups)
                heads += [c for c, _ in groups]
                kept += [len(g) for _, g in groups]
                parts += [g for _, g in groups]
            levels.append([start, start + sizes, centre, radius, np.concatenate([[0], np.cumsum(children)])])
            order, sizes, centre = np.concatenate(parts), np.array(kept), np.array(heads)
            if len(sizes) == n:
                break
        levels.append([np.arange(n), np.arange(n) + 1, centre, np.zeros(n), np.arange(n + 1)])
        where = np.empty(n, np.int64)
        where[order] = np.arange(n)
        for level in levels:
            level[2] = where[level[2]]
        return cls([tuple(level) for level in levels]), order

    @staticmethod
    def _cover(x, own, centre, r):
        """A node's points in balls of radius r around some of them, the node's centre first. Single precision will do: true radii are measured."""
        points, least = x[own], np.float32(1 - r * r / 2)
        left = np.concatenate([np.flatnonzero(own == centre), np.flatnonzero(own != centre)])
        groups = []
        while len(left):
            heads = left[:BALLS]
            near = points[heads] @ points[left].T >= least
            near[np.arange(len(heads)), np.arange(len(heads))] = True
            open_ = np.ones(len(left), bool)
            for k, row in enumerate(near):
                if open_[k]:
                    inside = np.flatnonzero(row & open_)
                    open_[inside] = False
                    members = own[left[inside]]
                    groups.append((int(own[heads[k]]), members))
            left = left[open_]
        return groups

    def level(self, k: int) -> tuple:
        return self.levels[min(k, len(self.levels) - 1)]


class Walk:
    """Links between two trees (or inside one): weights linked to each point, and components.

    seen, opened, whole and points count the pairs of nodes looked at, those opened, those linked
    unopened, and the pairs of points decided by cosine; the others were cut.
    """

    def __init__(self, left, right, cosine: float):
        (self.xa, self.wa, self.ta), (self.xb, self.wb, self.tb) = left, right
        self.same = left is right
        self.fa, self.fb = self.xa.astype(np.float32), self.xb.astype(np.float32)
        self.error = (self.xa.shape[1] + 4) * 2.0**-23  # of a cosine in single precision
        self.cosine, self.t = cosine, math.sqrt(2 - 2 * cosine)
        self.na, self.nb = len(self.xa), len(self.xb)
        n = self.na + (0 if self.same else self.nb)
        self.offset = n - self.nb
        self.links, self.spans = np.zeros(n, np.int64), np.zeros(n + 1, np.int64)
        self.sum_a, self.sum_b = np.concatenate([[0], np.cumsum(self.wa)]), np.concatenate([[0], np.cumsum(self.wb)])
        self.labels = np.arange(n)
        self.seen = self.opened = self.whole = self.points = 0
        a, b = np.zeros(1, np.int32), np.zeros(1, np.int32)
        for k in range(1, max(len(self.ta.levels), len(self.tb.levels))):
            rest = [part for pairs in self._children(k, a, b) for part in [self._judge(k, *pairs)] if len(part[0])]
            if not rest:
                break
            a, b = (np.concatenate(side) for side in zip(*rest, strict=True))

    def _children(self, k, a, b):
        """Pairs of children (level k) of the pairs (a, b), with cosines of their centres; far ones are left out."""
        up_a, up_b = self.ta.level(k - 1), self.tb.level(k - 1)
        first_a, first_b = up_a[4], up_b[4]  # a tree that has ended stays at its points
        ca, cb, ra, rb = self.ta.level(k)[2], self.tb.level(k)[2], self.ta.level(k)[3], self.tb.level(k)[3]
        size_a, size_b = np.diff(first_a)[a], np.diff(first_b)[b]
        total = int((size_a * size_b).sum())
        rows, cols = np.unique(a), np.unique(b)
        wide_a, wide_b = np.diff(first_a)[rows], np.diff(first_b)[cols]
        i_all, j_all = ragged(first_a[rows], wide_a), ragged(first_b[cols], wide_b)
        self.seen += total
        if len(i_all) * len(j_all) <= 16 * total:  # one product of all with all, then those whose parents are a pair
            table = np.zeros((len(rows), len(cols)), bool)
            table[np.searchsorted(rows, a), np.searchsorted(cols, b)] = True
            of_a, of_b = np.repeat(np.arange(len(rows)), wide_a), np.repeat(np.arange(len(cols)), wide_b)
            every = bool(table.all())
            right, reach_b = self.fb[cb[j_all]].T.copy(), rb[j_all].astype(np.float32)
            step = max(1, STEP // len(j_all))
            for lo in range(0, len(i_all), step):
                i = i_all[lo : lo + step]
                cos = self.fa[ca[i]] @ right
                reach = np.minimum(2, np.float32(self.t + 1e-6) + ra[i].astype(np.float32)[:, None] + reach_b[None])
                good = cos >= 1 - np.float32(self.error + 1e-6) - reach * reach / 2
                if not every:
                    good &= table[of_a[lo : lo + step]][:, of_b]
                p, q = np.nonzero(good)
                yield i[p], j_all[q], cos[p, q]
            return
        ends = np.cumsum(size_a * size_b)
        lo = 0
        while lo < len(a):  # few of many: gathered
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STEP // 4, side="right")))
            wide = (size_a * size_b)[lo:hi]
            pair = np.repeat(np.arange(lo, hi), wide)
            at = np.arange(len(pair)) - np.repeat(np.cumsum(wide) - wide, wide)
            i, j = first_a[a[pair]] + at // size_b[pair], first_b[b[pair]] + at % size_b[pair]
            yield i, j, np.einsum("ij,ij->i", self.fa[ca[i]], self.fb[cb[j]])
            lo = hi

    def _judge(self, k, i, j, cos):
        """Cut, link or keep pairs of nodes of level k."""
        sa, ea, _, ra, _ = self.ta.level(k)
        sb, eb, _, rb, _ = self.tb.level(k)
        if self.same:
            keep = i <= j
            i, j, cos = i[keep], j[keep], cos[keep]
        both = ra[i] + rb[j]
        reach = np.minimum(2, self.t + both + _SLACK)
        keep = cos + self.error >= 1 - reach * reach / 2
        i, j, cos, both = i[keep], j[keep], cos[keep], both[keep]
        single = (ea[i] - sa[i] == 1) & (eb[j] - sb[j] == 1)
        inner = self.t - both - _SLACK
        whole = ~single & (inner > 0) & (cos - self.error >= 1 - inner * inner / 2)
        self._points(sa[i[single]], sb[j[single]], cos[single])
        self._bulk(i[whole], j[whole], sa, ea, sb, eb)
        rest = ~single & ~whole
        self.opened += int(rest.sum())
        self.whole += int(whole.sum())
        self.points += int(single.sum())
        return i[rest].astype(np.int32), j[rest].astype(np.int32)

    def _points(self, p, q, cos):
        """Pairs of points: sure ones by single precision and its error, the others by doubles."""
        if self.same:
            other = p != q
            p, q, cos = p[other], q[other], cos[other]
        good = cos >= self.cosine + self.error
        doubt = np.flatnonzero((cos >= self.cosine - self.error) & ~good)
        for lo in range(0, len(doubt), 65536):
            d = doubt[lo : lo + 65536]
            good[d] = np.einsum("ij,ij->i", self.xa[p[d]], self.xb[q[d]]) >= self.cosine
        p, q = p[good], q[good]
        if not len(p):
            return
        np.add.at(self.links, p, self.wb[q])
        np.add.at(self.links, q + self.offset, self.wa[p])
        self.labels = joined(self.labels, p, q + self.offset)

    def _bulk(self, i, j, sa, ea, sb, eb):
        """All points of two nodes are linked."""
        if not len(i):
            return
        own = (i == j) if self.same else np.zeros(len(i), bool)
        o = self.offset
        wb, wa = self.sum_b[eb[j]] - self.sum_b[sb[j]], self.sum_a[ea[i]] - self.sum_a[sa[i]]
        np.add.at(self.spans, sa[i], wb)
        np.add.at(self.spans, ea[i], -wb)
        np.add.at(self.spans, sb[j[~own]] + o, wa[~own])
        np.add.at(self.spans, eb[j[~own]] + o, -wa[~own])
        inside = ragged(sa[i[own]], ea[i[own]] - sa[i[own]])
        np.add.at(self.links, inside, -self.wa[inside])  # a point is no link of its own
        for lo in range(0, len(i), 4096):
            a, b = i[lo : lo + 4096], j[lo : lo + 4096]
            for side, (s, e), move in ((a, (sa, ea), 0), (b, (sb, eb), o)):
                wide = e[side] - s[side]
                self.labels = joined(self.labels, np.repeat(sa[a], wide), ragged(s[side], wide) + move)

    def result(self):
        """Positions (those of the right tree after the left's): linked weights, and component labels."""
        return self.links + np.cumsum(self.spans)[:-1], self.labels


_BLOCK = pa.schema([("block", pa.int64()), ("size", pa.int64()), ("reps", pa.binary()), ("weights", pa.binary()), ("v", pa.binary()), ("tree", pa.binary())])
_BLOCK_SQL = "block long, size long, reps binary, weights binary, v binary, tree binary"
_LINKS = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("label", pa.int64())])


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares of very large or small components are finite."""
    v = np.asarray(v, np.float64)
    v = v / np.abs(v).max(axis=-1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=-1, keepdims=True))


def _pack(table: pa.Table) -> pa.Table:
    """The rows of a block in the order of its cover tree, and the tree."""
    v = np.array(table.column("v").to_pylist(), table.schema.field("v").type.value_type.to_pandas_dtype())
    tree, order = CoverTree.build(_unit(v))
    reps, weights = table.column("rep").to_numpy()[order], table.column("n").to_numpy()[order]
    row = (table.column("block")[0].as_py(), len(v), reps.tobytes(), weights.tobytes(), v[order].tobytes(), pickle.dumps(tree.levels))
    return pa.table([[x] for x in row], schema=_BLOCK)


def sides_of(blocks: int, cores: int) -> int:
    """Sides that blocks are dealt to: pairs of sides are tasks, one and a half for every core, and a side has about SIDE_BLOCKS blocks at most."""
    few = next(t for t in range(1, cores + 3) if t * (t + 1) >= 3 * cores)
    return max(1, min(blocks, max(few, -(-blocks // SIDE_BLOCKS))))


def near_pairs_summary(distinct: DataFrame, cosine: float = COSINE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(rep, links, label) rows of distinct vectors (rep, n, v): partial link counts, and spanning pairs rep-label."""
    spark = distinct.sparkSession
    total, longest = distinct.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not total:
        return spark.createDataFrame([], "rep long, links long, label long")
    tree = PivotTree([_unit(r) for r in sample(distinct, "rep", total, longest)], math.isqrt(total - 1) + 1)
    kind = distinct.schema["v"].dataType.simpleString()
    schema = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("v", pa.list_(pa.float32() if "float" in kind else pa.float64())), ("cell", pa.int64()), ("far", pa.float64())])
    shared = spark.sparkContext.broadcast(tree)  # rows ** 0.5 pivots, within SENT bytes

    def assign(batches):
        for batch in batches:
            rows = batch.column("v").to_pylist()
            cell, far = np.zeros(len(rows), np.int64), np.zeros(len(rows))
            for at, x in by_length(rows):
                cell[at], far[at] = shared.value.assign(_unit(x))
            yield batch_of(schema, batch.column("rep"), batch.column("n"), batch.column("v"), pa.array(cell), pa.array(far))

    dealt = stored(distinct.mapInArrow(assign, f"rep long, n long, v {kind}, cell long, far double"), "cells")
    layout = Layout(dealt, "rep", tree, block_rows)
    blocks = layout.place(dealt).select("block", "rep", "n", "v").groupBy("block").applyInArrow(_pack, _BLOCK_SQL)
    # a row for every block and group that it may have a link with
    near = layout.near_groups(math.sqrt(2 - 2 * cosine)).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"), "group", "other", "other_pieces")
    near = stored(near.select(block_of(F.col("group"), F.col("piece")).alias("block"), "other", "other_pieces"), "near")

    width = np.dtype(f"f{4 if 'float' in kind else 8}")

    def walk(sent: pa.Table, asked: pa.Table) -> pa.Table:
        at = {block: i for i, block in enumerate(sent.column("block").to_pylist())}

        def side(block):
            size, reps, weights, v, levels = (sent.column(c)[at[block]].as_py() for c in _BLOCK.names[1:])
            return np.frombuffer(reps, np.int64), (_unit(np.frombuffer(v, width).reshape(size, -1)), np.frombuffer(weights, np.int64), CoverTree(pickle.loads(levels)))

        found, last = [], None
        for a, b in sorted(zip(asked.column("a").to_pylist(), asked.column("b").to_pylist(), strict=True)):
            if a != last:
                last, left = a, side(a)
            right = left if a == b else side(b)
            counts, labels = Walk(left[1], right[1], cosine).result()
            reps = left[0] if a == b else np.concatenate([left[0], right[0]])
            some = np.flatnonzero(counts)
            found.append(batch_of(_LINKS, pa.array(reps[some]), pa.array(counts[some]), pa.array(reps[labels[some]])))
        return pa.Table.from_batches(found, _LINKS)

    # blocks are dealt to `sides` and a task gets two sides, so a block is sent `sides` times and not once for every other block
    sides = sides_of(layout.blocks, spark.sparkContext.defaultParallelism)
    pairs = near.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("other_pieces") - 1))).select(F.col("block").alias("a"), block_of(F.col("other"), F.col("piece")).alias("b")).where("a <= b")
    one, two = (F.pmod(F.xxhash64(c), F.lit(sides)) for c in ("a", "b"))
    pairs = pairs.withColumns({"s": F.least(one, two), "t": F.greatest(one, two)})
    needs = pairs.select(F.col("a").alias("block"), "s", "t").unionByName(pairs.select(F.col("b").alias("block"), "s", "t")).distinct()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * sides * (sides + 1))
    dealt_to = lambda x: x.repartition(tasks, "s", "t").groupBy("s", "t")
    tiles = dealt_to(blocks.join(needs, "block")).cogroup(dealt_to(pairs.toDF("a", "b", "s2", "t2").select(F.col("s2").alias("s"), F.col("t2").alias("t"), "a", "b")))
    out = stored(tiles.applyInArrow(walk, "rep long, links long, label long"), "links")
    layout.close()
    forget(near)
    forget(dealt)
    return out


def near_vectors(vectors: DataFrame, cosine: float = COSINE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    vectors needs vec_id and embedding; other columns are ignored. Links are pairs with cosine
    >= `cosine` (above 0) in double precision, equal vectors included; n_links counts other rows. Vectors
    that are null, empty, zero or hold null or non-finite components link with nothing, nor do
    rows with a null vec_id or vectors of different lengths. Repeated rows link with each
    other. An empty table gives an empty result.
    """
    if not 0 < cosine < 1:
        raise ValueError("the cosine is between 0 and 1")
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind).alias("embedding"))
    good = F.col("vec_id").isNotNull() & finite() & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    keyed = rows.withColumn("h1", F.when(good, F.xxhash64("embedding"))).withColumn("h2", F.when(good, F.xxhash64(F.lit(11), "embedding")))
    distinct = stored(keyed.where("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("v")), "vectors")
    part = near_pairs_summary(distinct.select("rep", "n", "v"), cosine, block_rows)
    links = part.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(part.where("rep <> label").select(F.col("rep").alias("a"), F.col("label").alias("b")))
    named = distinct.select("h1", "h2", "rep", "n").join(links, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = keyed.select("vec_id", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op1_embedding_near_dedup(spark, sf_dir) -> DataFrame:
    """Links and components of all embeddings at cosine 0.9."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), good AS (
  SELECT vec_id, e FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
  ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.a = v.vec_id) AS n_links, min(reach.b) AS component_id,
       v.vec_id = min(reach.b) AS kept
FROM v JOIN reach ON reach.a = v.vec_id GROUP BY v.vec_id
"""
