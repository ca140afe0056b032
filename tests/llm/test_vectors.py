"""Cover-tree near-dedup and top-k search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotweave.llm import covertree, knn, vectors

INF = float("inf")


def rows_of(seed, n=120, d=8):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=d)
        rows.append((i * 3, v))
        for _ in range(int(rng.integers(0, 4)) if i % 4 == 0 else 0):
            rows.append((1000 + len(rows), v + rng.normal(size=d) * rng.choice([0.0, 0.01, 0.2, 0.35])))
    centre = rng.normal(size=d)
    rows += [(3000 + k, centre + rng.normal(size=d) * 0.03) for k in range(60)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    odd = [(5000, None), (5001, [0.0] * d), (5002, [None] * d), (5003, [INF] + [1.0] * (d - 1)), (5004, []), (5005, [1.0, 2.0]), (5006, [2.0, 4.0]), (None, rows[0][1]), (5007, [float("nan")] * d)]
    return rows + odd + [rows[0], rows[0]]


def usable(i, v):
    return i is not None and v and all(x is not None and np.isfinite(x) for x in v)


def plain_links(rows, cosine=0.9):
    n = len(rows)
    link = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(n):
            (i, u), (j, v) = rows[a], rows[b]
            if a != b and usable(i, u) and usable(j, v) and len(u) == len(v) and any(u) and any(v):
                link[a, b] = np.dot(u, v) / np.sqrt(np.dot(u, u) * np.dot(v, v)) >= cosine
    label = list(range(n))
    for _ in range(n):
        new = [min([label[a], *[label[b] for b in np.flatnonzero(link[a])]]) for a in range(n)]
        if new == label:
            break
        label = new
    small = {}
    for a in range(n):
        if rows[a][0] is not None:
            small[label[a]] = min(rows[a][0], small.get(label[a], rows[a][0]))
    return sorted([(rows[a][0], int(link[a].sum()), small.get(label[a])) for a in range(n)], key=repr)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_links_and_components(spark, kind):
    rows = rows_of(1)
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, rep string, n int")
    got = covertree.near_vectors(df, block_rows=16).collect()
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in got], key=repr) == plain_links(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def check_tree(x, tree):
    """Every level holds all points in ranges; radii cover; a node's centre goes on in its first child; radii shrink."""
    for k, (start, stop, centre, radius, first) in enumerate(tree.levels):
        assert start[0] == 0 and stop[-1] == len(x) and (start[1:] == stop[:-1]).all()
        for a, b, c, r in zip(start, stop, centre, radius, strict=True):
            assert a <= c < b and np.linalg.norm(x[a:b] - x[c], axis=1).max() <= r + 1e-9
        if k + 1 < len(tree.levels):
            below = tree.levels[k + 1]
            assert (below[2][first[:-1]] == centre).all() and (below[0][first[:-1]] == start).all()
            if 0 < k + 1 < len(tree.levels) - 1:
                assert (below[3][below[1] - below[0] > 1] <= covertree.RADII[k] * 1.01).all()  # filled in single precision


def built(x, w):
    tree, order = covertree.CoverTree.build(x)
    return x[order], w[order], tree


@pytest.mark.parametrize("seed", range(3))
def test_walk_counts_like_all_pairs(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(90, 5))
    x[30:60] = x[0] + rng.normal(size=(30, 5)) * 0.02
    x[60:80] = x[1] + rng.normal(size=(20, 5)) * 0.4
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w = rng.integers(1, 4, 90)
    sides = [built(x[part], w[part]) for part in (slice(0, 50), slice(50, 90), slice(80, 81))]
    for side in sides:
        check_tree(side[0], side[2])
    for one, other in ((0, 1), (0, 2), (2, 1)):
        (a, wa, _), (b, wb, _) = sides[one], sides[other]
        counts, labels = covertree.Walk(sides[one], sides[other], 0.9).result()
        hit = a @ b.T >= 0.9
        assert counts.tolist() == [*(hit @ wb).tolist(), *(hit.T @ wa).tolist()]
        assert all(labels[i] == labels[j + len(a)] for i, j in zip(*np.nonzero(hit), strict=True))
    a, wa, _ = sides[0]
    counts, _ = covertree.Walk(sides[0], sides[0], 0.9).result()
    hit = a @ a.T >= 0.9
    np.fill_diagonal(hit, False)
    assert counts.tolist() == (hit @ wa).tolist()


@pytest.mark.parametrize("kind", ["groups", "dense", "mixed", "random"])
def test_large_blocks(kind):
    """4096 vectors: exact counts, nested levels, and most pairs cut or linked unopened where there is structure."""
    rng = np.random.default_rng(4)
    n, d = 4096, 32
    x = rng.normal(size=(n, d))
    if kind == "groups":
        x = np.repeat(rng.normal(size=(n // 64, d)), 64, axis=0) + rng.normal(size=(n, d)) * 0.02
    elif kind == "dense":
        x = rng.normal(size=d) + rng.normal(size=(n, d)) * 0.1
    elif kind == "mixed":
        x[: n // 2] = np.repeat(rng.normal(size=(n // 16, d)), 8, axis=0) + rng.normal(size=(n // 2, d)) * 0.1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = built(x, np.ones(n, np.int64))
    check_tree(side[0], side[2])
    walk = covertree.Walk(side, side, 0.9)
    counts, _ = walk.result()
    hit = side[0] @ side[0].T >= 0.9
    np.fill_diagonal(hit, False)
    assert counts.tolist() == hit.sum(axis=1).tolist()
    if kind == "groups":
        assert len(side[2].levels[2][0]) < n // 8 and walk.seen < n * n // 16 and walk.points < n * n // 64


def plain_top(rows, k, every):
    good = [(i, [int(np.floor(1024 * np.float64(x))) for x in v]) for i, v in rows if usable(i, v)]
    out = []
    for i in sorted({i for i, _ in good if i % every == 0}):
        q = next(v for j, v in good if j == i)
        found = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in good if j != i and len(v) == len(q))[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(16, 4), (4096, 512)])
def test_top_k(spark, blocks):
    rows = rows_of(2)
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, cell string, rank int")
    got = knn.top_k(df, F.col("vec_id") % 10 == 0, k=7, block_rows=blocks[0], query_rows=blocks[1])
    assert sorted(map(tuple, got.collect())) == plain_top(rows, 7, 10)


def test_top_k_of_an_id_in_many_rows(spark):
    rng = np.random.default_rng(5)
    near, far = np.array([4.0, 0, 0, 0]), np.array([0, 4.0, 0, 0])
    rows = [(0, near.tolist())] * 30 + [(i, (near * 0.2 + rng.normal(size=4) * 0.01 + (i % 2) * far).tolist()) for i in range(1, 60)]
    df = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<float>")
    rows = [(i, np.float32(v).tolist()) for i, v in rows]
    got = knn.top_k(df, F.col("vec_id") == 0, k=3, block_rows=4, query_rows=4)
    assert sorted(map(tuple, got.collect())) == plain_top(rows, 3, 1000)


def test_wide_components_stay_exact():
    q, v = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 1.0], [2.0**40, 0.0]])
    assert knn.scores(q, v[:1]).tolist() == [[2**60 + 1]]
    with pytest.raises(OverflowError):
        knn.scores(q, v)


@pytest.mark.parametrize("size", [1024, 128])
@pytest.mark.parametrize("kind", ["clusters", "random"])
def test_pivots_cut_what_lies_apart(spark, kind, size):
    """20,000 vectors in 64 tight clusters: few rows are visited; random ones stay exact. With small blocks the cells of a cluster of a third are cut in shells."""
    rng = np.random.default_rng(6)
    n, d = 20_000, 16
    of = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, 64, n))
    x = rng.normal(size=(64, d))[of] + rng.normal(size=(n, d)) * 0.01 if kind == "clusters" else rng.normal(size=(n, d))
    x = knn.integers(x)
    tree = vectors.PivotTree(list(x[:2048]), 142)
    cell, far = tree.assign(x)
    dealt = spark.createDataFrame([(i, int(c), float(f)) for i, (c, f) in enumerate(zip(cell, far, strict=True))], "vec_id long, cell long, far double").repartition(3)
    layout = vectors.Layout(dealt, "vec_id", tree, size)
    rows = {r.vec_id: r.block for r in layout.place(dealt).collect()}
    c = layout.cells[d]
    group = {(r.group, r.cell): r for r in layout.groups().collect()}
    block = np.array([rows[i] for i in range(n)])
    own = [group[b >> 32, k] for b, k in zip(block.tolist(), cell.tolist(), strict=True)]
    low, high = np.array([g.low for g in own]), np.array([g.high for g in own])
    assert len(rows) == n and np.unique(block, return_counts=True)[1].max() < size * 1.4 and c.rows.sum() == n
    assert all((b & 0xFFFFFFFF) < g.pieces for b, g in zip(block.tolist(), own, strict=True))
    assert (far >= low - 1e-9).all() and (far <= high + 1e-9).all()
    at = np.searchsorted(c.number, cell)
    layout.measure_inner(11)
    for k in range(len(c.number)):
        assert c.inner_rows[k] == (far[at == k] <= c.inner[k]).sum() and c.inner[k] <= c.high[k]
    assert c.large.any() == (c.rows.max() > size) and (size == 1024 or c.large.any())
    assert (c.inner[c.large] < c.high[c.large]).all()
    bounds = knn.Bounds(c, 11)
    least, floor = bounds.need(x[::100])
    score = x[::100] @ x.T
    tenth = -np.sort(-score, axis=1)[:, 10]
    assert (floor <= tenth).all()
    sent = least[:, at] <= high[None]  # a row goes where its group reaches far enough
    assert ((least[:, at] <= far[None]) | (score < tenth[:, None])).all() and (sent | (score < tenth[:, None])).all()
    share = sent.mean()
    assert share < 0.5 if kind == "clusters" else share <= 1


@pytest.mark.parametrize("sent", [vectors.PLACES_SENT, 0])
def test_groups_of_large_cells_meet(spark, monkeypatch, sent):
    """Few cells of many blocks: shells, pieces of equal distance, and the join that is no broadcast."""
    monkeypatch.setattr(vectors, "PLACES_SENT", sent)
    monkeypatch.setattr(vectors, "SAMPLE_ROWS", 4)
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=4) + rng.normal(size=(90, 4)) * 0.3, np.eye(4)[rng.integers(0, 4, 60)] * rng.choice([-1.0, 1.0], (60, 1)), rng.normal(size=(40, 4))])
    rows = [(i, np.float32(v).tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = covertree.near_vectors(df, block_rows=4).collect()
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in got], key=repr) == plain_links(rows)
    found = knn.top_k(df, F.col("vec_id") % 10 == 0, k=3, block_rows=4, query_rows=4)
    assert sorted(map(tuple, found.collect())) == plain_top(rows, 3, 10)


def test_pivots_stay_within_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SENT", 8 * 8 * 5)
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 8)))], "vec_id long, v array<double>")
    found = vectors.sample(df, "vec_id", 300, 8)
    tree = vectors.PivotTree([np.array(v) for v in found], 18)
    assert len(found) == 5 and sum(len(p) for p in tree.pivots.values()) <= 5


def test_empty_tables(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert covertree.near_vectors(df).count() == 0
    assert knn.top_k(df, F.col("vec_id") % 10 == 0).count() == 0


def test_a_block_is_sent_to_few_tasks():
    """What is sent of a block grows with the sides, which keep to the cores until a side is full."""
    assert [covertree.sides_of(b, 12) for b in (1, 3, 16, 73, 300)] == [1, 3, 6, 6, 6]
    assert covertree.sides_of(64 * 100, 12) == 100 and covertree.sides_of(64 * 100 + 1, 12) == 101


def test_many_blocks_on_few_sides(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    x = np.concatenate([centres[i % 12] + 0.05 * rng.normal(size=8) for i in range(300)]).reshape(-1, 8)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    links = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    monkeypatch.setattr(covertree, "SIDE_BLOCKS", 7)
    got = {r.vec_id: r.n_links for r in covertree.near_vectors(df, block_rows=16).collect()}
    assert [got[i] for i in range(300)] == links.tolist()
