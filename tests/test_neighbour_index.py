"""Leave-one-out neighbours by the index against brute force."""

import numpy as np
import pytest

from spotweave.operators import neighbour_index
from spotweave.operators.neighbour_index import Domain, leave_one_out_neighbours


def some_rows(seed, n=400, d=5, tight=False):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d)) * (30 if tight else 1)
    rows = []
    for i in range(n):
        dom, unit = "ab"[i % 3 > 0], f"u{i % 4}"
        z = centres[rng.integers(12)] + rng.normal(size=d) * [1, 2, 0.5, 1, 3] * (1 + 0.3 * (i % 4))
        rows.append((i, dom, unit, f"l{i % 5}", [float(v) for v in z]))
    rows += [(1000 + i, "alone", "u0", "x", [0.0] * d) for i in range(5)]
    rows += [(2000 + i, "a", f"u{i % 2}", "copy", [1.0] * d) for i in range(30)]  # ties
    return rows + [(3000, "pair", "u0", "x", [0.0] * d), (3001, "pair", "u1", "y", [1.0] * d)]


def plain(rows, k):
    out = {}
    for key, dom, unit, _, z in rows:
        train = [r for r in rows if r[1] == dom and r[2] != unit]
        if not train:
            continue
        m = np.array([r[4] for r in train])
        mean, sd = m.mean(axis=0), m.std(axis=0)
        sd = np.where(sd < 1e-8, 1, sd)
        dist = np.sqrt((((m - mean) / sd - (np.array(z) - mean) / sd) ** 2).sum(axis=1))
        order = sorted(range(len(train)), key=lambda j: (round(dist[j], 9), train[j][0]))[:k]
        out[key] = [(train[j][0], train[j][3], dist[j]) for j in order]
    return out


@pytest.mark.parametrize("seed,k,piece,tight", [(1, 5, 4096, False), (2, 3, 16, True), (3, 500, 50, False)])
def test_against_plain(spark, seed, k, piece, tight):
    rows = some_rows(seed, tight=tight)
    df = spark.createDataFrame(rows, "key long, domain string, unit string, label string, z array<double>").repartition(3)
    found, folds = leave_one_out_neighbours(df, k, piece)
    got = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got.setdefault(r.key, []).append((r.other, r.label, r.dist))
    want = plain(rows, k)
    assert got.keys() == want.keys()
    for key, near in want.items():
        assert [x[:2] for x in got[key]] == [x[:2] for x in near] and [x[2] for x in got[key]] == pytest.approx([x[2] for x in near])
    assert {(r.domain, r.unit): r.n_train for r in folds.collect()} == {(d, u): sum(r[1] == d and r[2] != u for r in rows) for d, u in {(r[1], r[2]) for r in rows if r[1] != "alone"}}


def test_cells_are_cut():
    """In tight clusters a query asks for few cells, and never misses one that holds a neighbour."""
    rng = np.random.default_rng(5)
    pivots = rng.normal(size=(64, 4)) * 50
    x = Domain(np.ones(4), pivots)
    for u in range(3):
        x.n[f"u{u}"], x.reach[f"u{u}"] = np.full(64, 20.0), np.full(64, 1.0 + u)
    x.close()
    need = x.need(pivots + 0.1, "u2", np.array([0.8, 1.0, 1.3, 1.1]), 5)
    assert need[np.arange(64), np.arange(64)].all() and need.sum() < 64 * 4


def test_shuffled_rows_stay_linear(spark, monkeypatch):
    """Every row lies in one cell once, whatever the number of units."""
    rows = [(i, "a", f"u{i % 40}", "l", [float(i % 7), float(i % 11)]) for i in range(800)]
    df = spark.createDataFrame(rows, "key long, domain string, unit string, label string, z array<double>")
    written = []
    own = neighbour_index.cut
    monkeypatch.setattr(neighbour_index, "cut", lambda x: written.append(own(x)) or written[-1])
    found, _ = leave_one_out_neighbours(df, 3)
    assert found.count() == 2400 and max(x.count() for x in written) == 800


def test_empty_table(spark):
    df = spark.createDataFrame([], "key long, domain string, unit string, label string, z array<double>")
    found, folds = leave_one_out_neighbours(df, 5)
    assert found.count() == 0 and folds.count() == 0


def test_queries_stream_past_a_piece(spark, monkeypatch):
    """No task gathers all queries of a piece: only the asking is a cogroup; a group that asks is small where there are many cells."""
    monkeypatch.setattr(neighbour_index, "OUT", 1)
    rows = some_rows(4)
    df = spark.createDataFrame(rows, "key long, domain string, unit string, label string, z array<double>").repartition(3)
    found, _ = leave_one_out_neighbours(df, 2, 16)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1 and "MapInArrow" in plan.replace("FlatMapCoGroupsInArrow", "")
    got = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got.setdefault(r.key, []).append(r.other)
    assert got == {key: [x[0] for x in near] for key, near in plain(rows, 2).items()}
