"""Substring deduplication against brute force."""

import hashlib
import re

import numpy as np
import pytest

from spotweave.llm import substrings


def plain(rows, k=13):
    split = [[w for w in re.split("[\x20\x09-\x0d]+", t or "") if w] for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, split, strict=True):
        if i is not None:
            for p in range(len(w) - k + 1):
                g = tuple(w[p : p + k])
                first[g] = min(i, first.get(g, i))
    out = []
    for (i, _), w in zip(rows, split, strict=True):
        gone = set()
        for p in range(len(w) - k + 1):
            if i is not None and first.get(tuple(w[p : p + k]), i) < i:
                gone |= set(range(p, p + k))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for n, x in enumerate(w) if n not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(seed):
    rng = np.random.default_rng(seed)
    word = lambda: rng.choice(["a", "bb", "é", "Don't", "x.", "the"]) + str(rng.integers(0, 30))
    passage = [word() for _ in range(40)]
    rows = []
    for i in range(40):
        w = [word() for _ in range(int(rng.integers(0, 90)))]
        if i % 3 == 0:
            a = int(rng.integers(0, 20))
            at = int(rng.integers(0, len(w) + 1))
            w[at:at] = passage[a : a + int(rng.integers(10, 40))]
        rows.append((int(rng.integers(0, 60)), [" ", "\n", "\t "][i % 3].join(w)))
    rows += [(100 + j, rows[5][1]) for j in range(5)]
    rows += [(None, " ".join(passage)), (7, None), (8, ""), (9, "w " * 4000), (300, "w " * 4001 + "end"), (301, "w " * 12 + "x"), (9, "w " * 4000), (9, " ".join(passage))]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rows = rows_of(seed)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, th string, bucket int")
    got = substrings.dedup_substrings(df.repartition(3), buckets=[1, 4, 16][seed])
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr) == plain(rows)


def test_levels_of_buckets(spark, monkeypatch):
    """More buckets than a level deals to: 8 bits, then 3 more."""
    monkeypatch.setattr(substrings, "FAN_OUT", 256)
    rows = rows_of(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert substrings._levels(11) == [8, 3] and substrings._levels(0) == [0]
    got = substrings.dedup_substrings(df.repartition(3), buckets=2048)
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr) == plain(rows)


def test_paths_on_the_grid():
    assert substrings._on_grid(5, 70, 60) == [(5, 4, 60), (9, 64, 64), (73, 2, 128)]
    assert substrings._on_grid(0, 3, 64) == [(0, 3, 64)]


@pytest.mark.parametrize("times", [1, 2])
def test_collisions_are_judged_again(spark, monkeypatch, times):
    """Windows whose hash falls together with that of another text of smaller id: a false repeat stays, a true one goes."""
    a, b = (" ".join(f"{x}{i}" for i in range(20)) for x in "ab")
    rows = [(1, a), (2, b), (3, a), (4, a + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    edges, seeds = substrings.repeated_edges, []
    th = {r.doc_id: r.th for r in df.selectExpr("doc_id", "xxhash64(text) th").collect()}

    def forged(docs, k, buckets, seed):
        seeds.append(seed)
        found = edges(docs, k, buckets, seed)
        if seed >= times:
            return found
        p = [substrings.planes(np.array([3]), 4), substrings.planes(np.array([1]), 8), substrings.planes(np.array([3]), 4)]
        q = [substrings.planes(np.arange(8), 4), substrings.planes(np.full(8, 2), 8), substrings.planes(np.arange(8), 4)]
        wrong = spark.createDataFrame([(2, th[2], *map(bytearray, p)), (3, th[3], *map(bytearray, q))], substrings._SOURCES_SQL)
        return found.where("doc_id <> 3").unionByName(wrong)

    monkeypatch.setattr(substrings, "repeated_edges", forged)
    got = substrings.dedup_substrings(df)
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == plain(rows)
    assert seeds == list(range(times + 1))


def test_empty_table(spark):
    assert substrings.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0
