"""Line deduplication against a plain version."""

import hashlib

import pytest

from spotweave.llm import lines

BLANK = " \t\n\x0b\x0c\r"


def plain(rows, least=10):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(BLANK))
    owner = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= least:
                owner[key(x)] = min(i, owner.get(key(x), i))
    out = []
    for i, t in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if i is None or len(key(x)) < least or owner[key(x)] == i]
        out.append((i, len(every), len(every) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [
    (5, "A shared line here\nshort\n  a SHARED line here\t\nown five"),
    (2, "a shared line here\nshort\nunique to document two"),
    (9, " a shared line here\nÄ shared line here\nshort\n\n"),
    (9, "unique to document two\nrow of the same id"),
    (7, None),
    (8, ""),
    (None, "a shared line here\nunique to document two"),
    (11, "row of the same id\r\nown five own five"),
    (12, "own five own five\n" * 3000 + "unique to document two"),
    (11, "row of the same id\r\nown five own five"),
]


@pytest.mark.parametrize("batches,fanout", [(1, 2), (3, 2), (5, 2), (6, 3)])
def test_against_plain(spark, batches, fanout):
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in ROWS], "doc_id long, text string, n_lines string, pos int")
    got = lines.dedup_lines(df, batches=batches, fanout=fanout)
    assert sorted(map(tuple, got.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=repr) == plain(ROWS)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lines.dedup_lines(df).count() == 0


def test_runs_are_compacted(spark):
    store = lines.LineRuns(spark, fanout=2)
    for k in range(4):
        df = spark.createDataFrame([(k, f"line number {k:05d}\nthe line they all share")], "doc_id long, text string")
        gone = store.add(df).collect()
        assert (len(gone) == 0) == (k == 0)
    assert [len(x) for x in store.levels] == [0, 0, 1]
    assert store.runs()[0].count() == 5
    store.close()
