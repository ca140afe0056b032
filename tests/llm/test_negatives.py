"""Hard negatives and wide-integer products against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotweave.llm import negatives
from spotweave.llm.negatives import Packed, hard_negatives

INF, NAN = float("inf"), float("nan")


@pytest.mark.parametrize("most,dim,rows", [(100, 64, 37), (3, 5, 8), (1 << 20, 3, 5), (1 << 40, 2, 3), (0, 4, 4)])
def test_products_are_exact(most, dim, rows):
    rng = np.random.default_rng(most % 97)
    v, a = (np.floor(rng.uniform(-most, most + 1, size=(n, dim))) for n in (rows, 6))
    want = [[sum(int(x) * int(y) for x, y in zip(r, c, strict=True)) for c in v] for r in a]
    if any(abs(x) >= 1 << 63 for r in want for x in r):
        with pytest.raises(OverflowError):
            Packed(v).scores(a)
    else:
        assert Packed(v).scores(a).tolist() == want


@pytest.mark.parametrize("sign", [-1, 1])
def test_products_of_one_sign(sign):
    v, a = sign * np.arange(12.0).reshape(4, 3), -sign * np.ones((2, 3)) * 7
    assert Packed(v).scores(a).tolist() == (a @ v.T).astype(int).tolist()
    assert Packed(v * 2.0**45).scores(a * 0 + 1).tolist() == [[int(x) << 45 for x in v.sum(axis=1)]] * 2
    assert Packed(v).scores(a * 0 - 2.0**52).shape == (2, 4)


def test_a_score_beyond_long_is_refused():
    with pytest.raises(OverflowError):
        Packed(np.full((1, 2), 2.0**40)).scores(np.full((1, 2), 2.0**40))


def plain(rows, is_anchor, scale=256.0, positives=5, count=3, low=50, high=95):
    """The rows in order of the operator's columns."""
    use = [(i, lab, [int(np.floor(scale * x)) for x in v]) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for anchor in {i for i, *_ in use if is_anchor(i)}:
        _, lab, a = min(((i, lab, v) for i, lab, v in use if i == anchor), key=lambda r: r[1:])
        near = sorted((-dot(a, v), i) for i, k, v in use if i != anchor and k == lab and len(v) == len(a))[:positives]
        for s, p in near:
            far = sorted((-dot(a, v), i) for i, k, v in use if k != lab and len(v) == len(a) and low * -s <= 100 * dot(a, v) <= high * -s)
            out += [(anchor, p, r + 1, i, -s, -t) for r, (t, i) in enumerate(far[:count])]
    return sorted(out)


def some_rows(seed, n=240, d=6):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=d)], int(rng.integers(0, 4))) for i in range(n)]
    rows += [(n + k, rows[3][1], 2) for k in range(60)]  # a group of copies
    rows += [(500, None, 1), (505, [], 1), (510, [NAN] * d, 1), (515, [1.0] * d, None), (520, [INF] + [0.0] * (d - 1), 0), (None, [1.0] * d, 1), (525, [None] * d, 1), (530, [1.0, 2.0], 1), (531, [1.0, 2.0], 1), (532, [0.6, 1.2], 2)]
    rows += [(535, [0.0] * d, 1), (540, [-1.0] * d, 1), rows[5], rows[5], (10, [0.5] * d, 3)]
    return rows


@pytest.mark.parametrize("kind,block,bundle", [("float", 16, 3), ("double", 50, 1), ("double", 4096, 16)])
def test_against_plain(spark, kind, block, bundle):
    rows = some_rows(1)
    df = spark.createDataFrame([(i, v, k, "x", 1) for i, v, k in rows], f"vec_id long, embedding array<{kind}>, label int, block string, n int")
    got = hard_negatives(df, F.col("vec_id") % 5 == 0, block_rows=block, group_rows=7, bundle=bundle)
    want = plain(rows, lambda i: i % 5 == 0)
    assert len(want) > 100 and sorted(map(tuple, got.collect())) == want


def test_large_components_go_by_long_integers(spark):
    rows = [(i, [v * 2.0**20 for v in x], k) for i, x, k in some_rows(2, n=60) if x and None not in x]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = hard_negatives(df, F.col("vec_id") % 5 == 0, block_rows=16)
    assert sorted(map(tuple, got.collect())) == plain(rows, lambda i: i % 5 == 0)


def test_a_window_of_a_negative_or_zero_score(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [-1.0, 0.0], 0), (2, [0.0, 1.0], 0), (3, [0.0, 5.0], 1), (4, [-0.7, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, hard_negatives(df, F.col("vec_id") == 0).collect()))
    assert got == [(0, 2, 1, 3, 0, 0)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    got = hard_negatives(df, F.col("vec_id") % 5 == 0)
    assert got.count() == 0 and got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_query_agrees_with_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    embeddings = duckdb.read_parquet(f"{sf}/embeddings.parquet")
    want = duckdb.query(negatives.OP13_SQL).df() if embeddings is not None else None
    got = negatives.op13_hard_negatives(spark, sf).toPandas()
    cols = list(got.columns)
    assert len(got) and sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want[cols].values.tolist()))
