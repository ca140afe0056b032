"""Harmony against a plain version, connected parts, and principal components regression."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spotweave.functions.keys import digest
from spotweave.operators import correction, integration
from spotweave.operators.parts import connected_parts


def batches(n=240, d=4, seed=0):
    rng = np.random.default_rng(seed)
    kind, batch = rng.integers(0, 3, n), rng.integers(0, 2, n)
    z = np.eye(d)[kind] * 4 + rng.normal(size=(n, d)) * 0.4 + batch[:, None] * np.array([1.5, -1.0, 0.5, 2.0])[:d]
    return z, kind, batch


def frame(spark, z, kind, batch):
    return spark.createDataFrame([(i, f"b{b}", f"k{k}", [float(x) for x in v]) for i, (v, k, b) in enumerate(zip(z, kind, batch, strict=True))], "key long, batch string, label string, v array<double>").repartition(3)


def unit(x):
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def plain_harmony(z, batch, block, first, theta=2.0, sigma=0.1, ridge=1.0, rounds=20, inner=20, tol=1e-4, itol=1e-5):
    """The same steps on one machine, row by row where it is short."""
    n, share = len(z), np.bincount(batch) / len(z)
    nb, k, blocks = len(share), len(first), block.max() + 1
    now, y, hist, r = z.copy(), unit(first), [], None
    one = np.eye(nb)[batch]
    far = 2 * (1 - unit(now) @ y.T)
    r = np.exp(-far / sigma)
    r /= r.sum(axis=1, keepdims=True)
    held = np.stack([r[block == q].T @ one[block == q] for q in range(blocks)])
    prior = None
    for _ in range(rounds):
        last = None
        u = unit(now)
        for step in range(inner):
            # the first centres of a round come from the assignments to the vectors before they were moved
            y = unit(r.T @ (u if step or prior is None else before))
            far = 2 * (1 - u @ y.T)
            new = np.empty_like(r)
            for q in range(blocks):
                o = held.sum(axis=0) - held[q]
                e = np.outer(o.sum(axis=1), share)
                w = np.exp(-far / sigma) * (((e + 1) / (o + 1)) ** theta)[:, batch].T
                new[block == q] = (w / w.sum(axis=1, keepdims=True))[block == q]
            r = new
            held = held + (np.stack([r[block == q].T @ one[block == q] for q in range(blocks)]) - held) / (1 + theta)
            o = r.T @ one
            e = np.outer(o.sum(axis=1), share)
            obj = (r * far).sum() + sigma * (r * np.log(np.maximum(r, 1e-300))).sum() + sigma * theta * (o * np.log((o + 1) / (e + 1))).sum()
            hist.append(obj)
            if last is not None and abs(last - obj) < itol * abs(last):
                break
            last = obj
        before, now = u, z.copy()
        for c in range(k):
            x = np.concatenate([np.ones((n, 1)), one], axis=1)
            w = np.linalg.solve((x * r[:, [c]]).T @ x + np.diag([0] + [ridge] * nb), (x * r[:, [c]]).T @ z)
            now -= r[:, [c]] * (one @ w[1:])
        if prior is not None and abs(prior - obj) < tol * abs(prior):
            break
        prior = obj
    return now, hist


def test_harmony_equals_the_plain_version(spark):
    blocks = 7
    z, kind, batch = batches()
    df, hist = frame(spark, z, kind, batch), []
    got = correction.harmony(df, "key", "batch", "v", clusters=4, blocks=blocks, rounds=2, inner=6, history=hist)
    got = np.array([r.z for r in got.orderBy("key").collect()])
    ids = df.select("key", F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("q"), digest(42, "harmony", "key").alias("d")).orderBy("key").collect()
    first = z[np.argsort([r.d for r in ids], kind="stable")[:4]]
    want, plain_hist = plain_harmony(z, batch, np.array([r.q for r in ids]), first, rounds=2, inner=6)
    assert len(hist) == len(plain_hist) and hist == pytest.approx(plain_hist) and got == pytest.approx(want, abs=1e-8)


def test_harmony_settles_and_mixes(spark):
    z, kind, batch = batches(seed=3)
    df, hist = frame(spark, z, kind, batch), []
    done = correction.harmony(df, "key", "batch", "v", clusters=5, history=hist)
    print(hist)
    assert hist[-1] < hist[0] and len(hist) < 400
    assert integration.pcr(done, "z", "batch", 4) < 0.1 * integration.pcr(df, "v", "batch", 4)
    got = np.array([r.z for r in done.orderBy("key").collect()])
    centre = np.array([got[kind == k].mean(axis=0) for k in range(3)])
    assert (np.linalg.norm(got[:, None] - centre[None], axis=2).argmin(axis=1) == kind).mean() > 0.95


def test_harmony_of_no_rows(spark):
    df = spark.createDataFrame([], "key long, batch string, v array<double>")
    assert correction.harmony(df, "key", "batch", "v").count() == 0


def test_parts_of_long_chains_settle(spark):
    n = 700
    edges = [(i, i + 1) for i in range(n)] + [(5000, 5001), (5001, 5000), (6000, 6000)] + [(9000, 9000 + k) for k in range(1, 300)]
    got = {r.key: r.part for r in connected_parts(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(n + 1), 0), 5000: 5000, 5001: 5000, **dict.fromkeys(range(9000, 9300), 9000)}
    assert connected_parts(spark.createDataFrame([], "a long, b long")).count() == 0
    with pytest.raises(RuntimeError):
        connected_parts(spark.createDataFrame(edges, "a long, b long"), rounds=1)


def test_connectivity_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200) if i != 150], "key long, other long")
    label = spark.createDataFrame([(i, "a") for i in range(201)] + [(300, "b")], "key long, label string")
    assert integration.graph_connectivity(edges, label).first()[0] == pytest.approx((151 / 201 + 1) / 2)


def test_principal_components_regression(spark):
    z, kind, batch = batches(seed=5)
    x = z - z.mean(axis=0)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    p = x @ vt.T[:, :3]
    between = sum((batch == b).sum() * p[batch == b].mean(axis=0) ** 2 for b in (0, 1))
    assert integration.pcr(frame(spark, z, kind, batch), "v", "batch", 3) == pytest.approx(between.sum() / (p**2).sum())


def test_chi_square_tails_of_arrays():
    got = integration.chi_square_tail([0.0, 3.841458820694124, 18.307038053275146, 500.0, 5.0, 0.01], [3, 1, 10, 4, 0, 7])
    assert got[:3].tolist() == pytest.approx([1.0, 0.05, 0.05]) and got[3] < 1e-100 and got[4] == 1.0 and got[5] == pytest.approx(1.0, abs=1e-6)


def test_one_row_of_sums_reaches_the_driver(spark, monkeypatch):
    from spotweave.operators.linalg import summed_arrays

    def run(batches):
        for x in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.array([v, 2.0 * v]).tobytes() for v in x.column("id").to_pylist()], pa.binary())], names=["a"])

    kind, rows = type(spark.range(1)), []
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: rows.append(collect(self)) or rows[-1])
    part = spark.range(0, 40, 1, 40).mapInArrow(run, "a binary")
    assert summed_arrays(part)[0].tolist() == [780.0, 1560.0] and [len(r) for r in rows] == [1]
    assert not summed_arrays(part.where("false"))
