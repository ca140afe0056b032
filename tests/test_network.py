"""Data-parallel training against one machine, and gradients against differences."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotweave.functions.keys import digest_number
from spotweave.operators import models
from spotweave.operators.network import Adversarial, AdamW, Guided, Trainer

VALID = np.array([[1, 1, 0, 0], [0, 1, 1, 1]], bool)


def batch(rng, n=7):
    context = rng.integers(0, 2, n)
    domain = np.array([rng.choice(np.flatnonzero(VALID[c])) for c in context])
    return rng.normal(size=(n, 5)), rng.normal(size=(n, 3)), domain, context


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = Guided(4, 6)
    p, x = net.start(5, 3, 1, 1, rng), batch(rng)
    _, grads = net.sums(p, *x, 0.0, True)
    for w, g in zip(p, grads, strict=True):
        for at in [tuple(rng.integers(0, s) for s in w.shape) for _ in range(4)]:
            w[at] += 1e-6
            up = net.sums(p, *x, 0.0, False)[0].sum()
            w[at] -= 2e-6
            down = net.sums(p, *x, 0.0, False)[0].sum()
            w[at] += 1e-6
            assert g[at] == pytest.approx((up - down) / 2e-6, abs=1e-4)


def judged(net, p, x, y, domain, context):
    """The discriminator's own loss, written out row by row."""
    total = 0.0
    _, z, _ = net.encode(p, x)
    for i in range(len(x)):
        u = np.concatenate([z[i], np.eye(2)[context[i]]])
        s = np.maximum(u @ p[8] + p[9], 0) @ p[10] + p[11]
        ok = np.flatnonzero(VALID[context[i]])
        log = s[ok] - s[ok].max() - np.log(np.exp(s[ok] - s[ok].max()).sum())
        total -= (1 - net.smoothing) * log[ok.tolist().index(domain[i])] + net.smoothing * log.mean()
    return total


def test_the_reversed_gradient():
    rng = np.random.default_rng(1)
    net = Adversarial(4, 6, 5, VALID, 0.1)
    p, x = net.start(5, 3, 4, 2, rng), batch(rng)
    _, plain = net.sums(p, *x, 0.0, True)
    _, turned = net.sums(p, *x, 0.7, True)
    for k, w in enumerate(p):
        for at in [tuple(rng.integers(0, s) for s in w.shape) for _ in range(3)]:
            w[at] += 1e-6
            up = judged(net, p, *x)
            w[at] -= 2e-6
            down = judged(net, p, *x)
            w[at] += 1e-6
            slope = (up - down) / 2e-6
            if k >= 8:
                assert turned[k][at] == pytest.approx(slope, abs=1e-4)  # the discriminator descends
            elif k < 4:
                assert turned[k][at] - plain[k][at] == pytest.approx(-0.7 * slope, abs=1e-4)  # the encoder climbs
            else:
                assert turned[k][at] == plain[k][at]
    assert net.strength(0, 10) == 0 and net.strength(10, 10) == pytest.approx(0.5, abs=1e-3)


def data(spark, n=300):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 5))
    y = np.tanh(x @ rng.normal(size=(5, 3))) + rng.normal(size=(n, 3)) * 0.05
    rows = [(i, f"s{i % 4}", "ab"[i % 4 > 1], [float(v) for v in x[i]], [float(v) for v in y[i]]) for i in range(n)] + [(9999, "s0", "a", None, [0.0] * 3)]
    return x, y, spark.createDataFrame(rows, "key long, slide string, tissue string, x array<double>, y array<double>").repartition(3)


def test_equals_one_machine_on_the_same_batches(spark):
    x, y, df = data(spark)
    got = Trainer(Guided(3, 8), batches=3, epochs=3, seed=5).fit(df, "x", "y", "key")
    meta = df.where("key < 9999").select("key", F.pmod(F.xxhash64("key"), F.lit(3)).alias("b"), (digest_number(5, "network", "key") < int(0.1 * 2**32)).alias("v")).orderBy("key").collect()
    b, v = np.array([r.b for r in meta]), np.array([r.v for r in meta])
    scale = lambda a: (a - a[~v].mean(axis=0)) / a[~v].std(axis=0)
    u, w, net = scale(x), scale(y), Guided(3, 8)
    p = net.start(5, 3, 1, 1, np.random.default_rng(5))
    opt, hist = AdamW(p, 3e-3, 1e-2, 9), []
    for epoch in range(3):
        for k in np.random.default_rng([5, epoch]).permutation(3):
            own = (b == k) & ~v
            _, g = net.sums(p, u[own], w[own], None, None, 0.0, True)
            opt.step(p, [a / own.sum() for a in g])
        hist.append(net.sums(p, u[v], w[v], None, None, 0.0, False)[0].mean())
    assert got.history == pytest.approx(hist)
    z = {r.key: r.z for r in got.transform(df.where("x is not null"), "x", "key").collect()}
    best = got.p
    assert z[7] == pytest.approx(net.encode(best, u[7:8])[1][0].tolist())


def test_the_schedule_and_the_decay():
    w = [np.ones((2, 2)), np.ones(2)]
    opt = AdamW(w, 0.1, 0.5, 4)
    for _ in range(4):
        opt.step(w, [np.zeros((2, 2)), np.zeros(2)])
    rates = [0.1 * 0.5 * (1 + math.cos(math.pi * t / 4)) for t in range(4)]
    assert w[0][0, 0] == pytest.approx(np.prod([1 - r * 0.5 for r in rates])) and (w[1] == 1).all()


def test_an_adversary_hides_the_slides(spark):
    _, _, df = data(spark)
    net = models.DomainAdversarial(3, 8, 6, epochs=3, batches=2).fit(df, "x", "y", "key", "slide", "tissue")
    assert len(net.history) == 3 and net.history[-1] < net.history[0] * 1.2
    z = net.transform(df.where("x is not null"), "x", "key").collect()
    assert len(z) == 300 and all(len(r.z) == 3 and np.isfinite(r.z).all() for r in z)
    with pytest.raises(ValueError):
        models.Autoencoder(2, 4).fit(df.limit(0), "x", "y", "key")
