"""Permutation nulls against brute force."""

import functools
import inspect
import tracemalloc
from hashlib import md5

import numpy as np
import pyarrow as pa
import pytest
from pyspark import AccumulatorParam
from pyspark.sql import GroupedData
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from spotweave.operators import biosignal, nulls


@pytest.fixture
def data(spark):
    rng = np.random.default_rng(8)
    value = [float(v) for v in rng.normal(size=120)]
    sets = {"up": list(range(6)), "mixed": list(range(0, 120, 10)), "all": list(range(120)), "few": [1, 2], "half": list(range(60))}
    for i in range(6):
        value[i] += 3
    stat = spark.createDataFrame([(f"g{i:03d}", v, i % 3) for i, v in enumerate(value)] + [("none", None, 0)], "target string, value double, stratum int").repartition(5)
    net = spark.createDataFrame([(s, f"g{i:03d}", 1) for s, m in sets.items() for i in [*m, m[0]]] + [("up", "absent", 1)], "source string, target string, rank int").repartition(4)
    return np.array(value), sets, stat, net


def walk(hit, weight):
    """The running sum over all targets."""
    up = np.where(hit, weight, 0.0)
    run = np.cumsum(up / up.sum()) - np.cumsum(~hit) / max(1, (~hit).sum())
    return run[np.abs(run).argmax()]


def test_running_sums(data):
    value, sets, stat, net = data
    order = np.argsort(-value, kind="stable")
    _, hits, n = nulls.ranking_hits(stat, net)
    got = {r.source: (r.set_size, r.es) for r in nulls.running_scores(hits, n).collect()}
    assert n == 120
    for s, m in sets.items():
        hit = np.isin(order, m)
        assert got[s] == (len(m), pytest.approx(walk(hit, np.abs(value[order]))))


def test_draws_equal_whole_walks():
    weight = np.abs(np.random.default_rng(1).normal(size=50))
    for size in (1, 5, 49, 50):
        for r in range(20):
            at = np.random.default_rng([7, size, r]).choice(50, size, replace=False, shuffle=False)
            hit = np.isin(np.arange(50), at)
            assert abs(nulls.drawn_scores(weight, size, r, 7)) == pytest.approx(abs(walk(hit, weight)))


def test_enrichment(data):
    value, sets, stat, net = data
    times = 2000
    got = {r.source: r for r in biosignal.enrichment_scores(stat, net, times=times).collect()}
    assert sorted(got) == ["all", "half", "mixed", "up"]  # `few` is too small
    weight = np.abs(value[np.argsort(-value, kind="stable")])
    for s, r in got.items():
        null = np.array([nulls.drawn_scores(weight, len(sets[s]), k, 42) for k in range(times)])
        side = np.abs(null[np.sign(null) == np.sign(r.es)])
        assert r.norm == pytest.approx(r.es / side.mean()) and r.pval == pytest.approx(max(1 / times, (side >= abs(r.es)).mean()))
    assert got["up"].pval < 0.05 < got["mixed"].pval and all(r.padj >= r.pval for r in got.values())


@pytest.mark.parametrize("stratum", [None, "stratum"])
def test_shuffles(data, stratum):
    value, sets, stat, net = data
    stat = stat.where("value is not null")
    got = {(r.source, r.replicate): r.value for r in nulls.permutation_null(net.where("target <> 'absent'"), stat, 9, 42, stratum).collect()}
    assert len(got) == 9 * len(sets)
    for r in range(9):
        number = [md5(f"42|null|{r // 4}|g{i:03d}".encode()).hexdigest()[8 * (r % 4) : 8 * (r % 4) + 8] for i in range(120)]
        moved = np.empty(120)
        for s in range(3) if stratum else [None]:
            own = [i for i in range(120) if s is None or i % 3 == s]
            moved[own] = value[sorted(own, key=lambda i: (number[i], i))]
        for s, m in sets.items():
            assert got[s, r] == pytest.approx(moved[m].mean())


def test_set_means_at_ten_thousand(data):
    _, _, stat, net = data
    stat = stat.where("value is not null")
    got = {r.source: r for r in biosignal.set_mean_tests(biosignal.set_members(net, stat, 1), stat).collect()}
    assert got["up"].pval == 1e-4 and got["all"].pval == 1.0 and 0.05 < got["mixed"].pval < 1


def test_empty_tables(spark):
    stat = spark.createDataFrame([], "target string, value double")
    net = spark.createDataFrame([], "source string, target string")
    assert biosignal.enrichment_scores(stat, net, times=10).count() == 0
    assert biosignal.set_mean_tests(biosignal.set_members(net, stat, 1), stat, 10).count() == 0


def test_digests_of_whole_arrays():
    texts = [b"", b"g1", "\u00e9t\u00e9".encode(), b"x" * 43, b"x" * 44, b"x" * 45, b"y" * 300, *(str(i).encode() for i in range(9000))]
    text, sizes = nulls.ended(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int32))
    for head in (b"42|null|0|", b"42|null|2499|", b"z" * 70):
        want = np.frombuffer(b"".join(md5(head + t).digest() for t in texts), ">u4").reshape(-1, 4).T
        assert (nulls.digest_numbers(head, text, sizes) == want).all()


def test_the_statistic_is_sent_to_few_tasks(data, spark):
    """The statistic travels once for each task that shares the replicates: that number does not follow the shuffle partitions."""
    _, _, stat, _ = data
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "400")
    try:
        assert nulls._keys(stat, 10_000) == 4 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert nulls._keys(stat, 3) == 3


def test_members_are_made_once(spark, data):
    _, _, stat, net = data
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    g = stat.where("value is not null")
    members = biosignal.set_members(net, g, 2).localCheckpoint()
    counted = members.mapInArrow(count, members.schema)
    assert biosignal.set_mean_tests(counted, g, 8).count() == 5
    assert made.value == members.count()


@pytest.mark.parametrize("kind", ["normal", "equal", "zero", "skewed"])
def test_large_sets_walk_few_hits(kind, monkeypatch):
    """The extreme of a large random set is that of the whole walk, but only blocks that may hold it are walked."""
    rng = np.random.default_rng(4)
    n = 300_000
    weight = {"normal": np.abs(rng.normal(size=n)), "equal": np.ones(n), "zero": np.zeros(n), "skewed": rng.exponential(size=n) ** 4}[kind]
    walked = []
    extreme = nulls._first_extreme
    monkeypatch.setattr(nulls, "_first_extreme", lambda before, after: walked.append(len(before)) or extreme(before, after))
    for size in (nulls.MANY, 12_345, 100_000, n):
        for r in range(3):
            hit = np.zeros(n, bool)
            hit[np.random.default_rng([7, size, r]).choice(n, size, replace=False, shuffle=False)] = True
            want = walk(hit, weight if weight.any() else np.ones(n))
            assert nulls.drawn_scores(weight, size, r, 7) == pytest.approx(want, abs=1e-9)
            assert kind == "skewed" or size == n or walked[-1] < size / 2


def test_shuffles_in_strata_of_any_number(spark):
    """Strata that share a slice, negative and large ones and rows without one; names that are longer than a block of md5; sets that lie in some strata only."""
    strata = [0, 16, -16, None, 3, 10**12]
    names = [f"g{i:03d}" + "x" * (60 if i % 7 == 0 else 0) for i in range(90)]
    value = np.random.default_rng(5).normal(size=90)
    sets = {"first": list(range(0, 90, 6)), "mixed": list(range(0, 90, 4)), "all": list(range(90)), None: [3, 9, 10]}
    stat = spark.createDataFrame([(names[i], float(value[i]), strata[i % 6]) for i in range(90)], "target string, value double, stratum long").repartition(4)
    net = spark.createDataFrame([(s, names[i]) for s, m in sets.items() for i in m], "source string, target string").repartition(3)
    got = {(r.source, r.replicate): r.value for r in nulls.permutation_null(net, stat, 6, 42, "stratum").collect()}
    assert len(got) == 6 * len(sets)
    for r in range(6):
        moved = np.empty(90)
        for s in range(6):
            own = sorted(range(s, 90, 6), key=lambda i: names[i])
            number = {i: md5(f"42|null|{r // 4}|{names[i]}".encode()).hexdigest()[8 * (r % 4) : 8 * (r % 4) + 8] for i in own}
            moved[own] = value[sorted(own, key=lambda i: (number[i], names[i]))]
        for s, m in sets.items():
            assert got[s, r] == pytest.approx(moved[m].mean())


def test_sums_by_strips(monkeypatch):
    """Members that are looked up a few at a time sum to the same: sets end inside strips, on their bounds, and span several."""
    rng, n = np.random.default_rng(6), 500
    sizes = np.array([1, 6, 7, 14, 100, 3, 200])
    places = np.concatenate([np.sort(rng.choice(n, k, replace=False)) for k in sizes]).astype(np.int32)
    texts = [nulls.ended(np.frombuffer(b"".join(b"%03d" % i for i in range(lo, hi)), np.uint8), np.full(hi - lo, 3, np.int32)) for lo, hi in ((0, 300), (300, n))]
    value = rng.normal(size=n)
    run = lambda: [x for _, x in nulls.shuffled_sums(texts, value, [0, 120, n], sizes, places, [2, 5, 7], 42)]
    whole = run()
    monkeypatch.setattr(nulls, "STRIP", 7)
    assert np.allclose(whole, run(), rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize(("stratum", "each"), [("stratum", 35), (None, 75)])
def test_a_task_holds_one_slice_of_strata(spark, monkeypatch, stratum, each):
    """What a worker allocates at most: shuffles in strata need a stratum at a time, and a target takes its text once and a few numbers."""

    class Most(AccumulatorParam):
        def zero(self, value):
            return 0

        def addInPlace(self, a, b):
            return max(a, b)

    peak, n = spark.sparkContext.accumulator(0, Most()), 200_000

    def traced(apply):
        def apply_traced(self, func, schema):
            @functools.wraps(func)
            def run(*args):
                import pandas  # noqa: F401 - a worker's first call loads it

                tracemalloc.start()
                out = func(*args)
                out = out if isinstance(out, pa.Table) else list(out)
                peak.add(tracemalloc.get_traced_memory()[1])
                tracemalloc.stop()
                return out if isinstance(out, pa.Table) else iter(out)

            run.__signature__ = inspect.signature(func)
            return apply(self, run if func.__name__ == "run" else func, schema)

        return apply_traced

    for cls in (GroupedData, PandasCogroupedOps):
        monkeypatch.setattr(cls, "applyInArrow", traced(cls.applyInArrow))
    stat = spark.range(n).selectExpr("id AS target", "id * 0.5 AS value", "id % 5 AS stratum")
    net = spark.range(n).selectExpr("id % 25 AS source", "id AS target")
    assert nulls.permutation_null(net, stat, 8, 42, stratum).count() == 25 * 8
    assert 0 < peak.value < each * n
