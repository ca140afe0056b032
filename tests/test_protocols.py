"""Caps on training rows, dispatch, organ-balanced rows, least fold sizes and families against plain versions."""

from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotweave.functions import ids
from spotweave.operators import biosignal, bootstrap, diagnostics, probes
from spotweave.operators.results import Refused


def some_rows(spark, n=150):
    rng = np.random.default_rng(4)
    data = [(i, "skin" if i % 2 else "lung", f"d{i % 6 // 2}", f"s{i % 12}", "abc"[min(int(rng.integers(0, 5)), 2)], [float(v) for v in rng.normal(size=3)]) for i in range(n)]
    return data, spark.createDataFrame([(k, z, a, t, d, s, 0, 0) for k, t, d, s, a, z in data], "key long, z array<double>, annotation string, tissue string, donor string, sample_id string, region int, replicate int").repartition(3)


def digest(*parts):
    return md5("|".join(map(str, parts)).encode()).hexdigest()


def test_training_caps_keep_classes_in_proportion(spark):
    data, df = some_rows(spark)
    got = probes.capped_train(df.withColumn("f", F.col("tissue")), "f", 20).collect()
    for t in ("skin", "lung"):
        own = [r for r in data if r[1] == t]
        n = {a: sum(r[4] == a for r in own) for a in {r[4] for r in own}}
        exact = {a: c * 20 / len(own) for a, c in n.items()}
        quota = {a: int(e) for a, e in exact.items()}
        for a in sorted(exact, key=lambda a: (-(exact[a] - int(exact[a])), digest(42, "remainder", a)))[: 20 - sum(quota.values())]:
            quota[a] += 1
        want = {r[0] for a in n for r in sorted((r for r in own if r[4] == a), key=lambda r: (digest(42, "stratified", r[0]), r[0]))[: quota[a]]}
        assert {r.key for r in got if r.f == t} == want and len(want) == 20
    assert probes.capped_train(df.withColumn("f", F.col("tissue")), "f", 1000).count() == len(data)


def test_a_wide_cap_changes_nothing(spark):
    _, df = some_rows(spark)
    a, b = probes.leave_one_out(df, "donor"), probes.dispatch("loso_donor", df, cap=10_000)
    assert sorted(a.select(*b.columns).collect()) == sorted(b.collect())
    low = probes.dispatch("loso_donor", df, cap=9).select("n_train").distinct().collect()
    assert [r.n_train for r in low] == [9]


def test_dispatch(spark):
    _, df = some_rows(spark)
    folds = spark.createDataFrame([("cross_slide", "f", "eval", "s1"), ("cross_slide", "f", "train", "s3"), ("cross_slide", "f", "train", "s5")], "level string, fold string, role string, sample_id string")
    one = probes.dispatch("pooled_loso_on_fold", df, folds, level="cross_slide", fold="f")
    assert sorted(one.collect()) == sorted(probes.leave_one_out_on_fold(df, folds, "cross_slide", "f").collect()) and one.count() > 20
    with pytest.raises(Refused):
        probes.dispatch("nowhere", df)
    for name in probes.FOLD_PROTOCOLS:
        with pytest.raises(Refused):
            probes.dispatch(name, df)


def test_balanced_rows_by_level(spark):
    _, df = some_rows(spark)
    pred = probes.leave_one_out(df, "donor")
    both = pred.withColumn("level", F.lit("one")).unionByName(pred.where("donor <> 'd0'").withColumn("level", F.lit("two")))
    got = {r.level: r for r in bootstrap.balanced_rows(both, "level", 50).collect()}
    for name, own in (("one", pred), ("two", pred.where("donor <> 'd0'"))):
        want = bootstrap.balanced_row(own, 50).first()
        assert [got[name][c] for c in want.asDict()] == pytest.approx(list(want))
    assert bootstrap.balanced_rows(both.limit(0), "level", 5).count() == 0


def test_groupings(spark):
    df = spark.createDataFrame([("A-12-x", "c1"), ("B-7-y", "c2"), ("odd", "c1"), ("C-1", "c3")], "sample_id string, dataset_id string")
    reg = spark.createDataFrame([("c1", r"^[A-Z]-(\d+)"), ("c2", None)], "dataset_id string, donor_pattern string")
    got = {r.sample_id: r.patient for r in diagnostics.resolved_grouping(df, "patient", reg).collect()}
    assert got == {"A-12-x": "12", "B-7-y": "B-7-y", "odd": "odd", "C-1": "C-1"}
    assert diagnostics.resolved_grouping(df, "sample_id") is df
    with pytest.raises(Refused):
        diagnostics.resolved_grouping(df, "organ", reg)
    assert df.select(ids.patient("sample_id", F.lit(r"^([A-Z])-"))).first()[0] == "A"


def test_folds_of_few_rows_and_unresolved_targets(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(90, 3))
    y = x @ rng.normal(size=(3, 2)) + rng.normal(size=(90, 2)) * 0.1
    fold = ["a"] * 40 + ["b"] * 45 + ["c"] * 5
    rows = [(i, fold[i], [float(v) for v in x[i]], None if i % 10 == 9 else [float(v) for v in y[i]]) for i in range(90)]
    df = spark.createDataFrame(rows, "key long, fold string, x array<double>, y array<double>")
    got = biosignal.fold_ridge(df, "x", "y", "fold", min_train=30, min_test=10)
    keys = {(r.fold, r.key) for r in got.collect()}
    assert keys == {(fold[i], i) for i in range(85) if i % 10 != 9}
    # pooled over folds, not the mean of the folds' own
    level = biosignal.level_r2(got, spark.createDataFrame([("a", "L"), ("b", "L")], "fold string, level string")).collect()
    rows = got.collect()
    for r in level:
        t = np.array([[q.truth, q.guess] for q in rows if q.target == r.target])
        assert r.r2 == pytest.approx(1 - ((t[:, 0] - t[:, 1]) ** 2).sum() / ((t[:, 0] - t[:, 0].mean()) ** 2).sum()) and r.n == len(t)
    with pytest.raises(ValueError):
        biosignal.fold_ridge(df, "x", "y", "fold", most=10)


def test_families_are_adjusted_apart(spark):
    stat = spark.createDataFrame([(f"g{i}", float(i % 13)) for i in range(80)], "target string, value double")
    net = spark.createDataFrame([(f"s{j}", f"g{i}") for j in range(8) for i in range(j, 80, 5 + j)], "source string, target string")
    fam = spark.createDataFrame([(f"s{j}", f) for j in range(8) for f in (["x"] if j < 3 else ["y"] if j < 7 else ["x", "y"])], "source string, family string")
    m = biosignal.set_members(net, stat, 2)
    got = biosignal.set_mean_tests(m, stat, 400, families=fam).collect()
    assert len(got) == 9
    for f in "xy":
        own = sorted((r.pval, r.padj) for r in got if r.family == f)
        p = np.array([a for a, _ in own])
        want = np.minimum(1, np.minimum.accumulate((p * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1])
        assert sorted(b for _, b in own) == pytest.approx(sorted(want.tolist()))
