"""Per-target prediction quality, its strata, multiple testing and set-level tests."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.functions.lineage import cut
from spotweave.operators.linalg import Moments, cross_moments, log_grid, ridge_gcv
from spotweave.operators.nulls import permutation_null, ranking_hits, running_scores, score_null
from spotweave.operators.ranking import equal_parts, global_rank, suffix_minimum


def r2_by_target(df: DataFrame, by: list[str], truth: str, guess: str) -> DataFrame:
    """R2 of every target from four additive sums; null where the truth does not vary. Runs in a stream unchanged."""
    y, e = F.col(truth), F.col(truth) - F.col(guess)
    n, s, q, r = F.count(y), F.sum(y), F.sum(y * y), F.sum(e * e)
    total = q - s * s / n
    return df.groupBy(*by).agg(n.alias("n"), F.when(total > 1e-12 * F.greatest(q, F.lit(1.0)), 1 - r / total).alias("r2"))


def level_summary(df: DataFrame) -> DataFrame:
    """Means of both R2 and of their difference, and the share of targets that improve, per level."""
    d = F.col("r2_refined") - F.col("r2_frozen")
    return df.groupBy("level").agg(F.count(d).alias("n_genes"), F.avg("r2_frozen").alias("mean_r2_frozen"), F.avg("r2_refined").alias("mean_r2_refined"), F.avg(d).alias("mean_delta_r2"), (100 * F.avg((d > 0).cast("double"))).alias("pct_improved"))


def quartiles(df: DataFrame, value: str = "r2_frozen", delta: str = "delta_r2") -> DataFrame:
    """Targets in quarters by quantile edges, right-closed, lowest included; equal edges make one quarter."""
    x = df.where(F.col(value).isNotNull() & F.col(delta).isNotNull())
    e = x.agg(F.percentile(value, F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("e")).select(F.array_distinct("e").alias("e"))
    x = x.join(F.broadcast(e))  # one row
    below = F.size(F.filter(F.slice("e", 2, 8), lambda c: c < F.col(value)))
    q = F.least(below, F.size("e") - 2) + 1
    d = F.col(delta)
    return x.withColumn("quartile", q).groupBy("quartile").agg(F.count(F.lit(1)).alias("n_genes"), F.min(value).alias("frozen_r2_min"), F.max(value).alias("frozen_r2_max"), F.avg(d).alias("mean_delta_r2"), (100 * F.avg((d > 0).cast("double"))).alias("pct_improved"))


def strata(df: DataFrame, baseline: str, key: str, bins: int) -> DataFrame:
    """Equal-count strata by rank of the baseline, ties by key; null where there are fewer rows than bins."""
    ranked, total = global_rank(df, [baseline, key], "_r")
    stratum = equal_parts(F.col("_r"), total, bins) if 2 <= bins <= total else F.lit(None).cast("int")
    return ranked.withColumn("stratum", stratum).drop("_r")


def detrended(df: DataFrame, baseline: str, statistic: str, key: str, bins: int) -> DataFrame:
    """The statistic less the mean of its stratum."""
    x = strata(df, baseline, key, bins)
    means = x.groupBy(F.col("stratum").alias("_s")).agg(F.avg(statistic).alias("_mean"))
    x = x.join(F.broadcast(means), F.col("stratum").eqNullSafe(F.col("_s")))  # a row per stratum
    return x.withColumn("detrended", F.col(statistic) - F.coalesce("_mean", F.lit(0.0))).drop("_s", "_mean")


def benjamini_hochberg(df: DataFrame, p: str, by: list[str] = (), out: str = "padj") -> DataFrame:
    """Adjusted p-values: monotone from the largest down, clipped to [0, 1]; a null p stays null and counts for nothing.

    With `by` each group is a family of its own. Equal p-values are adjusted alike.
    """
    by = list(by)
    some = df.where(F.col(p).isNotNull() & ~F.isnan(p)).withColumn("_tie", F.monotonically_increasing_id())
    ranked, total = global_rank(some, [*by, p, "_tie"], "_r", keep=True)
    ranked = ranked.withColumns({f"_k{i}": F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for i, c in enumerate(by)})  # null is a family too
    group = [f"_k{i}" for i in range(len(by))]
    if by:
        families = ranked.groupBy(*group).agg(F.min("_r").alias("_first"), F.count(F.lit(1)).alias("_m"))
        ranked = ranked.join(families, group).withColumn("_r", F.col("_r") - F.col("_first") + 1).drop("_first")
    else:
        ranked = ranked.withColumn("_m", F.lit(total))
    ranked = ranked.withColumn("_q", F.col(p) * F.col("_m") / F.col("_r"))
    x = suffix_minimum(ranked, "_q", group).withColumn(out, F.least(F.lit(1.0), "_least"))
    rest = df.where(F.col(p).isNull() | F.isnan(p)).withColumn(out, F.lit(None).cast("double"))
    return x.select(*df.columns, out).unionByName(rest)


def set_members(net: DataFrame, statistic: DataFrame, least: int) -> DataFrame:
    """(source, target, value) of distinct members that have a statistic, for sets of at least `least` of them."""
    x = net.select("source", "target").distinct().join(statistic.select("target", "value"), "target")
    big = x.groupBy("source").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return x.join(big, "source", "left_semi").select("source", "target", "value")


def coverage(net: DataFrame, universe: DataFrame, floor: float = 0.0) -> DataFrame:
    """The share of a collection's targets that the universe has; below the floor is an error where one is given."""
    t = net.select("target").distinct()
    u = universe.select("target").distinct().withColumn("in", F.lit(1))
    out = t.join(u, "target", "left").agg(F.count(F.lit(1)).alias("n_targets"), F.count("in").alias("n_covered")).withColumn("coverage", F.col("n_covered") / F.col("n_targets"))
    if floor > 0 and out.first()["coverage"] < floor:
        raise ValueError("the universe covers too little of the collection")
    return out


def set_means(members: DataFrame, statistic: DataFrame) -> DataFrame:
    """Mean of every set and its difference from the background mean."""
    b = statistic.agg(F.avg("value").alias("background"))
    m = members.groupBy("source").agg(F.count(F.lit(1)).alias("set_size"), F.avg("value").alias("mean"))
    return m.join(F.broadcast(b)).withColumn("mean_delta", F.col("mean") - F.col("background"))  # one row


def set_mean_tests(members: DataFrame, statistic: DataFrame, times: int = 10_000, seed: int = 42, stratum: str | None = None, families: DataFrame | None = None) -> DataFrame:
    """Observed set means against the permutation null: expected mean, two-sided p floored at 1/times, adjusted p.

    families (source, family): sets are adjusted within their family; a set of two families is in both.
    """
    members = cut(members)
    observed = set_means(members, statistic)
    null = cut(permutation_null(members, statistic, times, seed, stratum))
    expected = null.groupBy("source").agg(F.avg("value").alias("expected"))
    far = null.join(observed.select("source", "mean"), "source").join(expected, "source")
    slack = 1e-9 * (F.abs("mean") + F.abs("expected"))  # the order of sums makes no difference
    p = far.groupBy("source").agg(F.first("expected").alias("expected"), F.avg((F.abs(F.col("value") - F.col("expected")) >= F.abs(F.col("mean") - F.col("expected")) - slack).cast("double")).alias("pval"))
    x = observed.join(p, "source").withColumn("pval", F.greatest("pval", F.lit(1.0 / times)))
    if families is None:
        return benjamini_hochberg(x, "pval")
    return benjamini_hochberg(cut(x.join(families.select("source", "family").distinct(), "source")), "pval", ["family"])


def grid_saturation(chosen: DataFrame, low: float, high: float) -> DataFrame:
    """The share of targets whose penalty is at either end of the grid."""
    return chosen.agg(F.avg((F.col("alpha") <= low).cast("double")).alias("at_low"), F.avg((F.col("alpha") >= high).cast("double")).alias("at_high"))


def enrichment_scores(statistic: DataFrame, net: DataFrame, times: int = 10_000, least: int = 5, seed: int = 42) -> DataFrame:
    """Running-sum enrichment of every set on the ranked statistic against `times` random sets of its size.

    Returns source, set_size, es, norm (es over the mean size of null scores of its sign; null without any), pval (the
    share of those at least as far out, floored at 1/times) and padj. Sets with fewer than `least` ranked targets are left out.
    """
    ranked, hits, total = ranking_hits(statistic, set_members(net, statistic.where(F.col("value").isNotNull() & ~F.isnan("value")), least))
    scores = cut(running_scores(hits, total))
    null = score_null(ranked, scores, times, seed)
    met = scores.join(null, "set_size", "left").withColumn("_side", F.signum("null_es") == F.signum("es"))
    size = F.when(F.col("_side"), F.abs("null_es"))
    out = met.groupBy("source", "set_size", "es").agg(F.avg(size).alias("_mean"), F.avg((size >= F.abs("es")).cast("double")).alias("_p"))
    out = out.select("source", "set_size", "es", F.when(F.col("_mean") > 0, F.col("es") / F.col("_mean")).alias("norm"), F.greatest(F.coalesce("_p", F.lit(1.0)), F.lit(1.0 / times)).alias("pval"))
    return benjamini_hochberg(cut(out), "pval")


def significant(table: DataFrame, fdr: float = 0.05) -> DataFrame:
    return table.where(F.col("padj") < fdr)


def strongest(table: DataFrame, n: int = 6) -> DataFrame:
    return table.orderBy(F.desc(F.abs("norm")), "source").limit(n)


def fold_ridge(rows: DataFrame, x: str, y: str, fold: str, alphas: np.ndarray | None = None, min_train: int = 2, min_test: int = 1, most: int = 1 << 29) -> DataFrame:
    """Held-out predictions of every fold by GCV ridge on standardised moments: (key, fold, target, truth, guess).

    A fold's training moments are the total minus its own: one pass serves all folds. Rows without targets (or without a vector) are
    unresolved: they neither train nor test. Folds with fewer rows than min_train or min_test predict nothing. The weights of
    all folds go to every task: more than `most` bytes are an error.
    """
    spark, alphas = rows.sparkSession, log_grid() if alphas is None else alphas
    rows = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(fold).isNotNull())
    by = {r[fold]: Moments.of(r.asDict()) for r in cross_moments(rows, x, y, [fold]).collect()}  # a row per fold
    total = None
    for m in by.values():
        total = m if total is None else total + m
    weights = {}
    for name, m in by.items():
        t = total - m
        if t.n < min_train or m.n < min_test:
            continue
        mx, my = t.sx / t.n, t.sy / t.n
        xx, xy, yy = t.centred()
        w, _ = ridge_gcv(Moments(t.n, t.sx, t.sy, xx, xy, yy), alphas)
        weights[name] = (w, mx, my)
    if sum(w.nbytes for w, _, _ in weights.values()) > most:
        raise ValueError("the weights of all folds are too large to send to every task")
    shared = spark.sparkContext.broadcast(weights)  # its size is checked
    src = rows.select("key", F.col(fold).cast("string").alias("fold"), F.col(x).cast("array<double>").alias("x"), F.col(y).cast("array<double>").alias("y"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            b = batch.column("y").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            names = np.array(batch.column("fold").to_pylist())
            guess = np.full_like(b, np.nan)
            for f in np.unique(names):
                if f not in shared.value:
                    continue
                w, mx, my = shared.value[f]
                guess[names == f] = (a[names == f] - mx) @ w + my
            d = b.shape[1]
            at = pa.array(np.repeat(np.arange(batch.num_rows), d))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(at), batch.column("fold").take(at), pa.array(np.tile(np.arange(d), batch.num_rows)), pa.array(b.ravel()), pa.array(guess.ravel())], names=["key", "fold", "target", "truth", "guess"])

    return src.mapInArrow(run, f"key {kind}, fold string, target long, truth double, guess double").where(~F.isnan("guess"))


def level_r2(predictions: DataFrame, folds: DataFrame) -> DataFrame:
    """(level, target, n, r2): each target's R2 over the held-out rows of all folds of a level together, not the mean of the folds' own.

    folds: fold, level; a fold of several levels counts in each.
    """
    return r2_by_target(predictions.join(F.broadcast(folds.select("fold", "level").distinct()), "fold"), ["level", "target"], "truth", "guess")  # a row per fold
