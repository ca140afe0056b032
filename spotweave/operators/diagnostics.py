"""How much of a representation is explained by groups, how many dimensions it has, what two share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotweave.functions.ids import patient
from spotweave.functions.keys import digest_number
from spotweave.functions.vectors import squared_norm, unit
from spotweave.operators.linalg import cca, effective_rank, moments_by, moments_of, projected_correlation, spectrum_rank
from spotweave.operators.probes import moments
from spotweave.operators.results import refuse
from spotweave.operators.sampling import permuted, uniform_sample


def variance_split(df: DataFrame, vector: str, grouping: str) -> DataFrame:
    """Total, between-group and within-group sums of squares, in one pass of additive moments."""
    rows = df.select(F.col(grouping).cast("string").alias("g"), F.col(vector).alias("z"))
    m = moments(rows, ["g"])
    d = m.groupBy("pos").agg(F.sum("q").alias("q"), F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    corrected = F.col("s") * F.col("s") / F.col("n")
    out = d.agg(F.max("n").alias("n"), F.sum(F.col("q") - corrected).alias("total_ss"), F.sum(F.col("b") - corrected).alias("between_ss"))
    groups = rows.agg(F.countDistinct("g").alias("n_groups"))
    out = out.join(groups).withColumn("within_ss", F.col("total_ss") - F.col("between_ss"))
    share = lambda c: F.when(F.col("total_ss") > 0, F.col(c) / F.col("total_ss")).otherwise(0.0)
    return out.select(F.lit(vector).alias("column"), F.lit(grouping).alias("grouping"), "n", "n_groups", "total_ss", "between_ss", "within_ss", share("between_ss").alias("between_fraction"), share("within_ss").alias("within_fraction"))


def variance_table(df: DataFrame, vectors: list[str], groupings: list[str], cap: int | None = None, key: str = "spot_key", seed: int = 42) -> DataFrame:
    """variance_split of every vector and grouping with at least two groups; a sample of `cap` rows where given."""
    if cap:
        df = uniform_sample(df, key, cap, seed, "variance")
    out = None
    for v in vectors:
        for g in groupings:
            part = variance_split(df, v, g)
            out = part if out is None else out.unionByName(part)
    return out.where("n_groups >= 2")


def resolved_grouping(df: DataFrame, name: str, registry: DataFrame | None = None) -> DataFrame:
    """The rows with the column that a grouping's name stands for, under that name.

    `patient` is read out of the slide's id by its cohort's pattern (registry: dataset_id, donor_pattern), and is the slide where the cohort has none;
    any other name is a column, and an unknown one is refused.
    """
    if name in df.columns:
        return df
    if name != "patient" or registry is None:
        refuse(f"the grouping {name}", "no column has this name", f"any of {sorted(df.columns)}, or patient with a registry")
    patterns = registry.select("dataset_id", F.col("donor_pattern").alias("_pattern")).dropDuplicates(["dataset_id"])
    return df.join(F.broadcast(patterns), "dataset_id", "left").withColumn(name, patient("sample_id", F.col("_pattern"))).drop("_pattern")  # a row per cohort


def mean_pairwise_cosine(df: DataFrame, vector: str) -> DataFrame:
    """Mean cosine of all pairs of different rows without forming a pair: sums of unit vectors only."""
    u = df.select(unit(F.col(vector)).alias("u"))
    n = u.agg(F.count(F.lit(1)).alias("n"), F.sum(squared_norm(F.col("u"))).alias("own"))
    s = u.select(F.posexplode("u").alias("pos", "v")).groupBy("pos").agg(F.sum("v").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("all"))
    pairs = F.col("n") * (F.col("n") - 1)
    return n.join(s).select("n", F.when(pairs > 0, (F.col("all") - F.col("own")) / pairs).alias("mean_pairwise_cosine"))


def matching_correlation(df: DataFrame, left: str, right: str) -> DataFrame:
    """abs Pearson of matching components of two vectors, 0 where undefined."""
    x = df.select(F.posexplode(F.arrays_zip(F.col(left).alias("a"), F.col(right).alias("b"))).alias("component", "p"))
    x = x.select("component", F.col("p.a").cast("double").alias("a"), F.col("p.b").cast("double").alias("b"))
    n, sa, sb = F.count(F.lit(1)), F.sum("a"), F.sum("b")
    cov = F.sum(F.col("a") * F.col("b")) - sa * sb / n
    va, vb = F.sum(F.col("a") * F.col("a")) - sa * sa / n, F.sum(F.col("b") * F.col("b")) - sb * sb / n
    return x.groupBy("component").agg(F.when((va > 0) & (vb > 0), F.abs(cov) / F.sqrt(va * vb)).otherwise(0.0).alias("correlation"))


def effective_rank_table(df: DataFrame, column: str, samples: int, iterations: int, key: str = "spot_key", seed: int = 42) -> DataFrame:
    """Effective rank over repeated samples without replacement: mean, sd, least, largest and share of the dimensions."""
    spark = df.sparkSession
    first = df.select(F.size(column).alias("d")).first()
    ranks = [effective_rank(uniform_sample(df.select(key, column), key, samples, seed, f"rank-{i}"), column) for i in range(iterations)]
    d = first["d"] if first else 0
    row = (column, d, samples, iterations, float(np.mean(ranks)), float(np.std(ranks)), float(np.min(ranks)), float(np.max(ranks)), float(100 * np.mean(ranks) / d) if d else 0.0)
    return spark.createDataFrame([row], "column string, dim int, n_samples int, n_iters int, eff_rank double, eff_rank_std double, eff_rank_min double, eff_rank_max double, pct_of_dim double")


def shuffled_columns(df: DataFrame, column: str, key: str, seed: int = 42) -> DataFrame:
    """A control: every dimension shuffled by itself among all rows."""
    x = df.select(key, F.posexplode(column).alias("pos", "v"))
    x = permuted(x, key, "v", ["pos"], seed, "column-shuffle")
    return x.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("a")).select(key, F.col("a.v").alias(column))


def normal_vector(column: str, key: str, seed: int = 42) -> Column:
    """A standard normal vector of the column's length, by Box-Muller on digests."""
    pos = F.sequence(F.lit(0), F.size(column) - 1)
    u = lambda p, i: (digest_number(seed, p, F.col(key), i) + 1) / F.lit(4294967297.0)
    return F.transform(pos, lambda i: F.sqrt(-2 * F.log(u("g1", i))) * F.cos(2 * np.pi * u("g2", i)))


def gaussian(df: DataFrame, column: str, key: str, seed: int = 42) -> DataFrame:
    """A control: standard normal vectors of the same shape."""
    return df.select(key, normal_vector(column, key, seed).alias(column))


def control_ranks(df: DataFrame, column: str, key: str, components: int = 8, seed: int = 42) -> DataFrame:
    """Effective rank of the controls: normal vectors, every dimension shuffled by itself, and the first principal components.

    One pass gives the moments of the rows and of the normal vectors. Those of the components are the rows' own, projected, so no row is embedded
    and a task never holds more than one Python worker.
    """
    m = moments_of(df.select(column, normal_vector(column, key, seed).alias("_normal")), column, "_normal")
    if m is None:
        raise ValueError("no rows to fit")
    rows, _, normal = m.centred()
    rows = [("gaussian", spectrum_rank(normal, m.n)), ("shuffled", effective_rank(shuffled_columns(df, column, key, seed), column)), (f"pca{components}", spectrum_rank(rows, m.n, components))]
    return df.sparkSession.createDataFrame(rows, "variant string, eff_rank double")


def leave_one_slide_out(df: DataFrame, left: str, right: str, slide: str, patient: str, ridge: float = 1e-3, report: int = 10, min_train: int = 50, min_test: int = 20) -> DataFrame:
    """CCA fitted without a slide and measured on it. Moments add up: training is the total minus the slide.

    paired: another slide of the same patient is in training.
    """
    by = moments_by(df, left, right, slide)
    owner = {r[slide]: r[patient] for r in df.select(slide, patient).distinct().collect()}  # a row per slide
    total = None
    for m in by.values():
        total = m if total is None else total + m
    rows = []
    for name, m in sorted(by.items()):
        train = total - m
        if train.n < min_train or m.n < min_test:
            rows.append((name, int(m.n), None, None, "too few spots"))
            continue
        s, wx, wy = cca(train, ridge, report)
        c = projected_correlation(m, wx, wy, train.sx / train.n, train.sy / train.n)
        paired = any(owner[o] == owner[name] for o in by if o != name)
        rows.append((name, int(m.n), float(c.mean()), paired, None))
    return df.sparkSession.createDataFrame(rows, "slide string, n long, mean_correlation double, paired boolean, note string")
