"""Count matrices as long rows (sample_id, spot, gene, count): vocabularies, normalisation, gene selection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def vocabulary(counts: DataFrame, min_expressed: int = 1) -> DataFrame:
    """Genes that every slide lists and that are positive in at least `min_expressed` spots."""
    slides = counts.agg(F.countDistinct("sample_id").alias("n"))
    g = counts.groupBy("gene").agg(F.countDistinct("sample_id").alias("n_slides"), F.count_if(F.col("count") > 0).alias("n_expressed"))
    return g.join(F.broadcast(slides), g.n_slides == slides.n).where(F.col("n_expressed") >= min_expressed).select("gene", "n_expressed")  # one row


def expression(spots: DataFrame, counts: DataFrame, genes: DataFrame, scale: float = 1e4) -> DataFrame:
    """Left join of spots with log1p(count / total * scale); a spot without counts has found = false and no genes."""
    total = counts.groupBy("sample_id", "spot").agg(F.sum("count").alias("total"))
    x = counts.join(genes.select("gene"), "gene", "left_semi").join(total, ["sample_id", "spot"])
    x = x.withColumn("value", F.when(F.col("total") > 0, F.log1p(F.col("count") / F.col("total") * scale)).otherwise(0.0))
    v = x.groupBy("sample_id", "spot").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("gene", "value")))).alias("genes"))
    out = spots.select("sample_id", "spot").join(total.select("sample_id", "spot", F.lit(True).alias("found")), ["sample_id", "spot"], "left")
    return out.join(v, ["sample_id", "spot"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def min_cells(counts: DataFrame, least: int) -> DataFrame:
    """Rows of genes positive in at least `least` spots."""
    good = counts.groupBy("gene").agg(F.count_if(F.col("count") > 0).alias("n")).where(F.col("n") >= least)
    return counts.join(good, "gene", "left_semi")


def nonzero_everywhere(counts: DataFrame, batch: str) -> DataFrame:
    """Rows of genes that are positive somewhere in every batch."""
    n = counts.agg(F.countDistinct(batch).alias("n_batches"))
    g = counts.where(F.col("count") > 0).groupBy("gene").agg(F.countDistinct(batch).alias("n"))
    good = g.join(F.broadcast(n), g.n == n.n_batches).select("gene")  # one row
    return counts.join(good, "gene", "left_semi")


def usable_batch(df: DataFrame, batch: str | None) -> str | None:
    """The batch column, unless it has a single value."""
    if batch is None:
        return None
    return batch if df.select(batch).distinct().limit(2).count() > 1 else None


def unique_names(genes: DataFrame, name: str, key: str) -> DataFrame:
    """Names made unique: the second and later of one name get -1, -2, ..."""
    r = F.row_number().over(Window.partitionBy(name).orderBy(key)) - 1
    return genes.withColumn("unique_name", F.when(r == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit("-"), r.cast("string"))))


def dispersion(counts: DataFrame, n_spots: int, by: list[str] = ()) -> DataFrame:
    """Variance of counts standardised by a quadratic fit of log variance on log mean, clipped at sqrt(n).

    Absent rows are zeros. Two aggregates and a small fit; with fewer than three usable genes the variance itself is returned.
    """
    n = float(n_spots)
    keys = [*by, "gene"]
    m = counts.groupBy(*keys).agg(F.sum("count").alias("s"), F.sum(F.col("count") * F.col("count")).alias("q"))
    m = m.withColumn("mean", F.col("s") / n).withColumn("var", (F.col("q") - F.col("s") * F.col("s") / n) / (n - 1))
    good = (F.col("mean") > 0) & (F.col("var") > 0)
    lx, ly = F.log10("mean"), F.log10("var")
    sums = m.where(good).agg(*[F.sum(F.pow(lx, k)).alias(f"x{k}") for k in range(5)], *[F.sum(F.pow(lx, k) * ly).alias(f"y{k}") for k in range(3)]).first()
    if not sums["x0"] or sums["x0"] < 3:
        return m.select(*keys, "mean", F.col("var").alias("score"))
    a = np.array([[sums[f"x{i + j}"] for j in range(3)] for i in range(3)])
    c = np.linalg.lstsq(a, np.array([sums[f"y{k}"] for k in range(3)]), rcond=None)[0]
    sd = F.sqrt(F.pow(F.lit(10.0), F.lit(float(c[0])) + F.lit(float(c[1])) * lx + F.lit(float(c[2])) * lx * lx))
    m = m.withColumn("sd", F.when(good, sd))
    z = F.least((F.col("count") - F.col("mean")) / F.col("sd"), F.lit(n**0.5))
    x = counts.join(m.where(good), keys)
    part = x.groupBy(*keys).agg(F.sum(z * z).alias("zz"), F.count(F.lit(1)).alias("k"), F.first("mean").alias("mean"), F.first("sd").alias("sd"))
    zero = F.pow(F.col("mean") / F.col("sd"), F.lit(2.0))  # each absent spot
    return part.select(*keys, "mean", ((F.col("zz") + (F.lit(n) - F.col("k")) * zero) / (n - 1)).alias("score"))


def consensus(scores: DataFrame, group: str, candidates: int, n: int) -> DataFrame:
    """Genes ranked inside every group, then by the number of groups that list them and their mean rank."""
    r = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "gene"))
    x = scores.withColumn("r", r).where(F.col("r") <= candidates).groupBy("gene").agg(F.count(F.lit(1)).alias("n_groups"), F.avg("r").alias("mean_rank"))
    return x.orderBy(F.desc("n_groups"), "mean_rank", "gene").limit(n)


def select_genes(counts: DataFrame, n_spots: int, n_genes: int, strategy: str = "global", group: str = "sample_id", shared: float = 0.5) -> DataFrame:
    """Highly variable genes: global, the union of each group's own (per_slide), or part shared and part by group (mixed)."""
    if strategy == "global":
        return dispersion(counts, n_spots).orderBy(F.desc("score"), "gene").limit(n_genes).select("gene").orderBy("gene")
    scores = dispersion(counts, n_spots, [group])
    own = scores.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "gene")))
    if strategy == "per_slide":
        return own.where(F.col("r") <= n_genes).select("gene").distinct().orderBy("gene")
    if strategy != "mixed":
        raise ValueError(f"unknown strategy {strategy!r}")
    k = int(n_genes * shared)
    both = consensus(scores, group, n_genes, k).select("gene")
    return both.union(own.where(F.col("r") <= n_genes - k).select("gene")).distinct().orderBy("gene")


def prepared(counts: DataFrame, least: int, batch: str) -> DataFrame:
    """Cohort preparation: minimum support first, then genes that are silent in some batch; the order matters."""
    return nonzero_everywhere(min_cells(counts, least), batch)
