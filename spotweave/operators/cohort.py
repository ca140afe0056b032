"""Cohort summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.functions.labels import is_labelled


def select_rows(df: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Keep the named samples (none named: all), then drop the excluded ones."""
    if include:
        df = df.where(F.col("sample_id").isin(*include))
    return df.where(~F.col("sample_id").isin(*exclude)) if exclude else df


def split_rows(df: DataFrame, split: str) -> DataFrame:
    """Rows of a split; `all` is everything, an empty split an error."""
    out = df if split == "all" else df.where(F.col("split") == split)
    if out.isEmpty():
        raise ValueError(f"no rows in split {split!r}")
    return out


def cohort_table(spots: DataFrame) -> DataFrame:
    """One row per slide: its ids, spots, annotated spots and classes."""
    real = is_labelled("annotation")
    return (
        spots.groupBy("sample_id")
        .agg(
            *[F.min(c).alias(c) for c in ("dataset_id", "tissue", "donor", "region", "replicate", "split")],
            F.count(F.lit(1)).alias("n_spots"),
            F.count_if(real).alias("n_annotated"),
            F.array_sort(F.collect_set(F.when(real, F.col("annotation")))).alias("_c"),
        )
        .withColumn("n_classes", F.size("_c").cast("long"))
        .withColumn("classes", F.array_join("_c", "|"))
        .drop("_c")
        .orderBy("dataset_id", "sample_id")
    )


def class_table(spots: DataFrame) -> DataFrame:
    """Spots and slides of every class by tissue, and over ALL tissues, in one pass of grouping sets."""
    rows = spots.where(is_labelled("annotation") | (F.col("annotation_floored") != ""))
    rows = rows.withColumn("class", F.when(F.col("annotation_floored") != "", F.col("annotation_floored")).otherwise(F.col("annotation")))
    rows = rows.withColumn("kept", F.col("annotation_floored") == "")
    out = rows.groupingSets([["tissue", "class"], ["class"]], "tissue", "class").agg(
        F.grouping("tissue").alias("_g"),
        F.array_join(F.array_sort(F.collect_set("annotation_raw")), "|").alias("raw_labels"),
        F.count(F.lit(1)).alias("n_spots"),
        F.countDistinct("sample_id").alias("n_slides"),
        F.bool_or("kept").alias("scored"),
    )
    return out.select(F.when(F.col("_g") == 1, F.lit("ALL")).otherwise(F.col("tissue")).alias("tissue"), F.col("class").alias("annotation"), "raw_labels", "n_spots", "n_slides", "scored")


def run_summary(spots: DataFrame) -> DataFrame:
    """Spots, slides, donors and annotated spots per split and tissue."""
    return spots.groupBy("split", "tissue").agg(
        F.count(F.lit(1)).alias("n_spots"), F.countDistinct("sample_id").alias("n_slides"), F.countDistinct("donor").alias("n_donors"), F.count_if(is_labelled("annotation")).alias("n_annotated")
    )


def dataset_table(cohort: DataFrame) -> DataFrame:
    """Donors, samples and spots by dataset, organs ordered by their total spots."""
    from pyspark.sql import Window

    out = cohort.groupBy("dataset_id", "tissue", "split").agg(F.countDistinct("donor").alias("n_donors"), F.count(F.lit(1)).alias("n_samples"), F.sum("n_spots").alias("n_spots"))
    return out.withColumn("organ_spots", F.sum("n_spots").over(Window.partitionBy("tissue"))).orderBy(F.desc("organ_spots"), "tissue", "dataset_id")
