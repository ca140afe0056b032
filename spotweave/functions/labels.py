"""Labels: which count as labelled, their canonical form, and the support floor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels that mean "not labelled", compared trimmed and upper-cased.
BELOW_FLOOR = "BELOW_CLASS_FLOOR"
UNLABELLED = ("UNASSIGNED", "UNASSIGNED_", "NONE", "NAN", "", "MIXED", "WHITESPACE", "UNKNOWN", BELOW_FLOOR)
# Spellings of one class, upper-cased, to its canonical name.
CANONICAL = {"TUM": "Tumor"}


def is_labelled(label: str | Column) -> Column:
    c = F.col(label) if isinstance(label, str) else label
    return c.isNotNull() & ~F.upper(F.trim(c)).isin(*UNLABELLED)


def canonical(label: str | Column) -> Column:
    """Trimmed, known spellings renamed; a label that is not labelled comes back trimmed."""
    c = F.trim(F.col(label) if isinstance(label, str) else label)
    out = c
    for raw, name in CANONICAL.items():
        out = F.when(F.upper(c) == raw, F.lit(name)).otherwise(out)
    return out


def classes(df: DataFrame, label: str = "annotation") -> DataFrame:
    """The distinct real classes, sorted."""
    return df.where(is_labelled(label)).select(F.col(label).alias("class")).distinct().orderBy("class")


def class_support(df: DataFrame, min_spots: int, min_slides: int) -> DataFrame:
    """Every (tissue, annotation) with its spots, slides and why it falls below the floor (null: it does not).

    A bound of 0 is off. Too few spots is named before too few slides.
    """
    n = df.where(is_labelled("annotation")).groupBy("tissue", "annotation")
    n = n.agg(F.count(F.lit(1)).alias("n_spots"), F.countDistinct("sample_id").alias("n_slides"))
    few, narrow = F.lit(min_spots > 0) & (F.col("n_spots") < min_spots), F.lit(min_slides > 0) & (F.col("n_slides") < min_slides)
    return n.withColumn("below", F.when(few, F.lit("spots")).when(narrow, F.lit("slides")))


def apply_floor(df: DataFrame, min_spots: int, min_slides: int) -> DataFrame:
    """Demote classes below the floor to a sentinel; annotation_floored keeps what they were, else ''."""
    low = class_support(df, min_spots, min_slides).where("below is not null").select("tissue", "annotation", F.lit(True).alias("_low"))
    out = df.join(low, ["tissue", "annotation"], "left")
    gone = F.coalesce("_low", F.lit(False))
    return out.withColumn("annotation_floored", F.when(gone, F.col("annotation")).otherwise("")).withColumn(
        "annotation", F.when(gone, F.lit(BELOW_FLOOR)).otherwise(F.col("annotation"))
    ).drop("_low")
