"""Columns that follow from ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Id formats.
SAMPLE = r"^(.+)-(\d+)-(\d+)$"
TISSUE_DASH = r"^(MW-[A-Za-z])-\d"
TISSUE_LETTERS = r"^([A-Za-z]+)\d"


def parsed(sample_id: str = "sample_id") -> list[Column]:
    """donor, region, replicate; an id of another form is its own donor, with -1 and -1."""
    c = F.col(sample_id)
    fits = c.rlike(SAMPLE)
    number = lambda g: F.when(fits, F.regexp_extract(c, SAMPLE, g).cast("int")).otherwise(F.lit(-1))
    return [F.when(fits, F.regexp_extract(c, SAMPLE, 1)).otherwise(c).alias("donor"), number(2).alias("region"), number(3).alias("replicate")]


def fallback_tissue(sample_id: str = "sample_id") -> Column:
    """Tissue of a sample that the registry does not list."""
    c = F.col(sample_id)
    dash, letters = F.regexp_extract(c, TISSUE_DASH, 1), F.regexp_extract(c, TISSUE_LETTERS, 1)
    return F.when(dash != "", dash).when(letters != "", F.upper(letters)).otherwise(c)


def patient(sample_id: str, pattern: Column) -> Column:
    """Group 1 of the cohort's pattern on the slide id, else the id; patients are not donors."""
    c = F.col(sample_id)
    found = F.call_function("regexp_extract", c, pattern, F.lit(1))
    return F.when(pattern.isNotNull() & F.rlike(c, pattern) & (found != ""), found).otherwise(c)


def with_registry(spots: DataFrame, registry: DataFrame) -> DataFrame:
    """Left lookup of sample_id in the registry (sample_id, tissue, split): the registry's tissue wins over the fallback."""
    r = registry.select("sample_id", F.col("tissue").alias("_tissue"), F.col("split").alias("_split"))
    out = spots.join(r, "sample_id", "left").withColumn("tissue", F.coalesce("_tissue", fallback_tissue()))
    return out.withColumn("split", F.coalesce("_split", F.lit("test"))).drop("_tissue", "_split")
