"""Hierarchical folds as rows (level, fold, role, sample_id): self-joins of the slide table.

The slide table has one row per slide, so these joins are on a few thousand rows however
many spots there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotweave.functions.keys import digest
from spotweave.functions.labels import is_labelled
from spotweave.functions.lineage import cut

LEVELS = ("cross_replicate", "cross_region", "cross_donor", "cross_slide")


def annotated_slides(spots: DataFrame, tissues: list[str] | None = None) -> DataFrame:
    """Slides with a labelled spot, of the pinned tissues where given (no match is an error)."""
    out = spots.where(is_labelled("annotation")).select("sample_id", "tissue", "donor", "region", "replicate").distinct()
    if tissues:
        out = out.where(F.col("tissue").isin(*tissues))
        if out.isEmpty():
            raise ValueError("no annotated slide in the pinned tissues")
    return out


def _rows(level: str, slides: DataFrame, by: list[str], held: str, name) -> DataFrame:
    """Each value of `held` inside a group of `by` is one fold: it is evaluated, its siblings train."""
    s = slides.withColumn("_held", F.col(held).cast("string"))
    many = s.groupBy(*by).agg(F.countDistinct("_held").alias("_n")).where("_n >= 2")
    s = s.join(many, by, "left_semi")
    folds = s.groupBy(*by, "_held").agg(F.first("region").alias("_region"), F.first("replicate").alias("_replicate")).withColumn("fold", name)
    pairs = folds.select(*by, F.col("_held").alias("_out"), "fold").join(s, by)
    role = F.when(F.col("_held") == F.col("_out"), F.lit("eval")).otherwise(F.lit("train"))
    return pairs.select(F.lit(level).alias("level"), "fold", role.alias("role"), "sample_id")


def cross_replicate(slides: DataFrame) -> DataFrame:
    """Hold out one slide of a (donor, region) with two or more; only ids that could be parsed."""
    s = slides.where("region >= 0 and replicate >= 0")
    return _rows("cross_replicate", s, ["donor", "region"], "sample_id", F.concat(F.lit("cross_rep__"), "donor", F.lit("-"), "region", F.lit("__eval_"), "_replicate"))


def cross_region(slides: DataFrame) -> DataFrame:
    """Hold out one region of a donor with two or more."""
    return _rows("cross_region", slides.where("region >= 0"), ["donor"], "region", F.concat(F.lit("cross_reg__"), "donor", F.lit("__eval_region_"), "_held"))


def cross_donor(slides: DataFrame, most: int | None = None, seed: int = 42) -> DataFrame:
    """Hold out one donor of a tissue with two or more; at most `most` folds a tissue, drawn by digest."""
    out = _rows("cross_donor", slides, ["tissue"], "donor", F.concat(F.lit("cross_donor__"), "tissue", F.lit("__eval_"), "_held"))
    if most is None:
        return out
    donors = slides.select("tissue", "donor").distinct()
    order = Window.partitionBy("tissue").orderBy(digest(seed, "donor-cap", "tissue", "donor"), "donor")
    keep = donors.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    return out.join(keep.select(F.concat(F.lit("cross_donor__"), "tissue", F.lit("__eval_"), "donor").alias("fold")), "fold", "left_semi").select("level", "fold", "role", "sample_id")


def cross_slide(slides: DataFrame) -> DataFrame:
    """Hold out one slide of a tissue with two or more."""
    return _rows("cross_slide", slides, ["tissue"], "sample_id", F.concat(F.lit("cross_slide__"), "tissue", F.lit("__eval_"), "_held"))


BUILDERS = {"cross_replicate": cross_replicate, "cross_region": cross_region, "cross_donor": cross_donor, "cross_slide": cross_slide}


def generate(slides: DataFrame, levels=LEVELS, most_donors: int | None = None, seed: int = 42) -> DataFrame:
    """The union of the levels' folds. The slide table is written once."""
    slides = cut(slides)
    out = None
    for level in levels:
        rows = cross_donor(slides, most_donors, seed) if level == "cross_donor" else BUILDERS[level](slides)
        out = rows if out is None else out.unionByName(rows)
    return out


def fold_lists(rows: DataFrame) -> DataFrame:
    """The fold table: sorted train and eval slides of each fold."""
    pick = lambda role: F.array_join(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.col("sample_id")))), "|")
    return rows.groupBy("level", "fold").agg(pick("train").alias("train_sample_ids"), pick("eval").alias("eval_sample_ids"))


def eval_donors(rows: DataFrame, slides: DataFrame) -> DataFrame:
    """Distinct donors that each fold evaluates."""
    x = rows.where("role = 'eval'").join(slides.select("sample_id", "donor"), "sample_id")
    return x.groupBy("level", "fold").agg(F.array_join(F.array_sort(F.collect_set("donor")), "|").alias("eval_donors"))


def scoped_folds(rows: DataFrame, slides: DataFrame, tissues: list[str]) -> DataFrame:
    """Folds all of whose evaluated slides are in the tissues."""
    x = rows.where("role = 'eval'").join(slides.select("sample_id", "tissue"), "sample_id")
    good = x.groupBy("level", "fold").agg(F.bool_and(F.col("tissue").isin(*tissues)).alias("ok")).where("ok")
    return rows.join(good, ["level", "fold"], "left_semi")


def held_out_in(rows: DataFrame, cohort: DataFrame) -> DataFrame:
    """Every slide with the levels it is held out in, and the spans of its tissue, donor and region."""
    levels = rows.where("role = 'eval'").groupBy("sample_id").agg(F.array_join(F.array_sort(F.collect_set("level")), "|").alias("held_out_in"))
    out = cohort.join(levels, "sample_id", "left")
    span = lambda *c: F.count(F.lit(1)).over(Window.partitionBy(*c))
    return out.select(
        "tissue", "donor", "region", "replicate", "sample_id", "n_annotated", "n_classes", F.coalesce("held_out_in", F.lit("")).alias("held_out_in"),
        span("tissue").alias("tissue_rows"), span("tissue", "donor").alias("donor_rows"), span("tissue", "donor", "region").alias("region_rows"),
    )
