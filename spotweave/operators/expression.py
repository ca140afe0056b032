"""Counts over slides pooled on shared genes, rows looked up by id or place, and the gene baseline's order of steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.functions.labels import is_labelled
from spotweave.operators import sampling
from spotweave.operators.ranking import global_rank, rank_within


def stripped(gene) -> F.Column:
    """A gene id without its version: what stands before the last point and digits."""
    return F.regexp_replace(gene, r"\.[0-9]+$", "")


def pooled_slides(counts: DataFrame) -> DataFrame:
    """Counts (sample_id, spot, gene, count) on the genes that every slide has, versions stripped; none shared is an error.

    Genes that differ in the version alone are one gene: their counts add.
    """
    x = counts.withColumn("gene", stripped(F.col("gene").cast("string"))).groupBy("sample_id", "spot", "gene").agg(F.sum("count").alias("count"))
    have = x.select("gene", "sample_id").distinct().groupBy("gene").agg(F.count(F.lit(1)).alias("_n"))
    all_slides = x.select("sample_id").distinct().agg(F.count(F.lit(1)).alias("_all"))
    shared = have.join(F.broadcast(all_slides)).where("_n = _all").select("gene")  # one row
    if not counts.isEmpty() and shared.isEmpty():
        raise ValueError("the slides share no genes")
    return x.join(shared, "gene", "left_semi")


def reindexed(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of the ids, in no order; an id without a row is an error that names one."""
    gone = ids.join(rows.select(key), key, "left_anti").first()
    if gone:
        raise KeyError(gone[key])
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def at_places(rows: DataFrame, order: list[str], places: DataFrame) -> DataFrame:
    """The rows at the places (column place, from 0) of an order."""
    ranked, _ = global_rank(rows, order, "place")
    return ranked.withColumn("place", F.col("place") - 1).join(places.select(F.col("place").cast("long").alias("place")).distinct(), "place", "left_semi")


def every_nth(rows: DataFrame, order: list[str], step: int, first: int = 0) -> DataFrame:
    """Every step-th row of an order, from the one at place `first` on."""
    ranked, _ = global_rank(rows, order, "place")
    place = F.col("place") - 1
    return ranked.withColumn("place", place).where((F.col("place") >= first) & (F.pmod(F.col("place") - first, F.lit(step)) == 0))


def gene_places(names: list[str], wanted: list[str]) -> list[int]:
    """Where each wanted gene stands among the names, -1 where it does not."""
    at = {n: i for i, n in reversed(list(enumerate(names)))}
    return [at.get(w, -1) for w in wanted]


def spots_by_slide(spots: DataFrame) -> DataFrame:
    """(dataset_id, sample_id, n_spots, first_spot, last_spot): the spots of every slide."""
    return spots.groupBy("dataset_id", "sample_id").agg(F.count(F.lit(1)).alias("n_spots"), F.min("spot_id").alias("first_spot"), F.max("spot_id").alias("last_spot"))


def slide_places(spots: DataFrame) -> DataFrame:
    """Every spot with its slide's size and its place (from 0, by id) inside the slide: what a loop over slides would read, as rows."""
    ranked = rank_within(spots.select("dataset_id", "sample_id", "spot_id"), ["dataset_id", "sample_id"], ["spot_id"], "place")
    return ranked.select("dataset_id", "sample_id", "spot_id", (F.col("place") - 1).alias("place"), F.col("_n").alias("n_spots"))


def gene_lookup(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gene, place) of every wanted gene: its first place among the names (gene, place), -1 where it has none."""
    first = names.groupBy("gene").agg(F.min("place").alias("_at"))
    return wanted.select("gene").join(first, "gene", "left").select("gene", F.coalesce("_at", F.lit(-1)).cast("long").alias("place"))


def scoring_rows(spots: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """The rows that a panel scores: the labelled ones, `size` of them at most, by class in proportion."""
    return sampling.stratified_sample(spots.where(is_labelled("annotation")), key, "annotation", size, seed=seed)


def strategy_groups(spots: DataFrame, strategy: str, group: str) -> DataFrame:
    """Rows with the group that genes are ranked in: all for global, else the group column's value."""
    return spots.withColumn("gene_group", F.lit("all") if strategy == "global" else F.col(group).cast("string"))
