"""The cohort that the registered queries run on: the driver's vectors with ids, labels and groups derived from vec_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotweave.functions.ids import fallback_tissue, parsed
from spotweave.functions.labels import apply_floor, canonical

#: Raw labels by the vectors' label: spellings, sentinels and a null.
RAW = {0: "TUM", 1: "Tumor", 2: "Stroma", 3: "NOR", 4: "TLS", 5: "INFL", 6: "LN", 7: " mixed ", 9: "Whitespace"}
TISSUES = ("skin", "lung", "kidney")
MIN_SPOTS, MIN_SLIDES = 10, 2


def raw_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vector: spot_key, sample_id, dataset_id, split, annotation_raw, gene and patch."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("s", (F.col("vec_id") % 32).cast("int"))
    s = F.col("s")
    n = lambda x: F.floor(x).cast("int").cast("string")
    test = F.concat(F.lit("D"), n(s / 4), F.lit("-"), n(s / 2 % 2 + 1), F.lit("-"), n(s % 2 + 1))
    fit = F.concat(F.lit("MW-"), F.when(s % 2 == 0, "B").otherwise("G"), F.lit("-"), s.cast("string"), F.lit("a"))
    label = F.lit(None).cast("string")
    for k, name in RAW.items():
        label = F.when(F.col("label") == k, F.lit(name)).otherwise(label)
    return e.select(
        F.col("vec_id").alias("spot_key"),
        F.concat(F.lit("bc"), F.col("vec_id").cast("string")).alias("spot_id"),
        F.when(s < 24, test).otherwise(fit).alias("sample_id"),
        F.when(s < 24, "cohort_a").otherwise("cohort_b").alias("dataset_id"),
        F.when(s < 24, "test").otherwise("train").alias("split"),
        F.when(s < 24, label).otherwise("UNASSIGNED").alias("annotation_raw"),
        F.when(s < 24, F.element_at(F.array(*map(F.lit, TISSUES)), (F.floor(s / 4) % 3 + 1).cast("int"))).alias("listed_tissue"),
        F.slice("embedding", 1, 32).alias("gene_features"),
        F.slice("embedding", 33, 32).alias("patch_features"),
    )


def spots(spark: SparkSession, sf_dir: str, floor: bool = True) -> DataFrame:
    """The spot table with canonical labels, groups and the support floor."""
    x = raw_spots(spark, sf_dir)
    x = x.select("*", *parsed()).withColumn("tissue", F.coalesce("listed_tissue", fallback_tissue())).withColumn("annotation", canonical("annotation_raw")).drop("listed_tissue")
    return apply_floor(x, MIN_SPOTS, MIN_SLIDES) if floor else x.withColumn("annotation_floored", F.lit(""))


#: The same in DuckDB: views raw, spots (with the floor) and slides.
SQL = """
WITH RECURSIVE e AS (SELECT *, CAST(vec_id % 32 AS INTEGER) AS s FROM embeddings
), raw AS (
  SELECT vec_id AS spot_key, 'bc' || vec_id AS spot_id,
    CASE WHEN s < 24 THEN 'D' || (s // 4) || '-' || ((s // 2) % 2 + 1) || '-' || (s % 2 + 1)
         ELSE 'MW-' || CASE WHEN s % 2 = 0 THEN 'B' ELSE 'G' END || '-' || s || 'a' END AS sample_id,
    CASE WHEN s < 24 THEN 'cohort_a' ELSE 'cohort_b' END AS dataset_id,
    CASE WHEN s < 24 THEN 'test' ELSE 'train' END AS split,
    CASE WHEN s < 24 THEN CASE label WHEN 0 THEN 'TUM' WHEN 1 THEN 'Tumor' WHEN 2 THEN 'Stroma' WHEN 3 THEN 'NOR' WHEN 4 THEN 'TLS'
         WHEN 5 THEN 'INFL' WHEN 6 THEN 'LN' WHEN 7 THEN ' mixed ' WHEN 9 THEN 'Whitespace' END ELSE 'UNASSIGNED' END AS annotation_raw,
    CASE WHEN s < 24 THEN ['skin', 'lung', 'kidney'][(s // 4) % 3 + 1] END AS listed,
    embedding[1:32] AS gene_features, embedding[33:64] AS patch_features
  FROM e
), derived AS (
  SELECT * EXCLUDE (listed),
    coalesce(nullif(regexp_extract(sample_id, '^(.+)-([0-9]+)-([0-9]+)$', 1), ''), sample_id) AS donor,
    coalesce(TRY_CAST(nullif(regexp_extract(sample_id, '^(.+)-([0-9]+)-([0-9]+)$', 2), '') AS INTEGER), -1) AS region,
    coalesce(TRY_CAST(nullif(regexp_extract(sample_id, '^(.+)-([0-9]+)-([0-9]+)$', 3), '') AS INTEGER), -1) AS replicate,
    coalesce(listed, nullif(regexp_extract(sample_id, '^(MW-[A-Za-z])-[0-9]', 1), ''), sample_id) AS tissue,
    CASE WHEN upper(trim(annotation_raw)) = 'TUM' THEN 'Tumor' ELSE trim(annotation_raw) END AS annotation0
  FROM raw
), labelled AS (
  SELECT *, annotation0 IS NOT NULL AND upper(trim(annotation0)) NOT IN
    ('UNASSIGNED', 'UNASSIGNED_', 'NONE', 'NAN', '', 'MIXED', 'WHITESPACE', 'UNKNOWN', 'BELOW_CLASS_FLOOR') AS real0 FROM derived
), low AS (
  SELECT tissue, annotation0 FROM labelled WHERE real0 GROUP BY ALL HAVING count(*) < 10 OR count(DISTINCT sample_id) < 2
), spots AS (
  SELECT l.* EXCLUDE (annotation0, real0), l.annotation0,
    CASE WHEN low.tissue IS NOT NULL THEN 'BELOW_CLASS_FLOOR' ELSE l.annotation0 END AS annotation,
    CASE WHEN low.tissue IS NOT NULL THEN l.annotation0 ELSE '' END AS annotation_floored,
    l.real0 AND low.tissue IS NULL AS is_real
  FROM labelled l LEFT JOIN low ON l.tissue = low.tissue AND l.annotation0 = low.annotation0
), slides AS (
  SELECT DISTINCT sample_id, tissue, donor, region, replicate FROM spots WHERE is_real
), folds AS (
  SELECT 'cross_replicate' AS level, 'cross_rep__' || h.donor || '-' || h.region || '__eval_' || h.replicate AS fold,
    CASE WHEN s.sample_id = h.sample_id THEN 'eval' ELSE 'train' END AS role, s.sample_id
  FROM slides h JOIN slides s ON h.donor = s.donor AND h.region = s.region
  WHERE h.region >= 0 AND h.replicate >= 0 AND (SELECT count(*) FROM slides x WHERE x.donor = h.donor AND x.region = h.region) >= 2
  UNION ALL
  SELECT 'cross_region', 'cross_reg__' || h.donor || '__eval_region_' || h.region, CASE WHEN s.region = h.region THEN 'eval' ELSE 'train' END, s.sample_id
  FROM (SELECT DISTINCT donor, region FROM slides WHERE region >= 0) h JOIN slides s ON h.donor = s.donor
  WHERE (SELECT count(DISTINCT region) FROM slides x WHERE x.donor = h.donor) >= 2
  UNION ALL
  SELECT 'cross_donor', 'cross_donor__' || h.tissue || '__eval_' || h.donor, CASE WHEN s.donor = h.donor THEN 'eval' ELSE 'train' END, s.sample_id
  FROM (SELECT DISTINCT tissue, donor FROM slides) h JOIN slides s ON h.tissue = s.tissue
  WHERE (SELECT count(DISTINCT donor) FROM slides x WHERE x.tissue = h.tissue) >= 2
  UNION ALL
  SELECT 'cross_slide', 'cross_slide__' || h.tissue || '__eval_' || h.sample_id, CASE WHEN s.sample_id = h.sample_id THEN 'eval' ELSE 'train' END, s.sample_id
  FROM slides h JOIN slides s ON h.tissue = s.tissue
  WHERE (SELECT count(*) FROM slides x WHERE x.tissue = h.tissue) >= 2
)
"""
