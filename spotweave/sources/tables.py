"""Sources and sinks: merged spot tables, registries, feature files, manifests, gene sets, scores."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns that a merged spot table must have.
REQUIRED = ("sample_id", "spot_id", "array_row", "array_col", "dataset_id", "annotation", "gene_features", "patch_features")
VERSION = 2


def flat(df: DataFrame, *columns: str) -> DataFrame:
    """Nested (1, D) vectors to plain arrays."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.flatten(c) for c in columns if kinds[c].startswith("array<array")})


def read_merged(spark: SparkSession, splits: dict[str, str]) -> DataFrame:
    """Union of the splits' Parquet tables with their split name; a missing column is an error."""
    out = None
    for name, path in splits.items():
        part = spark.read.parquet(path)
        missing = [c for c in REQUIRED if c not in part.columns]
        if missing:
            raise ValueError(f"{path} lacks {', '.join(missing)}")
        part = flat(part, "gene_features", "patch_features").select(*REQUIRED).withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def write_cache(df: DataFrame, path: str, source: str) -> None:
    """The flattened table, partitioned by split, with its version and source in a row beside it."""
    df.write.mode("overwrite").partitionBy("split").parquet(f"{path}/spots")
    df.sparkSession.createDataFrame([(VERSION, source)], "version int, source string").coalesce(1).write.mode("overwrite").parquet(f"{path}/info")


def read_cache(spark: SparkSession, path: str, source: str) -> DataFrame | None:
    """The cached table, or None where it is of another source or version and must be built again."""
    info = spark.read.parquet(f"{path}/info").first()
    return spark.read.parquet(f"{path}/spots") if info and (info["version"], info["source"]) == (VERSION, source) else None


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The cache without its vectors: the scan reads no vector column."""
    x = spark.read.parquet(f"{path}/spots")
    return x.drop("gene_features", "patch_features")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A JSON registry of datasets to one row per sample: dataset_id, tissue, donor_pattern, sample_id, split."""
    sample = "struct<id:string,split:string,donor_pattern:string>"
    x = spark.read.schema(f"datasets array<struct<name:string,tissue:string,donor_pattern:string,subdir:string,samples:array<{sample}>>>").json(path, multiLine=True)
    x = x.select(F.explode("datasets").alias("d")).select("d.*").select("*", F.explode("samples").alias("s"))
    return x.select(F.col("name").alias("dataset_id"), "tissue", F.coalesce("s.donor_pattern", "donor_pattern").alias("donor_pattern"), "subdir", F.col("s.id").alias("sample_id"), F.col("s.split").alias("split"))


def data_paths(registry: DataFrame, profile: dict[str, str]) -> DataFrame:
    """Where each dataset lies: the site profile's path wins over the registry's."""
    x = registry.select("dataset_id", "subdir").distinct()
    own = F.create_map(*[F.lit(v) for kv in profile.items() for v in kv]) if profile else None
    return x.select("dataset_id", F.coalesce(F.element_at(own, F.col("dataset_id")), "subdir").alias("path") if own is not None else F.col("subdir").alias("path"))


def write_features(df: DataFrame, path: str, width: int) -> None:
    """Vectors in the wide form spot_id, e0 .. e{width-1}, a folder per slide."""
    df.select("dataset_id", "sample_id", "spot_id", *[F.col("v")[i].alias(f"e{i}") for i in range(width)]).write.mode("overwrite").partitionBy("dataset_id", "sample_id").parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """The wide form back to (dataset_id, sample_id, spot_id, v)."""
    x = spark.read.parquet(path)
    e = sorted((c for c in x.columns if c[0] == "e" and c[1:].isdigit()), key=lambda c: int(c[1:]))
    return x.select("dataset_id", "sample_id", "spot_id", F.array(*e).alias("v"))


def merge_modalities(gene: DataFrame, patch: DataFrame, labels: DataFrame) -> DataFrame:
    """Inner join of both feature tables on the spot; absent labels are UNASSIGNED at (0, 0)."""
    k = ["dataset_id", "sample_id", "spot_id"]
    x = gene.withColumnRenamed("v", "gene_features").join(patch.withColumnRenamed("v", "patch_features"), k)
    x = x.join(labels.select(*k, "annotation", "array_row", "array_col"), k, "left")
    return x.fillna({"annotation": "UNASSIGNED", "array_row": 0, "array_col": 0})


def write_manifest(path: str, model: str, slides: list[tuple[str, str]]) -> None:
    """Slides (dataset, sample, file) to embed; a file that is not there is an error."""
    for *_, file in slides:
        if not Path(file).exists():
            raise FileNotFoundError(file)
    Path(path).write_text(json.dumps({"model": model, "slides": slides}, indent=1))


def read_manifest(path: str) -> dict:
    if not Path(path).exists():
        raise FileNotFoundError(f"no manifest at {path}: write it first")
    return json.loads(Path(path).read_text())


def missing_outputs(manifest: DataFrame, written: DataFrame) -> DataFrame:
    """Manifest entries without an output."""
    return manifest.join(written, ["dataset_id", "sample_id"], "left_anti")


def read_sets(spark: SparkSession, path: str, source: str = "source", target: str = "target") -> DataFrame:
    """A gene-set collection as (source, target)."""
    return spark.read.parquet(path).select(F.col(source).alias("source"), F.col(target).alias("target"))


def read_optional(spark: SparkSession, path: str, schema: str, kind: str = "csv") -> DataFrame:
    """A table that may not be there or may be empty: then an empty frame of the schema."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).option("header", True).format(kind).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def write_scores(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def file_digest(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def frame_digest(df: DataFrame) -> str:
    """A digest of a frame's rows that their order does not change."""
    return str(df.agg(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()[0])


def write_predictions(pred: DataFrame, path: str) -> DataFrame:
    """Predictions by model, seed, protocol and level, and the index of what is there."""
    keys = ["model", "seed", "protocol", "level"]
    pred.write.mode("overwrite").partitionBy(*keys).parquet(path)
    return pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
