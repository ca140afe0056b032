"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, PII redaction, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a
frame that is written as Parquet in the shared folder and read again for the next one. All
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotweave.llm import langid, lines, packing, pii, simhash
from spotweave.llm.common import ship, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes if no language is found in it, or its best one has less than this probability.
LEAST_SCORE = 0.3


def _with_text(df: DataFrame, text: str) -> DataFrame:
    """The columns of documents, with another text and its length."""
    return df.select("doc_id", F.col(text).alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; the others go."""
    ship(spark)
    found = langid.identify(docs, langid.train(docs), keep=COLUMNS)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a document of smaller id holds."""
    ship(spark)
    return _with_text(lines.dedup_lines(docs, keep=["doc_id", "lang", "source"]), "kept_text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the least by id, then by a hash of its text. Rows without an id stay."""
    ship(spark)
    found = simhash.near_duplicates(docs.where("doc_id is not null"))
    kept = found.groupBy("part").agg(F.min(F.struct("doc_id", "text_hash")).alias("one")).select("one.*")
    once = docs.withColumn("text_hash", F.xxhash64("text")).join(kept, ["doc_id", "text_hash"], "left_semi")
    return once.dropDuplicates(["doc_id", "text_hash"]).select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    ship(spark)
    return _with_text(pii.find_pii(docs, keep=["doc_id", "lang", "source"]), "redacted")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences: one row per piece."""
    import public_tokenizers

    ship(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("pii", redact), ("packing", pack)]
#: The first stage is a trained network and the last a tokenizer: no SQL for these.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
