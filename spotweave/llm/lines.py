"""Line deduplication against levelled sorted runs of line hashes.

A store holds runs: tables of (h1, h2, owner), bucketed and sorted by the 128-bit line
hash. Documents arrive in batches of ascending ids. A batch aggregates its own line
hashes to their smallest document, merge-anti-joins every run (equal bucketing, so runs
are not shuffled again), and adds what is new as a run of level 0; when a level has
`fanout` runs, they are merged into one of the next level. A line is dropped when the
owner of its hash is an earlier document. Only hashes and ids are shuffled for this; the
text moves once, to meet the positions of its dropped lines.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, batch_of, blocks, forget, shared_dir, stored

#: The bytes stripped at both ends of a line: space and \t \n \v \f \r.
BLANKS = " \t\n\u000b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS = 10
BATCHES = 3
FANOUT = 2


def _key(line) -> F.Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, th, pos, h1, h2) for every line whose key is long enough; th tells rows of one id apart."""
    return (
        docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
        .select("doc_id", "th", "pos", _key(F.col("line")).alias("k"))
        .where(F.char_length("k") >= min_chars)
        .select("doc_id", "th", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(7), "k").alias("h2"))
    )


class LineRuns:
    """The levelled store. Runs are tables in the shared folder, named in the session's catalog."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        if fanout < 2:
            raise ValueError("fanout is at least 2")
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels for t in level]

    def _write(self, owners: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        (
            owners.repartition(self.buckets, "h1", "h2").write.format("parquet").option("path", f"{shared_dir(self.spark)}/{name}")
            .bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        )
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            merged = self.spark.table(old[0])
            for t in old[1:]:
                merged = merged.unionByName(self.spark.table(t))
            self.levels[level] = []
            self._write(merged, level + 1)
            self._drop(old)

    def _drop(self, names: list[str]) -> None:
        conf = self.spark._jsc.hadoopConfiguration()
        for t in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(self.spark)}/{t}")
            path.getFileSystem(conf).delete(path, True)

    def add(self, batch: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
        """Drop positions of the batch, as stored (doc_id, th, drops); then its new hashes are a run.

        A batch must not hold ids below those of earlier batches that share lines with it:
        earlier batches own their lines whatever the ids.
        """
        lines = stored(line_hashes(batch, min_chars), "line-hashes")
        new = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"))
        for run in self.runs():
            new = new.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        self._write(new, 0)
        # read without their buckets: both sides are dealt anew, so a very common line is a skewed partition that Spark splits
        paths = [f"{shared_dir(self.spark)}/{t}" for level in self.levels for t in level]
        owners = self.spark.read.schema("h1 long, h2 long, owner long").parquet(*paths)
        dropped = lines.join(owners, ["h1", "h2"]).where("owner < doc_id")
        out = stored(dropped.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("drops")), "dropped-lines")
        forget(lines)
        return out

    def close(self) -> None:
        self._drop([t for level in self.levels for t in level])
        self.levels = []


def dropped_lines(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, th, drops): which lines of each document an earlier document owns."""
    spark = docs.sparkSession
    cuts = docs.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000).alias("q")).first()["q"] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    store, out = LineRuns(spark, fanout), []
    try:
        for k in range(len(cuts) + 1):
            part = docs.where(F.col("doc_id").isNotNull())
            if k:
                part = part.where(F.col("doc_id") > cuts[k - 1])
            if k < len(cuts):
                part = part.where(F.col("doc_id") <= cuts[k])
            out.append(store.add(part, min_chars))
    finally:
        store.close()
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every


def dedup_lines(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, min_chars: int = MIN_CHARS, keep: list[str] | None = None) -> DataFrame:
    """Documents with the lines dropped that a document of smaller id holds.

    Returns the columns `keep` (default: doc_id) plus n_lines, n_dropped, text (the kept lines
    joined by a line feed) and kept_sha256. Null or empty text is one empty line and stays "".
    A row with a null doc_id keeps all its lines and owns none. Rows that repeat an id are
    treated alike and never drop each other's lines. Other columns are ignored unless kept. A text of any
    length is split whole; an empty table gives an empty result.
    """
    docs = docs.withColumn("text", F.col("text").cast("string"))
    keep = keep or ["doc_id"]
    drops = dropped_lines(docs.select(F.col("doc_id").cast("long"), "text"), batches, fanout, min_chars)
    rows = docs.select(
        *[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_th"), F.col("text").alias("_text")
    )
    rows = rows.join(drops.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("drops").alias("_drops")), ["_id", "_th"], "left")
    rows = rows.select(*[f"_{i}" for i in range(len(keep))], "_text", "_drops")
    kinds = [docs.schema[c].dataType for c in keep]
    names = ", ".join(f"`_{i}` {t.simpleString()}" for i, t in enumerate(kinds))
    counts = pa.schema([("n", pa.int64()), ("d", pa.int64()), ("t", pa.string()), ("s", pa.string())])

    def run(arrived):
        for batch in blocks(arrived, "_text"):
            out = []
            for text, gone in zip(as_bytes(batch.column("_text")), batch.column("_drops").to_pylist(), strict=True):
                text = text or b""
                n = text.count(b"\n") + 1
                if gone:
                    gone = set(gone)
                    text = b"\n".join([x for i, x in enumerate(text.split(b"\n")) if i not in gone])
                out.append((n, len(gone or ()), text.decode(), hashlib.sha256(text).hexdigest()))
            made = batch_of(counts, *zip(*out, strict=True))
            same = [batch.column(f"_{i}") for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*same, *made.columns], names=[*(f"_{i}" for i in range(len(keep))), "n_lines", "n_dropped", "text", "kept_sha256"])

    out = rows.mapInArrow(run, f"{names}, n_lines long, n_dropped long, text string, kept_sha256 string")
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], "n_lines", "n_dropped", F.col("text").alias("kept_text"), "kept_sha256")


def op2_line_dedup(spark, sf_dir) -> DataFrame:
    """Line counts, dropped lines and the digest of what stays, for all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, row, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM (SELECT doc_id, text, row_number() OVER () AS row FROM documents)
), keyed AS (
  SELECT doc_id, row, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), owners AS (
  SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k
), judged AS (
  SELECT keyed.*, coalesce(owner < doc_id, false) AS gone FROM keyed LEFT JOIN owners USING (k)
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY row
"""
