"""Shared parts: the cluster's shared folder, stored intermediate tables, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that a Python worker unpacks at once.
BLOCK_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local one, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spotweave-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str, columns: list[str] | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spotweave-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a stored table that no later plan reads."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.stored_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def as_bytes(column: pa.Array) -> list:
    """The UTF-8 bytes of a text column, None for null."""
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def blocks(batches, column: str, limit: int = BLOCK_BYTES):
    """Slice Arrow batches so that each holds about `limit` bytes of `column` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        import pyarrow.compute as pc

        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size + 64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all elements of the slices (start, length), one slice after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    skip = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return np.arange(total, dtype=np.int64) + skip


def joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union the components of positions a[i] and b[i]; a label is the smallest position of its component."""
    while len(a):
        la, lb = labels[a], labels[b]
        differ = la != lb
        if not differ.any():
            break
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        low = np.minimum(la, lb)
        np.minimum.at(labels, la, low)
        np.minimum.at(labels, lb, low)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
    return labels


def ship(spark: SparkSession) -> None:
    """Give the executors this package's code, once per application."""
    import shutil
    from pathlib import Path

    context = spark.sparkContext
    if getattr(context, "_spotweave_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    base = Path(tempfile.mkdtemp(prefix="spotweave-")) / "spotweave"
    shutil.copytree(top, base / "spotweave", ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(str(base), "zip", base))
    context._spotweave_shipped = True


def factorized(words: list[str], texts: list[str]) -> tuple[np.ndarray, list[str]]:
    """A code for every word, and the distinct words. pandas takes strings to end at a NUL, so texts with one go by a dict."""
    if any("\x00" in t for t in texts):
        seen: dict[str, int] = {}
        code = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
        return code, list(seen)
    import pandas as pd

    code, distinct = pd.factorize(np.array(words, dtype=object))
    return code, distinct.tolist()
