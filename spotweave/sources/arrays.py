"""Numpy arrays as a Spark data source: `.npy` files, and members of `.npz` archives, read by ranges of rows.

A partition is a range of rows; it opens the file, goes to the range's first byte and reads no other rows. With the option `columns` (first:stop) only
these columns of a row reach Spark. Compressed members of an archive have no byte ranges and are one partition. Paths without a scheme and
file:// paths are opened as files, others through pyarrow's file systems.
"""

from __future__ import annotations

import ast
import io
import struct
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a partition, and rows of an Arrow batch by bytes.
RANGE_BYTES, BATCH_BYTES = 32 << 20, 4 << 20


def _open(path: str):
    if "://" not in path or path.startswith("file:"):
        return open(path.removeprefix("file://").removeprefix("file:"), "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def npy_header(f) -> tuple[tuple[int, ...], np.dtype, int]:
    """(shape, dtype, offset of the data) of a stream at its first byte. Arrays in Fortran order and of objects are refused."""
    start = f.read(8)
    if start[:6] != b"\x93NUMPY":
        raise ValueError("not an .npy file")
    wide = start[6] > 1
    size = struct.unpack("<I" if wide else "<H", f.read(4 if wide else 2))[0]
    about = ast.literal_eval(f.read(size).decode("utf-8" if start[6] > 2 else "latin1"))
    if about["fortran_order"] and len(about["shape"]) > 1:
        raise ValueError("an array in Fortran order has no row ranges; store it in C order")
    kind = np.dtype(about["descr"])
    if kind.hasobject:
        raise ValueError("arrays of objects are not read")
    return tuple(about["shape"]), kind, (12 if wide else 10) + size


def _member(path: str, member: str | None) -> tuple[int, bool]:
    """(offset of the member's bytes in the file, whether they are stored as they are)."""
    if member is None:
        return 0, True
    with _open(path) as f, zipfile.ZipFile(f) as z:
        name = member if member.endswith(".npy") else f"{member}.npy"
        info = z.getinfo(name)
        f.seek(info.header_offset + 26)
        names, extra = struct.unpack("<HH", f.read(4))
        return info.header_offset + 30 + names + extra, info.compress_type == zipfile.ZIP_STORED


class RowRange(InputPartition):
    def __init__(self, first: int, rows: int):
        self.first, self.rows = first, rows


class NpyReader(DataSourceReader):
    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}  # Spark's options have no case
        self.path, self.member = options["path"], options.get("member")
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.base, self.plain = _member(self.path, self.member)
        with self._stream() as f:
            self.shape, self.kind, start = npy_header(f)
        self.data = self.base + start if self.plain else start
        lo, _, hi = (options.get("columns") or "").partition(":")
        self.width = int(np.prod(self.shape[1:], dtype=np.int64)) if len(self.shape) > 1 else 1
        self.lo, self.hi = int(lo or 0), min(int(hi or self.width), self.width)

    def _stream(self):
        if self.plain:
            f = _open(self.path)
            f.seek(self.base)
            return f
        z = zipfile.ZipFile(_open(self.path))
        return z.open(self.member if self.member.endswith(".npy") else f"{self.member}.npy")

    def partitions(self):
        rows = self.shape[0] if self.shape else 0
        each = max(1, self.range_bytes // max(1, self.width * self.kind.itemsize)) if self.plain else max(1, rows)
        return [RowRange(k, min(each, rows - k)) for k in range(0, rows, each)] or [RowRange(0, 0)]

    def read(self, partition: RowRange):
        size, first, left = self.width * self.kind.itemsize, partition.first, partition.rows
        step = max(1, BATCH_BYTES // max(1, size))
        with self._stream() as f:
            if self.plain:
                f.seek(self.data + first * size)
            else:
                npy_header(f)
            while left:
                n = min(step, left)
                raw = f.read(n * size)
                if len(raw) != n * size:
                    raise ValueError(f"{self.path} ends before its last row")
                x = np.frombuffer(raw, self.kind).reshape(n, self.width)[:, self.lo : self.hi].astype(np.float64)
                ends = pa.array(np.arange(0, x.size + 1, x.shape[1] or 1, dtype=np.int32)[: n + 1] if x.shape[1] else np.zeros(n + 1, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(x).ravel()))], names=["row", "v"])
                first, left = first + n, left - n


class NpySource(DataSource):
    """format("npy"): (row, v) of an array's first axis, the others flattened. Options: path, member (of an .npz), columns, rangeBytes."""

    @classmethod
    def name(cls):
        return "npy"

    def schema(self):
        return "row bigint, v array<double>"

    def reader(self, schema):
        return NpyReader(dict(self.options))


def read_array(spark: SparkSession, path: str, member: str | None = None, columns: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(row, v) of a stored array, in ranges of rows."""
    spark.dataSource.register(NpySource)
    options = {"rangeBytes": str(range_bytes)} | ({"member": member} if member else {}) | ({"columns": columns} if columns else {})
    return spark.read.format("npy").options(**options).load(path)


def npy_bytes(shape: tuple[int, ...], kind: str = "<f4") -> bytes:
    """The header of an .npy file, padded so that the data begin at a multiple of 64."""
    out = io.BytesIO()
    np.lib.format.write_array_header_1_0(out, {"descr": kind, "fortran_order": False, "shape": shape})
    return out.getvalue()


def write_arrays(df: DataFrame, path: str, vector: str, order: list[str], width: int, kind: str = "<f4") -> DataFrame:
    """One .npy per range of the order, written by the tasks that hold the rows: (file, first, rows), an index in order. path is a folder that all tasks reach.

    The files together are the rows in their order; vectors of another width are an error. Nothing passes through the driver but the index, a row per file.
    """
    from spotweave.operators.ranking import global_rank

    ranked, _ = global_rank(df.select(*order, F.col(vector).cast("array<double>").alias("_v")), order, "_row", keep=True)
    place = path.removeprefix("file://").removeprefix("file:").rstrip("/")

    def write(table: pa.Table) -> pa.Table:
        import os
        import uuid

        table = table.sort_by("_row")
        v = table.column("_v").combine_chunks()
        if len(v) and (np.diff(v.offsets.to_numpy()) != width).any():
            raise ValueError(f"a vector is not {width} wide")
        name = f"part-{table.column('_range')[0].as_py():05d}.npy"
        os.makedirs(place, exist_ok=True)
        aside = f"{place}/.{name}.{uuid.uuid4().hex}"
        with open(aside, "wb") as f:
            f.write(npy_bytes((len(v), width), kind))
            f.write(v.flatten().to_numpy(zero_copy_only=False).astype(kind).tobytes())
        os.replace(aside, f"{place}/{name}")  # a task that runs again leaves the same file
        return pa.table([[name], [table.column("_row")[0].as_py() - 1], [len(v)]], names=["file", "first", "rows"])

    return ranked.select("_range", "_row", "_v").groupBy("_range").applyInArrow(write, "file string, first long, rows long")


def read_parts(spark: SparkSession, path: str, index: DataFrame, **options) -> DataFrame:
    """The rows that write_arrays wrote, with their numbers over all files. The index has a row per file."""
    out = None
    for r in sorted(index.collect(), key=lambda r: r["first"]):
        own = read_array(spark, f"{path}/{r['file']}", **options).withColumn("row", F.col("row") + r["first"])
        out = own if out is None else out.unionByName(own)
    return out if out is not None else spark.createDataFrame([], "row long, v array<double>")
