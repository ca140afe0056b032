"""Results stored under a digest of what they were made of, and given back for nothing else.

An entry's place is its name, a digest of its parameters, and an order-free fingerprint of its input rows. It is written aside and
renamed into place whole, so a reader sees all of it or none, and two writers of one entry leave one. Asking for a result
that was made of other rows, or of rows that nobody recorded, is refused rather than answered.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotweave.operators.results import refuse

UNKNOWN = "unrecorded"


def row_hashes(df: DataFrame, key: list[str], columns: list[str] | None = None) -> DataFrame:
    """(key, fingerprint): a hash of each row's columns, to find the rows in which two tables differ by a join."""
    return df.select(*key, F.xxhash64(*(columns or df.columns)).alias("fingerprint"))


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> str:
    """A digest of the rows whatever their order and partitioning: repeats count, and so do the columns' names and types.

    Rows are hashed twice with different seeds; counts, sums and exclusive ors of the hashes are aggregated. One pass, one row to the driver.
    """
    names = sorted(columns or df.columns)
    one, two = F.xxhash64(*names), F.xxhash64(F.lit(11), *names)
    got = df.agg(F.count(F.lit(1)), F.bit_xor(one), F.bit_xor(two), F.sum(one.cast("decimal(38,0)")), F.sum(two.cast("decimal(38,0)"))).first()
    kinds = [(n, df.schema[n].dataType.simpleString()) for n in names]
    return hashlib.sha256(json.dumps([kinds, [str(x) for x in got]]).encode()).hexdigest()[:32]


def differing_rows(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys whose rows differ or stand in one of the tables alone."""
    names = [c for c in a.columns if c in b.columns]
    x, y = row_hashes(a, key, names), row_hashes(b, key, names).withColumnRenamed("fingerprint", "_other")
    return x.join(y, key, "full").where(~F.col("fingerprint").eqNullSafe(F.col("_other"))).select(*key)


class ResultStore:
    """Stored results under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self._conf)

    def _children(self, path: str) -> list[str]:
        p, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _place(self, name: str, params: dict) -> str:
        digest = hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:16]
        return f"{self.path}/{name}/{digest}"

    def put(self, name: str, params: dict, inputs: str | None, rows: DataFrame) -> DataFrame:
        """Store rows made of inputs with this fingerprint (None: nobody knows), and read them back. What is there already stays."""
        place, aside = f"{self._place(name, params)}/{inputs or UNKNOWN}", f"{self.path}/.aside-{uuid.uuid4().hex}"
        rows.write.parquet(f"{aside}/rows")
        about = self.spark.createDataFrame([(name, json.dumps(params, sort_keys=True, default=str), inputs)], "name string, params string, inputs string")
        about.coalesce(1).write.json(f"{aside}/about")
        source, fs = self._at(aside)
        target, _ = self._at(place)
        fs.mkdirs(target.getParent())
        # renaming onto a folder that is there would move it inside: look first, and take what another writer left
        if fs.exists(target) or not fs.rename(source, target):
            fs.delete(source, True)
        stray, _ = self._at(f"{place}/{source.getName()}")
        if fs.exists(stray):
            fs.delete(stray, True)
        return self._read(place)

    def _read(self, place: str) -> DataFrame:
        return self.spark.read.parquet(f"{place}/rows")

    def find(self, name: str, params: dict, inputs: str) -> DataFrame | None:
        """The rows made of exactly these inputs, or None."""
        place = f"{self._place(name, params)}/{inputs}"
        path, fs = self._at(place)
        return self._read(place) if fs.exists(path) else None

    def require(self, name: str, params: dict, inputs: str) -> DataFrame:
        """The rows made of exactly these inputs; refused with the reason where there are none."""
        found = self.find(name, params, inputs)
        if found is not None:
            return found
        what, others = f"the stored {name}", [x for x in self._children(self._place(name, params)) if not x.startswith(".")]
        if not self._children(f"{self.path}/{name}"):
            refuse(what, "nothing is stored under this name", "run the stage that makes it")
        if not others:
            refuse(what, f"none was made with {params}", "run the stage that makes it with these parameters")
        if others == [UNKNOWN]:
            refuse(what, "it does not record what it was made of", "run the stage that makes it again")
        refuse(what, f"it was made of {[x for x in others if x != UNKNOWN]}, and these rows are {inputs}", "one stage ran again without the other")

    def reuse(self, name: str, params: dict, inputs: str, make) -> tuple[DataFrame, bool]:
        """The stored rows, or those that `make()` gives, stored; and whether they were there."""
        found = self.find(name, params, inputs)
        return (found, True) if found is not None else (self.put(name, params, inputs, make()), False)
