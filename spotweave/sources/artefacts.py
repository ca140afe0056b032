"""Tables that the stages of a run leave for each other: read, noted as pending, or refused.

A table that a stage has not come to yet is a matter of time; one that a stage left out, or left empty, is a fault. A table is written
aside and renamed into its place whole, so a stage that lost its driver while it wrote leaves nothing under the table's name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from spotweave.operators.results import refuse


class Artefacts:
    """The tables of a run, a folder for each stage, under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        #: (what, why) of the tables that were asked for and are not there yet.
        self.pending: list[tuple[str, str]] = []

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _children(self, path: str) -> list[str]:
        p, fs = self._at(path)
        names = (s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else ()
        return sorted(n for n in names if not n.startswith((".", "_")))

    def write(self, rows: DataFrame, stage: str, name: str) -> None:
        """Write a stage's table, in place of one it left before."""
        source, fs = self._at(f"{self.path}/.aside-{uuid.uuid4().hex}")
        rows.write.parquet(source.toString())
        target, _ = self._at(f"{self.path}/{stage}/{name}")
        fs.mkdirs(target.getParent())
        fs.delete(target, True)
        if not fs.rename(source, target):
            fs.delete(source, True)
            refuse(name, f"it could not be put into the folder of {stage}")

    def _note(self, what: str, why: str) -> None:
        self.pending.append((what, why))

    def read(self, stage: str, name: str, what: str, required: bool = True) -> DataFrame | None:
        """A stage's table; None, and a note, where it is pending.

        Pending: the stage has left nothing at all, or it left other tables but not this one and the table is not `required`. Refused: a
        required table that the stage left out, and any table without rows.
        """
        there = self._children(f"{self.path}/{stage}")
        if not there:
            return self._note(what, f"{stage} has left nothing yet")
        if name not in there:
            if required:
                refuse(what, f"{stage} left {', '.join(there)} but no {name}", f"run {stage} again")
            return self._note(what, f"{stage} left no {name}")
        found = self.spark.read.parquet(f"{self.path}/{stage}/{name}")
        if found.isEmpty():
            refuse(what, f"the table {name} of {stage} has no rows", f"run {stage} again")
        return found

    def pending_table(self) -> DataFrame:
        """(what, why): what was noted, in the order of asking."""
        return self.spark.createDataFrame(self.pending, "what string, why string")
