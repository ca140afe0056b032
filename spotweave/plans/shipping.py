"""Gives the executors this package's code."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add the package as a file of the application, once; the driver serves it to the executors."""
    context = spark.sparkContext
    if getattr(context, "_spotweave_code", False):
        return
    top = Path(__file__).resolve().parents[1]
    base = Path(tempfile.mkdtemp(prefix="spotweave-")) / "spotweave"
    shutil.copytree(top, base / top.name, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(str(base), "zip", base))
    context._spotweave_code = True
