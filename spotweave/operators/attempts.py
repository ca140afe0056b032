"""Comparing methods of which one may take its workers down: a crash becomes a row, and the comparison is still refused."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotweave.functions.lineage import cut
from spotweave.operators.results import Refused, refuse

# What Spark says when a task took its worker or executor down (after its own retries).
CRASHES = ("Python worker exited unexpectedly", "ExecutorLostFailure")


def attempt(make: Callable[[], DataFrame]) -> tuple[DataFrame | None, str | None]:
    """(rows, None), written once, or (None, why) if workers died of it. Every other error goes on."""
    try:
        return cut(make()), None
    except (PySparkException, Py4JJavaError) as e:
        why = next((c for c in CRASHES if c in str(e)), None)
        if why is None:
            raise
        return None, why


def compared(spark: SparkSession, methods: dict[str, Callable[[], DataFrame]], score: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """(method, crash, and score's columns) of all methods, each method's rows made once.

    A method whose workers died has one row with the reason in `crash` and nulls elsewhere; the others are scored all the same. `keep` gets all
    rows before the comparison is refused because of a crash.
    """
    out, crashed = None, []
    for name, make in methods.items():
        made, why = attempt(make)
        if made is None:
            crashed.append((name, why))
            continue
        rows = score(made).select(F.lit(name).alias("method"), F.lit(None).cast("string").alias("crash"), "*")
        out = rows if out is None else out.unionByName(rows)
    if crashed:
        failed = spark.createDataFrame(crashed, "method string, crash string")
        out = failed if out is None else out.unionByName(failed, allowMissingColumns=True)
        if keep is not None:
            keep(out)
        refuse("the comparison", "; ".join(f"{n}: {w}" for n, w in crashed), "leave these methods out or mend them")
    if keep is not None and out is not None:
        keep(out)
    return spark.createDataFrame([], "method string, crash string") if out is None else out


def scored_representations(df: DataFrame, key: str, representations: dict[str, str], score: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(representation, embedding, n_rows, and score's columns): one driver over feature columns and every model and seed.

    representations: name (such as `model (seed n)`) to its vector column; score(df, column) gives the rows of one, for example those of
    integration.panel. `embedding` is the fingerprint of keys and vectors: a score may be used again for an equal one only. An error is
    refused under the representation's name; none is left out.
    """
    from spotweave.operators.reuse import fingerprint

    if not representations:
        refuse("the scores of representations", "none was named")
    out = None
    for name, column in representations.items():
        if column not in df.columns:
            refuse(f"the scores of {name}", f"there is no column {column}")
        mark = fingerprint(df.select(F.col(key).alias("key"), F.col(column).alias("x")))
        try:
            rows = cut(score(df, column))
        except (Refused, ImportError):
            raise
        except Exception as e:
            refuse(f"the scores of {name}", f"{type(e).__name__}: {e}")
        rows = rows.select(F.lit(name).alias("representation"), F.lit(mark).alias("embedding"), F.lit(df.count()).cast("long").alias("n_rows"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out
