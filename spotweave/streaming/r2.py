"""R2 as a stream: an extension, for the batch engine has no streams.

The same additive sums run in complete mode over predictions that keep arriving.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from spotweave.operators.biosignal import r2_by_target


def r2_stream(spark, path: str, schema: str, by: list[str], truth: str = "truth", guess: str = "guess") -> DataFrame:
    """A streaming frame of R2 by target over the Parquet files that appear under a path."""
    return r2_by_target(spark.readStream.schema(schema).parquet(path), by, truth, guess)


def run_to_memory(stream: DataFrame, name: str):
    """Process what is there now into a table of the session."""
    q = stream.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
