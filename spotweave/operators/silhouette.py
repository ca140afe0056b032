"""Exact silhouettes: every row's mean distance to the rows of each label, by tiles of bounded size.

Rows are cut into chunks; a task gets one chunk and goes through the others of its scope, and answers with a
sum of distances and a count for each row and label. No pair of rows leaves a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.operators.knn import CHUNK, _chunks, _matrix


def label_distances(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(scope, key, own, label, total, n): sums of Euclidean distances from each row to the other rows of each label of its scope.

    rows: scope, key, label (strings but for key), x (array<double>).
    """
    kind = rows.schema["key"].dataType.simpleString()
    a = _chunks(rows, "scope", ["key", "label", "x"], "left", chunk)
    b = _chunks(rows.select("scope", "key", "label", "x"), "scope", ["key", "label", "x"], "right", chunk)
    parts = rows.groupBy("scope").agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).alias("_n"))
    tiles = a.drop("_c").join(parts, "scope").withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    work = tiles.join(b, ["scope", "_c"]).select("scope", "left", "right")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                left, right = batch.column("left")[i].values, batch.column("right")[i].values
                x, y = _matrix(left), _matrix(right)
                names, code = np.unique(np.array(right.field("label").to_pylist(), object).astype(str), return_inverse=True)
                order = np.argsort(code, kind="stable")
                y, cuts = y[order], np.flatnonzero(np.diff(code[order], prepend=-1))
                own, other = left.field("key").to_pylist(), np.array(right.field("key").to_pylist(), object)[order]
                at = {k: j for j, k in enumerate(other.tolist())}
                n = np.diff(np.append(cuts, len(y)))
                for lo in range(0, len(x), 256):
                    part = x[lo : lo + 256]
                    d = np.sqrt(np.maximum(0, (part * part).sum(axis=1)[:, None] - 2 * part @ y.T + (y * y).sum(axis=1)[None]))
                    for r, k in enumerate(own[lo : lo + 256]):
                        if k in at:
                            d[r, at[k]] = 0.0  # the row itself
                    total = np.add.reduceat(d, cuts, axis=1)
                    m = len(part)
                    who = np.repeat(np.arange(lo, lo + m), len(names))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([batch.column("scope")[i].as_py()] * len(who), pa.string()), left.field("key").take(pa.array(who)), left.field("label").take(pa.array(who)),
                            pa.array(np.tile(names, m).tolist(), pa.string()), pa.array(total.ravel()), pa.array(np.tile(n, m)),
                        ],
                        names=["scope", "key", "own", "label", "total", "n"],
                    )

    found = work.mapInArrow(run, f"scope string, key {kind}, own string, label string, total double, n long")
    return found.groupBy("scope", "key", "own", "label").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def silhouettes(distances: DataFrame, between: str = "nearest") -> DataFrame:
    """(scope, key, own, s) of label distances; 0 for the only row of its label, none in a scope of one label.

    between: the other labels count by the nearest of them (nearest) or by the mean of their means (mean).
    """
    own = F.col("label") == F.col("own")
    other = F.when(~own, F.col("total") / F.col("n"))
    x = distances.groupBy("scope", "key", "own").agg(
        F.max(F.when(own, F.col("total"))).alias("t"), F.max(F.when(own, F.col("n"))).alias("m"), (F.min(other) if between == "nearest" else F.avg(other)).alias("b")
    ).where("b is not null")
    a = F.col("t") / (F.col("m") - 1)
    return x.select("scope", "key", "own", F.when(F.col("m") > 1, F.coalesce((F.col("b") - a) / F.greatest(a, "b"), F.lit(0.0))).otherwise(0.0).alias("s"))


def _rows(df: DataFrame, scope, label: str, key: str, vector: str) -> DataFrame:
    return df.select(scope.alias("scope"), F.col(key).alias("key"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("x"))


def silhouette_label(df: DataFrame, key: str, label: str, vector: str, chunk: int = CHUNK) -> DataFrame:
    """Mean silhouette of the labels, on [0, 1]."""
    return silhouettes(label_distances(_rows(df, F.lit("all"), label, key, vector), chunk)).agg(((F.avg("s") + 1) / 2).alias("silhouette_label"))


def bras(df: DataFrame, key: str, batch: str, label: str, vector: str, chunk: int = CHUNK) -> DataFrame:
    """Batch removal: within every label, 1 - |s| of the batches' silhouettes against the mean of the others; averaged over a label, then over labels."""
    s = silhouettes(label_distances(_rows(df, F.col(label).cast("string"), batch, key, vector), chunk), "mean")
    return s.groupBy("scope").agg(F.avg(1 - F.abs("s")).alias("v")).agg(F.avg("v").alias("bras"))


def isolated_label_score(df: DataFrame, key: str, batch: str, label: str, vector: str, chunk: int = CHUNK) -> DataFrame:
    """Mean silhouette, on [0, 1], of the labels that the fewest batches hold, each against all other rows."""
    from spotweave.operators.integration import isolated_labels

    few = isolated_labels(df, label, batch).select(F.col(label).cast("string").alias("own"))
    d = label_distances(_rows(df, F.lit("all"), label, key, vector), chunk).join(F.broadcast(few), "own", "left_semi")  # a row per isolated label
    rest = F.when(F.col("label") == F.col("own"), F.col("own")).otherwise(F.lit("\u0001rest"))
    two = d.withColumn("label", rest).groupBy("scope", "key", "own", "label").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return silhouettes(two).groupBy("own").agg(((F.avg("s") + 1) / 2).alias("v")).agg(F.avg("v").alias("isolated_labels"))


