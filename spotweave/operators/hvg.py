"""Gene selection and principal components from raw counts, without a dense matrix.

Counts stay long rows (sample_id, spot, gene, count). Genes are ranked on the fit spots' raw counts; the values of the kept ones,
log1p of counts per ten thousand, are gathered per spot as (places, values), so a row is as wide as the spot has genes. The Gramian of
these sparse rows is summed in tasks and added by blocks of genes; means and deviations enter it afterwards. The embedding takes
the offset of all absent genes at once. A spot without counts is a zero row, so the result has the rows of the spot table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.functions.lineage import cut
from spotweave.operators.counts import dispersion, vocabulary

#: Genes of a block of the Gramian, and genes that may be kept at all: the Gramian is one matrix on the driver.
BLOCK, MOST_GENES = 256, 8192
SPOT = ["sample_id", "spot"]


def ranked_genes(counts: DataFrame, fit: DataFrame, n_top: int, min_expressed: int = 1) -> DataFrame:
    """(gene, score, place): the n_top genes of largest dispersion on the fit spots among those that every slide has; places (from 0) by gene.

    counts: of all slides; fit: sample_id, spot. The vocabulary is that of all slides, the ranking that of the fit spots. Ties of the score go to the smaller gene.
    """
    shared = vocabulary(counts, min_expressed).select("gene")
    own = cut(counts.join(fit.select(*SPOT).distinct(), SPOT, "left_semi"))
    n = own.select(*SPOT).distinct().count()
    if n < 2:
        raise ValueError(f"{n} of the fit spots have counts; two are needed to rank genes")
    scores = dispersion(own.join(shared, "gene", "left_semi"), n).select("gene", "score")
    top = scores.orderBy(F.desc("score"), "gene").limit(n_top)
    rows = sorted(top.collect())  # n_top rows
    kind = counts.schema["gene"].dataType.simpleString()
    return counts.sparkSession.createDataFrame([(r["gene"], r["score"], i) for i, r in enumerate(rows)], f"gene {kind}, score double, place int")


def sparse_rows(counts: DataFrame, genes: DataFrame, scale: float = 1e4) -> DataFrame:
    """(sample_id, spot, places, values) of spots with counts: log1p(count / total * scale) of the kept genes, by place. The total is of all the spot's genes."""
    placed = counts.join(F.broadcast(genes.select("gene", "place")), "gene", "left")  # n_top rows
    value = F.when(F.col("place").isNotNull(), F.struct("place", F.col("count").cast("double").alias("count")))
    rows = placed.groupBy(*SPOT).agg(F.sum("count").cast("double").alias("total"), F.array_sort(F.collect_list(value)).alias("e"))
    values = F.transform("e", lambda e: F.when(F.col("total") > 0, F.log1p(e["count"] / F.col("total") * scale)).otherwise(0.0))
    return rows.select(*SPOT, F.col("e.place").alias("places"), values.alias("values"))


def gene_scaler(rows: DataFrame, n_genes: int) -> DataFrame:
    """(place, mean, sd) over all rows, absent genes as zeros; population deviation, under 1e-8 it is 1."""
    n = rows.count()
    sums = rows.select(F.explode(F.arrays_zip("places", "values")).alias("e")).groupBy(F.col("e.places").alias("place")).agg(F.sum("e.values").alias("s"), F.sum(F.col("e.values") * F.col("e.values")).alias("q"))
    every = rows.sparkSession.range(n_genes).select(F.col("id").cast("int").alias("place"))
    x = every.join(sums, "place", "left").select("place", (F.coalesce("s", F.lit(0.0)) / n).alias("mean"), (F.coalesce("q", F.lit(0.0)) / n).alias("square"))
    sd = F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    return x.select("place", "mean", F.when(sd < 1e-8, 1.0).otherwise(sd).alias("sd"))


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """(flat, sizes) of a list column."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def sparse_gramian(rows: DataFrame, n_genes: int) -> np.ndarray:
    """Sum of outer products of sparse rows. Tasks send blocks of BLOCK genes' rows; a block's parts are added apart from the others'."""
    if n_genes > MOST_GENES:
        raise ValueError(f"more than {MOST_GENES} genes")
    schema = pa.schema([("block", pa.int32()), ("g", pa.binary())])

    def run(batches):
        total = np.zeros((n_genes, n_genes))
        for batch in batches:
            places, sizes = _lists(batch.column("places"))
            values, _ = _lists(batch.column("values"))
            ends = np.cumsum(sizes)
            for lo, hi in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
                at, v = places[lo:hi], values[lo:hi]
                total[np.ix_(at, at)] += np.outer(v, v)
        starts = range(0, n_genes, BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array([s // BLOCK for s in starts], pa.int32()), pa.array([total[s : s + BLOCK].tobytes() for s in starts], pa.binary())], schema=schema)

    def add(table: pa.Table) -> pa.Table:
        total = None
        for v in table.column("g"):
            part = np.frombuffer(v.as_py(), np.float64)
            total = part.copy() if total is None else total + part
        return pa.table([[table.column("block")[0].as_py()], [total.tobytes()]], schema=schema)

    parts = rows.select("places", "values").mapInArrow(run, "block int, g binary").groupBy("block").applyInArrow(add, "block int, g binary")
    out = np.zeros((n_genes, n_genes))
    for r in parts.collect():  # n_genes x n_genes, checked
        part = np.frombuffer(r["g"], np.float64).reshape(-1, n_genes)
        out[r["block"] * BLOCK : r["block"] * BLOCK + len(part)] = part
    return out


class HvgPca:
    """Counts to principal components: kept genes, their scaler and the components are fitted on the fit spots."""

    def __init__(self, n_top: int = 2000, components: int = 128, min_expressed: int = 1, scale: bool = True):
        self.n_top, self.components, self.min_expressed, self.scale = n_top, components, min_expressed, scale

    def fit(self, counts: DataFrame, fit: DataFrame) -> HvgPca:
        """counts: sample_id, spot, gene, count of all slides; fit: sample_id, spot. Components are capped at the spots and genes there are."""
        self.genes = cut(ranked_genes(counts, fit, self.n_top, self.min_expressed))
        n_genes = self.genes.count()
        asked = fit.select(*SPOT).distinct()
        rows = cut(sparse_rows(counts.join(asked, SPOT, "left_semi"), self.genes))
        n, total = rows.count(), asked.count()
        scaler = sorted(gene_scaler(rows, n_genes).collect())  # n_genes rows
        self.mean = np.array([r["mean"] for r in scaler])
        self.sd = np.array([r["sd"] for r in scaler]) if self.scale else np.ones(n_genes)
        centred = (sparse_gramian(rows, n_genes) - n * np.outer(self.mean, self.mean)) / np.outer(self.sd, self.sd)
        values, vectors = np.linalg.eigh(centred / (n - 1))
        k = min(self.components, n, n_genes)
        order = np.argsort(values)[::-1][:k]
        v = vectors[:, order]
        sign = np.sign(v[np.abs(v).argmax(axis=0), np.arange(k)])
        self.vectors, self.variance = v * np.where(sign == 0, 1, sign), np.maximum(values[order], 0)
        self.history = {
            "n_components": k, "n_fit_spots": n, "n_fit_spots_unresolved": total - n, "input_dim": n_genes, "n_shared_genes": vocabulary(counts, self.min_expressed).count(),
            "explained_variance_ratio": float(self.variance.sum() / max(np.maximum(values, 0).sum(), 1e-300)), "scaled": self.scale,
        }
        return self

    def embed(self, counts: DataFrame, spots: DataFrame, out: str = "z") -> DataFrame:
        """The spots with their components; a spot without counts has zeros, and found is false."""
        rows = sparse_rows(counts.join(spots.select(*SPOT).distinct(), SPOT, "left_semi"), self.genes)
        x = spots.join(rows, SPOT, "left").withColumn("found", F.col("places").isNotNull())
        weights = self.vectors / self.sd[:, None]
        shared = spots.sparkSession.sparkContext.broadcast((weights, self.mean @ weights))  # at most MOST_GENES x components
        k = weights.shape[1]
        names = [*spots.columns, "found"]

        def run(batches):
            w, offset = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                found = batch.column("found").to_numpy(zero_copy_only=False)
                places, values = batch.column("places"), batch.column("values")
                sizes = np.where(found, np.nan_to_num(pc.list_value_length(places).to_numpy(zero_copy_only=False).astype(float)), 0).astype(np.int64)
                at, v = places.flatten().to_numpy(zero_copy_only=False), values.flatten().to_numpy(zero_copy_only=False)
                z = np.zeros((batch.num_rows, k))
                some = np.flatnonzero(sizes)
                if len(some):
                    z[some] = np.add.reduceat(w[at] * v[:, None], (np.cumsum(sizes) - sizes)[some], axis=0)
                z[found] -= offset
                made = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, k).astype(np.int32)), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), made], names=[*names, out])

        kinds = ", ".join(f"`{c}` {x.schema[c].dataType.simpleString()}" for c in names)
        return x.select(*names, "places", "values").mapInArrow(run, f"{kinds}, `{out}` array<double>")
