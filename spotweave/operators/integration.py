"""Integration metrics on neighbour edges, contingency tables and moments."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotweave.functions.lineage import cut
from spotweave.operators.linalg import moments_by
from spotweave.operators.parts import connected_parts
from spotweave.operators.results import refuse


def chi_square_tail(x: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """P(chi-square >= x) of whole arrays (or of one number): the upper regularised incomplete gamma function, by series or continued fraction; 1 where there is no degree of freedom."""
    if np.ndim(x) == 0:
        return float(chi_square_tail([x], [dof])[0])
    x, dof = np.asarray(x, float) / 2, np.asarray(dof, float)
    out = np.ones(len(x))
    some = (x > 0) & (dof > 0)
    a, y = dof[some] / 2, x[some]
    front = np.exp(-y + a * np.log(y) - np.array([math.lgamma(v) for v in a]))
    series = y < a + 1
    term = 1 / a
    total = term.copy()
    for n in range(1, 1000):
        term = np.where(series, term * y / (a + n), 0.0)
        total += term
        if (term <= total * 1e-15).all():
            break
    b, tiny = y + 1 - a, 1e-300
    b = np.where(b == 0, tiny, b)
    c, d = np.full(len(y), 1 / tiny), 1 / b
    h = d.copy()
    for i in range(1, 1000):
        an = -i * (i - a)
        b = b + 2
        low = an * d + b
        d = 1 / np.where(low == 0, tiny, low)
        c = b + an / c
        c = np.where(c == 0, tiny, c)
        step = np.where(series, 1.0, c * d)
        h = h * step
        if (np.abs(step - 1) < 1e-15).all():
            break
    out[some] = np.clip(np.where(series, 1 - front * total, front * h), 0, 1)
    return out


def lisi(edges: DataFrame, labels: DataFrame, perplexity: float) -> DataFrame:
    """(key, lisi): inverse Simpson index of the neighbours' labels under Gaussian weights of the given perplexity.

    edges: key, other, dist without self; labels: key, label. One row per query, its neighbours in a list of fixed length.
    """
    x = edges.join(labels.select(F.col("key").alias("other"), "label"), "other").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("dist", "label"))).alias("a"))
    kind = edges.schema["key"].dataType.simpleString()

    def weights(d):
        """Gaussian weights of rows of distances, each row bisected to the perplexity at the same time; inf for no neighbour."""
        n, goal = len(d), math.log(perplexity)
        low, high, beta = np.zeros(n), np.full(n, np.inf), np.ones(n)
        near = d - d.min(axis=1, keepdims=True)
        for _ in range(60):
            p = np.exp(-np.where(np.isfinite(near), near, 0) * beta[:, None]) * np.isfinite(near)
            p /= p.sum(axis=1, keepdims=True)
            h = -(p * np.log(np.maximum(p, 1e-300))).sum(axis=1)
            open_ = np.abs(h - goal) >= 1e-6
            if not open_.any():
                break
            up = open_ & (h > goal)
            low[up] = beta[up]
            high[open_ & ~up] = beta[open_ & ~up]
            beta = np.where(open_, np.where(np.isinf(high), beta * 2, (low + np.where(np.isinf(high), low, high)) / 2), beta)
        return p

    def run(batches):
        for batch in batches:
            lists = batch.column("a")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            row = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            d = np.full((len(sizes), int(sizes.max())), np.inf)
            d[row, place] = flat.field("dist").to_numpy(zero_copy_only=False)
            names, code = np.unique(np.array(flat.field("label").to_pylist(), object).astype(str), return_inverse=True)
            share = np.bincount(row * len(names) + code, weights(d)[row, place], len(sizes) * len(names)).reshape(len(sizes), -1)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(1 / (share**2).sum(axis=1))], names=["key", "lisi"])

    return x.mapInArrow(run, f"key {kind}, lisi double")


def scaled_lisi(values: DataFrame, n_labels: int, batches: bool) -> DataFrame:
    """Median over rows, on [0, 1] with 1 good: mixing for batches, purity for classes."""
    m = F.median("lisi")
    return values.agg(((m - 1) / (n_labels - 1) if batches else (n_labels - m) / (n_labels - 1)).alias("score"))


def kbet(edges: DataFrame, batch: DataFrame, label: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Per label, the share of rows whose neighbours' batches agree with the label's batch shares (chi-square)."""
    x = edges.join(batch.select(F.col("key").alias("other"), "batch"), "other").join(label.select("key", "label"), "key").join(label.select(F.col("key").alias("other"), F.col("label").alias("_l")), "other").where("label = _l")
    share = batch.join(label, "key").groupBy("label", "batch").agg(F.count(F.lit(1)).alias("n"))
    share = share.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("label"))).withColumn("dof", F.count(F.lit(1)).over(Window.partitionBy("label")) - 1)
    seen = x.groupBy("key", "label", "batch").agg(F.count(F.lit(1)).alias("seen"))
    size = x.groupBy("key", "label").agg(F.count(F.lit(1)).alias("k"))
    grid = size.join(share.select("label", "batch", "share", "dof"), "label").join(seen, ["key", "label", "batch"], "left")
    e = F.col("k") * F.col("share")
    stat = grid.groupBy("key", "label").agg(F.sum(F.pow(F.coalesce("seen", F.lit(0)) - e, F.lit(2.0)) / e).alias("stat"), F.first("dof").alias("dof"))

    @F.pandas_udf("double")
    def tail(s, d):
        return pd.Series(chi_square_tail(s.to_numpy(), d.to_numpy()), index=s.index)

    return stat.withColumn("p", tail("stat", "dof")).groupBy("label").agg(F.avg((F.col("p") >= alpha).cast("double")).alias("acceptance"))


def graph_connectivity(edges: DataFrame, label: DataFrame) -> DataFrame:
    """Mean over labels of the share of a label's rows in its largest connected part."""
    l = label.select("key", "label")
    x = edges.select(F.col("key").alias("a"), F.col("other").alias("b")).join(l.select(F.col("key").alias("a"), "label"), "a").join(l.select(F.col("key").alias("b"), F.col("label").alias("_l")), "b").where("label = _l and a <> b")
    part = l.join(connected_parts(x), "key", "left").withColumn("part", F.coalesce("part", "key"))
    size = part.groupBy("label", "part").agg(F.count(F.lit(1)).alias("n"))
    return size.groupBy("label").agg((F.max("n") / F.sum("n")).alias("share")).agg(F.avg("share").alias("graph_connectivity"))


def contingency_scores(cells: DataFrame) -> DataFrame:
    """NMI (arithmetic mean) and ARI of a contingency table (a, b, n), in closed form."""
    w = lambda *c: F.sum("n").over(Window.partitionBy(*c))
    x = cells.withColumn("na", w("a")).withColumn("nb", w("b")).withColumn("t", w())
    pairs = lambda c: c * (c - 1) / 2
    n = F.col("n").cast("double")
    joint = x.agg(F.sum(n / F.col("t") * F.log(n * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"), F.sum(pairs(n)).alias("index"), F.first("t").alias("t"))
    side = lambda c, name: cells.groupBy(c).agg(F.sum("n").cast("double").alias("m")).withColumn("t", F.sum("m").over(Window.partitionBy())).agg((-F.sum(F.col("m") / F.col("t") * F.log(F.col("m") / F.col("t")))).alias(f"h{name}"), F.sum(pairs(F.col("m"))).alias(f"p{name}"))
    out = joint.join(side("a", "a")).join(side("b", "b"))
    chance = F.col("pa") * F.col("pb") / pairs(F.col("t").cast("double"))
    top = (F.col("pa") + F.col("pb")) / 2
    h = (F.col("ha") + F.col("hb")) / 2
    return out.select(F.when(h > 0, F.col("mi") / h).otherwise(1.0).alias("nmi"), F.when(top != chance, (F.col("index") - chance) / (top - chance)).otherwise(1.0).alias("ari"))


def kmeans_agreement(df: DataFrame, vector: str, label: str, k: int, seed: int = 42) -> DataFrame:
    """NMI and ARI of k-means clusters against labels."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(label).alias("b"))
    found = KMeans(k=k, seed=seed).fit(x).transform(x)
    return contingency_scores(found.groupBy(F.col("prediction").cast("string").alias("a"), "b").agg(F.count(F.lit(1)).alias("n")))


def centroid_silhouette(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Mean simplified silhouette: distance to the own label's centroid against the nearest other, so no pair of rows is formed."""
    from spotweave.functions.vectors import squared_norm

    x = df.select(F.col(label).alias("l"), F.col(vector).alias("z"), F.monotonically_increasing_id().alias("id"))
    m = x.select("l", F.posexplode("z").alias("pos", "v")).groupBy("l", "pos").agg(F.avg("v").alias("v")).groupBy("l").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("a")).select(F.col("l").alias("c"), F.col("a.v").alias("m"))
    d = x.join(F.broadcast(m)).select("id", "l", "c", F.sqrt(squared_norm(F.zip_with("z", "m", lambda a, b: a.cast("double") - b))).alias("d"))  # a row per label
    s = d.groupBy("id").agg(F.min(F.when(F.col("c") == F.col("l"), F.col("d"))).alias("own"), F.min(F.when(F.col("c") != F.col("l"), F.col("d"))).alias("near"))
    return s.agg(F.avg((F.col("near") - F.col("own")) / F.greatest("near", "own")).alias("silhouette"))


def pcr(df: DataFrame, vector: str, batch: str, components: int = 10) -> float:
    """Between-batch share of each principal component, weighted by its variance; all from one Gramian and the sums of every batch."""
    by = moments_by(df, vector, vector, batch)
    if not by:
        return 0.0
    total = None
    for m in by.values():
        total = m if total is None else total + m
    centred = total.centred()[0]
    values, vectors = np.linalg.eigh(centred / max(1, total.n - 1))
    order = np.argsort(values)[::-1][: min(components, total.n)]
    mean = total.sx / total.n
    between = sum(m.n * ((m.sx / m.n - mean) @ vectors[:, order]) ** 2 for m in by.values())
    whole = np.maximum(values[order], 0) * max(1, total.n - 1)
    share = np.where(whole > 1e-12 * max(whole.max(initial=0), 1e-300), between / np.maximum(whole, 1e-300), 0.0)
    return float((share * whole).sum() / max(whole.sum(), 1e-300))


def pcr_comparison(before: float, after: float) -> float:
    """How much of the batches' share of variance is gone, none at least."""
    return max(0.0, (before - after) / before) if before > 0 else 0.0


def isolated_labels(df: DataFrame, label: str, batch: str) -> DataFrame:
    """The labels that the fewest batches hold."""
    n = df.groupBy(label).agg(F.countDistinct(batch).alias("n_batches"))
    return n.withColumn("least", F.min("n_batches").over(Window.partitionBy())).where("n_batches = least").drop("least")


def graph_plan(counts: dict[str, int], k: int, least: int, rounds: int = 8) -> tuple[int, list[str]]:
    """Neighbours per batch and the batches kept: k is held to the smallest batch, batches under the floor go, until nothing changes."""
    kept = dict(counts)
    for _ in range(rounds):
        small = [b for b, n in kept.items() if n <= least]
        if not small:
            break
        for b in small:
            del kept[b]
    return min([k, *[n - 1 for n in kept.values()]]) if kept else 0, sorted(kept)


# The names of the metrics of both panels, of the composites, and of what is no metric.
PANELS = {
    "batch": ("ilisi", "kbet", "graph_connectivity", "pcr_comparison", "bras", "silhouette_batch"),
    "bio": ("isolated_labels", "kmeans_nmi", "kmeans_ari", "silhouette_label", "clisi"),
}
COMPOSITES = ("batch_correction", "bio_conservation", "total")
NO_METRICS = ("n_spots", "n_batches", "error")


def split_panels(metrics: DataFrame, name: str = "metric") -> DataFrame:
    """Batch, bio or other for every metric; composites and counts are dropped. Names are compared in lower case, spaces as underscores."""
    m = F.regexp_replace(F.lower(F.trim(F.col(name))), r"\s+", "_")
    panel = F.when(m.isin(*PANELS["batch"]), "batch").when(m.isin(*PANELS["bio"]), "bio").otherwise("other")
    return metrics.where(~m.isin(*COMPOSITES, *NO_METRICS)).withColumn("panel", panel)


# Neighbours (the row itself among them) that the graph metrics read.
GRAPH_SIZES = {"ilisi": 90, "clisi": 90, "kbet": 50, "graph_connectivity": 15}


def graph_at(graph: DataFrame, size: int) -> DataFrame:
    """The edges (key, other, dist) of a padded graph (key, rank, other, dist, the row itself at rank 0) cut at `size` neighbours, itself among them."""
    return graph.where((F.col("rank") > 0) & (F.col("rank") < size) & (F.col("dist") < float("inf"))).select("key", "rank", "other", "dist")


def graph_panel(graph: DataFrame, rows: DataFrame) -> DataFrame:
    """(metric, score) of the metrics that read nothing but a neighbour graph, all from one graph at their own sizes.

    rows: key, batch, label of the graph's rows. A graph narrower than the widest size, or of other rows, is refused.
    """
    need = max(GRAPH_SIZES.values())
    width = graph.groupBy("key").agg(F.max("rank").alias("w")).agg(F.min("w"), F.count(F.lit(1))).first()
    if width[1] and width[0] + 1 < need:
        refuse("the graph panel", f"the graph has {width[0] + 1} neighbours a row and {need} are read", "ask for more neighbours")
    if width[1] != rows.count() or not graph.select("key").distinct().join(rows.select("key"), "key", "left_anti").isEmpty():
        refuse("the graph panel", "the graph and the labels are not of the same rows")
    batch, label = rows.select("key", F.col("batch").alias("label")), rows.select("key", "label")
    n_batch, n_label = rows.agg(F.countDistinct("batch"), F.countDistinct("label")).first()
    at = {m: graph_at(graph, k) for m, k in GRAPH_SIZES.items()}
    wide = GRAPH_SIZES["ilisi"] // 3
    parts = {"clisi": scaled_lisi(lisi(at["clisi"], label, wide), n_label, False), "graph_connectivity": graph_connectivity(at["graph_connectivity"], label)}
    if n_batch > 1:
        parts |= {"ilisi": scaled_lisi(lisi(at["ilisi"], batch, wide), n_batch, True), "kbet": kbet(at["kbet"], rows.select("key", "batch"), label).agg(F.avg("acceptance"))}
    return _scores(parts)


def _scores(parts: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, p in parts.items():
        p = p.toDF("score").select(F.lit(name).alias("metric"), F.col("score").cast("double").alias("score"))
        out = p if out is None else out.unionByName(p)
    return out


def panel(df: DataFrame, key: str, batch: str, label: str, vector: str, before: str | None = None, graph: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """(metric, score, panel): batch removal and conservation of labels of one embedding; ten metrics, from one neighbour graph and the coordinates.

    before: the vector that the embedding's share of batch variance is compared with (default: the embedding's own, which gives 0). With
    one batch only the metrics of labels are there. The graph is built once at the widest size unless one is given.
    """
    from spotweave.operators import silhouette
    from spotweave.operators.knn import padded_graph

    rows = cut(df.select(F.col(key).alias("key"), F.col(batch).cast("string").alias("batch"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("x"), F.col(before or vector).cast("array<double>").alias("y")))
    if graph is None:
        graph = cut(padded_graph(rows.select("key", "batch", "x"), max(GRAPH_SIZES.values()) - 1))
    found = graph_panel(graph, rows)
    agreement = kmeans_agreement(rows, "x", "label", rows.select("label").distinct().count(), seed)
    parts = {
        "isolated_labels": silhouette.isolated_label_score(rows, "key", "batch", "label", "x"), "silhouette_label": silhouette.silhouette_label(rows, "key", "label", "x"),
        "kmeans_nmi": agreement.select("nmi"), "kmeans_ari": agreement.select("ari"),
    }
    if rows.select("batch").distinct().limit(2).count() > 1:
        now, then = pcr(rows, "x", "batch"), pcr(rows, "y", "batch")
        parts |= {"bras": silhouette.bras(rows, "key", "batch", "label", "x"), "pcr_comparison": df.sparkSession.createDataFrame([(pcr_comparison(then, now),)], "score double")}
    return split_panels(found.unionByName(_scores(parts)))
