"""Representations: fit on one split, embed every row; and the transforms of an ablation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.functions.keys import digest_number
from spotweave.operators.linalg import PCA
from spotweave.operators.network import Adversarial, Guided, Trainer
from spotweave.operators.sampling import permuted


def pca_embedding(df: DataFrame, vector: str, k: int, fit: str = "true", out: str = "z") -> DataFrame:
    """Components of the rows that meet `fit`, applied to all."""
    return PCA(k).fit(df.where(fit), vector).transform(df, vector, out)


def concatenated(df: DataFrame, *vectors: str, out: str = "both") -> DataFrame:
    return df.withColumn(out, F.concat(*[F.col(v).cast("array<double>") for v in vectors]))


class Autoencoder:
    """A two-layer network from one vector to another through a normalised latent layer, trained on all rows where they lie."""

    def __init__(self, latent: int = 16, hidden: int = 64, epochs: int = 30, rate: float = 3e-3, seed: int = 42, batches: int = 8):
        self.trainer = Trainer(Guided(latent, hidden), batches=batches, epochs=epochs, rate=rate, seed=seed)

    def fit(self, df: DataFrame, source: str, target: str, key: str) -> Autoencoder:
        self.trainer.fit(df, source, target, key)
        self.history = self.trainer.history
        return self

    def transform(self, df: DataFrame, source: str, key: str) -> DataFrame:
        """(key, z): the latent layer of every row."""
        return self.trainer.transform(df, source, key)


class DomainAdversarial:
    """The same network with a discriminator of slides behind a reversed gradient, asked only about slides of the row's tissue."""

    def __init__(self, latent: int = 16, hidden: int = 64, judge: int = 32, epochs: int = 30, rate: float = 3e-3, strength: float = 0.5, smoothing: float = 0.1, seed: int = 42, batches: int = 8):
        self.options, self.net = {"epochs": epochs, "rate": rate, "seed": seed, "batches": batches}, (latent, hidden, judge)
        self.smoothing, self.strength = smoothing, strength

    def fit(self, df: DataFrame, source: str, target: str, key: str, slide: str, tissue: str) -> DomainAdversarial:
        pairs = df.select(slide, tissue).distinct().collect()  # a row per slide
        slides, tissues = sorted({r[slide] for r in pairs}), sorted({r[tissue] for r in pairs})
        valid = np.zeros((len(tissues), len(slides)), bool)
        for r in pairs:
            valid[tissues.index(r[tissue]), slides.index(r[slide])] = True
        spark = df.sparkSession
        code = lambda names, a, b: F.broadcast(spark.createDataFrame([(v, i) for i, v in enumerate(names)], f"{a} {df.schema[a].dataType.simpleString()}, {b} int"))
        rows = df.join(code(slides, slide, "_domain"), slide).join(code(tissues, tissue, "_context"), tissue)  # a row per slide and per tissue
        self.trainer = Trainer(Adversarial(*self.net, valid, self.smoothing, self.strength), **self.options)
        self.trainer.fit(rows, source, target, key, "_domain", "_context", len(slides), len(tissues))
        self.history = self.trainer.history
        return self

    def transform(self, df: DataFrame, source: str, key: str) -> DataFrame:
        return self.trainer.transform(df, source, key)


def transform_patches(df: DataFrame, strategy: str, vector: str, sample: str, key: str, seed: int = 42) -> DataFrame:
    """The ablation's conditions: none, shuffled within a sample or among all rows, or Gaussian of the same moments."""
    if strategy == "none":
        return df
    if strategy == "within_sample":
        return permuted(df, key, vector, [sample], seed, "patch")
    if strategy == "global":
        return permuted(df, key, vector, [], seed, "patch")
    if strategy != "gaussian":
        raise ValueError(f"unknown strategy {strategy!r}")
    m = df.select(F.posexplode(vector).alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    m = m.agg(F.array_sort(F.collect_list(F.struct("pos", "m", "s"))).alias("a"))
    u = lambda p, i: (digest_number(seed, p, F.col(key), i) + 1) / F.lit(4294967297.0)
    x = df.join(F.broadcast(m))  # one row
    return x.withColumn(vector, F.transform("a", lambda e: e["m"] + e["s"] * F.sqrt(-2 * F.log(u("n1", e["pos"]))) * F.cos(2 * np.pi * u("n2", e["pos"])))).drop("a")


PATCH_TRANSFORMS = ("none", "within_sample", "global", "gaussian")
EMBEDDERS = {"pca": pca_embedding, "ae": Autoencoder, "cdann": DomainAdversarial}
