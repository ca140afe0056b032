"""Corrected arms: a model fitted on gene features from which the batches were taken out first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.operators import correction
from spotweave.operators.linalg import PCA
from spotweave.operators.results import refuse
from spotweave.operators.reuse import ResultStore, fingerprint

# Corrections of features, those whose result depends on the seed, and models that do not read gene features.
CORRECTIONS = ("harmony", "combat")
SEEDED = ("harmony",)
NO_GENES = {"hvg_pca": "it starts from raw counts", "pca_oracle": "it reads the other view", "pca_oracle_matched": "it reads the other view"}


def arm(name: str) -> tuple[str, str] | None:
    """(correction, model) of a corrected arm's name such as combat_pca; None for a model's own name."""
    head, _, model = name.partition("_")
    return (head, model) if model and head in CORRECTIONS else None


def check_arms(names: list[str]) -> None:
    """Refuse corrected arms of models that a correction cannot reach, and corrections of corrections."""
    for name in names:
        own = arm(name)
        if own and own[1] in NO_GENES:
            refuse(f"the model {name}", f"{own[1]} has no corrected form: {NO_GENES[own[1]]}", f"leave {name} out")
        if own and arm(own[1]):
            refuse(f"the model {name}", "a corrected arm is not corrected again", "name one correction")


def arm_reference(name: str) -> str | None:
    """The model that an arm is compared with: the same correction's pca; None for others and for that one itself."""
    own = arm(name)
    return None if own is None or own[1] == "pca" else f"{own[0]}_pca"


class FitRowsPCA:
    """Components of a column fitted on the rows of a condition alone; applied to all rows. `state` rebuilds it elsewhere."""

    def __init__(self, components: int, condition):
        self.pca, self.condition = PCA(components), condition

    def fit(self, df: DataFrame, column: str) -> FitRowsPCA:
        self.pca.fit(df.where(self.condition), column)
        return self

    def apply(self, df: DataFrame, column: str, out: str) -> DataFrame:
        return self.pca.transform(df, column, out)

    def state(self) -> dict:
        return {"mean": self.pca.mean.tolist(), "components": self.pca.components.tolist(), "variance": self.pca.variance.tolist()}

    @classmethod
    def of(cls, state: dict) -> FitRowsPCA:
        import numpy as np

        made = cls(len(state["variance"]), F.lit(True))
        made.pca.mean, made.pca.components, made.pca.variance = (np.array(state[k]) for k in ("mean", "components", "variance"))
        return made


def corrected_block(df: DataFrame, method: str, key: str, block: str, batch: str, fit, components: int = 0, seed: int = 42, store: ResultStore | None = None) -> DataFrame:
    """The rows with the block replaced by its corrected form; every other column is as it was.

    With components the block is projected first, by components of the rows of `fit` alone, so rows held out do not shape it; the width is then theirs. A
    correction that changes the width is refused. With a store the corrected block is kept by method (and seed where the
    method has one) and by the fingerprint of what went in, and taken from there when it comes again.
    """
    if method not in CORRECTIONS:
        refuse(f"a {method} correction", "there is no such method", f"any of {CORRECTIONS}")
    own = df.select(key, F.col(batch).alias("_batch"), F.col(block).cast("array<double>").alias("_x"), F.lit(fit).alias("_fit"))
    if components:
        own = FitRowsPCA(components, F.col("_fit")).fit(own, "_x").apply(own, "_x", "_x")
    own = own.select(key, "_batch", "_x")

    def make() -> DataFrame:
        made = correction.harmony(own, key, "_batch", "_x", out="_z", seed=seed) if method == "harmony" else correction.combat(own, "_batch", "_x", "_z")
        return made.select(key, F.col("_z"))

    params = {"method": method, "components": components, "batch": batch} | ({"seed": seed} if method in SEEDED else {})
    made = make() if store is None else store.reuse("corrected_block", params, fingerprint(own), make)[0]
    wide = own.join(made, key).where(F.size("_x") != F.size("_z"))
    if not wide.isEmpty():
        refuse(f"the {method} block", "its width changed", "models read it by place")
    return df.drop(block).join(made.select(key, F.col("_z").alias(block)), key).select(*df.columns)


def resolved(df: DataFrame, name: str, key: str, block: str, batch: str, fit, **options) -> tuple[DataFrame, str, str]:
    """The rows that an arm's model reads, the model's own name, and the correction (none for a plain model)."""
    check_arms([name])
    own = arm(name)
    if own is None:
        return df, name, "none"
    return corrected_block(df, own[0], key, block, batch, fit, **options), own[1], own[0]
