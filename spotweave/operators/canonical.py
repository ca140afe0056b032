"""Canonical correlation of two wide views, its nulls and its held-out form, from additive moments.

Both views are reduced to their own components first, at most a fifth as many as there are rows, by projecting moments, not rows.
Nulls pair each row's left side with another row's right side. Rows are dealt once into random bundles (of all rows, or of a slide's)
and shuffled inside them, every permutation in the same task, so no row is copied for a permutation; only the cross moments of
a permutation leave a task. Shuffling inside random bundles is a subgroup of all shuffles, under which rows are exchangeable too.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.operators.linalg import Moments, cca, moments_by, moments_of, projected_correlation

#: Rows of a bundle at most, and bytes of its vectors.
BUNDLE, BUNDLE_BYTES = 8192, 1 << 26
#: Fewest rows that train and that are tested when a slide is held out.
MIN_TRAIN, MIN_TEST = 50, 20


class Reduction:
    """Each side's leading components, of its own centred moments."""

    def __init__(self, m: Moments, most: int):
        xx, _, yy = m.centred()
        self.mx, self.my = m.sx / m.n, m.sy / m.n
        self.vx, self.vy = (self._leading(s, min(most, len(s), max(2, m.n // 5))) for s in (xx, yy))

    @staticmethod
    def _leading(s: np.ndarray, k: int) -> np.ndarray:
        values, vectors = np.linalg.eigh(s)
        return vectors[:, np.argsort(values)[::-1][:k]]

    def of(self, m: Moments) -> Moments:
        """Moments of any group of the rows in reduced coordinates, about the means of all."""
        xx, xy, yy = m.centred(self.mx, self.my)
        return Moments(m.n, self.vx.T @ (m.sx - m.n * self.mx), self.vy.T @ (m.sy - m.n * self.my), self.vx.T @ xx @ self.vx, self.vx.T @ xy @ self.vy, self.vy.T @ yy @ self.vy)


def shuffled_cross_moments(df: DataFrame, left: str, right: str, key: str, times: int, reduction: Reduction, group: str | None = None, seed: int = 42, bundle: int = BUNDLE) -> np.ndarray:
    """(times, a, b): sums of products of reduced left sides with right sides shuffled inside bundles of the whole or of each group."""
    wide = 8 * (len(reduction.mx) + len(reduction.my))
    rows = max(2, min(bundle, BUNDLE_BYTES // wide))
    x = df.where(F.col(left).isNotNull() & F.col(right).isNotNull())
    x = x.select(F.col(key).cast("string").alias("k"), (F.col(group).cast("string") if group else F.lit("all")).alias("g"), F.col(left).cast("array<double>").alias("x"), F.col(right).cast("array<double>").alias("y"))
    sizes = x.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / rows).alias("parts"))
    dealt = x.join(sizes, "g").withColumn("b", F.pmod(F.xxhash64("k"), F.col("parts")))
    schema = pa.schema([("p", pa.int32()), ("xy", pa.binary())])
    a, b = reduction.vx.shape[1], reduction.vy.shape[1]
    r = reduction

    def run(name, table):
        order = np.argsort(np.array(table.column("k").to_pylist()), kind="stable")
        take = lambda c: table.column(c).combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)[order]
        u, v = (take("x") - r.mx) @ r.vx, (take("y") - r.my) @ r.vy
        mark = zlib.crc32("|".join(str(n.as_py()) for n in name).encode())
        out = [(u.T @ v[np.random.default_rng([seed, mark, p]).permutation(len(v))]).tobytes() for p in range(times)]
        return pa.table([pa.array(range(times), pa.int32()), pa.array(out, pa.binary())], schema=schema)

    def add(table: pa.Table) -> pa.Table:
        total = None
        for v in table.column("xy"):
            part = np.frombuffer(v.as_py(), np.float64)
            total = part.copy() if total is None else total + part
        return pa.table([[table.column("p")[0].as_py()], [total.tobytes()]], schema=schema)

    parts = dealt.select("g", "b", "k", "x", "y").groupBy("g", "b").applyInArrow(run, "p int, xy binary").groupBy("p").applyInArrow(add, "p int, xy binary")
    out = np.zeros((times, a, b))
    for row in parts.collect():  # permutations x reduced dimensions, both parameters
        out[row["p"]] = np.frombuffer(row["xy"], np.float64).reshape(a, b)
    return out


def _null(m: Moments, shuffled: np.ndarray, ridge: float, report: int) -> np.ndarray:
    xx, _, yy = m.centred()
    # products about the means of all: those of the reduced sides are zero
    return np.array([cca(Moments(m.n, 0 * m.sx, 0 * m.sy, xx, xy, yy), ridge, report)[0] for xy in shuffled])


def spectrum(df: DataFrame, left: str, right: str, slide: str, key: str, dim: int = 50, ridge: float = 1e-4, report: int = 10, permutations: int = 50, seed: int = 42, bundle: int = BUNDLE) -> dict:
    """Canonical correlations, the means and 95 % quantiles of both nulls, and the shares of shared variance that slides do not explain."""
    whole = moments_of(df, left, right)
    if whole is None or whole.n < 4:
        raise ValueError("too few rows for canonical correlations")
    r = Reduction(whole, dim)
    m = r.of(whole)
    found = {"observed": cca(m, ridge, report)[0]}
    for name, group in (("global", None), ("within_slide", slide)):
        null = _null(m, shuffled_cross_moments(df, left, right, key, permutations, r, group, seed, bundle), ridge, report)
        found |= {f"{name}_mean": null.mean(axis=0), f"{name}_q95": np.percentile(null, 95, axis=0)}
    shared = float((found["observed"] ** 2).sum())
    for name in ("mean", "q95"):
        found[f"spot_level_{name}"] = max(0.0, shared - float((found[f"within_slide_{name}"] ** 2).sum())) / shared if shared > 0 else None
    return found | {"n": int(whole.n), "reduction": r}


def spectrum_rows(df: DataFrame, left: str, right: str, slide: str, key: str, **options) -> DataFrame:
    """spectrum as rows (variant, component, correlation, q95); the shares of spots are variants of one row."""
    f = spectrum(df, left, right, slide, key, **options)
    rows = [("observed", i, float(v), None) for i, v in enumerate(f["observed"])]
    for name in ("global", "within_slide"):
        rows += [(name, i, float(m), float(q)) for i, (m, q) in enumerate(zip(f[f"{name}_mean"], f[f"{name}_q95"], strict=True))]
    rows += [(f"spot_level_{n}_null", 0, f[f"spot_level_{n}"], None) for n in ("mean", "q95")]
    return df.sparkSession.createDataFrame(rows, "variant string, component int, correlation double, q95 double")


def held_out_slides(df: DataFrame, left: str, right: str, slide: str, patient: str, reduction: Reduction, ridge: float = 1e-4, report: int = 10, min_train: int = MIN_TRAIN, min_test: int = MIN_TEST) -> list[dict]:
    """Each slide measured by the projections of the others, in reduced coordinates; paired where another slide of its patient trains. A row per slide is on the driver."""
    by = {k: reduction.of(m) for k, m in moments_by(df, left, right, slide).items()}
    owner = {str(r[slide]): r[patient] for r in df.select(slide, patient).distinct().collect()}  # a row per slide
    total = None
    for m in by.values():
        total = m if total is None else total + m
    rows = []
    for name, m in sorted(by.items()):
        train = total - m
        if train.n < min_train or m.n < min_test:
            continue
        rho, wx, wy = cca(train, ridge, report)
        test = projected_correlation(m, wx, wy, train.sx / train.n, train.sy / train.n)
        paired = any(owner[o] == owner[name] for o in by if o != name)
        rows.append({"slide": name, "patient": str(owner[name]), "paired": paired, "rho1_train": float(rho[0]), "rho1_test": float(test[0]), "n_test": int(m.n)})
    return rows


def ceiling(df: DataFrame, left: str, right: str, slide: str, patient: str, key: str, dim: int = 50, ridge: float = 1e-4, report: int = 10, permutations: int = 50, min_train: int = MIN_TRAIN, min_test: int = MIN_TEST, seed: int = 42) -> DataFrame:
    """The whole diagnostic as one row: the first correlation against its null, shares of spots, and held-out slides with and without a sibling of their patient.

    patient_gap is the difference of the held-out means of paired and unpaired slides; where one of the two groups is empty it is null and `note` says which.
    """
    f = spectrum(df, left, right, slide, key, dim, ridge, report, permutations, seed)
    rows = held_out_slides(df, left, right, slide, patient, f["reduction"], ridge, report, min_train, min_test)
    mean = lambda xs: float(np.mean(xs)) if xs else None
    with_, without = [r["rho1_test"] for r in rows if r["paired"]], [r["rho1_test"] for r in rows if not r["paired"]]
    gap = mean(with_) - mean(without) if with_ and without else None
    note = None if gap is not None else "no slide could be held out" if not rows else "every held-out slide has a sibling of its patient" if with_ else "no held-out slide has a sibling of its patient"
    row = (f["n"], df.select(slide).distinct().count(), float(f["observed"][0]), float(f["within_slide_q95"][0]), f["spot_level_mean"], f["spot_level_q95"], len(rows), mean([r["rho1_train"] for r in rows]), mean([r["rho1_test"] for r in rows]), mean(with_), mean(without), gap, note)
    names = "n_spots long, n_slides long, rho1 double, rho1_within_q95 double, spot_level_mean double, spot_level_q95 double, n_held_out int, rho1_train double, rho1_test double, rho1_paired double, rho1_unpaired double, patient_gap double, note string"
    return df.sparkSession.createDataFrame([row], names)
