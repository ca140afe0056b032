"""Spots on images: an affine map from landmarks by normal equations, and its application; geometric layer widths."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_affine(landmarks: DataFrame) -> np.ndarray:
    """The 2 x 3 map of (col, row, 1) to (image_x, image_y) by least squares over complete landmarks.

    The sums of products are aggregated where the rows are; only nine numbers reach the driver. Fewer than three
    landmarks, landmarks on a line, and maps that flatten the plane are errors.
    """
    good = landmarks.select(*[F.col(c).cast("double").alias(c) for c in ("col", "row", "image_x", "image_y")]).dropna()
    u = [F.col("col"), F.col("row"), F.lit(1.0)]
    sums = [F.sum(a * b) for a in u for b in u] + [F.sum(a * F.col(t)) for t in ("image_x", "image_y") for a in u]
    n, *found = good.agg(F.count(F.lit(1)), *sums).first()
    if n < 3:
        raise ValueError(f"{n} landmarks; three are needed")
    gram, right = np.array(found[:9], float).reshape(3, 3), np.array(found[9:], float).reshape(2, 3)
    scale = np.sqrt(np.diag(gram))
    scale[scale == 0] = 1
    if np.linalg.matrix_rank(gram / np.outer(scale, scale), tol=1e-9) < 3:
        raise ValueError("the landmarks lie on a line")
    out = np.linalg.solve(gram, right.T).T
    if abs(np.linalg.det(out[:, :2])) <= 1e-8:
        raise ValueError("the map flattens the plane")
    return out


def first_present(df: DataFrame, names: tuple[str, ...], default: float | None = None) -> F.Column:
    """The first of the columns that the frame has, else the default; without one it is an error."""
    for n in names:
        if n in df.columns:
            return F.col(n)
    if default is None:
        raise KeyError(f"none of {names}")
    return F.lit(default)


def spot_pixels(spots: DataFrame, affine: np.ndarray | None = None) -> DataFrame:
    """Image and array coordinates of spots: by an affine map of the array's, or from x_pixel and y_pixel, which are transposed."""
    col, row = first_present(spots, ("array_col", "y_array"), 0), first_present(spots, ("array_row", "x_array"), 0)
    if affine is None:
        x, y = F.col("y_pixel"), F.col("x_pixel")
    else:
        x, y = (float(m[0]) * col + float(m[1]) * row + float(m[2]) for m in affine)
    return spots.withColumns({"image_x": x, "image_y": y, "array_col": col, "array_row": row})


def layer_widths(first: int, last: int, layers: int) -> list[int]:
    """Widths of `layers` linear layers: powers of two along a geometric line, with both ends as given."""
    if layers < 1:
        raise ValueError("at least one layer")
    a, b = math.log2(first), math.log2(last)
    inner = [1 << round(a + (b - a) * k / layers) for k in range(1, layers)]
    return [first, *inner, last]


def scope_name(tissues: list[str] | None) -> str:
    """The tissues of a scope in order, joined; all where there are none."""
    return "-".join(sorted(tissues)) if tissues else "all"
