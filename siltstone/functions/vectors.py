"""Vector functions on arrays of doubles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.BinaryType())
def float32_bytes(vectors: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats of each vector, one after another."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


def vector_digest(vector: Column) -> Column:
    """SHA-256 of the vector as packed 32-bit floats."""
    return F.sha2(float32_bytes(vector), 256)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def stable_sum(values: Column) -> Column:
    """Sum with the lost low parts carried along (Neumaier), which no order of the values changes noticeably."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

    def step(state: Column, x: Column) -> Column:
        total = state["s"] + x
        lost = F.when(F.abs(state["s"]) >= F.abs(x), state["s"] - total + x).otherwise(x - total + state["s"])
        return F.struct(total.alias("s"), (state["c"] + lost).alias("c"))

    return F.aggregate(values, start, step, lambda state: state["s"] + state["c"])


def stable_cosine(a: Column, b: Column) -> Column:
    """Cosine of compensated sums; null for a zero vector."""
    products = [stable_sum(F.zip_with(x, y, lambda p, q: p * q)) for x, y in ((a, b), (a, a), (b, b))]
    return products[0] / F.nullif(F.sqrt(products[1]) * F.sqrt(products[2]), F.lit(0.0))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def distance_score(metric: str, distance: Column) -> Column:
    """Score of a distance: 1 - d for cosine, -d for l2 and inner product."""
    return 1 - distance if metric == "cosine" else -distance


def normalised(a: Column) -> Column:
    """Unit length; zero vectors stay as they are."""
    length = norm(a)
    return F.when(length == 0, a).otherwise(F.transform(a, lambda x: x / length))


def is_valid(a: Column, dimensions: int | None = None) -> Column:
    """Not empty, finite throughout, and of the given size."""
    good = (F.size(a) > 0) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return good if dimensions is None else good & (F.size(a) == dimensions)


def max_abs_difference(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
