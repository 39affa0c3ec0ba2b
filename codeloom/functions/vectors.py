"""Vector arithmetic as column expressions; sums run in double precision."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def literal_vector(values: Sequence[float]) -> Column:
    return F.lit([float(v) for v in values]).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x
    )


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(vec), F.lit(0.0), lambda s, x: s + x * x))


def normalise(vec: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    length = norm(vec)
    return F.when(length > 0, F.transform(as_double(vec), lambda x: x / length)).otherwise(
        as_double(vec)
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 where either side has no direction."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(0.0))


def smoothed_cosine(a: Column, b: Column, epsilon: float = 1e-10) -> Column:
    """Cosine with a small constant in the denominator, as the store-side search uses."""
    return dot(a, b) / (norm(a) * norm(b) + F.lit(epsilon))


def pack_float32(vec: Column) -> Column:
    """Little-endian float32 blob of a vector (NULL for NULL or an empty vector)."""
    @F.pandas_udf(T.BinaryType())
    def pack(series: pd.Series) -> pd.Series:
        return series.map(
            lambda v: None if v is None or len(v) == 0 else np.asarray(v, dtype="<f4").tobytes()
        )

    return pack(vec)


def unpack_float32(blob: Column) -> Column:
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def unpack(series: pd.Series) -> pd.Series:
        return series.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4"))

    return unpack(blob)
