"""Distances between dense vectors as Spark columns. Lower is nearer throughout.

Everything is built from higher-order functions over arrays, summed in double precision. Vectors of unequal length
give NULL, as zip_with fills the shorter one up with NULLs; so do NULL elements.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from enum import StrEnum

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Metric(StrEnum):
    """Metrics that a collection can be searched by, and Manhattan, which is a function only."""

    L2 = "l2"
    COSINE = "cosine"
    DOT = "dot"
    MANHATTAN = "manhattan"
    HAMMING = "hamming"

    @classmethod
    def parse(cls, name: str) -> Metric:
        """Also takes the spelling that serialised configurations have."""
        return cls({"dot_product": "dot"}.get(name.lower(), name.lower()))


def vector(values: Sequence[float]) -> Column:
    """A literal vector."""
    return F.lit([float(v) for v in values]) if len(values) else F.array().cast("array<double>")


def _column(v: Column | str | Sequence[float]) -> Column:
    return F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else vector(v)


def _sum(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda total, x: total + x)


def _over(a, b, pair: Callable[[Column, Column], Column]) -> Column:
    return _sum(F.zip_with(_column(a), _column(b), lambda x, y: pair(x.cast("double"), y.cast("double"))))


def l2_squared(a, b) -> Column:
    return _over(a, b, lambda x, y: (x - y) * (x - y))


def l2(a, b) -> Column:
    return F.sqrt(l2_squared(a, b))


def dot(a, b) -> Column:
    return _over(a, b, lambda x, y: x * y)


def dot_distance(a, b) -> Column:
    """The negated product; 0 rather than -0 where it is nothing."""
    return F.lit(0.0) - dot(a, b)


def norm(a) -> Column:
    return F.sqrt(_sum(F.transform(_column(a), lambda x: x.cast("double") * x.cast("double"))))


def cosine_similarity(a, b) -> Column:
    """0 if a side has no length."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.when(dot(a, b).isNotNull(), F.lit(0.0))).otherwise(dot(a, b) / F.nullif(size, F.lit(0.0)))


def cosine(a, b) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def manhattan(a, b) -> Column:
    return _over(a, b, lambda x, y: F.abs(x - y))


def hamming_sign(a, b) -> Column:
    """How many places are above 0 on one side only."""
    return _over(a, b, lambda x, y: ((x > 0) != (y > 0)).cast("double"))


@F.pandas_udf(T.DoubleType())
def hamming_bits(a: pd.Series, b: pd.Series) -> pd.Series:
    """How many 32-bit floats differ in their bits, over the shorter length: -0 and 0 differ, equal NaNs don't.

    Spark's own comparison takes -0 for 0, so this one is an Arrow-fed function.
    """

    def one(x, y):
        if x is None or y is None:
            return None
        n = min(len(x), len(y))
        return float((np.asarray(x[:n], np.float32).view(np.uint32) != np.asarray(y[:n], np.float32).view(np.uint32)).sum())

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


DISTANCES: dict[Metric, Callable[..., Column]] = {Metric.L2: l2, Metric.COSINE: cosine, Metric.DOT: dot_distance, Metric.MANHATTAN: manhattan, Metric.HAMMING: hamming_sign}


def distance(metric: Metric | str) -> Callable[..., Column]:
    """The builder for a metric."""
    return DISTANCES[Metric.parse(str(metric))]


def check(a, b, *, nan: bool = False, empty: bool = True) -> Column:
    """NULL for a valid pair, else what is wrong with it: length, then emptiness, then NaN."""
    a, b = _column(a), _column(b)
    out = F.when(a.isNull() | b.isNull(), "null vector").when(F.size(a) != F.size(b), F.format_string("length mismatch: expected %d, actual %d", F.size(a), F.size(b)))
    if empty:
        out = out.when(F.size(a) == 0, "empty vector")
    if nan:
        bad = lambda v: F.exists(v, lambda x: F.isnan(x.cast("double")))
        out = out.when(bad(a) | bad(b), "NaN in vector")
    return out


def _safe(build: Callable[..., Column], **how) -> Callable[..., Column]:
    def safe(a, b, *, fail: bool = False) -> Column:
        """struct(value, error); with fail, the value, and an invalid pair fails the query."""
        error = check(a, b, **how)
        if fail:
            return F.when(error.isNotNull(), F.raise_error(error).cast("double")).otherwise(build(a, b))
        return F.struct(F.when(error.isNull(), build(a, b)).alias("value"), error.alias("error"))

    return safe


#: Validated forms. Only the first looks for NaN.
l2_safe = _safe(l2, nan=True)
cosine_similarity_safe = _safe(cosine_similarity)
dot_safe = _safe(dot)
manhattan_safe = _safe(manhattan)
