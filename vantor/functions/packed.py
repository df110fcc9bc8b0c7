"""Distances between packed bit strings: arrays of integers 0 to 255, or binary columns by way of unpack()."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vantor.functions.distance import _column, _safe


def unpack(data: Column | str) -> Column:
    """The bytes of a binary column as integers."""
    data = _column(data)
    places = F.when(F.octet_length(data) > 0, F.sequence(F.lit(1), F.octet_length(data))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("int"))


def pack_signs(v: Column | str) -> Column:
    """One bit for each element, set if it is above 0; the first element is the lowest bit of the first byte."""
    v = _column(v)
    starts = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.size(v) - 1, F.lit(8))).otherwise(F.array().cast("array<int>"))
    # the bits of a byte are added up by their weights
    weights = F.array(*(F.lit(1 << i) for i in range(8)))
    return F.transform(starts, lambda s: F.aggregate(F.zip_with(F.slice(v, s + 1, 8), weights, lambda x, w: F.when(x > 0, w).otherwise(0)), F.lit(0), lambda t, x: t + x))


def _total(a, b, pair) -> Column:
    return F.aggregate(F.zip_with(_column(a), _column(b), pair), F.lit(0).cast("long"), lambda t, x: t + x)


def hamming_bytes(a, b) -> Column:
    """How many bytes differ."""
    return _total(a, b, lambda x, y: (x != y).cast("long")).cast("double")


def hamming(a, b) -> Column:
    """How many bits differ."""
    return _total(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")).cast("double")


def jaccard(a, b) -> Column:
    """Common bits over all bits; 0 if there are none."""
    both, either = _total(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y)).cast("long")), _total(a, b, lambda x, y: F.bit_count(x.bitwiseOR(y)).cast("long"))
    return F.when(either == 0, F.lit(0.0)).otherwise(both.cast("double") / F.nullif(either, F.lit(0)))


def jaccard_distance(a, b) -> Column:
    return F.lit(1.0) - jaccard(a, b)


#: struct(value, error): only the length is checked.
hamming_safe = _safe(hamming, empty=False)
