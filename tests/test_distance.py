import math

import pytest
from pyspark.sql import functions as F

from vantor.functions import distance as D
from vantor.functions import packed as P


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("build", "a", "b", "expected"),
    [
        (D.l2_squared, [3, 0], [0, 4], 25),
        (D.l2, [3, 0], [0, 4], 5),
        (D.l2_squared, [5], [2], 9),
        (D.l2_squared, [], [], 0),
        (D.l2_squared, [1, 2, 3, 4], [4, 3, 2, 1], 20),
        (D.dot, [1, 2, 3], [4, 5, 6], 32),
        (D.dot_distance, [1, 2, 3], [4, 5, 6], -32),
        (D.cosine, [1, 2, 3], [1, 2, 3], 0),
        (D.cosine, [1, 0], [0, 1], 1),
        (D.cosine, [1, 0], [-1, 0], 2),
        (D.cosine_similarity, [0, 0], [1, 0], 0),
        (D.manhattan, [1, 2, 3], [4, 6, 3], 7),
        (D.hamming_sign, [1, -1, 0.5, -0.5], [0.5, -0.5, 1, -1], 0),
        (D.hamming_sign, [1, -1, 0.5, -0.5], [-1, 1, -0.5, 0.5], 4),
        (D.l2_squared, [1, 2, 3, 4, 5, 6, 7, 8] * 2 + [1], [8, 7, 6, 5, 4, 3, 2, 1] * 2 + [0], 337),
        (D.l2, [1, 2], [1], None),
    ],
)
def test_dense(spark, build, a, b, expected):
    got = value(spark, build(a, b))
    assert got == expected if expected is None else got == pytest.approx(expected, abs=1e-12)


def test_bit_pattern_hamming(spark):
    rows = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0, 0.0, 3.0]), ([0.0], [-0.0]), ([math.nan], [math.nan]), (None, [1.0])], "a array<float>, b array<float>")
    assert [r.h for r in rows.select(D.hamming_bits("a", "b").alias("h")).collect()] == [1.0, 1.0, 0.0, None]


@pytest.mark.parametrize(
    ("build", "a", "b", "expected"),
    [
        (P.hamming_bytes, [0, 1, 2, 3], [0, 0, 2, 0], 2),
        (P.hamming, [1], [3], 1),
        (P.hamming, [255, 0], [0, 255], 16),
        (P.hamming, [170, 240, 15], [85, 15, 240], 24),
        (P.jaccard, [240, 15], [240, 15], 1),
        (P.jaccard, [12], [10], 1 / 3),
        (P.jaccard, [0, 0], [0, 0], 0),
        (P.jaccard_distance, [255], [0], 1),
    ],
)
def test_packed(spark, build, a, b, expected):
    assert value(spark, build(F.lit(a), F.lit(b))) == pytest.approx(expected)


def test_packing(spark):
    assert value(spark, P.pack_signs(F.lit([1.0, -1.0, 0.0, 2.0, 0.5, 0.5, 0.5, 0.5, 3.0]))) == [0b11111001, 1]
    assert value(spark, P.unpack(F.lit(bytearray(b"\x00\xff\x80")))) == [0, 255, 128]
    assert value(spark, P.unpack(F.lit(bytearray(b"")))) == []


def test_safe(spark):
    assert value(spark, D.l2_safe([1, 2], [1])).error == "length mismatch: expected 2, actual 1"
    assert value(spark, D.l2_safe([], [])).error == "empty vector"
    assert value(spark, D.l2_safe([math.nan], [1])).error == "NaN in vector"
    assert value(spark, D.dot_safe([math.nan], [1])).error is None
    assert value(spark, D.manhattan_safe([1, 2], [3, 4])).value == 4
    assert value(spark, P.hamming_safe(F.lit([170]), F.lit([170, 240]))).error == "length mismatch: expected 1, actual 2"
    with pytest.raises(Exception, match="length mismatch"):
        value(spark, D.l2_safe([1, 2], [1], fail=True))


def test_metric_names():
    assert D.Metric.parse("dot_product") is D.Metric.DOT and D.Metric.parse("L2") is D.Metric.L2
    with pytest.raises(ValueError):
        D.Metric.parse("euclid")
