"""Smallest and largest k, over a table or for each group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def smallest(rows: DataFrame, k: int, by: str, *ties: str) -> DataFrame:
    """The k smallest, ascending; each task keeps k rows. NULLs come last, NaN before them."""
    return rows.orderBy(F.col(by).asc_nulls_last(), *ties).limit(max(0, k))


def largest(rows: DataFrame, k: int, by: str, *ties: str) -> DataFrame:
    """The k largest, descending."""
    return rows.orderBy(F.col(by).desc_nulls_last(), *ties).limit(max(0, k))


def smallest_of_each(rows: DataFrame, k: int, group: str, by: str, *ties: str) -> DataFrame:
    """The k smallest of each group with their rank; Spark keeps k rows of a group in each task before the shuffle."""
    near = Window.partitionBy(group).orderBy(F.col(by).asc_nulls_last(), *ties)
    return rows.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)
