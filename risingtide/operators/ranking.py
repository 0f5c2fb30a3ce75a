"""Top rows per group and over the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def top_per_group(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank_value"
) -> DataFrame:
    """The ``n`` first rows of each group with their rank.

    ``order`` should end in a unique column. Spark cuts to ``n`` rows per group
    before the shuffle, so a hot group costs no more than any other.
    """
    window = W.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def top_overall(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """Sort and limit in one step (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)


def max_per_key(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per key with the largest value."""
    return df.groupBy(*keys).agg(F.max(value).alias(value))
