"""Monthly series: means, pivots and scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from risingtide.functions.times import month_start
from risingtide.functions.vectors import share


def monthly_mean(df: DataFrame, by: Sequence[str], date: str, value: str, out: str) -> DataFrame:
    return df.groupBy(*by, month_start(date).alias("month")).agg(F.avg(value).alias(out))


def monthly_share(
    df: DataFrame, by: Sequence[str], date: str, part: str, rest: str, out: str = "score"
) -> DataFrame:
    """Mean of ``part / (part + rest)`` per key and month; 0/0 is left out of the mean."""
    return df.groupBy(*by, month_start(date).alias("month")).agg(F.avg(share(part, rest)).alias(out))


def pivot_filled(
    df: DataFrame, key: str, period: str, value: str, periods: Sequence[str], fill: float = 0.0
) -> DataFrame:
    """One row per key, one column per period, gaps filled.

    ``df`` holds one value per (key, period). The periods are given, so no
    extra pass looks for them; a row of another period stops the job.
    """
    periods = list(periods)
    listed = F.col(period).isNull() | F.col(period).cast("string").isin([str(p) for p in periods])
    unlisted = F.raise_error(F.concat(F.lit("period not listed: "), F.col(period).cast("string")))
    kind = df.schema[period].dataType
    df = df.withColumn(period, F.when(listed, F.col(period)).otherwise(unlisted.cast(kind)))
    wide = df.groupBy(key).pivot(period, list(periods)).agg(F.first(value, ignorenulls=True))
    return wide.na.fill(fill, list(periods))


def period_span(df: DataFrame, period: str, step: str = "INTERVAL 1 MONTH") -> Column:
    """All periods from the first to the last, as one array value."""
    span = df.agg(F.min(period).alias("a"), F.max(period).alias("b"))
    return span.select(F.sequence("a", "b", F.expr(step))).scalar()


def to_series(df: DataFrame, key: str, period: str, value: str, periods: Column) -> DataFrame:
    """``key``, ``periods`` and ``series``: one number per period, gaps as 0.

    ``df`` holds one value per (key, period), so a key's list is no longer than
    the calendar.
    """
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(key)
        .agg(F.map_from_entries(F.collect_list(F.struct(period, value))).alias("__at"))
        .withColumn("periods", periods)
        .select(
            key,
            "periods",
            F.transform(
                "periods", lambda p: F.coalesce(F.col("__at")[p], F.lit(0.0)).cast("double")
            ).alias("series"),
        )
    )


def with_z_scores(df: DataFrame, series: str = "series", out: str = "z") -> DataFrame:
    """Zero mean and unit population deviation along the series; constant -> zeros.

    Mean and deviation come from one stable running pass over the array.
    """

    def step(acc: Column, x: Column) -> Column:
        n = acc["n"] + 1
        mean = acc["mean"] + (x - acc["mean"]) / n
        m2 = acc["m2"] + (x - acc["mean"]) * (x - mean)
        return F.struct(n.alias("n"), mean.alias("mean"), m2.alias("m2"))

    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    moments = F.aggregate(
        series,
        start,
        step,
        lambda acc: F.struct(
            acc["mean"].alias("mean"), F.sqrt(F.try_divide(acc["m2"], acc["n"])).alias("std")
        ),
    )
    scaled = F.transform(
        series,
        lambda x: F.coalesce(
            F.try_divide(x - F.col("__moments")["mean"], F.col("__moments")["std"]), F.lit(0.0)
        ),
    )
    return df.withColumn("__moments", moments).withColumn(out, scaled).drop("__moments")


def long_form(df: DataFrame, key: str, series: str = "series", out: str = "value") -> DataFrame:
    """Back to one row per (key, period)."""
    pairs = F.arrays_zip(F.col("periods").alias("period"), F.col(series).alias(out))
    return df.select(key, F.inline(pairs))


def mean_by_cluster(df: DataFrame, cluster: str = "cluster", series: str = "series") -> DataFrame:
    """Mean of every period column per cluster: ``cluster``, ``period``, ``mean``."""
    return (
        long_form(df, cluster, series)
        .groupBy(cluster, "period")
        .agg(F.avg("value").alias("mean"))
    )
