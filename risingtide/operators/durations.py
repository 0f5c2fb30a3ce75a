"""How long until an item trends and for how long it does."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from risingtide.functions.times import hours_between, inclusive_days, whole_days
from risingtide.operators.snapshots import first_per_key, nulls_last


def days_to_trend(
    df: DataFrame, key: str, published: str, trending: str,
    tiebreak: Sequence[str] = (), out: str = "time_to_trend",
) -> DataFrame:
    """First trending row of each key with its whole days since publication."""
    first = first_per_key(df, [key], trending, tiebreak)
    return first.withColumn(out, whole_days(published, trending))


def trend_durations(
    df: DataFrame, key: str, trending: str, category: str, order: Sequence[str] = ()
) -> DataFrame:
    """First and last trending time per key, its category and days in between, inclusive.

    Rows without a trending time come last.
    """
    when = nulls_last(trending, *order)
    spans = df.groupBy(key).agg(
        F.min(trending).alias("start_trending"),
        F.max(trending).alias("end_trending"),
        F.min_by(category, F.when(F.col(category).isNotNull(), when)).alias(category),
    )
    return spans.withColumn("trending_duration", inclusive_days("start_trending", "end_trending"))


def duration_features(
    df: DataFrame,
    key: str = "video_id",
    region: str = "region",
    published: str = "publishedAt",
    trending: str = "trending_date",
    firsts: Sequence[str] = (
        "title", "channelTitle", "channelSuscribers", "category",
        "channelAvgVisits", "channelAvgLikes", "channelAvgComments",
    ),
    maxima: Sequence[str] = ("view_count", "likes", "dislikes", "comment_count"),
    tiebreak: Sequence[str] = (),
    per_region: bool = False,
) -> DataFrame:
    """One row per (key, region) with both durations in hours; rows with a null are dropped.

    Durations run over all regions of a key unless ``per_region``. Snapshots are
    folded to one row per (key, region) first; only those rows meet per key.
    """
    when = nulls_last(trending, *tiebreak)
    folded = df.groupBy(key, region).agg(
        F.min(trending).alias("__first"),
        F.max(trending).alias("__last"),
        F.min_by(F.struct(published, *firsts), when).alias("__earliest"),
        *[F.max(c).cast("bigint").alias(c) for c in maxima],
    ).select("*", "__earliest.*")
    if not per_region:
        regions = W.partitionBy(key)
        folded = folded.withColumns(
            {"__first": F.min("__first").over(regions), "__last": F.max("__last").over(regions)}
        )
    return folded.select(
        key,
        hours_between(published, "__first").alias("becomeTrendingDuration"),
        hours_between("__first", "__last").alias("endTrendingDuration"),
        region,
        *firsts,
        *maxima,
    ).dropna()
