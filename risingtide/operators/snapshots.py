"""Choosing rows among repeated snapshots of the same key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from risingtide.operators.skew import join_per_key

def before(df: DataFrame, date: str, cutoff: str) -> DataFrame:
    """Rows strictly before the cutoff. Apply this before choosing the latest row."""
    return df.where(F.col(date) < F.lit(cutoff).cast(df.schema[date].dataType))


def nulls_last(*columns: str) -> Column:
    """An ascending sort value of several columns in which a missing value comes after all others."""
    return F.struct(*[part for c in columns for part in (F.col(c).isNull(), F.col(c))])


def _edge_row(df: DataFrame, keys: Sequence[str], order: list[Column]) -> DataFrame:
    # rank <= 1 lets Spark keep one row per key on the map side (WindowGroupLimit),
    # so a hot key sends one row per task through the shuffle.
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank <= 1").drop("__rank")


def latest_per_key(
    df: DataFrame, keys: Sequence[str], date: str, ties: str = "first", tiebreak: Sequence[str] = ()
) -> DataFrame:
    """The latest row of each key.

    ``ties="first"`` keeps exactly one row, chosen by ``tiebreak`` ascending;
    ``ties="all"`` keeps every row of the latest date.
    """
    if ties == "first":
        return _edge_row(df, keys, [F.desc(date), *[F.asc(t) for t in tiebreak]])
    if ties != "all":
        raise ValueError("ties must be 'first' or 'all'")
    per_date = df.groupBy(*keys, date).agg(F.count(F.lit(1)).alias("__rows"))
    stats = per_date.groupBy(*keys).agg(
        F.max(date).alias(date),
        F.coalesce(F.max_by("__rows", date), F.sum("__rows")).alias("__rows"),
    )
    return join_per_key(df, stats, [*keys, date], "__rows", "left_semi")


def first_per_key(
    df: DataFrame, keys: Sequence[str], date: str, tiebreak: Sequence[str] = ()
) -> DataFrame:
    """The earliest row of each key, exactly one. Rows without a date come last."""
    return _edge_row(df, keys, [F.asc_nulls_last(date), *[F.asc(t) for t in tiebreak]])


def first_values(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Per key, each column's first non-missing value in the given order, missing order values last."""
    rank = nulls_last(*order)
    return df.groupBy(*keys).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in columns]
    )


def with_bounds(
    df: DataFrame, keys: Sequence[str], date: str, low: str = "first_date", high: str = "last_date"
) -> DataFrame:
    """Add each key's earliest and latest date to all of its rows."""
    stats = df.groupBy(*keys).agg(
        F.min(date).alias(low), F.max(date).alias(high), F.count(F.lit(1)).alias("__rows")
    )
    return join_per_key(df, stats, keys, "__rows")


def typed_snapshot(
    df: DataFrame,
    cutoff: str = "2023-11-01",
    key: str = "video_id",
    date: str = "trending_date",
    published: str = "publishedAt",
    casts: dict[str, str] | None = None,
) -> DataFrame:
    """Latest rows before the cutoff, strings filled, columns cast.

    The dates may be ISO text or timestamps. Text that is no number becomes null.
    """
    casts = casts or {"comments_disabled": "boolean", "categoryId": "int", "view_count": "bigint"}
    latest = latest_per_key(before(df, date, cutoff).na.fill(""), [key], date, ties="all")
    kinds = dict(latest.dtypes)

    def cast(name: str, kind: str) -> Column:
        if kinds[name] == "string":
            return F.col(name).try_cast(kind)
        return F.col(name).cast(kind)

    day = lambda c: F.try_to_timestamp(c) if kinds[c] == "string" else F.col(c)
    return latest.withColumns(
        {
            "days_since_published": F.date_diff(day(date), day(published)),
            **{name: cast(name, kind) for name, kind in casts.items()},
        }
    )
