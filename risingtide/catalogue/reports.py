"""Distributions, monthly series and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from risingtide.catalogue.base import query, table
from risingtide.operators.distribution import exact_tiles, quantiles, quartile_bins
from risingtide.operators.durations import days_to_trend
from risingtide.operators.series import (
    long_form,
    mean_by_cluster,
    monthly_mean,
    monthly_share,
    period_span,
    pivot_filled,
    to_series,
    with_z_scores,
)
from risingtide.operators.warping import cluster_series
from risingtide.plans.reports import cluster_shares, days_to_trend_quartiles, duration_boxes


def _trending(spark: SparkSession, folder: str) -> DataFrame:
    items, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    return items.join(orders, items["l_orderkey"] == orders["o_orderkey"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "o_orderdate", "l_shipdate", "o_orderpriority"
    )


_DAYS_SQL = """
SELECT l_orderkey, any_value(o_orderpriority) AS o_orderpriority,
       cast(floor((epoch(min(l_shipdate)) - epoch(any_value(o_orderdate))) / 86400) AS bigint) AS time_to_trend
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey"""


@query(_DAYS_SQL)
def days_to_trend_rows(spark, folder):
    days = days_to_trend(
        _trending(spark, folder), "l_orderkey", "o_orderdate", "l_shipdate", ["l_linenumber", "l_partkey"]
    )
    return days.select("l_orderkey", "o_orderpriority", "time_to_trend")


@query(
    f"""
SELECT o_orderpriority, round(q[1], 4) AS q1, round(q[2], 4) AS q2, round(q[3], 4) AS q3 FROM (
  SELECT o_orderpriority, quantile_cont(time_to_trend, [0.25, 0.5, 0.75]) AS q FROM ({_DAYS_SQL}) GROUP BY 1)"""
)
def days_to_trend_by_category(spark, folder):
    found = days_to_trend_quartiles(
        _trending(spark, folder), "l_orderkey", "o_orderdate", "l_shipdate", "o_orderpriority",
        ["l_linenumber", "l_partkey"],
    )
    return found.select("o_orderpriority", *[F.round(q, 4).alias(q) for q in ("q1", "q2", "q3")])


@query(
    """
WITH s AS (
  SELECT l_orderkey, any_value(o_orderpriority) AS o_orderpriority,
         cast(floor((epoch(max(l_shipdate)) - epoch(min(l_shipdate))) / 86400) AS bigint) + 1 AS d
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey),
q AS (SELECT o_orderpriority, quantile_cont(d, [0.25, 0.5, 0.75]) AS q FROM s GROUP BY 1)
SELECT o_orderpriority, count(*) AS n,
       cast(min(d) FILTER (d >= q[1] - 1.5 * (q[3] - q[1])) AS double) AS whisker_low,
       round(max(q[1]), 4) AS q1, round(max(q[2]), 4) AS median, round(max(q[3]), 4) AS q3,
       cast(max(d) FILTER (d <= q[3] + 1.5 * (q[3] - q[1])) AS double) AS whisker_high
FROM s JOIN q USING (o_orderpriority) GROUP BY 1"""
)
def trend_duration_boxplot(spark, folder):
    boxes = duration_boxes(
        _trending(spark, folder), "l_orderkey", "l_shipdate", "o_orderpriority", ["l_linenumber"]
    )
    return boxes.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


# ---------------------------------------------------------------- quartiles


@query(
    """SELECT list_transform(quantile_cont(value, [0, 0.25, 0.5, 0.75, 1]), lambda x: round(x, 6))::varchar AS q,
              count(value) AS n FROM events"""
)
def global_quantiles(spark, folder):
    events = table(spark, folder, "events")
    found = quantiles(events, "value", [0, 0.25, 0.5, 0.75, 1])
    shown = F.transform("quantiles", lambda x: F.round(x, 6).cast("string"))
    return found.select(
        F.concat(F.lit("["), F.array_join(shown, ", "), F.lit("]")).alias("q")
    ).withColumn("n", events.agg(F.count("value")).scalar())


@query(
    """
SELECT event_id, 1 + (value > q[1])::int + (value > q[2])::int + (value > q[3])::int AS quartile
FROM events, (SELECT quantile_cont(value, [0.25, 0.5, 0.75]) AS q FROM events)"""
)
def quartile_bins_by_value(spark, folder):
    return quartile_bins(table(spark, folder, "events"), "value").select("event_id", "quartile")


@query("SELECT event_id, ntile(4) OVER (ORDER BY value, event_id) AS tile FROM events")
def ntile_bins(spark, folder):
    return exact_tiles(table(spark, folder, "events"), "value", "event_id", 4).select("event_id", "tile")


# ---------------------------------------------------------------- series


@query(
    """
SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, round(avg(o_totalprice), 2) AS mean_price
FROM orders GROUP BY ALL"""
)
def monthly_mean_metric(spark, folder):
    found = monthly_mean(
        table(spark, folder, "orders"), ["o_orderpriority"], "o_orderdate", "o_totalprice", "mean_price"
    )
    return found.select(
        "o_orderpriority", F.date_format("month", "yyyy-MM").alias("month"),
        F.round("mean_price", 2).alias("mean_price"),
    )


@query(
    """
SELECT l_suppkey, strftime(l_shipdate, '%Y-%m') AS month,
       round(avg(l_discount / nullif(l_discount + l_tax, 0)), 9) AS score
FROM lineitem GROUP BY ALL"""
)
def monthly_ratio(spark, folder):
    found = monthly_share(
        table(spark, folder, "lineitem"), ["l_suppkey"], "l_shipdate", "l_discount", "l_tax"
    )
    return found.select(
        "l_suppkey", F.date_format("month", "yyyy-MM").alias("month"), F.round("score", 9).alias("score")
    )


_PERIODS = [f"d{day:02d}" for day in range(1, 32)]


@query(
    "SELECT user_id, "
    + ", ".join(
        f"coalesce(max(value) FILTER (strftime(ts, '%d') = '{p[1:]}'), 0) AS {p}" for p in _PERIODS
    )
    + " FROM events GROUP BY user_id"
)
def pivot_by_day(spark, folder):
    daily = (
        table(spark, folder, "events")
        .groupBy("user_id", F.concat(F.lit("d"), F.date_format("ts", "dd")).alias("day"))
        .agg(F.max("value").alias("peak"))
    )
    return pivot_filled(daily, "user_id", "day", "peak", _PERIODS)


def _user_series(spark: SparkSession, folder: str) -> DataFrame:
    daily = (
        table(spark, folder, "events")
        .groupBy("user_id", F.to_date("ts").alias("day"))
        .agg(F.avg("value").alias("mean"))
    )
    span = period_span(daily, "day", "INTERVAL 1 DAY")
    return with_z_scores(to_series(daily, "user_id", "day", "mean", span))


@query(
    """
WITH d AS (SELECT user_id, ts::date AS day, avg(value) AS m FROM events GROUP BY ALL),
span AS (SELECT unnest(generate_series(min(day)::timestamp, max(day)::timestamp, INTERVAL 1 DAY))::date AS day FROM d),
f AS (SELECT u.user_id, s.day, coalesce(m, 0) AS v
      FROM (SELECT DISTINCT user_id FROM d) u CROSS JOIN span s LEFT JOIN d USING (user_id, day))
SELECT user_id, strftime(day, '%Y-%m-%d') AS day,
       round(coalesce((v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0), 0), 5) AS z
FROM f WINDOW w AS (PARTITION BY user_id)"""
)
def series_znorm(spark, folder):
    scaled = long_form(_user_series(spark, folder), "user_id", "z", "z")
    return scaled.select(
        "user_id", F.date_format("period", "yyyy-MM-dd").alias("day"), F.round("z", 5).alias("z")
    )


@query()
def series_clusters(spark, folder):
    """Users grouped by the shape of their daily values under time warping."""
    return cluster_series(_user_series(spark, folder), "user_id", "z").labelled.select(
        "user_id", "cluster", F.round("distance", 6).alias("distance")
    )


@query("SELECT user_id, 1 AS labels, true AS known, true AS placed FROM events GROUP BY user_id")
def cluster_labels(spark, folder):
    """Every series has one label, of a known cluster, at a distance from its centroid."""
    found = cluster_series(_user_series(spark, folder), "user_id", "z").labelled
    return found.groupBy("user_id").agg(
        F.count("cluster").alias("labels"), F.bool_and(F.col("cluster").between(0, 2)).alias("known"),
        F.bool_and(F.col("distance") >= 0).alias("placed"))


@query()
def cluster_trend(spark, folder):
    """Mean unscaled series of every cluster."""
    series = _user_series(spark, folder)
    labels = cluster_series(series, "user_id", "z").labelled.select("user_id", "cluster")
    return mean_by_cluster(series.join(labels, "user_id"))


@query()
def share_clusters(spark, folder):
    """Suppliers by their monthly discount share: the full job."""
    found = cluster_shares(
        table(spark, folder, "lineitem"), "l_suppkey", "l_shipdate", "l_discount", "l_tax"
    )
    return found.labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("suppliers"))
