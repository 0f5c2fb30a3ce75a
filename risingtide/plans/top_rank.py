"""Which categories hold the daily top places, per month."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from risingtide.functions.times import day_key, month_text
from risingtide.operators.enrich import lookup
from risingtide.operators.ranking import max_per_key, top_per_group
from risingtide.schemas import VIDEOS
from risingtide.sinks.writers import write_csv
from risingtide.sources.readers import read_categories_csv
from risingtide.sources.records import read_records


def top_rank(
    facts: DataFrame,
    categories: DataFrame,
    n: int = 10,
    item: str = "video_id",
    day: str = "publishedAt",
    category: str = "categoryId",
    value: str = "view_count",
    category_id: str = "id",
    category_name: str = "name",
    by: Sequence[str] = (),
) -> DataFrame:
    """``date`` (month), ``type``, ``name``, ``rank_count``, newest month first.

    With ``by``, e.g. the country, all of its values are ranked apart in one pass and kept as columns.

    Per day the ``n`` items with the highest value are ranked, an item counting
    once per day and category. An unknown category takes its rank and then
    drops out. Ties go to the lower item, then category.
    """
    rows = facts.select(
        *by,
        F.col(item).alias("id"),
        day_key(facts, day).alias("date"),
        F.col(category).alias("type"),
        F.col(value).alias("value"),
    )
    best = max_per_key(rows, [*by, "id", "date", "type"], "value")
    order = [F.desc("value"), F.asc("id"), F.asc("type")]
    daily = top_per_group(best, [*by, "date"], order, n)
    # Counted before the names are joined: the join then sees one row per month and category.
    counts = (
        daily.groupBy(*by, month_text("date").alias("date"), F.col("type").cast("string").alias("type"))
        .agg(F.count(F.lit(1)).alias("rank_count"))
    )
    named = lookup(counts, categories, "type", category_id, {category_name: "name"}, "inner")
    return named.select(*by, "date", "type", "name", "rank_count").orderBy(
        *by, F.desc("date"), F.desc("rank_count"), "type"
    )


TOP_RANK_SQL = """
WITH best AS (
  SELECT {item} AS id, {day} AS date,
         {category} AS type, max({value}) AS value
  FROM {facts}
  GROUP BY 1, 2, 3
), ranked AS (
  SELECT id, date, type,
         row_number() OVER (PARTITION BY date ORDER BY value DESC, id, type) AS rank_value
  FROM best
), daily AS (
  SELECT substring(cast(date AS string), 1, 7) AS date, cast(type AS string) AS type
  FROM ranked WHERE rank_value <= :n
)
SELECT d.date, d.type, c.{category_name} AS name, count(*) AS rank_count
FROM daily d JOIN {categories} c ON d.type = cast(c.{category_id} AS string)
GROUP BY d.date, d.type, c.{category_name}
ORDER BY d.date DESC, rank_count DESC, d.type
"""


def top_rank_sql(
    spark: SparkSession,
    facts: DataFrame,
    categories: DataFrame,
    n: int = 5,
    item: str = "video_id",
    day: str = "publishedAt",
    category: str = "categoryId",
    value: str = "view_count",
    category_id: str = "id",
    category_name: str = "name",
) -> DataFrame:
    """The same report written in SQL over the two DataFrames."""
    return spark.sql(
        TOP_RANK_SQL, args={"n": n}, facts=facts.withColumn("__day", day_key(facts, day)),
        categories=categories, item=F.col(item), day=F.col("__day"), category=F.col(category),
        value=F.col(value),
        category_id=F.col(category_id), category_name=F.col(category_name),
    )


def generate_top_rank(
    spark: SparkSession, category_path: str, data_path: str | Sequence[str], output: str, n: int = 10
) -> DataFrame:
    """Read the files, drop malformed records, and write the report as one CSV file.

    The report is one row per month and category, hence the single file.
    """
    good, _ = read_records(spark, data_path, VIDEOS)
    report = top_rank(good, read_categories_csv(spark, category_path), n)
    write_csv(report, output, single_file=True)
    return report


def category_totals(
    reports: DataFrame | dict[str, DataFrame], name: str = "name", value: str = "rank_count",
    country: str = "country", countries: Sequence[str] | None = None,
) -> DataFrame:
    """Total per category with one column per country, to compare countries.

    ``reports`` is one report with a column ``country`` (see ``by`` of ``top_rank``), or one
    for each country. Without ``countries`` all that the report holds get a column; with
    them, a row of another country stops the job rather than vanish.
    """
    if isinstance(reports, DataFrame):
        if not countries:
            return reports.groupBy(name).pivot(country).agg(F.sum(value))
        unlisted = F.raise_error(F.concat(F.lit("country not listed: "), F.coalesce(country, F.lit("null"))))
        known = F.when(F.col(country).isin(list(countries)), F.col(country)).otherwise(unlisted.cast("string"))
        return reports.withColumn(country, known).groupBy(name).pivot(country, list(countries)).agg(F.sum(value))
    tagged = [df.select(name, value).withColumn("country", F.lit(c)) for c, df in reports.items()]
    stacked = reduce(DataFrame.unionByName, tagged)
    return stacked.groupBy(name).pivot("country", list(reports)).agg(F.sum(value))


def monthly_totals(
    report: DataFrame, selected: Sequence[str], month: str = "date", category: str = "type",
    name: str = "name", value: str = "rank_count",
) -> DataFrame:
    """Total per month for chosen categories."""
    return (
        report.where(F.col(category).isin(list(selected)))
        .groupBy(month, name, category)
        .agg(F.sum(value).alias(value))
    )
