"""From raw country files to enriched, regularised rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from risingtide.functions.text import tag_list, word_tokens
from risingtide.functions.times import parse_time
from risingtide.operators.enrich import combine_category, lookup, sample_frequent_keys, translate
from risingtide.operators.split import split_by_key
from risingtide.schemas import VIDEOS
from risingtide.sinks.writers import write_csv
from risingtide.sources.readers import read_categories_json
from risingtide.sources.records import read_records

# The columns that later steps use.
USEFUL = (
    "video_id", "title", "publishedAt", "channelId", "channelTitle", "categoryId",
    "trending_date", "tags", "view_count", "likes", "dislikes", "comment_count", "description",
)


def preprocess(videos: DataFrame, categories: DataFrame) -> DataFrame:
    """Add ``category_name`` (null where unknown) and fill missing descriptions."""
    named = lookup(videos, categories, "categoryId", "id", {"category": "category_name"})
    return named.na.fill({"description": ""})


def preprocess_file(
    spark: SparkSession, data_path: str, category_path: str, output: str
) -> None:
    """One country's file to its processed CSV; an existing result is kept."""
    good, _ = read_records(spark, data_path, VIDEOS)
    write_csv(preprocess(good, read_categories_json(spark, category_path)), output, mode="ignore")


def sample_and_translate(
    videos: DataFrame, translations: DataFrame, min_count: int = 5, fraction: float = 0.018,
    keys: Sequence[str] = ("country", "video_id"), item: str = "video_id", by: Sequence[str] = ("country",),
) -> DataFrame:
    """All rows of sampled, often seen items with their texts translated.

    An item is counted for each value of ``by`` apart, that is in each country.
    """
    return translate(sample_frequent_keys(videos, item, min_count, fraction, by=by), translations, keys)


def split_channels(
    videos: DataFrame, held_out: float = 0.1, channel: str = "channelId", seed: str = ""
) -> tuple[DataFrame, DataFrame]:
    """Hold out whole channels: (train, test)."""
    return split_by_key(videos, channel, held_out, seed)


def split_file(
    spark: SparkSession, path: str, train_path: str, test_path: str, held_out: float = 0.1
) -> None:
    """Split one processed file by channel; results already there are kept."""
    rows, _ = read_records(spark, path, VIDEOS)
    for part, target in zip(split_channels(rows, held_out), (train_path, test_path)):
        write_csv(part, target, mode="ignore")


def regularise(
    videos: DataFrame, columns: Sequence[str] = USEFUL, tokens: Iterable[str] = ("title", "tags", "description"),
    stopwords: Iterable[str] = (),
) -> DataFrame:
    """Keep the useful columns, tokenise some of them and parse the dates.

    ``channelTitle`` stays text, since it is joined on later.
    """
    df = videos.select(*columns)
    tokens, kinds, stopwords = set(tokens), dict(df.dtypes), list(stopwords)
    new = {c: word_tokens(c, stopwords) for c in columns if c in tokens and c != "tags"}
    if "tags" in tokens and "tags" in columns:
        new["tags"] = tag_list("tags")
    for c in ("publishedAt", "trending_date"):
        if kinds.get(c) == "string":
            new[c] = parse_time(c)
    return df.withColumns(new) if new else df


def country_rows(
    videos: DataFrame, categories: DataFrame, country: str | Column, columns: Sequence[str] = USEFUL,
    tokens: Iterable[str] = ("title", "tags", "description"), stopwords: Iterable[str] = (),
) -> DataFrame:
    """Regularised rows with category and region: one country's, or many told apart by a column."""
    rows = regularise(videos, columns, tokens, stopwords)
    return combine_category(rows, categories).withColumn("region", F.lit(country) if isinstance(country, str) else country)


def load_countries(
    spark: SparkSession, files: dict[str, tuple[str, str]], stopwords: Iterable[str] = ()
) -> DataFrame:
    """All countries stacked, given as {country: (videos CSV, categories JSON)}."""
    return all_countries(
        country_rows(
            read_records(spark, videos, VIDEOS)[0],
            read_categories_json(spark, categories).select("id", "category"),
            country,
            stopwords=stopwords,
        )
        for country, (videos, categories) in files.items()
    )


def all_countries(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
