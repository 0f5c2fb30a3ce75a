"""Lookups and key-set joins.

No join here carries a broadcast hint: Spark broadcasts a side it has measured
to be below ``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles
both sides. Adaptive execution then splits skewed keys of stored tables;
joins with aggregated keys go through ``join_per_key``, which slices them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from risingtide.functions.keys import in_sample
from risingtide.functions.text import NO_TAGS, unescape_html
from risingtide.operators.membership import maybe_listed
from risingtide.operators.skew import ROWS_PER_SLICE, join_per_key


def lookup(
    df: DataFrame,
    table: DataFrame,
    key: str,
    table_key: str,
    columns: dict[str, str],
    how: str = "left",
) -> DataFrame:
    """Add ``columns`` ({table column: new name}) of the row with the same key.

    Keys are compared as text. A miss gives null (``left``) or drops the row
    (``inner``).
    """
    side = table.select(
        F.col(table_key).cast("string").alias("__key"),
        *[F.col(c).alias(new) for c, new in columns.items()],
    )
    return df.join(side, F.col(key).cast("string") == F.col("__key"), how).drop("__key")


def combine_category(df: DataFrame, categories: DataFrame, key: str = "categoryId") -> DataFrame:
    """Left lookup of the category; both key columns are dropped."""
    return lookup(df, categories, key, "id", {"category": "category"}).drop(key)


def _key_sizes(df: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("__rows"))


def keep_keys(df: DataFrame, keys: DataFrame, on: Sequence[str], screen: bool = False) -> DataFrame:
    """Rows whose key is listed. Keys are settled first, one row each; hot ones are sliced.

    ``screen`` drops most other rows by a Bloom filter of the keys before the first shuffle:
    for key lists too long to broadcast that match few of the rows.
    """
    if screen:
        df = maybe_listed(df, keys, on)
    listed = _key_sizes(df, on).join(keys.select(*on), list(on), "left_semi")
    return join_per_key(df, listed, on, "__rows", "left_semi")


def drop_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is not listed; rows with a null key stay."""
    rest = _key_sizes(df, on).join(keys.select(*on), list(on), "left_anti")
    return join_per_key(df, rest, on, "__rows", "left_semi")


def with_match(df: DataFrame, keys: DataFrame, on: Sequence[str], out: str = "_merge") -> DataFrame:
    """Tell for every row whether its key is listed: both / left_only."""
    side = keys.select(*on).distinct().withColumn("__hit", F.lit(True))
    label = F.when(F.col("__hit"), "both").otherwise("left_only")
    flagged = _key_sizes(df, on).join(side, list(on), "left").withColumn(out, label).drop("__hit")
    return join_per_key(df, flagged, on, "__rows")


def join_on_name(left: DataFrame, right: DataFrame, left_key, right_key, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Inner join on two computed key columns, e.g. ``normalised_name``.

    The rows of ``left`` are counted per name, and names above ``rows_per_slice`` rows are
    joined in slices. A missing name matches nothing. ``right`` may have a name twice.
    """
    named = left.withColumn("__name", left_key).where("__name IS NOT NULL")
    columns = [c for c in right.columns]
    side = right.withColumn("__name", right_key).join(_key_sizes(named, ["__name"]), "__name")
    joined = join_per_key(named, side, ["__name"], "__rows", rows_per_slice=rows_per_slice)
    return joined.drop("__name").select(*left.columns, *columns)


def sample_frequent_keys(
    df: DataFrame, key: str, min_count: int = 5, fraction: float = 0.018, seed: str = "",
    by: Sequence[str] = (),
) -> DataFrame:
    """All rows of a repeatable sample of the keys seen more than ``min_count`` times.

    With ``by`` a key is counted for each of its values apart, e.g. per country.

    The hash test needs no shuffle and goes first, so only sampled rows are counted.
    """
    picked = df.where(in_sample(key, fraction, seed))
    counts = picked.groupBy(*by, key).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > min_count)
    return join_per_key(picked, counts, [*by, key], "__rows", "left_semi")


def translate(
    df: DataFrame,
    translations: DataFrame,
    keys: Sequence[str] = ("country", "video_id"),
    fields: Sequence[str] = ("title", "tags", "description"),
) -> DataFrame:
    """Replace text by its translation where the dictionary has one.

    ``translations`` has ``keys``, ``field`` and ``text``. Empty text and the
    "no tags" mark stay as they are; entities are decoded after translation.
    """
    keys = list(keys)
    per_key = translations.groupBy(*keys).agg(
        *[F.max(F.when(F.col("field") == f, F.col("text"))).alias(f"__{f}") for f in fields]
    )
    per_key = _key_sizes(df, keys).join(per_key, keys, "left")
    joined = join_per_key(df, per_key, keys, "__rows")
    new = {}
    for f in fields:
        fixed = (F.length(f) == 0) | (F.lower(f) == NO_TAGS.lower())
        new[f] = F.when(fixed, F.col(f)).otherwise(F.coalesce(unescape_html(f"__{f}"), F.col(f)))
    return joined.withColumns(new).drop(*[f"__{f}" for f in fields])


def untranslated(
    df: DataFrame, translations: DataFrame, keys: Sequence[str] = ("country", "video_id")
) -> DataFrame:
    """The keys still missing in the dictionary."""
    return df.select(*keys).distinct().join(translations.select(*keys), list(keys), "left_anti")
