"""Positions for terms and labels, and sparse vectors, with no list on the driver.

A vocabulary or the labels of a column are a table like any other: each entry's position
is its place by falling count, ties by name, found by ``running_before`` in ranges. Rows
get their positions by a join on the name, hot names in slices, and a sparse vector is the
group of one row's entries, no longer than that row's terms or columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from risingtide.operators.distribution import RANGE_ROWS, running_before, value_counts
from risingtide.operators.skew import join_per_key
from risingtide.operators.terms import TermTest, _any, term_stats
from risingtide.session import materialise


def frequency_index(counts: DataFrame, name: str, count: str, out: str = "index", size: str = "size",
                    range_rows: int = RANGE_ROWS) -> DataFrame:
    """``counts`` (one row per name) with each name's position ``out``, and their number ``size``.

    The most frequent name comes first, ties by name. A missing name has no position.
    """
    placed = counts.where(F.col(name).isNotNull()).select(
        "*", F.struct((-F.col(count)).alias("n"), F.col(name).alias("name")).alias("__place"), F.lit(1).alias("__one"))
    return running_before(placed, "__place", "__one", out=out, total=size, range_rows=range_rows).drop("__place", "__one")


def label_index(df: DataFrame, column: str, out: str = "index", range_rows: int = RANGE_ROWS) -> DataFrame:
    """``column``, its ``count``, position ``out`` and the number of labels ``size``: one row per label."""
    return frequency_index(value_counts(df, column, count="count"), column, "count", out, range_rows=range_rows)


def term_index(docs: DataFrame, tokens: str, keep: TermTest = _any, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``term``, ``count``, ``doc_count``, ``index`` and the number of terms ``size``: one row per term."""
    return frequency_index(term_stats(docs, tokens, keep), "term", "count", range_rows=range_rows)


def tfidf_entries(docs: DataFrame, key: str, tokens: str, keep: TermTest = _any) -> DataFrame:
    """``key``, ``index``, ``term``, ``count``, ``weight``: the entries of every document's vector.

    The weight is the count times log((documents + 1) / (documents with the term + 1)).
    ``key`` is unique; documents without a term have no entry. Every document counts.
    """
    # Only counts matter; sorted, repeated terms are next to each other and take little room.
    docs = materialise(docs.select(key, F.sort_array(tokens).alias(tokens)), "documents")
    total = F.lit(docs.count() + 1.0)
    index = term_index(docs, tokens, keep).select(
        "term", "index", "doc_count", F.log(total / (F.col("doc_count") + 1.0)).alias("__idf"))
    # Documents are shuffled once, by key: their terms are counted, and later gathered, where they then lie.
    counts = docs.repartition(key).select(key, F.explode_outer(tokens).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("count"))
    joined = join_per_key(counts.where("term IS NOT NULL"), index, ["term"], "doc_count")
    return joined.select(key, "index", "term", "count", (F.col("count") * F.col("__idf")).alias("weight"))


def sparse_vectors(entries: DataFrame, key: str, position: str = "index", value: str = "weight") -> DataFrame:
    """``key``, ``positions`` and ``values``, sorted by position: one row per key with an entry."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(position).alias("p"), F.col(value).alias("v"))))
    return entries.groupBy(key).agg(pairs.alias("__pairs")).select(
        key, F.col("__pairs.p").alias("positions"), F.col("__pairs.v").alias("values"))


def scaled_entries(df: DataFrame, key: str, numeric: Sequence[str], coded: Sequence[str],
                   range_rows: int = RANGE_ROWS) -> DataFrame:
    """``key``, ``pos``, ``value``: what is not zero of numeric and one-hot columns, scaled to unit deviation.

    The numeric columns come first. A coded column has a position for each label but the
    last by frequency; a row with that label, or with none, has no entry. The deviation of
    a position follows from its label's count. Only one number per column reaches the driver.
    """
    df = materialise(df.select(key, *numeric, *coded), "rows")
    figures = df.agg(F.count(F.lit(1)).alias("n"), *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(numeric)]).first()
    n, first = float(figures["n"]), len(numeric)
    scaled = [F.col(c).cast("double") / figures[f"s{i}"] if figures[f"s{i}"] else F.lit(0.0) for i, c in enumerate(numeric)]
    parts = [df.select(key, F.posexplode(F.array(*scaled)).alias("pos", "value"))] if numeric else []
    for column in coded:
        index = materialise(label_index(df, column, range_rows=range_rows), "labels")
        size = index.count()
        deviation = F.sqrt(F.col("count") * (n - F.col("count")) / F.lit(n * (n - 1) or 1.0))
        told = index.where(F.col("index") < size - 1).select(
            column, "count", (F.col("index") + first).cast("int").alias("pos"), F.try_divide(F.lit(1.0), deviation).alias("value"))
        parts.append(join_per_key(df.select(key, column), told, [column], "count").select(key, "pos", "value"))
        first += max(size - 1, 0)
    entries = parts[0]
    for part in parts[1:]:
        entries = entries.unionByName(part)
    return entries.where("value <> 0")
