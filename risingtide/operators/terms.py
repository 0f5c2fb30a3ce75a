"""Counting and weighting terms over whole corpora.

Documents carry an array of tokens. A document is never spread over a shuffle:
only (term, counts) pairs are, after Spark's map-side aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from risingtide.operators.ranking import top_per_group
from risingtide.session import materialise

TermTest = Callable[[Column], Column]

# A vocabulary up to this size is broadcast.
BROADCAST_TERMS = 10_000


def stack_texts(df: DataFrame, columns: Sequence[str], out: str = "document") -> DataFrame:
    """One document per text column and row."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.explode(F.array(*columns)).alias(out))


def _any(term: Column) -> Column:
    return F.length(term) > 0


def term_counts(
    docs: DataFrame, tokens: str, by: Sequence[str] = (), keep: TermTest = _any, once: bool = False
) -> DataFrame:
    """``term`` and its ``count``, per ``by``: occurrences, or with ``once`` documents.

    ``keep`` is tested on the distinct terms after counting, not on every token.
    """
    items = F.array_distinct(tokens) if once else F.col(tokens)
    # The outer form keeps Spark from tokenising twice to look for empty arrays first.
    counts = docs.select(*by, F.explode_outer(items).alias("term")).groupBy(*by, "term").agg(
        F.count(F.lit(1)).alias("count")
    )
    # Naming the count keeps the test behind the aggregation.
    return counts.where(F.when(F.col("count") > 0, keep(F.col("term"))))


def term_stats(docs: DataFrame, tokens: str, keep: TermTest = _any) -> DataFrame:
    """``term``, its number of occurrences ``count`` and of documents ``doc_count``."""
    seen = term_counts(docs, tokens, keep=keep).withColumn("doc_count", F.lit(0))
    found = term_counts(docs, tokens, keep=keep, once=True).select(
        "term", F.lit(0).alias("count"), F.col("count").alias("doc_count")
    )
    return seen.unionByName(found).groupBy("term").agg(
        F.sum("count").alias("count"), F.sum("doc_count").alias("doc_count")
    )


def smooth_idf(documents: Column, doc_count: Column) -> Column:
    return F.log((F.lit(1.0) + documents) / (F.lit(1.0) + doc_count)) + 1


def tfidf_top_terms(
    docs: DataFrame, tokens: str, vocabulary: int = 10, keep: TermTest = _any
) -> DataFrame:
    """Terms by their summed TF-IDF weight: ``term``, ``idf``, ``score``.

    The vocabulary is the most frequent terms that pass ``keep`` (ties by term).
    A document's weights are tf * idf, scaled to unit length over the
    vocabulary only.

    Documents are known by the hash of their tokens, so copies are weighed once
    and counted; a document meets itself again as at most ``vocabulary`` counts.
    """
    if vocabulary < 1:
        raise ValueError("vocabulary must be at least 1")
    spark = docs.sparkSession
    # A larger vocabulary is joined as Spark sees fit.
    small = F.broadcast if vocabulary <= BROADCAST_TERMS else lambda side: side
    top = term_counts(docs, tokens, keep=keep).where("term <> ''")
    kept = top.orderBy(F.desc("count"), "term").limit(vocabulary).select("term")
    # The empty term, put before every document's tokens, counts the copies.
    marker = spark.createDataFrame([("",)], "term string")
    held = F.coalesce(F.col(tokens), F.array().cast("array<string>"))
    own = F.filter(held, lambda t: F.length(t) > 0)
    # Every token with its length before it: ["a b"] and ["a", "b"] are different documents.
    marked = F.transform(held, lambda t: F.concat(F.length(t).cast("string"), F.lit(":"), t))
    # Hashed in a step of its own: next to explode it would be redone for every token.
    hashed = docs.select(
        F.unhex(F.md5(F.array_join(marked, ""))).alias("doc"),
        F.concat(F.array(F.lit("")), own).alias("terms"),
    )
    counts = materialise(
        hashed.select("doc", F.explode_outer("terms").alias("term"))
        .join(small(kept.unionByName(marker)), "term")
        .groupBy("doc", "term")
        .agg(F.count(F.lit(1)).alias("c")),
        "document-terms",
    )
    one_doc = W.partitionBy("doc")
    copies = F.max(F.when(F.col("term") == "", F.col("c"))).over(one_doc)
    per_doc = counts.withColumn("copies", copies)
    found = per_doc.groupBy("term").agg(F.sum("copies").alias("docs"))
    # ``found`` has at most ``vocabulary`` terms and the marker, which met every document.
    total = found.where("term = ''").select("docs").scalar()
    idf = found.where("term <> ''").withColumn("total", total).select(
        "term", smooth_idf(F.col("total"), F.col("docs")).alias("idf")
    )
    weight = F.col("c") * F.col("idf")
    weighed = (
        per_doc.where("term <> ''")
        .join(small(idf), "term")
        .withColumn("norm", F.sqrt(F.sum(weight * weight).over(one_doc)))
    )
    return weighed.groupBy("term").agg(
        F.max("idf").alias("idf"), F.sum(F.col("copies") * weight / F.col("norm")).alias("score")
    )


def lowest_idf_by_group(
    docs: DataFrame, tokens: str, group: str, n: int = 10, keep: TermTest = _any
) -> DataFrame:
    """Per group the ``n`` terms found in the most documents, with their idf.

    All groups are counted in one pass. The list is cut to ``n`` terms a group
    before the group sizes, needed for the idf only, are joined.
    """
    counts = term_counts(docs, tokens, [group], keep, once=True).withColumnRenamed("count", "doc_count")
    top = top_per_group(counts, [group], [F.desc("doc_count"), F.asc("term")], n, "rank")
    sizes = docs.groupBy(group).agg(F.count(F.lit(1)).alias("documents"))
    return top.join(sizes, group).select(
        group, "rank", "term", "doc_count",
        smooth_idf(F.col("documents"), F.col("doc_count")).alias("idf"),
    )


def top_words_by_group(
    docs: DataFrame, tokens: str, group: str, n: int = 10, keep: TermTest = _any
) -> DataFrame:
    """Per group the ``n`` words that occur most often."""
    counts = term_counts(docs, tokens, [group], keep)
    return top_per_group(counts, [group], [F.desc("count"), F.asc("term")], n, "rank")
