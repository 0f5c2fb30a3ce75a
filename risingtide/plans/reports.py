"""Distributions, monthly series and word reports."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F

from risingtide.functions.text import TERM_FRAGMENTS, alpha_term, letter_digit_runs
from risingtide.functions.times import month_start
from risingtide.operators.distribution import box_stats, exact_tiles, quantiles, quartile_bins
from risingtide.operators.durations import days_to_trend, trend_durations
from risingtide.operators.ranking import top_overall
from risingtide.operators.series import monthly_share, period_span, to_series, with_z_scores
from risingtide.operators.snapshots import before, latest_per_key
from risingtide.operators.terms import lowest_idf_by_group, stack_texts, tfidf_top_terms
from risingtide.operators.warping import MAX_ROUNDS, WarpedClusters, cluster_series


def days_to_trend_quartiles(
    df: DataFrame, key: str, published: str, trending: str, category: str, tiebreak: Sequence[str] = ()
) -> DataFrame:
    """Quartiles of days from publication to first trending, per category."""
    days = days_to_trend(df, key, published, trending, tiebreak)
    q = quantiles(days, "time_to_trend", [0.25, 0.5, 0.75], [category])
    return q.select(category, *[F.col("quantiles")[i].alias(f"q{i + 1}") for i in range(3)])


def duration_boxes(
    df: DataFrame, key: str, trending: str, category: str, order: Sequence[str] = ()
) -> DataFrame:
    """Box-plot numbers of the trending duration per category."""
    return box_stats(trend_durations(df, key, trending, category, order), "trending_duration", [category])


def share_series(
    df: DataFrame, key: str, date: str, part: str, rest: str
) -> DataFrame:
    """Per key the monthly mean of part/(part+rest), gaps 0, and its z-scores."""
    monthly = monthly_share(df, [key], date, part, rest)
    # The months of the rows are those of their means, without a shuffle.
    months = df.select(month_start(date).alias("month"))
    series = to_series(monthly, key, "month", "score", period_span(months, "month"))
    return with_z_scores(series)


def cluster_shares(
    df: DataFrame, key: str, date: str, part: str, rest: str, k: int = 3, max_iter: int = MAX_ROUNDS
) -> WarpedClusters:
    """Cluster the scaled monthly series of every key."""
    return cluster_series(share_series(df, key, date, part, rest), key, "z", k, max_iter)


def top_words(
    df: DataFrame, key: str, date: str, cutoff: str, texts: Sequence[str] = ("description", "title"),
    stopwords: Iterable[str] = (), n: int = 10, fragments: Iterable[str] = TERM_FRAGMENTS,
) -> DataFrame:
    """The words weighing most over the latest texts before the cutoff."""
    latest = latest_per_key(before(df.select(key, date, *texts), date, cutoff), [key], date, ties="all")
    docs = stack_texts(latest, texts).select(letter_digit_runs("document").alias("tokens"))
    found = tfidf_top_terms(docs, "tokens", n, alpha_term(stopwords, fragments))
    return top_overall(found, [F.desc("score"), F.asc("term")], n)


def top_words_by_quartile(
    df: DataFrame, key: str, date: str, cutoff: str, value: str, text: str = "description",
    stopwords: Iterable[str] = (), n: int = 10, tiebreak: Sequence[str] = (),
    equal_counts: bool = False, fragments: Iterable[str] = TERM_FRAGMENTS,
) -> DataFrame:
    """Per quartile of ``value`` the words found in the most of its texts.

    Quartiles go by value, so equal values stay together; ``equal_counts`` cuts
    the rows into four equal parts instead (then ``tiebreak`` names one unique
    numeric column).
    """
    latest = latest_per_key(before(df, date, cutoff), [key], date, "first", tiebreak)
    if equal_counts:
        binned = exact_tiles(latest, value, tiebreak[0], 4, "quartile")
    else:
        binned = quartile_bins(latest, value)
    docs = binned.select("quartile", letter_digit_runs(text).alias("tokens"))
    return lowest_idf_by_group(docs, "tokens", "quartile", n, alpha_term(stopwords, fragments))
