"""Regression metrics, each in a single aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from risingtide.operators.distribution import dense_ranks
from risingtide.operators.skew import join_per_key
from risingtide.session import materialise


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """``n``, ``mae``, ``mse`` and ``r2``; r2 is missing when the label never varies."""
    error = F.col(prediction).cast("double") - F.col(label).cast("double")
    squared = F.sum(error * error)
    n = F.count(error)
    known = F.when(error.isNotNull(), F.col(label).cast("double"))
    return df.agg(
        n.alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.try_divide(squared, n).alias("mse"),
        (1 - F.try_divide(squared, F.var_pop(known) * n)).alias("r2"),
    )


def _ranked_pairs(
    df: DataFrame, group: Sequence[str], label: str, prediction: str, expected: str, predicted: str
) -> DataFrame:
    """Distinct (group, label, prediction) with both dense ranks and the number of rows ``__n``.

    ``df``, often the output of a model, is computed once.
    """
    pairs = materialise(df.groupBy(*group, label, prediction).agg(F.count(F.lit(1)).alias("__n")))
    ranked = pairs
    for value, out in ((label, expected), (prediction, predicted)):
        ranks = dense_ranks(pairs, group, value, out, "__rows")
        ranked = join_per_key(ranked, ranks, [*group, value], "__rows")
    return ranked.withColumns({c: F.col(c).cast("double") for c in (expected, predicted)})


def with_ranks(
    df: DataFrame, group: Sequence[str], label: str, prediction: str,
    expected: str = "expected", predicted: str = "predicted",
) -> DataFrame:
    """Dense ranks of label and prediction inside the group, as doubles."""
    pairs = _ranked_pairs(df, group, label, prediction, expected, predicted)
    return join_per_key(df, pairs, [*group, label, prediction], "__n")


def rank_metrics(df: DataFrame, group: Sequence[str], label: str, prediction: str) -> DataFrame:
    """MAE and MSE of within-group ranks: how well the order inside a group is met.

    Rows with the same label and prediction are scored together.
    """
    pairs = _ranked_pairs(df, group, label, prediction, "expected", "predicted")
    error = F.when(
        F.col(label).isNotNull() & F.col(prediction).isNotNull(), F.col("predicted") - F.col("expected")
    )
    rows = F.sum(F.when(error.isNotNull(), F.col("__n")))
    return pairs.agg(
        F.coalesce(rows, F.lit(0)).alias("n"),
        F.try_divide(F.sum(F.abs(error) * F.col("__n")), rows).alias("mae"),
        F.try_divide(F.sum(error * error * F.col("__n")), rows).alias("mse"),
    )
