"""Approximate quantiles by mergeable sketches: one pass, no sorting, no range shuffle.

A KLL sketch of each group is built where the rows are; only sketches are shuffled, some
kilobytes each. Sketches of parts (days, files) can be stored and merged later, so a new
day costs one more sketch and old rows are not read again. With ``SIZE`` 800 the rank of an
estimate is off by less than ``RANK_ERROR`` of the group's rows but for a chance far below
one in a million; groups of up to ``SIZE`` rows are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

SIZE = 800
RANK_ERROR = 0.01


def quantile_sketches(df: DataFrame, value: str, by: Sequence[str] = (), size: int = SIZE, out: str = "sketch") -> DataFrame:
    """One sketch per group. Missing values and NaN are left out; a group without a value has none."""
    number = F.col(value).cast("double")
    rows = df.where(number.isNotNull() & ~F.isnan(number))
    return rows.groupBy(*by).agg(F.kll_sketch_agg_double(number, F.lit(size)).alias(out), F.count(F.lit(1)).alias("rows"))


def merged_sketches(sketches: DataFrame, by: Sequence[str] = (), size: int = SIZE, sketch: str = "sketch") -> DataFrame:
    """The sketches of larger groups from those of their parts."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double(sketch, F.lit(size)).alias(sketch), F.sum("rows").alias("rows"))


def sketch_quantiles(sketches: DataFrame, probs: Sequence[float], sketch: str = "sketch", out: str = "quantiles") -> DataFrame:
    """The sketches' columns with ``out``, the estimated quantiles, in the order of ``probs``."""
    found = F.array(*[F.kll_sketch_get_quantile_double(sketch, F.lit(float(p))) for p in probs])
    return sketches.withColumn(out, F.when(F.col("rows") > 0, found)).drop(sketch)


def rank_errors(df: DataFrame, value: str, estimates: DataFrame, probs: Sequence[float], by: Sequence[str] = (),
                quantiles: str = "quantiles") -> DataFrame:
    """``by``, ``rows`` and ``error``: how far, as a share of the rows, an estimate's ranks are from the wanted one at most.

    One more pass that counts the rows below and up to each estimate; ``estimates`` has a row per group.
    """
    number = F.col(value).cast("double")
    told = estimates.select(*[F.col(c).alias(f"__{c}") for c in by], F.col(quantiles).alias("__q"))
    rows = df.where(number.isNotNull() & ~F.isnan(number)).select(*by, number.alias("__value"))
    joined = rows.join(told, [rows[c].eqNullSafe(told[f"__{c}"]) for c in by]) if by else rows.crossJoin(F.broadcast(told))
    counts = [f(F.col("__q")[i]) for i in range(len(probs)) for f in (
        lambda q: F.sum((F.col("__value") < q).cast("long")), lambda q: F.sum((F.col("__value") <= q).cast("long")))]
    found = joined.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *[c.alias(f"__c{i}") for i, c in enumerate(counts)])
    gaps = []
    for i, p in enumerate(probs):
        low, high, wanted = F.col(f"__c{2 * i}") / F.col("rows"), F.col(f"__c{2 * i + 1}") / F.col("rows"), F.lit(float(p))
        gaps.append(F.greatest(low - wanted, wanted - high, F.lit(0.0)))
    return found.select(*by, "rows", F.array_max(F.array(*gaps)).alias("error"))
