"""Exact ranks and quantiles without sorting a whole group in one task.

Spark's ``percentile``, ``ntile`` and ranking windows gather a full group (or
the full table) in one place. Here equal values are first counted together,
then cut into ranges whose number follows the table; a running total inside a range plus
the totals of the ranges before it gives every value its exact position.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from risingtide.operators.skew import join_per_key
from risingtide.session import materialise

# Rows (distinct values) of one range, which one task sorts.
RANGE_ROWS = 200_000


def value_counts(df: DataFrame, value: str, by: Sequence[str] = (), count: str = "n") -> DataFrame:
    """Distinct values with their number of rows, missing values left out."""
    kept = df.where(F.col(value).isNotNull())
    return kept.groupBy(*by, value).agg(F.count(F.lit(1)).alias(count))


def running_before(
    df: DataFrame,
    value: str,
    weight: str,
    by: Sequence[str] = (),
    out: str = "before",
    total: str = "total",
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Add the sum of ``weight`` over all smaller values, and over the group.

    ``df`` has one row per (``by``, ``value``) and is computed once. It is cut into
    ranges of about ``range_rows`` rows, so their number follows the table. No task
    holds more than one range of one group; a group has one total per range.
    """
    by = list(by)
    df = materialise(df, "values")
    names = [f"__by{i}" for i in range(len(by))]
    ranges = max(1, -(-df.count() // range_rows))
    # Equal values share a range, missing ones come first.
    cut = materialise(df.repartitionByRange(ranges, value).withColumn("__range", F.spark_partition_id()), "ranges")
    part = cut.groupBy(*by, "__range").agg(F.sum(weight).alias("__sum"))
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    offsets = part.select(
        *[F.col(b).alias(n) for b, n in zip(by, names)],
        F.col("__range").alias("__at"),
        F.sum("__sum").over(group.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)).alias("__offset"),
        F.sum("__sum").over(group).alias(total),
    )
    inside = F.sum(weight).over(
        W.partitionBy(*by, "__range").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    )
    ranked = cut.withColumn("__inside", inside)
    on = ranked["__range"] == offsets["__at"]
    for b, n in zip(by, names):
        on = on & ranked[b].eqNullSafe(offsets[n])
    zero = F.lit(0)
    return (
        ranked.join(offsets, on)
        .withColumn(out, F.coalesce("__inside", zero) + F.coalesce("__offset", zero))
        .drop("__range", "__at", "__offset", "__inside", *names)
    )


def values_at(
    df: DataFrame,
    value: str,
    positions: Callable[[Column], list[Column]],
    by: Sequence[str] = (),
    count: str | None = None,
) -> DataFrame:
    """The values at given 0-based positions of each group's sorted rows.

    ``positions`` gets the group's row count and returns the positions wanted.
    Result: ``by``, ``value``, ``before`` (rows with a smaller value), ``total``,
    ``slot`` (index of the position) and ``position``.
    """
    if count is None:
        df, count = value_counts(df, value, by), "n"
    counted = running_before(df, value, count, by)
    wanted = F.array(*[p.cast("bigint") for p in positions(F.col("total"))])
    hit = F.filter(
        F.transform(wanted, lambda p, i: F.struct(i.alias("slot"), p.alias("position"))),
        lambda s: (s["position"] >= F.col("before")) & (s["position"] < F.col("before") + F.col(count)),
    )
    return counted.select(*by, F.col(value).alias("value"), "before", "total", F.inline(hit))


def quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    out: str = "quantiles",
    count: str | None = None,
) -> DataFrame:
    """Exact linear-interpolated quantiles: ``by``, ``out`` as array<double>.

    ``count`` is as in ``values_at``.
    """
    probs = list(probs)

    def ends(n: Column) -> list[Column]:
        spots = [(n - 1) * F.lit(float(p)) for p in probs]
        return [F.floor(s) for s in spots] + [F.ceil(s) for s in spots]

    found = values_at(df.withColumn(value, F.col(value).cast("double")), value, ends, by, count)
    # Both ends of every probability, as one small map per group.
    slots = found.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias("__at"),
        F.max("total").alias("__n"),
    )
    parts = []
    for i, p in enumerate(probs):
        low, high = F.col("__at")[F.lit(i)], F.col("__at")[F.lit(i + len(probs))]
        spot = (F.col("__n") - 1) * F.lit(float(p))
        parts.append(low + (high - low) * (spot - F.floor(spot)))
    return slots.select(*by, F.array(*parts).alias(out))


def box_stats(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Box-plot numbers per group, outliers left out of the whiskers.

    Whiskers are the extreme values within 1.5 interquartile ranges of the box.
    """
    by = list(by)
    counted = materialise(value_counts(df.withColumn(value, F.col(value).cast("double")), value, by))
    box = quantiles(counted, value, [0.25, 0.5, 0.75], by, "__box", count="n")
    sizes = counted.groupBy(*by).agg(F.count(F.lit(1)).alias("__values"))
    box = box.join(sizes.withColumnsRenamed({b: f"__{b}" for b in by}),
                   on=[F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by]).drop(*[f"__{b}" for b in by])
    q1, q3 = F.col("__box")[0], F.col("__box")[2]
    reach = (q3 - q1) * 1.5
    inside = F.col(value).between(q1 - reach, q3 + reach)
    return join_per_key(counted, box, by, "__values").groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(q1).alias("q1"),
        F.max(F.col("__box")[1]).alias("median"),
        F.max(q3).alias("q3"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
    )


def quartile_bins(df: DataFrame, value: str, out: str = "quartile", first: int = 1) -> DataFrame:
    """Bin by the table's quartile edges; a value on an edge goes to the lower bin.

    The rows themselves are not shuffled: the three edges come in as one value.
    """
    edges = quantiles(df, value, [0.25, 0.5, 0.75]).scalar()
    above = F.lit(first)
    for i in range(3):
        above = above + F.when(F.col(value) > F.col("__edges")[i], 1).otherwise(0)
    label = F.when(F.col(value).isNotNull(), above)
    return df.withColumn("__edges", edges).withColumn(out, label).drop("__edges")


def exact_tiles(df: DataFrame, value: str, unique: str, tiles: int, out: str = "tile") -> DataFrame:
    """Label rows 1..``tiles`` as ``ntile`` ordered by (``value``, ``unique``) does.

    Only the first row of each tile is looked for: its value, then its
    ``unique`` number among the rows of that value. The table itself is compared
    with those few rows and never shuffled. Rows without a value get no label.
    """

    def tile_starts(n: Column) -> list[Column]:
        size, extra = F.floor(n / tiles), F.pmod(n, F.lit(tiles))
        return [size * i + F.least(F.lit(i), extra) for i in range(1, tiles)]

    starts = values_at(df, value, tile_starts).select(
        F.col("slot").alias("__tile"),
        F.col("value").alias("__start"),
        (F.col("position") - F.col("before")).alias("__skip"),
    )
    # At most tiles - 1 rows, so the broadcast is bounded.
    tied = df.select(value, unique).join(F.broadcast(starts), F.col(value) == F.col("__start"))
    firsts = values_at(
        tied, unique, lambda n: [F.col("__skip")], ["__tile", "__start", "__skip"]
    ).agg(F.collect_list(F.struct(F.col("__start").alias("v"), F.col("value").alias("u"))))
    this = F.struct(F.col(value).alias("v"), F.col(unique).alias("u"))
    label = F.when(
        F.col(value).isNotNull(), F.size(F.filter("__firsts", lambda s: s <= this)) + 1
    )
    return df.withColumn("__firsts", firsts.scalar()).withColumn(out, label).drop("__firsts")


def dense_ranks(df: DataFrame, by: Sequence[str], value: str, out: str, rows: str) -> DataFrame:
    """``by``, ``value``, its ascending dense rank ``out`` inside ``by`` and its ``rows`` in ``df``."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias(rows)).withColumn("__one", F.lit(1))
    ranked = running_before(counts, value, "__one", by, out="__before", total="__groups")
    return ranked.select(*by, value, (F.col("__before") + 1).cast("bigint").alias(out), rows)


def dense_rank_within(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Ascending dense rank of ``value`` inside ``by``, joined onto the rows."""
    return join_per_key(df, dense_ranks(df, by, value, out, "__rows"), [*by, value], "__rows")
