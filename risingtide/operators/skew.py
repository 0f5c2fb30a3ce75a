"""Joining per-key results back onto rows when one key may be huge.

A per-key aggregate is already hash-partitioned by its key, and adaptive
execution splits a skewed join only when both sides come straight from a
shuffle. Hot keys are therefore sliced here, by count.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from risingtide.session import materialise

# Up to so many hot keys are broadcast. More of them (every key above one slice is
# one) are joined like any table, where adaptive execution splits what is skewed.
HOT_KEYS = 100_000
# A key is worth slicing only when it has more rows than one task handles easily.
ROWS_PER_SLICE = 2_000_000


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def join_per_key(
    df: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    rows: str,
    how: str = "inner",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Join ``stats`` (one row per key, or a few) onto ``df``, slicing the hot keys.

    ``rows`` names the column of ``stats`` holding how many rows of ``df`` have
    that key; it is dropped. ``how`` is ``inner`` or ``left_semi``. Null keys
    match each other, as they do in a window partition. ``stats`` is computed
    once and kept in the shared folder.
    """
    names = [f"__key{i}" for i in range(len(keys))]
    stats = materialise(stats, "per-key").withColumnsRenamed(dict(zip(keys, names)))
    slices = F.ceil(F.col(rows) / F.lit(rows_per_slice)).cast("int")
    # A key has one row here, also where ``stats`` has several.
    largest = stats.where(F.col(rows) > rows_per_slice).select(*names, rows).distinct()
    number = largest.limit(HOT_KEYS + 1).count()
    on = [df[k].eqNullSafe(stats[n]) for k, n in zip(keys, names)]
    if not number:
        return df.join(stats.drop(rows), _all(on), how).drop(*names)

    hot = materialise(
        largest.select(*[F.col(n).alias(f"__hot{i}") for i, n in enumerate(names)], slices.alias("__slices")), "hot-keys"
    )
    if number <= HOT_KEYS:
        hot = F.broadcast(hot)

    def with_slices(side: DataFrame, columns: Sequence[str]) -> DataFrame:
        same = [side[c].eqNullSafe(hot[f"__hot{i}"]) for i, c in enumerate(columns)]
        return side.join(hot, _all(same), "left")

    # The partition number spreads exact copies of a row over the slices too.
    spread = F.pmod(F.xxhash64(*[df[c] for c in df.columns], F.spark_partition_id()), F.col("__slices"))
    left = with_slices(df, keys).select(
        *[df[c] for c in df.columns], F.coalesce(spread, F.lit(0)).cast("int").alias("__slice")
    )
    every_slice = F.sequence(F.lit(0), F.coalesce("__slices", F.lit(1)) - 1)
    right = with_slices(stats, names).select(
        *[stats[c] for c in stats.columns if c != rows], F.explode(every_slice).alias("__stat_slice")
    )
    on = [left[k].eqNullSafe(right[n]) for k, n in zip(keys, names)]
    on.append(left["__slice"] == right["__stat_slice"])
    return left.join(right, _all(on), how).drop("__slice", "__stat_slice", *names)
