"""Screening rows by a Bloom filter of the keys, before anything is shuffled.

The filter is a table of bitmaps of ``BITMAP`` bits, built by Spark's own bitmap aggregate
and broadcast. A key's hash names one bitmap and ``PROBES`` bits in it, so a row is tested
by one broadcast lookup and a few bit tests, all native. Every listed key passes; of the
others about one in a hundred does, and the join that follows drops those.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from risingtide.session import materialise

# Bits of one bitmap, as Spark fixes them, and bits taken for each key.
BITMAP = 32_768
BITS_PER_KEY = 12
PROBES = 4
# Bitmaps that are broadcast at most, 4 KB each: 16 MB. More keys are not screened.
MAX_BITMAPS = 4_096


def _bitmap_of(keys: Sequence[Column], bitmaps: int) -> Column:
    return F.pmod(F.xxhash64(*keys, F.lit("bitmap")), F.lit(bitmaps)).cast("int")


def _bit_of(keys: Sequence[Column], probe: int) -> Column:
    return F.pmod(F.xxhash64(*keys, F.lit(probe)), F.lit(BITMAP))


def _is_set(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) != 0


def bloom_bitmaps(keys: DataFrame, on: Sequence[str], bitmaps: int) -> DataFrame:
    """``__bitmap`` and its ``__bits``: one row per bitmap that holds a key."""
    columns = [F.col(c) for c in on]
    places = F.explode(F.array(*[_bit_of(columns, p) for p in range(PROBES)]))
    return keys.select(_bitmap_of(columns, bitmaps).alias("__bitmap"), places.alias("__place")).groupBy("__bitmap").agg(
        F.bitmap_construct_agg("__place").alias("__bits"))


def maybe_listed(df: DataFrame, keys: DataFrame, on: Sequence[str], max_bitmaps: int = MAX_BITMAPS) -> DataFrame:
    """``df`` without most rows whose key is not listed; rows with a listed key all stay.

    A key with a null part is never listed. Both sides need the same key types. With more
    keys than ``max_bitmaps`` bitmaps hold, ``df`` comes back as it is.
    """
    listed = materialise(keys.select(*on).dropna().distinct(), "keys")
    bitmaps = max(1, -(-listed.count() * BITS_PER_KEY // BITMAP))
    if bitmaps > max_bitmaps:
        return df
    told = F.broadcast(materialise(bloom_bitmaps(listed, on, bitmaps), "bitmaps"))
    columns = [df[c] for c in on]
    hit = reduce(lambda a, b: a & b, [_is_set(told["__bits"], _bit_of(columns, p)) for p in range(PROBES)])
    marked = df.where(reduce(lambda a, b: a & b, [c.isNotNull() for c in columns]))
    return marked.join(told, _bitmap_of(columns, bitmaps) == told["__bitmap"]).where(hit).select(*[df[c] for c in df.columns])
