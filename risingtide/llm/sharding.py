"""A uniform random shuffle into shards of exact sizes, by a communication matrix.

Rows lie in blocks by a hash. How many rows of each block go to each shard is drawn from
the multivariate hypergeometric law (the matrix), as if all rows had been shuffled at
once. Each block permutes its rows and deals them out by its line of the matrix; rows
are exchanged; each receiver permutes again. Shards are cut into slices, and a second
matrix for each shard deals its rows over slices, so no task holds a whole shard.

There are sqrt(rows) / 8 blocks and as many slices, so blocks, slices and the first
matrix all grow with the square root of the table; the driver holds one number per block
and shard. The same rows and seed give the same shards however the table is stored.

The law is ``rows``: counts at most one apart. Equal texts are groups for nothing here:
they are shuffled like other rows. Null texts count as empty. Rows equal in id and text
lie in the same block. Extra columns are ignored. An empty table has no rows.
"""

from __future__ import annotations

from math import ceil, exp, lgamma, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from risingtide.llm.tables import Scratch

SHARDS = 24
SEED = 20_240_229


def _log_choose(n: int, k: int) -> float:
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` are good: inversion from the mode outward, for any size."""
    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low
    at = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))
    here = exp(_log_choose(good, at) + _log_choose(bad, drawn - at) - _log_choose(good + bad, drawn))
    left = rng.random() - here
    down, up, p_down, p_up = at, at, here, here
    while left > 0 and (down > low or up < high):
        if up < high:
            p_up *= (good - up) / (up + 1) * ((drawn - up) / (bad - drawn + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down / (good - down + 1) * ((bad - drawn + down) / (drawn - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
    return at


def communication_matrix(rng: np.random.Generator, sources: list[int], targets: list[int]) -> np.ndarray:
    """Counts from each source to each target with the given sums, as a uniform shuffle has them."""
    room, total = list(targets), sum(targets)
    found = np.zeros((len(sources), len(targets)), dtype=np.int64)
    for i, source in enumerate(sources):
        left, others = source, total
        for j, free in enumerate(room):
            others -= free
            found[i, j] = hypergeometric(rng, free, others, left)
            left -= found[i, j]
        room = [free - int(n) for free, n in zip(room, found[i])]
        total -= source
    return found


def even(total: int, parts: int) -> list[int]:
    """``parts`` counts at most one apart."""
    return [total // parts + (i < total % parts) for i in range(parts)]


def _slice_matrix(seed: int, slices: int):
    def deal(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("block")
        number = int(shard["shard"].iloc[0])
        counts = shard["n"].tolist()
        matrix = communication_matrix(np.random.default_rng([seed, number]), counts, even(sum(counts), slices))
        block = np.repeat(shard["block"].to_numpy(), slices)
        part = np.tile(np.arange(slices), len(shard))
        return pd.DataFrame({"block": block, "shard": number, "slice": part, "n": matrix.reshape(-1)})

    return deal


def _dealt(rows: pd.DataFrame, matrix: pd.DataFrame) -> pd.DataFrame:
    """One block: permuted by its random numbers and dealt by its line of both matrices."""
    rows = rows.sort_values(["order", "doc_id", "text_crc32"])
    matrix = matrix.sort_values(["shard", "slice"])
    for name in ("shard", "slice"):
        rows[name] = np.repeat(matrix[name].to_numpy(), matrix["n"].to_numpy()).astype(np.int32)
    return rows[["doc_id", "size", "text_crc32", "shard", "slice"]]


def _random(seed: int, part: int) -> Column:
    return F.xxhash64("doc_id", "size", "text_crc32", F.lit(seed + part))


def shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard``, ``slot``: one row per row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = scratch.keep(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32")), "rows")
    total = rows.count()
    blocks = max(1, ceil(sqrt(total) / 8))
    slices = max(1, ceil(blocks / shards))
    blocked = rows.withColumn("block", F.pmod(_random(seed, 0), F.lit(blocks)).cast("int"))
    counts = sorted((r["block"], r["count"]) for r in blocked.groupBy("block").count().collect())
    matrix = communication_matrix(np.random.default_rng(seed), [n for _, n in counts], even(total, shards))
    lines = [(b, s, int(n)) for (b, _), line in zip(counts, matrix) for s, n in enumerate(line)]
    first = spark.createDataFrame(lines, "block int, shard int, n long")
    second = scratch.keep(
        first.groupBy("shard").applyInPandas(_slice_matrix(seed, slices), "block int, shard int, slice int, n long"),
        "matrix")
    dealt = scratch.keep(
        blocked.withColumn("order", _random(seed, 1)).groupBy("block").cogroup(second.groupBy("block"))
        .applyInPandas(_dealt, "doc_id long, size long, text_crc32 long, shard int, slice int"), "dealt")
    # The receivers permute again; slices follow each other within a shard.
    order = Window.partitionBy("shard", "slice").orderBy(_random(seed, 2), "doc_id", "text_crc32")
    in_shard = F.lit(total // shards) + F.when(F.col("shard") < total % shards, 1).otherwise(0)
    before = F.col("slice") * F.floor(in_shard / slices) + F.least("slice", in_shard % slices)
    return dealt.select(
        "doc_id", "size", "text_crc32", "shard", (before + F.row_number().over(order) - 1).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, **settings) -> None:
    """All columns of ``docs`` (ids unique) as Parquet, a folder per shard, in slot order within files."""
    placed = shards(docs, **settings).select("doc_id", "shard", "slot")
    docs.join(placed, "doc_id").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard").parquet(path)
