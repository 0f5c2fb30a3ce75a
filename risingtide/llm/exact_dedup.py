"""Exact duplicates by an extendible-hash index on shared files.

1. Every text gets a 64-bit hash; equal hashes are counted together, so a group of
   copies fills its bucket once, however large it is.
2. The directory begins as one bucket. Overfull buckets are split by one more leading
   bit of the hash, which doubles the directory, until each holds at most ``capacity``
   hashes. All depths are derived from one histogram instead of one pass per doubling.
3. The index (bucket, hash, id, SHA-256) is written to the shared folder in ranges of
   buckets; each task owns a range of keys.
4. Hashes that occur twice or more form chains. Their texts are grouped by bucket, hash
   and the text itself, which compares bytes, so colliding texts stay apart. Copies are
   collapsed before the shuffle. Texts with a hash of their own are never moved.

Only DataFrame expressions are used. Null counts as an empty text; texts are equal when
identical. Of equal texts the row with the largest id stays. Rows repeating id and text
stay or go together; a row without id always stays, and counts towards its group.
Columns beyond id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from risingtide.llm.tables import Scratch, with_ids

# Hashes of one bucket.
CAPACITY = 1 << 16
# Leading bits beyond the balanced depth that splitting may use; at the last one a
# bucket overflows into a longer chain.
SLACK_BITS = 3


def directory(hashes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``slot``, ``bucket`` and ``depth``: which bucket each slot of the directory points to.

    ``hashes`` is a stored table of distinct ``hash``. Slots are the leading bits of a
    hash at the global depth; a bucket of less depth is pointed to by several slots.
    """
    buckets = max(1, -(-hashes.count() // capacity))
    bits = min(62, (buckets - 1).bit_length() + SLACK_BITS)
    slots = hashes.groupBy(_slot("hash", bits).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    levels = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth")).groupBy(
        "depth", F.expr(f"shiftright(slot, {bits} - depth)").alias("prefix")
    ).agg(F.sum("n").alias("n"))
    parents = levels.where(F.col("n") > capacity).select(
        (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent")
    )
    split = levels.withColumn("parent", F.shiftright("prefix", 1)).join(parents, ["depth", "parent"], "left_semi")
    leaves = levels.where("depth = 0").select("depth", "prefix", "n").union(split.select("depth", "prefix", "n")).where(
        (F.col("n") <= capacity) | (F.col("depth") == bits)
    )
    first = F.expr(f"shiftleft(prefix, {bits} - depth)")
    return leaves.select(
        first.alias("bucket"), "depth",
        F.explode(F.sequence(first, first + F.expr(f"shiftleft(1L, {bits} - depth)") - 1)).alias("slot"),
    ).select("slot", "bucket", "depth", F.lit(bits).alias("bits"))


def _slot(column: str, bits: int):
    return F.shiftrightunsigned(column, 64 - bits) if bits else F.lit(0).cast("long")


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``: one row per row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    entries = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    ).withColumn("hash", F.xxhash64("text"))
    hashes = scratch.keep(entries.groupBy("hash").agg(F.count(F.lit(1)).alias("n")), "hashes")
    slots = scratch.keep(directory(hashes, capacity), "directory")
    bits = slots.agg(F.max("bits")).first()[0] or 0

    # Two slots may not hold a hash that is in the table; every hash has a slot.
    index = scratch.keep(
        entries.select("doc_id", "hash", F.sha2("text", 256).alias("sha"), _slot("hash", bits).alias("slot"))
        .join(slots.select("slot", "bucket"), "slot").drop("slot")
        .repartitionByRange("bucket", "hash", "doc_id").sortWithinPartitions("bucket", "hash"),
        "index",
    )
    chained = scratch.keep(hashes.where("n > 1").select("hash"), "chained")
    chains = with_ids(entries, "hash", chained).withColumn("slot", _slot("hash", bits)).join(
        slots.select("slot", "bucket"), "slot"
    )
    groups = scratch.keep(
        chains.groupBy("bucket", "hash", "text").agg(
            F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
        ).select("bucket", "hash", F.sha2("text", 256).alias("sha"), "keep_id", "group_size"),
        "groups",
    )
    keep_id = F.coalesce("keep_id", "doc_id")
    return index.join(groups, ["bucket", "hash", "sha"], "left").select(
        "doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("doc_id").isNull() | (F.col("doc_id") == keep_id)).alias("kept"), F.col("sha").alias("text_sha256"),
    )
