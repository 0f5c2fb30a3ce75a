"""Near-duplicate documents by MinHash with tensored banding.

Plain banding with L tables of K hashes takes L * K minhashes of each set. Here two
small collections of ``side`` bands of ``rows`` minhashes are taken, 2 * side * rows
in all, and every pair of a left and a right band is the key of one table:
side ** 2 tables of 2 * rows hashes each. With ``side=10`` and ``rows=2`` that is 100
tables of 4 hashes from 40 minhashes instead of 400. Two sets of Jaccard similarity s
share a table unless all left or all right bands differ, so they are missed with a
probability below 2 * (1 - s ** rows) ** side: 0.0005 at s = 0.75, 0.0000002 at 0.9.

Candidates are verified on the full shingle sets, in rounds, so that a large group of
copies never becomes all its pairs:

1. equal sets are one class from the start, stood for by the smallest id;
2. in each bucket all classes are compared with the bucket's smallest id;
3. buckets that still hold several components are left with the classes that can
   have a link to another component at all: three quarters of their shingles must
   occur in other components of such buckets (no link is lost by this). They are
   compared with a further leader of another component, then in blocks of each bucket, or of each family of
   overlapping buckets: pairs of different components whose long sketches agree often
   enough are verified on the full sets.

Words are runs of characters other than 0x09-0x0D and 0x20 with A-Z in lower case.
Null and empty texts and texts without a word have the empty set and no link. A row
without id has no link and is kept. Rows repeating an id must repeat the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from risingtide.llm import words as W
from risingtide.llm.components import components
from risingtide.llm.tables import Scratch, with_ids

WIDTH = 5
SIDE = 10
ROWS = 2
# Similarity as a fraction: linked when 100 * intersection >= 75 * union.
PERCENT = 75
# Rounds of new leaders before what is left is compared in blocks.
LEADER_ROUNDS = 1
# Classes of one bucket compared with each other in one go.
BLOCK = 1024
# One-byte minhashes of a sketch for the comparison in blocks, and those looked at first.
SKETCH = 1024
HEAD = 128

_SIGNATURE = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()),
    T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType()),
    T.StructField("mins", T.ArrayType(T.IntegerType(), False)),
])


def _signer(width: int, hashes: int):
    """Batches of (id, text) to set size, a 128-bit digest of the set, and its minhashes."""
    factors, shifts = W.stream(7, hashes) | np.uint64(1), W.stream(8, hashes)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            size, low, high = (np.zeros(n, dtype=np.uint64) for _ in range(3))
            mins = np.zeros((n, hashes), dtype=np.uint64)
            with np.errstate(over="ignore"):
                for i, found in W.shingle_sets(batch.column(1), width):
                    if not len(found):
                        continue
                    size[i], low[i], high[i] = len(found), found.sum(), W.mix(found ^ factors[0]).sum()
                    for h in range(hashes):
                        mins[i, h] = (found * factors[h] + shifts[h]).min()
            flat = (mins >> np.uint64(32)).astype(np.uint32).view(np.int32).reshape(-1)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, (n + 1) * hashes, hashes, dtype=np.int32)), pa.array(flat)
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x.view(np.int64)) for x in (size, low, high)), lists],
                names=_SIGNATURE.names,
            )

    return sign


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               width: int = WIDTH, side: int = SIDE, rows: int = ROWS) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, digest of the set, minhashes."""
    pairs = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return pairs.mapInArrow(_signer(width, 2 * side * rows), _SIGNATURE)


def table_keys(classes: DataFrame, side: int = SIDE, rows: int = ROWS) -> DataFrame:
    """``key`` and ``rep``: one row per class and table, pairing left with right bands."""

    def bands(first: int):
        return F.array(*[
            F.xxhash64(F.lit(first + i), *[F.get("mins", F.lit((first + i) * rows + r)) for r in range(rows)])
            for i in range(side)
        ])

    left = classes.where("n_shingles > 0").select("rep", bands(side).alias("right"), F.explode(bands(0)).alias("l"))
    return left.select("rep", "l", F.explode("right").alias("r")).select(F.xxhash64("l", "r").alias("key"), "rep")


def _linker(width: int, percent: int):
    """Batches of (x, text of x, y, text of y) to the pairs that are similar enough."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2)]
            sets: dict[int, np.ndarray] = {}
            for side, texts in ((0, batch.column(1)), (1, batch.column(3))):
                unique, at = np.unique(ids[side], return_index=True)
                new = np.array([k for k, u in enumerate(unique) if u not in sets], dtype=np.int64)
                for i, found in W.shingle_sets(texts.take(pa.array(at[new])), width):
                    sets[unique[new[i]]] = found
            similar = np.zeros(len(batch), dtype=bool)
            for i, (x, y) in enumerate(zip(*ids)):
                a, b = sets[x], sets[y]
                if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
                    continue
                both = len(np.intersect1d(a, b, assume_unique=True))
                similar[i] = 100 * both >= percent * (len(a) + len(b) - both)
            yield pa.RecordBatch.from_arrays([pa.array(i[similar]) for i in ids], names=["x", "y"])

    return link


def verified(docs: DataFrame, pairs: DataFrame, scratch: Scratch, width: int, percent: int) -> DataFrame:
    """The pairs (x, y) of ``pairs`` whose full shingle sets are similar enough.

    Only texts that some pair names are moved. ``docs`` has ``doc_id`` and ``text``.
    """
    named = scratch.keep(pairs.select("x").union(pairs.select("y")).distinct(), "named")
    texts = scratch.keep(with_ids(docs, "doc_id", named).dropDuplicates(["doc_id"]), "texts")
    both = pairs.join(texts.toDF("y", "text_y"), "y").join(texts.toDF("x", "text_x"), "x")
    found = scratch.keep(
        both.select("x", "text_x", "y", "text_y").mapInArrow(_linker(width, percent), "x long, y long"), "links"
    )
    scratch.drop("named", "texts")
    return found


_RESIDUAL = T.StructType([
    T.StructField("rep", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType(), False)),
    T.StructField("sketch", T.BinaryType()),
])

# Shingles of one set that are hashed together.
_SLICE = 1024


def _setter(width: int):
    """Batches of (id, text) to the whole shingle set and a sketch of SKETCH one-byte minhashes."""
    factors, shifts = W.stream(9, SKETCH) | np.uint64(1), W.stream(10, SKETCH)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, sketches = [], []
            with np.errstate(over="ignore"):
                for _, found in W.shingle_sets(batch.column(1), width):
                    mins = np.min([
                        (found[i: i + _SLICE, None] * factors + shifts).min(axis=0) for i in range(0, len(found), _SLICE)
                    ], axis=0)
                    sketches.append(W.mix(mins).astype(np.uint8).tobytes())
                    sets.append(found.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sets, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                names=_RESIDUAL.names,
            )

    return build


def _least(hashes: int, percent: int) -> int:
    """A pair at the limit agrees in fewer places with a probability below one in a million."""
    share = percent / 100
    return int(hashes * share - 5 * (hashes * share * (1 - share)) ** 0.5)


def _agreeing(least_head: int, least: int):
    """In two blocks of a bucket: pairs of different components whose sketches agree often enough."""

    def agree(block: pd.DataFrame) -> pd.DataFrame:
        rep, root, part = (block[c].to_numpy() for c in ("rep", "root", "part"))
        sketch = np.frombuffer(b"".join(block["sketch"]), dtype=np.uint8).reshape(len(block), SKETCH)
        first, second = block["first"].iloc[0], block["second"].iloc[0]
        left, right = np.flatnonzero(part == first), np.flatnonzero(part == second)
        head = np.ascontiguousarray(sketch[:, :HEAD])
        out = [np.zeros((0, 2), dtype=np.int64)]
        for i in left:
            others = right[root[right] != root[i]]
            others = others[(head[others] == head[i]).sum(axis=1) >= least_head]
            near = rep[others[(sketch[others] == sketch[i]).sum(axis=1) >= least]]
            out.append(np.stack([np.minimum(rep[i], near), np.maximum(rep[i], near)], axis=1))
        found = np.unique(np.concatenate(out), axis=0)
        return pd.DataFrame({"x": found[:, 0], "y": found[:, 1]})

    return agree


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
    side: int = SIDE, rows: int = ROWS, percent: int = PERCENT,
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept``: one row per row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = scratch.keep(signatures(docs, width=width, side=side, rows=rows), "signed")
    digest = ["set_a", "set_b", "n_shingles"]
    classes = scratch.keep(
        signed.where("doc_id is not null and n_shingles > 0").groupBy(*digest)
        .agg(F.min("doc_id").alias("rep"), F.first("mins").alias("mins")),
        "classes",
    )
    keys = table_keys(classes, side, rows)
    buckets = scratch.keep(
        keys.groupBy("key").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"),
        "buckets",
    )
    members = scratch.keep(keys.join(buckets, "key").where("rep != leader"), "members")
    pairs = scratch.keep(members.select(F.col("leader").alias("x"), F.col("rep").alias("y")).distinct(), "pairs")
    links = verified(docs, pairs, scratch, width, percent)
    roots = components(links, scratch)
    roots = _mixed_rounds(docs, members, pairs, roots, scratch, width, percent)

    named = scratch.keep(
        classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        .select(*digest, F.coalesce("root", "rep").alias("root")),
        "roots",
    )
    component = F.coalesce("root", "doc_id")
    return signed.drop("mins").join(named, digest, "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"),
    )


def _mixed_rounds(docs: DataFrame, members: DataFrame, tested: DataFrame, roots: DataFrame,
                  scratch: Scratch, width: int, percent: int) -> DataFrame:
    """The components after all pairs of ``members`` that share a bucket were tested or ruled out."""
    sets = None
    for turn in range(LEADER_ROUNDS + 1):
        rooted = members.select("key", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
            "key", "rep", F.coalesce("root", "rep").alias("root")
        )
        members = scratch.keep(_mixed(scratch.keep(rooted, "rooted"), scratch), "mixed-members")
        if members.isEmpty():
            return roots
        nodes = scratch.keep(members.select("rep", "root").distinct(), "nodes")
        if sets is None:
            texts = scratch.keep(with_ids(docs, "doc_id", nodes.select("rep")).dropDuplicates(["doc_id"]), "texts")
            sets = scratch.keep(texts.mapInArrow(_setter(width), _RESIDUAL), "sets")
        alive = scratch.keep(_with_shared_shingles(nodes, sets, scratch, percent), "alive")
        members = scratch.keep(_mixed(members.join(alive, "rep", "left_semi"), scratch), "alive-members")
        if members.isEmpty():
            return roots
        sizes = members.groupBy("key").agg(
            F.min("root").alias("low"), F.max("root").alias("top"), F.count(F.lit(1)).alias("n"),
            F.sum(F.shiftright(F.xxhash64("rep"), 16)).alias("same"),
            F.min_by(F.struct("rep", "root"), F.xxhash64("rep", F.lit(turn))).alias("lead"),
        ).dropDuplicates(["n", "same", "low", "top"]).select(
            "key", "n", F.col("lead.rep").alias("lead"), F.col("lead.root").alias("lead_root"))
        buckets = scratch.keep(sizes, "sizes")  # buckets with the same members need one comparison
        if turn < LEADER_ROUNDS:
            # Classes of the leader's own component need no comparison with it.
            led = members.join(buckets, "key").where("root != lead_root")
            new = led.select(F.least("lead", "rep").alias("x"), F.greatest("lead", "rep").alias("y")).distinct()
        else:
            grouped = scratch.keep(_cheapest_groups(members, buckets, scratch), "grouped")
            sizes = grouped.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
            parts = F.ceil(F.col("n") / BLOCK).cast("int")
            cut = grouped.join(scratch.keep(sizes, "sizes"), "key").select(
                "key", "rep", "root", parts.alias("parts"), F.pmod(F.xxhash64("rep"), parts).cast("int").alias("part")
            ).join(sets.select("rep", "sketch"), "rep")
            blocks = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
                "key", F.least("part", "other").alias("first"), F.greatest("part", "other").alias("second"),
                "rep", "root", "sketch", "part",
            )
            new = blocks.groupBy("key", "first", "second").applyInPandas(_agreeing(_least(HEAD, percent), _least(SKETCH, percent)), "x long, y long").distinct()
        new = scratch.keep(new.join(tested, ["x", "y"], "left_anti"), "more")
        if new.isEmpty():
            continue
        links = verified(docs, new, scratch, width, percent)
        tested = scratch.keep(tested.union(new), "tested")
        roots = components(roots.union(links), scratch)
    return roots


def _cheapest_groups(members: DataFrame, buckets: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, rep, root): groups in which every pair that shares a bucket meets.

    The buckets themselves, or the families of classes that buckets connect, whichever
    need fewer comparisons: buckets of one family often hold nearly the same classes.
    """
    led = members.join(buckets, "key")
    families = components(led.select("rep", "lead"), scratch)
    by_family = members.select("rep", "root").distinct().join(
        families.toDF("rep", "family"), "rep", "left"
    ).select(F.coalesce("family", "rep").alias("key"), "rep", "root")
    square = F.sum(F.col("n").cast("double") * F.col("n"))
    of_families = by_family.groupBy("key").agg(F.count(F.lit(1)).alias("n")).agg(square).first()[0]
    of_buckets = buckets.agg(square).first()[0]
    return by_family if of_families <= of_buckets else led.select("key", "rep", "root")


def _mixed(rooted: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of buckets that hold more than one component."""
    keys = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("top")).where("low < top")
    return rooted.join(scratch.keep(keys.select("key"), "mixed"), "key", "left_semi")


def _with_shared_shingles(nodes: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """The classes with enough shingles that some other component has as well.

    Linked sets share ``percent`` of the shingles of either one at least.
    """
    each = nodes.join(sets.select("rep", "shingles"), "rep").select(
        "rep", "root", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle")
    )
    common = scratch.keep(
        each.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("top"))
        .where("low < top").select("shingle"),
        "common",
    )
    counts = each.join(common, "shingle", "left_semi").groupBy("rep", "size").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") * 100 >= F.col("size") * percent).select("rep")
