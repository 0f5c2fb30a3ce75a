"""Quality classifier: votes of the nearest labelled documents in a latent-semantic space.

A bounded, class-balanced sample of labelled training documents (``sample`` rows at most,
those with the smallest hash of their id) is turned into counts of hashed terms: runs of
three character classes, byte pairs, and how much of the text repeats. A truncated
singular value decomposition of the weighted counts gives the space. The projection and
the sample's vectors are broadcast: (terms + sample) * rank numbers of 4 bytes, 4 MB as
set. Every document, whole, is projected, compared with all sample vectors by blocked
matrix products (exact cosines), and its nearest ones vote with their similarity.
Votes are weighted by class so that the score reflects the class shares of all
training labels, not of the balanced sample.

Rows whose crc32 of the id as text leaves 2 when divided by 4 are held out of training.
Rows without a label or with a null one teach nothing. Null and empty texts are empty
texts and get a score like any other. Without training rows every score is 0.5. A row
without id is never held out. Repeated rows get equal scores. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from risingtide.llm import words as W
from risingtide.llm.tables import Scratch, small_batches

SAMPLE = 4_096
TERMS = 4_096
RANK = 128
NEIGHBOURS = 25
THRESHOLD = 0.7
# Documents projected and compared with the sample in one go.
BLOCK = 256
# The column of scores beside those of a caller's table.
SCORE = "__quality_score"

# Character classes: lower, upper, digit, space, line end, beyond ASCII, each other sign.
_CLASS = np.arange(256, dtype=np.int64) % 128
_CLASS[ord("a"): ord("z") + 1], _CLASS[ord("A"): ord("Z") + 1], _CLASS[ord("0"): ord("9") + 1] = 1, 2, 3
_CLASS[128:], _CLASS[[0x09, 0x0B, 0x0C, 0x0D, 0x20]], _CLASS[0x0A] = 4, 5, 6
_SHARES = 8


def _bin(code: np.ndarray, bins: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (W.mix(code.astype(np.uint64) + np.uint64(1)) % np.uint64(bins)).astype(np.int64)


_TRIPLES = _bin(np.arange(1 << 21), TERMS // 2 - 3 * _SHARES)
_PAIRS = _bin(np.arange(1 << 16), TERMS // 2)


def term_counts(texts: pa.Array) -> np.ndarray:
    """One row of TERMS weights per text, square-rooted and of length one, all zero for none."""
    data, offsets = W.buffers(texts)
    found = np.zeros((len(offsets) - 1, TERMS), dtype=np.float32)
    for i, words in W.word_hashes(texts):
        raw = data[offsets[i]: offsets[i + 1]]
        if len(raw) > 2:
            kind = _CLASS[raw]
            found[i, : TERMS // 2] = np.bincount(_TRIPLES[(kind[:-2] << 14) | (kind[1:-1] << 7) | kind[2:]], minlength=TERMS // 2)
        if len(raw) > 1:
            pair = (raw[:-1].astype(np.int64) << 8) | raw[1:]
            found[i, TERMS // 2:] = np.bincount(_PAIRS[pair], minlength=TERMS // 2)
        found[i] = np.sqrt(found[i] / max(len(raw), 1))
        n = len(words)
        if n:
            twice = (words[1:] == words[:-1]).mean() if n > 1 else 0
            runs = W.shingles(words, 3)
            shares = (twice, 1 - len(np.unique(words)) / n, 1 - len(np.unique(runs)) / len(runs))
        else:
            shares = (1, 1, 1)
        # Each share as a soft position between fixed marks.
        for k, share in enumerate(shares):
            place = share * (_SHARES - 1)
            low = min(int(place), _SHARES - 2)
            first = TERMS // 2 - 3 * _SHARES + k * _SHARES
            found[i, first + low] = 1 - (place - low)
            found[i, first + low + 1] = place - low
    return found


def fit_space(counts: np.ndarray, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """The mean, and the projection onto the leading right singular vectors, by subspace iteration.

    ``counts`` is centred in place, so that no second copy is held.
    """
    mean = counts.mean(axis=0)
    counts -= mean
    centred = counts
    width = min(rank, *counts.shape)
    basis = np.random.default_rng(7).standard_normal((counts.shape[1], width)).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(centred.T @ (centred @ basis))
    return mean, basis


def project(counts: np.ndarray, mean: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Latent vectors of length one."""
    found = (counts - mean) @ basis
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)


def votes(vectors: np.ndarray, sample: np.ndarray, labels: np.ndarray, weights: np.ndarray,
          neighbours: int = NEIGHBOURS) -> np.ndarray:
    """The share of label 1 among the nearest, by similarity and class weight."""
    cosine = vectors @ sample.T
    k = min(neighbours, len(sample))
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    # Cosines are sharpened, so that a near copy outweighs the crowd.
    weight = np.exp(16 * (np.take_along_axis(cosine, near, axis=1) - 1)) * weights[near]
    return (weight * labels[near]).sum(axis=1) / weight.sum(axis=1)


def _scorer(model, text_at: int, text_stays: bool):
    """Batches of rows to the same rows, with or without the text, and a score."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said = model.value if model is not None else None
        for batch in batches:
            texts, out = batch.column(text_at), np.full(len(batch), 0.5)
            for first in range(0, len(batch), BLOCK) if said else ():
                part = texts.slice(first, BLOCK)
                out[first: first + len(part)] = votes(project(term_counts(part), *said[:2]), *said[2:])
            kept = [i for i in range(batch.num_columns) if text_stays or i != text_at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array(out)], names=[*(batch.schema.names[i] for i in kept), SCORE])

    return score


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rank: int = RANK):
    """The broadcast model, or None without training rows.

    ``docs`` has ``doc_id`` and ``text``, ``labels`` ``doc_id`` and ``quality``. The
    driver gets ``sample`` rows of TERMS numbers of two bytes, 32 MB as set, and holds them
    as numbers of four.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).distinct()
    totals = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for label in (0, 1):
        # Ids beyond the labelled documents may fill a part of the sample; it stays a bounded sample.
        part = known.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2)
        chosen = part if chosen is None else chosen.union(part)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [row.astype(np.float16).tobytes() for row in term_counts(batch.column(2))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(counts, pa.binary())], names=["doc_id", "quality", "counts"])

    # Every copy of an id and text counts once, so that the driver gets no more rows than the sample has texts.
    texts = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality", F.xxhash64("text").alias("hash")).agg(
        F.min("text").alias("text")).select("doc_id", "quality", "text")
    with small_batches(spark):
        rows = texts.mapInArrow(count, "doc_id long, quality int, counts binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["doc_id"], r["quality"], r["counts"]))
    taught = np.array([r["quality"] for r in rows])
    counts = np.empty((len(rows), TERMS), dtype=np.float32)
    for i, row in enumerate(rows):
        counts[i] = np.frombuffer(row["counts"], dtype=np.float16)
    del rows
    mean, basis = fit_space(counts, rank)
    drawn = np.bincount(taught, minlength=2)
    weight = np.array([totals.get(q, 0) / max(drawn[q], 1) for q in (0, 1)])
    model = (mean, basis, project(counts, np.float32(0), basis), taught.astype(np.float32), weight[taught].astype(np.float32))
    return spark.sparkContext.broadcast(model)


def scored(docs: DataFrame, model) -> DataFrame:
    """``docs``, all columns (``text`` a string), with a column SCORE behind them."""
    schema = T.StructType([*docs.schema.fields, T.StructField(SCORE, T.DoubleType())])
    return docs.mapInArrow(_scorer(model, docs.columns.index("text"), True), schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted``: one row per row of ``docs``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = train(texts, labels)
    narrow = texts.select("doc_id", held_out().alias("held_out"), "text")
    schema = f"doc_id long, held_out boolean, {SCORE} double"
    found = Scratch(docs.sparkSession, "quality-classifier").keep(narrow.mapInArrow(_scorer(model, 2, False), schema), "scores")
    found = found.withColumnRenamed(SCORE, "score")
    return found.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
