"""Packing token pieces into sequences of fixed length, certified by lower bounds.

Documents are tokenised and only those longer than a sequence are cut, so that all
pieces but the first are full. Full pieces are sequences of their own. The others are
dealt over partitions by a hash of their row; each partition packs its pieces by
best-fit decreasing and certifies the number of bins with the largest bound that dual
feasible functions give. Partitions that meet their bound are done. The others keep
their full bins and exchange the pieces of all bins with room, which are dealt anew
over fewer partitions and packed again, until the bound is met, one partition is left,
or the rounds are over.

A null text is empty and has one piece, the end token. Repeated rows and repeated or
null ids are packed like any other row. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from risingtide.llm.tables import Scratch

LENGTH = 1024
# Pieces that one task packs together.
ITEMS = 1 << 16
ROUNDS = 6

_PACKED = "row long, length int, sequence_id long, offset long"


def lower_bound(counts: np.ndarray, size: int) -> int:
    """Bins that ``counts[w]`` items of each weight ``w`` need at least.

    The largest of: the volume; for every k, the function that raises weights above
    size - k to size and drops those below k; and the staircase functions of Fekete
    and Schepers for small k, alone and after that.
    """
    weights = np.arange(len(counts), dtype=np.int64)
    best = -(-int((counts * weights).sum()) // size)
    # Items above size - k, times size; volume of the items between k and size - k.
    above, volume = counts[::-1].cumsum()[::-1], (counts * weights).cumsum()
    for k in range(1, size // 2 + 1):
        total = int(above[size - k + 1] if size - k + 1 < len(counts) else 0) * size
        best = max(best, -(-(total + int(volume[size - k] - volume[k - 1])) // size))
    for k in range(1, 33):
        scaled = weights * (k + 1)
        stairs = np.where(scaled % size == 0, weights * k * (k + 1), scaled // size * size * (k + 1))
        best = max(best, -(-int((counts * stairs).sum()) // (size * k * (k + 1))))
    return best


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every item, and the room left in each bin."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms, open_rooms = [], 0  # the bits of open_rooms say which rooms some bin has
    for at, length in zip(order.tolist(), lengths[order].tolist()):
        fitting = open_rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            bin_ = by_room[room].pop()
            if not by_room[room]:
                open_rooms ^= 1 << room
        else:
            room, bin_ = size, len(rooms)
            rooms.append(size)
        bins[at], offsets[at] = bin_, size - room
        rooms[bin_] = room - length
        by_room[room - length].append(bin_)
        open_rooms |= 1 << (room - length)
    return bins, offsets, np.array(rooms, dtype=np.int64)


def _packer(size: int, turn: int, last: bool):
    """One partition of (row, length, part) to places; pieces to be exchanged have none."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches), schema=pa.schema(
            [("row", pa.int64()), ("length", pa.int32()), ("part", pa.int32())]))
        row, lengths, parts = (held.column(i).to_numpy() for i in range(3))
        for part in np.unique(parts):
            own = np.flatnonzero(parts == part)
            own = own[np.argsort(row[own])]
            bins, offsets, rooms = best_fit_decreasing(lengths[own], size)
            bound = lower_bound(np.bincount(lengths[own], minlength=size + 1), size)
            staying = np.ones(len(own), dtype=bool) if last or len(rooms) <= bound else (rooms == 0)[bins]
            yield pa.RecordBatch.from_arrays([
                pa.array(row[own]), pa.array(lengths[own]),
                pa.array((np.int64(turn) << 56) + (np.int64(part) << 32) + bins, mask=~staying),
                pa.array(offsets, mask=~staying),
            ], names=["row", "length", "sequence_id", "offset"])

    return pack


def best_fit_pack(pieces: DataFrame, scratch: Scratch, size: int = LENGTH, items: int = ITEMS,
                  rounds: int = ROUNDS) -> DataFrame:
    """``pieces``, a stored table with ``row`` (unique) and ``length``, with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    left = pieces.where(F.col("length") < size).select("row", F.col("length").cast("int").alias("length"))
    done = [pieces.where(F.col("length") == size).select(
        "row", (F.lit(1 << 62) + F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    count = left.count()
    for turn in range(rounds):
        if not count:
            break
        parts = -(-count // items)
        last = parts == 1 or turn == rounds - 1
        dealt = left.withColumn("part", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(parts)).cast("int"))
        packed = scratch.keep(
            dealt.repartition(parts, "part").mapInArrow(_packer(size, turn, last), _PACKED), f"packed-{turn}"
        )
        done.append(packed.where("sequence_id is not null").select("row", "sequence_id", "offset"))
        left = packed.where("sequence_id is null").select("row", "length")
        count = 0 if last else left.count()
    placed = done[0]
    for more in done[1:]:
        placed = placed.union(more)
    return pieces.join(placed, "row")


_PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids", T.BinaryType()),
])


def _cutter(path: str, size: int, end: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from risingtide.llm.bpe import encoder

        encode = encoder(path)
        for batch in batches:
            for first, last, ids, offsets in encode(batch.column(1), end):
                counts = np.diff(offsets)
                pieces = -(-counts // size)
                doc = np.repeat(np.arange(last - first), pieces)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                begins = np.where(number == 0, 0, counts[doc] - (pieces[doc] - number) * size)
                ends = counts[doc] - (pieces[doc] - 1 - number) * size
                at = np.append(offsets[doc] + begins, offsets[-1]).astype(np.int64) * 4
                binary = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(doc), [None, pa.py_buffer(at), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, last - first).take(pa.array(doc)), pa.array(number.astype(np.int32)),
                    pa.array(begins), pa.array(ends - begins), binary.cast(pa.binary()),
                ], names=_PIECES.names)

    return cut


def token_pieces(docs: DataFrame, path: str, size: int = LENGTH, end: int = 2, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids`` (little-endian 32-bit): one row per piece.

    ``path`` is a byte-level BPE file of the tokenizers library that every executor can read.
    """
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        _cutter(path, size, end), _PIECES)


def pack_documents(docs: DataFrame, path: str, size: int = LENGTH, end: int = 2, items: int = ITEMS) -> DataFrame:
    """The digest of every piece and its place: ``ids_crc32`` stands for the ids."""
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.keep(
        token_pieces(docs, path, size, end).select(
            "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"),
            F.monotonically_increasing_id().alias("row")),
        "pieces", batch_rows=4_000,
    )
    return best_fit_pack(pieces, scratch, size, items).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
