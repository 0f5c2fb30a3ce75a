"""Alignment of two tokenizers' tokens, all documents of a block in lockstep.

Tokenizer A is a byte-level BPE and encodes a space and the text; tokenizer B is a
sentencepiece model and encodes the text, before which it puts a space itself. Both cover
the same bytes, so tokens are spans that end at byte offsets. One vector holds a pair of
pointers, to a token of A and to one of B, for every lane of a block. In each step every
lane links the two tokens that it points to (they overlap), moves the pointer whose token
ends first, or both where they end together, which cuts a group; lanes that reach their
end are compacted away. A document is one lane; a long one is several, divided where both
tokenizers end a token, so that one long document does not keep the vector short.

How often two ids are linked in the whole corpus takes one more pass. A block (texts of
about BLOCK_BYTES) numbers its different id pairs and stores its links by these numbers.
The pairs of all blocks, each with its count in the block, are added up by a shuffle and
joined back; each block then gets the totals of its own pairs and sums them up per
document. Neither links nor pairs are ever sent to the driver or broadcast by force, and a
frequent pair is one row per block, not one per link.

Special tokens named in a text are plain text. Null and empty texts, and texts whose
tokens of A or of B do not join to the same bytes, have no tokens: all numbers are zero
and the digest is empty. Repeated rows and repeated or null ids are rows of their own,
and all count for the corpus. A very long text needs memory in proportion to its length.
An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from risingtide.llm import bpe, words as W
from risingtide.llm.sentence_pieces import prefixed
from risingtide.llm.tables import Scratch

# Text of one block.
BLOCK_BYTES = 1 << 20
# Tokens of A in one lane, about, and places looked at to divide a long document.
LANE = 512
PROBES = 64

_sides: dict[tuple[str, str], "Sides"] = {}


class TokenBytes:
    """The bytes of every token of a vocabulary, in one pool."""

    def __init__(self, raw: list[bytes]):
        self.lengths = np.array([len(r) for r in raw], dtype=np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.pool = np.frombuffer(b"".join(raw), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        return self.pool[np.repeat(self.begins[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Sides:
    """Both tokenizers and the bytes of their tokens, one per Python worker."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = bpe._Encoder(path_a)
        self.a.model.encode_special_tokens = True
        alphabet = bpe._byte_alphabet()
        with open(path_a, encoding="utf-8") as file:
            vocab = json.load(file)["model"]["vocab"]
        raw = [b""] * (max(vocab.values()) + 1)
        for token, number in vocab.items():
            # A name that is not written in the byte alphabet is a special token's, which is never used.
            raw[number] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else b""
        self.bytes_a = TokenBytes(raw)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = TokenBytes([
            bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
            else self.b.id_to_piece(i).replace("▁", " ").encode("utf-8")
            for i in range(self.b.get_piece_size())])

    def encode_a(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where those of each text begin."""
        ids, sizes = [np.zeros(0, np.int64)], []
        for _, _, found, at in self.a(texts, 0):
            ids.append(np.delete(found, at[1:] - 1).astype(np.int64))
            sizes.append(np.diff(at) - 1)
        return np.concatenate(ids), np.append(0, np.cumsum(np.concatenate(sizes) if sizes else []).astype(np.int64))

    def encode_b(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.b.encode(texts, num_threads=1)
        at = np.append(0, np.cumsum([len(x) for x in found], dtype=np.int64))
        return np.fromiter(chain.from_iterable(found), dtype=np.int64, count=at[-1]), at


def sides(path_a: str, path_b: str) -> Sides:
    if (path_a, path_b) not in _sides:
        _sides[path_a, path_b] = Sides(path_a, path_b)
    return _sides[path_a, path_b]


def lanes(at_a: np.ndarray, at_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray,
          lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """The first token of A and of B of every lane, closed by the numbers of all tokens.

    ``at_a`` and ``at_b`` say where the tokens of each text begin. All texts lie behind
    each other, so the ends of their tokens grow through the block.
    """
    sizes = np.diff(at_a)
    extra = np.maximum(sizes - 1, 0) // lane
    wanted = np.repeat(at_a[:-1], extra) + lane * (np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1)
    if len(wanted):
        # Of the places from each wanted one on, the first where both end a token, in the same text.
        last = np.repeat(at_a[1:], extra)
        probe = np.minimum(wanted[:, None] + np.arange(PROBES), last[:, None] - 1)
        ends = ends_a[probe - 1]
        after = np.searchsorted(ends_b, ends)
        common = ends_b[np.minimum(after, len(ends_b) - 1)] == ends
        some = common.any(axis=1)
        row, first = np.flatnonzero(some), common.argmax(axis=1)[some]
        more_a, more_b = probe[row, first], after[row, first] + 1
    else:
        more_a = more_b = np.zeros(0, dtype=np.int64)
    first_a = np.unique(np.concatenate([at_a[:-1][sizes > 0], more_a]))
    first_b = np.unique(np.concatenate([at_b[:-1][sizes > 0], more_b]))
    return np.append(first_a, at_a[-1]), np.append(first_b, at_b[-1])


def lockstep(first_a: np.ndarray, first_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The linked tokens of A and of B in order, and whether a group ends with the link."""
    number = len(first_a) - 1
    lane, i, j, stop = np.arange(number), first_a[:-1], first_b[:-1], first_a[1:]
    steps, taken = [], np.zeros(number, dtype=np.int64)
    while len(lane):
        end_a, end_b = ends_a[i], ends_b[j]
        steps.append((lane, i, j, end_a == end_b))
        i, j = i + (end_a <= end_b), j + (end_b <= end_a)
        alive = i < stop
        if not alive.all():
            taken[lane[~alive]] = len(steps)
            lane, i, j, stop = lane[alive], i[alive], j[alive], stop[alive]
    # A lane makes one link a step: its links lie in order from its base on.
    base = np.cumsum(taken) - taken
    link_a, link_b = np.zeros(taken.sum(), dtype=np.int64), np.zeros(taken.sum(), dtype=np.int64)
    cut = np.zeros(taken.sum(), dtype=bool)
    for step, (lane, i, j, ends) in enumerate(steps):
        place = base[lane] + step
        link_a[place], link_b[place], cut[place] = i, j, ends
    return link_a, link_b, cut


class Aligned:
    """The tokens, links and cuts of a block of texts.

    ``ids_a`` and ``ids_b`` hold the tokens of all texts; ``at_a``, ``at_b`` and
    ``at_links`` say where those of each text begin.
    """

    def __init__(self, own: Sides, data: np.ndarray, offsets: np.ndarray, lane: int = LANE):
        n = len(offsets) - 1
        texts = pa.Array.from_buffers(pa.large_string(), n, [
            None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        found_a, found_b = own.encode_a(texts), own.encode_b([t[1:] for t in texts.to_pylist()])
        same = np.diff(offsets) > 0
        for (ids, at), table in ((found_a, own.bytes_a), (found_b, own.bytes_b)):
            joined = table.joined(ids)
            ends = np.append(0, np.cumsum(table.lengths[ids]))[at]
            for k in range(n):
                same[k] = same[k] and np.array_equal(joined[ends[k]: ends[k + 1]], data[offsets[k]: offsets[k + 1]])
        (self.ids_a, self.at_a), (self.ids_b, self.at_b) = (
            (ids[np.repeat(same, np.diff(at))], np.append(0, np.cumsum(np.diff(at) * same))) for ids, at in (found_a, found_b))
        ends_a, ends_b = np.cumsum(own.bytes_a.lengths[self.ids_a]), np.cumsum(own.bytes_b.lengths[self.ids_b])
        first = lanes(self.at_a, self.at_b, ends_a, ends_b, lane)
        self.link_a, self.link_b, self.cut = lockstep(*first, ends_a, ends_b)
        self.at_links = np.searchsorted(self.link_a, self.at_a)

    def groups(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Behind the last token of A and of B of each group, and where the groups of each text begin."""
        last = np.flatnonzero(self.cut)
        return self.link_a[last] + 1, self.link_b[last] + 1, np.searchsorted(last, self.at_links)

    def group_texts(self) -> Iterator[bytes]:
        """Per text, its groups as ``a1,a2|b1;a3|b2,b3``."""
        stop_a, stop_b, _ = self.groups()
        before_a, before_b = np.append(0, stop_a), np.append(0, stop_b)
        n = len(self.ids_a) + len(self.ids_b)
        ids, sign = np.zeros(n, dtype=np.int64), np.full(n, ord(","), dtype=np.uint8)
        # A token of A comes behind the tokens of B of all groups before its own, one of B behind those of A of its own, too.
        place_a = np.arange(len(self.ids_a)) + np.repeat(before_b[:-1], np.diff(before_a))
        place_b = np.arange(len(self.ids_b)) + np.repeat(stop_a, np.diff(before_b))
        ids[place_a], ids[place_b] = self.ids_a, self.ids_b
        sign[place_a[stop_a - 1]], sign[place_b[stop_b - 1]] = ord("|"), ord(";")
        size = np.full(n, 2, dtype=np.int64)  # a digit and the sign behind it
        for k in range(1, len(str(ids.max(initial=0)))):
            size += ids >= 10 ** k
        ends = np.cumsum(size)
        out = np.zeros(ends[-1] if n else 0, dtype=np.uint8)
        out[ends - 1] = sign
        rest, at = ids, ends - 2
        while len(at):
            out[at] = ord("0") + rest % 10
            rest, at = rest // 10, at - 1
            more = rest > 0
            rest, at = rest[more], at[more]
        bounds = np.append(0, ends)[self.at_a + self.at_b]
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield out[a: max(a, b - 1)].tobytes()


def blocks_of(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last text of each block, and their bytes with a space before each."""
    data, offsets = prefixed(column)
    for first, last in W.chunks(offsets, size):
        yield first, last, data[offsets[first]: offsets[last]], offsets[first: last + 1] - offsets[first]


_BLOCK = ("block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
          "groups_sha256 array<string>, codes binary, pairs array<struct<code:int,pair:long,n:long>>")
_BLOCK_NAMES = [part.split(" ")[0] for part in _BLOCK.split(", ")]


def _one(values: pa.Array) -> pa.Array:
    """All values as the only row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _block_rows(path_a: str, path_b: str, size: int, lane: int):
    """Batches of (id, text) to one row per block: numbers per document, links by pair number, and the pairs."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, numbers = sides(path_a, path_b), count(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for first, last, data, offsets in blocks_of(batch.column(1), size):
                found = Aligned(own, data, offsets, lane)
                pair = (found.ids_a[found.link_a] << 32) | found.ids_b[found.link_b]
                pairs, codes, n = np.unique(pair, return_inverse=True, return_counts=True)
                named = pa.StructArray.from_arrays(
                    [pa.array(np.arange(len(pairs), dtype=np.int32)), pa.array(pairs), pa.array(n)], names=["code", "pair", "n"])
                groups = [hashlib.sha256(t).hexdigest() if t else "" for t in found.group_texts()]
                numbers_of = (np.diff(at).astype(np.int64) for at in (found.at_a, found.at_b, found.groups()[2], found.at_links))
                yield pa.RecordBatch.from_arrays([
                    pa.array([next(numbers)], pa.int64()), _one(batch.column(0).slice(first, last - first)),
                    *(_one(pa.array(x)) for x in numbers_of), _one(pa.array(groups, pa.string())),
                    pa.array([codes.astype("<u2" if len(pairs) <= 1 << 16 else "<u4").tobytes()], pa.binary()), _one(named)], names=_BLOCK_NAMES)

    return align


def pair_counts(blocks: DataFrame, scratch: Scratch) -> DataFrame:
    """``pair``, ``total``, ``best``: how many links hold each id pair, and whether no pair of its B id has more.

    A pair is the id of A times 2 ** 32 plus that of B.
    """
    each = blocks.select(F.explode("pairs").alias("p")).select("p.pair", "p.n")
    totals = scratch.keep(each.groupBy("pair").agg(F.sum("n").alias("total")), "totals")
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b_id")
    most = totals.groupBy(b_id).agg(F.max("total").alias("most"))
    return totals.select("pair", "total", b_id).join(most, "b_id").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


_DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_DIGEST_NAMES = [part.split(" ")[0] for part in _DIGEST.split(", ")]


def _finished(blocks: pa.Table, known: pa.Table) -> pa.Table:
    """The rows of a block's documents, given the totals of its pairs."""
    code = known.column("code").to_numpy()
    total, best = np.zeros(len(code), dtype=np.int64), np.zeros(len(code), dtype=np.int64)
    total[code], best[code] = known.column("total").to_numpy(), known.column("best").to_numpy().astype(np.int64)
    row = {name: blocks.column(name).combine_chunks() for name in blocks.column_names}
    each = {name: row[name].flatten() for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
    codes = np.frombuffer(row["codes"][0].as_py(), dtype="<u2" if len(code) <= 1 << 16 else "<u4")
    at = np.append(0, np.cumsum(each["n_links"].to_numpy()))
    for name, values in (("n_best", best), ("count_sum", total)):
        each[name] = pa.array(np.diff(np.append(0, np.cumsum(values[codes]))[at]))
    return pa.table([each[name] for name in _DIGEST_NAMES], names=_DIGEST_NAMES)


def digests(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
            block_bytes: int = BLOCK_BYTES, lane: int = LANE) -> DataFrame:
    """``doc_id``, numbers of tokens, groups and links, ``n_best``, ``count_sum``, ``groups_sha256``: one row per row of ``docs``.

    ``n_best`` counts the links whose pair is the most frequent one of its B id in the
    whole corpus, ties included; ``count_sum`` adds up the corpus-wide counts of all links.
    """
    scratch = Scratch(docs.sparkSession, "alignment")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = scratch.keep(texts.mapInArrow(_block_rows(path_a, path_b, block_bytes, lane), _BLOCK), "blocks")
    known = pair_counts(blocks, scratch)
    used = blocks.select(F.col("block").alias("owner"), F.explode("pairs").alias("p")).select("owner", "p.code", "p.pair")
    told = used.join(known, "pair").select("owner", "code", "total", "best")
    return scratch.keep(
        blocks.drop("pairs").groupBy("block").cogroup(told.groupBy("owner")).applyInArrow(_finished, _DIGEST), "digests")


_ALIGNED = ("doc_id long, a_ids array<long>, b_ids array<long>, link_a array<long>, link_b array<long>, "
            "group_a array<long>, group_b array<long>")
_ALIGNED_NAMES = [part.split(" ")[0] for part in _ALIGNED.split(", ")]


def alignments(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
               block_bytes: int = BLOCK_BYTES, lane: int = LANE) -> DataFrame:
    """The tokens and links themselves, one row per row of ``docs``.

    ``link_a`` and ``link_b`` are the positions of linked tokens, ``group_a`` and
    ``group_b`` the positions behind the last token of every group.
    """

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sides(path_a, path_b)
        for batch in batches:
            for first, last, data, offsets in blocks_of(batch.column(1), block_bytes):
                found = Aligned(own, data, offsets, lane)
                stop_a, stop_b, at = found.groups()
                columns = [(found.ids_a, found.at_a, None), (found.ids_b, found.at_b, None),
                           (found.link_a, found.at_links, found.at_a), (found.link_b, found.at_links, found.at_b),
                           (stop_a, at, found.at_a), (stop_b, at, found.at_b)]
                lists = [
                    pa.ListArray.from_arrays(pa.array(where.astype(np.int32)), pa.array(
                        values if base is None else values - np.repeat(base[:-1], np.diff(where))))
                    for values, where, base in columns]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *lists], names=_ALIGNED_NAMES)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return Scratch(docs.sparkSession, "alignment").keep(texts.mapInArrow(align, _ALIGNED), "aligned")
