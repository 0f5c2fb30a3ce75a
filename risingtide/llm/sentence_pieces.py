"""SentencePiece encoding by a max-plus scan, and decoding.

For a model of the BPE kind the ids are those of the sentencepiece library: of all
neighbours that make a piece the best-ranked are merged first, the leftmost on a tie.
Merges never cross a natural cut (see below), so texts are solved by their segments,
and giant ones in chunks that end at such cuts; a segment without a cut stays whole.
The library reads a literal U+2581 as a space; here it becomes byte pieces.

For other models they are the best-scoring segmentation into pieces, the scores added
up (for a unigram model: what the library gives). On a tie the longer last piece wins.
In both a space is the piece sign, one is put before the text, and characters that no
piece covers become their byte pieces, so any text decodes to itself.

The best score from one place of a text to another is a max-plus product of steps. A
giant text is cut into chunks of ``chunk`` bytes. A state at a boundary is the number of
bytes by which the last piece hangs over it; each chunk yields the transfer matrix from
states at its begin to states at its end. Matrices are combined per text, in groups of
FANIN and in rounds, which is possible because the product is associative; that fixes
the states at all boundaries, and every chunk is traced back on its own.

No piece crosses from a character to a space behind it, or touches a line feed or tab
where the vocabulary has none with it. At such natural cuts the only state is zero: a
chunk's matrix is the sum of its first segment, its inner ones and its last one, and
each distinct segment of a batch is solved once. Segments without a cut, however long,
are solved by the same steps.

Null texts count as empty; an empty text has no ids. Repeated rows and repeated or null
ids keep their own row. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from risingtide.llm import words as W
from risingtide.llm.tables import Scratch

CHUNK = 1 << 14
# Matrices of one text that one task combines.
FANIN = 256
# Chunks handed to Python in one go.
CHUNKS_TOGETHER = 256
# Segments up to so many bytes are solved together, all of a length at once.
SHORT = 48
_NONE = -np.inf

_models: dict[str, "Model"] = {}
_encoders: dict[str, "Model"] = {}


class Model:
    """The pieces of a model file, with spaces for the piece sign."""

    def __init__(self, path: str):
        import sentencepiece

        file = sentencepiece.SentencePieceProcessor(model_file=path)
        numbers = range(file.get_piece_size())
        self.byte_ids = np.array([file.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        kept = [i for i in numbers if not (file.is_byte(i) or file.is_control(i) or file.is_unknown(i) or file.is_unused(i))]
        self.raw: dict[int, bytes] = {int(i): bytes([b]) for b, i in enumerate(self.byte_ids)}
        self.pieces: dict[bytes, tuple[int, float]] = {}
        for i in kept:
            self.raw[i] = file.id_to_piece(i).replace("▁", " ").encode("utf-8")
            self.pieces[self.raw[i]] = (i, file.get_score(i))
        self.raw_sizes = np.array([len(self.raw.get(i, b"")) for i in numbers], dtype=np.int64)
        self.raw_ends = np.cumsum(self.raw_sizes)
        self.raw_bytes = np.frombuffer(b"".join(self.raw.get(i, b"") for i in numbers), np.uint8)
        self.longest = max(map(len, self.pieces))
        self.score_of = dict(self.pieces.values())
        # The byte piece that opens an unknown character carries its cost.
        self.first_bytes = {int(self.byte_ids[b]) for b in range(256) if not 0x80 <= b < 0xC0}
        # Unknown characters cost more than any piece in use.
        self.unknown = min(s for _, s in self.pieces.values() if s > -1e8) - 10
        if any(b" " in p.lstrip(b" ") for p in self.pieces):
            raise ValueError("a piece crosses words")
        self.cuts = bytes(b for b in b"\n\t" if not any(b in p for p in self.pieces))
        joined = b"".join(self.pieces)
        stops = np.cumsum([len(p) for p in self.pieces])
        hashes = W.span_hashes(np.frombuffer(joined, np.uint8), np.append(0, stops[:-1]), stops)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.ids = np.array([i for i, _ in self.pieces.values()])[order]
        self.scores = np.array([s for _, s in self.pieces.values()])[order]
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[self.hashes >> np.uint64(42)] = True
        self.space = np.zeros(256, dtype=bool)
        self.space[list(b" " + self.cuts)] = True

    def steps(self, data: bytes, at: int) -> list[tuple[int, int, float]]:
        """(end, id, score) of every piece that begins at ``at``, the longest first."""
        lead = data[at]
        size = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        found = []
        for end in range(min(len(data), at + self.longest), at, -1):
            piece = self.pieces.get(data[at:end])
            if piece:
                found.append((end, *piece))
        if not found or found[-1][0] > at + size:
            # Bytes of an unknown character follow each other; the first one carries the cost.
            inside = 0x80 <= lead < 0xC0
            if inside or data[at: at + size] not in self.pieces:
                found.append((at + 1, int(self.byte_ids[lead]), 0.0 if inside else self.unknown))
        return found

    def forward(self, data: bytes, start: dict[int, np.ndarray], stop: int) -> dict[int, np.ndarray]:
        """Best scores at every place reached by pieces that begin before ``stop``, from vectors of scores."""
        reached = dict(start)
        for at in range(min(reached, default=stop), stop):
            here = reached.get(at)
            if here is not None:
                for end, _, score in self.steps(data, at):
                    reached[end] = np.maximum(reached[end], here + score) if end in reached else here + score
        return reached

    def trace(self, data: bytes, first: int, stop: int, end: int) -> tuple[list[int], float]:
        """The best ids from ``first`` to ``end`` whose pieces begin before ``stop``."""
        best, back = {first: 0.0}, {}
        for at in range(first, stop):
            if at in best:
                for to, number, score in self.steps(data, at):
                    if to not in best or best[at] + score > best[to]:
                        best[to], back[to] = best[at] + score, (at, number)
        ids, at = [], end
        while at > first:
            at, number = back[at]
            ids.append(number)
        return ids[::-1], best[end]

    def segments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the runs between natural cuts: a word with all spaces before it, or other white space."""
        n = len(data)
        starts = np.zeros(n + 1, dtype=bool)
        starts[offsets[:-1]] = True
        space = data == 0x20
        starts[1:n] |= space[1:] & ~space[:-1]
        for byte in self.cuts:
            is_cut = data == byte
            starts[:n] |= is_cut
            starts[1: n + 1] |= is_cut
        at = np.flatnonzero(starts[:n])
        return at, np.append(at[1:], n)

    def solve(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of some distinct segments in order, how many each has, and its score."""
        ids: list = [None] * len(starts)
        scores = np.zeros(len(starts))
        sizes = stops - starts
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            if size > SHORT:
                for i in own:
                    raw = data[starts[i]: stops[i]].tobytes()
                    found, scores[i] = self.trace(raw, 0, len(raw), len(raw))
                    ids[i] = np.array(found, dtype=np.int32)
            else:
                tokens, counts, scores[own] = self._solve_equal(data[starts[own][:, None] + np.arange(size)])
                for i, row, n in zip(own.tolist(), tokens, counts.tolist()):
                    ids[i] = row[size - n:]
        counts = np.array([len(x) for x in ids], dtype=np.int64)
        return np.concatenate([np.zeros(0, np.int32), *ids]), counts, scores

    def _solve_equal(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segments of one length, a row each: ids (at the end of the row), their number, scores."""
        rows, n = text.shape
        with np.errstate(over="ignore"):
            up, down = W.power_up(n), W.power_down(n + 1)
            sums = np.zeros((rows, n + 1), dtype=np.uint64)
            np.cumsum(W.byte_values(text) * up, axis=1, out=sums[:, 1:])
        lead = (text & 0xC0) != 0x80
        size = np.where(text < 0xC0, 1, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, 4)))
        known = np.zeros((rows, n), dtype=bool)  # the character here is a piece
        best = np.full((rows, n + 1), _NONE)
        best[:, 0] = 0
        back, token = np.zeros((rows, n + 1), dtype=np.int16), np.zeros((rows, n + 1), dtype=np.int32)
        edges: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for i in range(n):
            for j in range(i + 1, min(n, i + self.longest) + 1):
                with np.errstate(over="ignore"):
                    h = W.mix((sums[:, j] - sums[:, i]) * down[i] + np.uint64(j - i) * W.LENGTH_STEP)
                row = np.flatnonzero(self.maybe[h >> np.uint64(42)])
                if len(row):
                    at = np.minimum(np.searchsorted(self.hashes, h[row]), len(self.hashes) - 1)
                    same = self.hashes[at] == h[row]
                    row, at = row[same], at[same]
                    if len(row):
                        edges[i, j] = (row, at)
                        known[row, i] |= size[row, i] == j - i
        unknown = lead & ~known
        for k in range(1, 4):  # the bytes that follow in an unknown character
            if n > k:
                unknown[:, k:] |= ~lead[:, k:] & unknown[:, :-k] & (size[:, :-k] > k) & lead[:, :-k]
        for j in range(1, n + 1):
            for i in range(max(0, j - self.longest), j):
                if (i, j) in edges:
                    row, at = edges[i, j]
                    score = best[row, i] + self.scores[at]
                    better = score > best[row, j]
                    row, at = row[better], at[better]
                    best[row, j], back[row, j], token[row, j] = score[better], i, self.ids[at]
            row = np.flatnonzero(unknown[:, j - 1])
            if len(row):
                score = best[row, j - 1] + np.where(lead[row, j - 1], self.unknown, 0.0)
                better = score > best[row, j]
                row = row[better]
                best[row, j], back[row, j], token[row, j] = score[better], j - 1, self.byte_ids[text[row, j - 1]]
        out, counts, at = np.zeros((rows, n), dtype=np.int32), np.zeros(rows, dtype=np.int64), np.full(rows, n)
        while True:
            row = np.flatnonzero(at > 0)
            if not len(row):
                return out, counts, best[:, n]
            counts[row] += 1
            out[row, n - counts[row]] = token[row, at[row]]
            at[row] = back[row, at[row]]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
        """Ids and score of each text in a buffer; each text is solved by its segments."""
        starts, stops = self.segments(data, offsets)
        before = np.searchsorted(starts, offsets)
        # Hashed in chunks, which bounds the memory of the 64-bit sums.
        hashes = np.concatenate([np.zeros(0, np.uint64), *(
            W.span_hashes(data[offsets[a]: offsets[b]], starts[before[a]: before[b]] - offsets[a], stops[before[a]: before[b]] - offsets[a])
            for a, b in W.chunks(offsets))])
        _, one, back = np.unique(hashes, return_index=True, return_inverse=True)
        pool, sizes, scores = self.solve(data, starts[one], stops[one])
        begins = np.cumsum(sizes) - sizes
        total = np.append(0, np.cumsum(sizes[back]))
        flat = W.gathered(pool, begins[back], begins[back] + sizes[back])
        added = np.append(0.0, np.cumsum(scores[back]))
        for a, b in zip(before[:-1], before[1:]):
            yield flat[total[a]: total[b]], added[b] - added[a]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a run of ids, with the space that was put before the text."""
        return W.gathered(self.raw_bytes, self.raw_ends[ids] - self.raw_sizes[ids], self.raw_ends[ids]).tobytes()

    def natural_cuts(self, data: bytes) -> np.ndarray:
        """Places inside a text where no piece crosses."""
        view = np.frombuffer(data, np.uint8)
        starts, _ = self.segments(view, np.array([0, len(view)]))
        return starts[1:]

    def inner_parts(self, chunks: list[tuple[bytes, int]]) -> list[tuple[int, int, np.ndarray, float] | None]:
        """For chunks of (data, own bytes): first and last natural cut, and ids and score between them.

        None where a chunk has no cut. The inner parts of all chunks are solved together.
        """
        spans, inner = [], []
        for data, own in chunks:
            cuts = self.natural_cuts(data)
            cuts = cuts[cuts <= own]
            spans.append((int(cuts[0]), int(cuts[-1])) if len(cuts) else None)
            inner.append(data[cuts[0]: cuts[-1]] if len(cuts) else b"")
        offsets = np.append(0, np.cumsum([len(x) for x in inner]))
        solved = self.encode(np.frombuffer(b"".join(inner), np.uint8), offsets)
        return [span and (*span, ids, float(score)) for span, (ids, score) in zip(spans, solved)]

    def transfer(self, data: bytes, own: int, part: tuple | None = None) -> np.ndarray:
        """The matrix of a chunk of ``own`` bytes; ``data`` goes on for a piece's length where the text does.

        ``part`` is the chunk's entry of ``inner_parts``.
        """
        width = self.longest
        part = part or self.inner_parts([(data, own)])[0]
        first = part[0] if part else own
        entries = {}
        for a in range(min(width, first + 1, len(data) + 1)):
            entries.setdefault(a, np.full(width, _NONE))[a] = 0.0
        reached = self.forward(data, entries, first)
        found = np.full((width, width), _NONE)
        if part:
            reached = self.forward(data, {part[1]: reached[first] + part[3]}, own) if first in reached else {}
        for b in range(width):
            if own + b in reached:
                found[:, b] = reached[own + b]
        return found

    def trace_chunk(self, data: bytes, own: int, entry: int, exit_: int, part: tuple | None) -> np.ndarray:
        """The ids of a chunk, given the states at its begin and end."""
        if not part:
            return np.array(self.trace(data, entry, own, own + exit_)[0], dtype=np.int32)
        first, last, inner, _ = part
        head, tail = self.trace(data, entry, first, first)[0], self.trace(data, last, own, own + exit_)[0]
        return np.concatenate([np.array(head, dtype=np.int32), inner, np.array(tail, dtype=np.int32)])


class MergeModel(Model):
    """A model of the BPE kind: neighbours are merged in the order of their ranks.

    Segments are rows of symbols: the place of a piece, or ``n`` and the code point of a
    character that is no piece. Rows of equal width are merged together, a pair each, from
    the widest on, so a row that has shrunk goes on with those of its new width.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.ranks = {p.decode("utf-8"): -score for p, (_, score) in self.pieces.items()}
        self.n = len(self.ranks)
        self.place = {p: i for i, p in enumerate(self.ranks)}
        self.number = np.array([i for i, _ in self.pieces.values()], dtype=np.int32)
        self.value = np.array([score for _, score in self.pieces.values()])
        self.of_point = np.arange(self.n, self.n + 0x110000, dtype=np.int32)
        for piece, i in self.place.items():
            if len(piece) == 1:
                self.of_point[ord(piece)] = i
        # The last entry is the rank of a pair that makes no piece.
        self.rank_of = np.append(np.unique(list(self.ranks.values()), return_inverse=True)[1], self.n).astype(np.int32)
        made = {}
        for piece, i in self.place.items():
            for cut in range(1, len(piece)):
                left, right = self.symbol(piece[:cut]), self.symbol(piece[cut:])
                if left is not None and right is not None:
                    made[self._key(left, right)] = i
        self.keys = np.array(sorted(made), dtype=np.int64)
        self.made_by = np.array([made[k] for k in self.keys.tolist()], dtype=np.int32)
        self.likely = np.zeros(1 << 22, dtype=bool)
        self.likely[self._slot(self.keys)] = True

    def symbol(self, part: str) -> int | None:
        return self.place.get(part, self.n + ord(part) if len(part) == 1 else None)

    def _key(self, left, right):
        return left * (self.n + 0x110000) + right

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * W.LENGTH_STEP) >> np.uint64(42)

    def made(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, -1 for none."""
        keys = self._key(left.astype(np.int64), right)
        found = np.full(keys.shape, -1, dtype=np.int32)
        at = np.nonzero(self.likely[self._slot(keys)])
        near = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
        found[at] = np.where(self.keys[near] == keys[at], self.made_by[near], -1) if len(self.keys) else -1
        return found

    def solve(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes, own = stops - starts, W.gathered(data, starts, stops)
        raw, first = own.tobytes(), np.cumsum(sizes) - sizes
        try:
            text, widths = raw.decode("utf-8"), np.add.reduceat((own & 0xC0) != 0x80, first, dtype=np.int64) if len(own) else sizes
        except UnicodeDecodeError:
            parts = [raw[a: a + n].decode("utf-8", "surrogateescape") for a, n in zip(first.tolist(), sizes.tolist())]
            text, widths = "".join(parts), np.array([len(p) for p in parts], dtype=np.int64)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        return self._numbered(*self._merged(text, self.of_point[points], widths))

    def _merged(self, text: str, symbols: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that are left of all segments in order, and how many each has."""
        first, left = np.cumsum(widths) - widths, widths.copy()
        for i in np.flatnonzero(widths > SHORT).tolist():
            parts = self._merge_many(list(text[first[i]: first[i] + widths[i]]))
            symbols[first[i]: first[i] + len(parts)] = [self.symbol(p) for p in parts]
            left[i] = len(parts)
        rows, sym, made = np.zeros(0, np.int64), np.zeros((0, 0), np.int32), np.zeros((0, 0), np.int32)
        short = np.flatnonzero(widths <= SHORT)
        short = short[np.argsort(-widths[short], kind="stable")]
        widest = int(widths[short[0]]) if len(short) else 0
        begins = np.searchsorted(-widths[short], -np.arange(widest + 1))
        for width in range(widest, 1, -1):
            new = short[begins[width]: begins[width - 1]]
            fresh = symbols[first[new][:, None] + np.arange(width)]
            pairs = self.made(fresh[:, :-1], fresh[:, 1:])
            rows, sym, made = (np.concatenate(x) if len(rows) else x[1] for x in ((rows, new), (sym, fresh), (made, pairs)))
            ranks = self.rank_of[made]
            at = ranks.argmin(axis=1)
            more = ranks[np.arange(len(rows)), at] < self.n
            done = rows[~more]
            symbols[first[done][:, None] + np.arange(width)] = sym[~more]
            left[done] = width
            rows, sym, made, at = rows[more], sym[more], made[more], at[more]
            row = np.arange(len(rows))
            piece, column = made[row, at], np.arange(width - 1)
            sym = np.where(column > at[:, None], sym[:, 1:], sym[:, :-1])
            sym[row, at] = piece
            made = np.where(column[:-1] >= at[:, None], made[:, 1:], made[:, :-1])
            row = np.flatnonzero(at > 0)
            made[row, at[row] - 1] = self.made(sym[row, at[row] - 1], piece[row])
            row = np.flatnonzero(at < width - 2)
            made[row, at[row]] = self.made(piece[row], sym[row, at[row] + 1])
        symbols[first[rows]] = sym[:, 0] if len(rows) else 0
        left[rows] = 1
        return W.gathered(symbols, first, first + left), left

    def _numbered(self, symbols: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, their number and the score of each segment; a character that is no piece becomes its bytes."""
        known, segment = symbols < self.n, np.repeat(np.arange(len(widths)), widths)
        points = (symbols[~known] - self.n).astype("<u4")
        raw = points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogateescape")
        # A byte that is not UTF-8 stands as a surrogate.
        sizes = np.ones(len(symbols), dtype=np.int64)
        sizes[~known] += (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        sizes[np.flatnonzero(~known)[(points >= 0xD800) & (points < 0xE000)]] = 1
        ids, whole = np.empty(int(sizes.sum()), dtype=np.int32), np.repeat(known, sizes)
        ids[whole], ids[~whole] = self.number[symbols[known]], self.byte_ids[np.frombuffer(raw, np.uint8)]
        values = np.full(len(symbols), float(self.unknown))
        values[known] = self.value[symbols[known]]
        n = len(widths)
        return ids, np.bincount(segment, sizes, n).astype(np.int64), np.bincount(segment, values, n)

    def _merge_many(self, parts: list[str]) -> list[str]:
        """The same by a heap of pairs; a pair one of whose sides has changed is passed over."""
        n = len(parts)
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right < n:
                both = parts[left] + parts[right]
                if both in self.ranks:
                    heapq.heappush(heap, (self.ranks[both], left, right, len(both)))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, left, right, size = heapq.heappop(heap)
            if not parts[left] or not parts[right] or after[left] != right or len(parts[left]) + len(parts[right]) != size:
                continue
            parts[left] += parts[right]
            parts[right] = ""
            after[left] = after[right]
            if after[right] < n:
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [p for p in parts if p]


def encoder(path: str) -> Model:
    """The model that gives the library's ids for the kind of the file."""
    if path not in _encoders:
        from sentencepiece import sentencepiece_model_pb2

        file = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as data:
            file.ParseFromString(data.read())
        merges = file.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE
        _encoders[path] = MergeModel(path) if merges else model(path)
    return _encoders[path]


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def prefixed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one buffer, with a space before each that is not empty."""
    data, offsets = W.buffers(texts)
    filled = np.diff(offsets) > 0
    moved = np.append(0, np.cumsum(filled))
    out = np.full(len(data) + moved[-1], 0x20, dtype=np.uint8)
    out[np.arange(len(data)) + np.repeat(moved[1:], np.diff(offsets))] = data
    return out, offsets + moved


_ENCODED = "doc_id long, row long, chunk int, ids binary, n_ids long, score double, round_trip boolean"
_ENCODED_NAMES = [part.split(" ")[0] for part in _ENCODED.split(", ")]


def _encode_whole(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            data, offsets = prefixed(batch.column(2))
            for first, last in W.chunks(offsets, 4 * W.CHUNK_BYTES):
                part, at = data[offsets[first]: offsets[last]], offsets[first: last + 1] - offsets[first]
                out = list(own.encode(part, at))
                raw = part.tobytes()
                same = [own.decode(ids) == raw[a:b] for (ids, _), a, b in zip(out, at[:-1], at[1:])]
                n = last - first
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(np.zeros(n, np.int32)),
                    pa.array([ids.astype("<i4").tobytes() for ids, _ in out], pa.binary()),
                    pa.array([len(ids) for ids, _ in out], pa.int64()), pa.array([s for _, s in out], pa.float64()),
                    pa.array(same, pa.bool_()),
                ], names=_ENCODED_NAMES)

    return encode


def _cut(path: str, chunk: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = model(path).longest
        for batch in batches:
            data, offsets = prefixed(batch.column(2))
            out = []
            for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
                text = data[a:b]
                edges = list(range(0, len(text), chunk))
                edges = sorted({next(p for p in range(e, -1, -1) if text[p] & 0xC0 != 0x80) for e in edges}) + [len(text)]
                for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
                    out.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), k, hi - lo, text[lo: hi + width].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], t) for k, t in enumerate(
                    (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
                names=["doc_id", "row", "chunk", "own", "data"])

    return cut


def _cut_naturally(path: str, chunk: int):
    """Chunks of at least ``chunk`` bytes that end where no merge crosses."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            data, offsets = prefixed(batch.column(2))
            out = []
            for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
                text = data[a:b].tobytes()
                cuts = own.natural_cuts(text)
                at = np.searchsorted(cuts, np.arange(chunk, len(text), chunk))
                edges = [0, *np.unique(cuts[at[at < len(cuts)]]).tolist(), len(text)]
                for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
                    out.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), k, text[lo:hi]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
                names=["doc_id", "row", "chunk", "data"])

    return cut


def _encode_cut(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            raw = batch.column(3).to_pylist()
            offsets = np.append(0, np.cumsum([len(x) for x in raw], dtype=np.int64))
            out = [(ids.astype("<i4").tobytes(), len(ids), float(score), own.decode(ids) == part) for part, (ids, score) in zip(
                raw, own.encode(np.frombuffer(b"".join(raw), np.uint8), offsets))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *(pa.array([r[k] for r in out], t) for k, t in enumerate(
                    (pa.binary(), pa.int64(), pa.float64(), pa.bool_())))], names=_ENCODED_NAMES)

    return encode


def _transfers(path: str):
    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            chunks = list(zip(batch.column(3).to_pylist(), batch.column(2).to_pylist()))
            found = [own.transfer(d, n, p).tobytes() for (d, n), p in zip(chunks, own.inner_parts(chunks))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.binary())], names=["row", "chunk", "matrix"])

    return transfer


def _matrices(group: pd.DataFrame) -> list[np.ndarray]:
    flat = [np.frombuffer(m, dtype=np.float64) for m in group["matrix"]]
    return [m.reshape(int(len(m) ** 0.5), -1) for m in flat]


def _product(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("chunk")
    whole = None
    for matrix in _matrices(group):
        whole = matrix if whole is None else (whole[:, :, None] + matrix[None]).max(axis=1)
    return pd.DataFrame({"row": group["row"].iloc[:1], "chunk": group["group"].iloc[:1], "matrix": [whole.tobytes()]})


def _resolve(group: pd.DataFrame) -> pd.DataFrame:
    """States at all boundaries inside a group whose outer ones are known."""
    group = group.sort_values("chunk")
    entry, exit_ = int(group["outer_entry"].iloc[0]), int(group["outer_exit"].iloc[0])
    matrices, scores, back = _matrices(group), None, []
    for matrix in matrices:
        if scores is None:
            scores = np.full(len(matrix), _NONE)
            scores[entry] = 0.0
        through = scores[:, None] + matrix
        back.append(through.argmax(axis=0))
        scores = through.max(axis=0)
    states = [exit_]
    for came_from in reversed(back):
        states.append(int(came_from[states[-1]]))
    states.reverse()
    return pd.DataFrame({"row": group["row"], "chunk": group["chunk"], "entry": states[:-1], "exit": states[1:]})


def boundary_states(matrices: DataFrame, scratch: Scratch, fanin: int = FANIN) -> DataFrame:
    """``row``, ``chunk``, ``entry``, ``exit``: the states of the best path of each text. Tables are stored."""
    most = matrices.agg(F.max("chunk")).first()[0] or 0
    grouped = matrices.withColumn("group", F.floor(F.col("chunk") / fanin).cast("int"))
    if most < fanin:
        outer = grouped.select("*", F.lit(0).alias("outer_entry"), F.lit(0).alias("outer_exit"))
    else:
        products = scratch.keep(
            grouped.groupBy("row", "group").applyInPandas(_product, "row long, chunk int, matrix binary"), "products")
        parents = boundary_states(products, scratch, fanin).select(
            "row", F.col("chunk").alias("group"), F.col("entry").alias("outer_entry"), F.col("exit").alias("outer_exit"))
        outer = grouped.join(parents, ["row", "group"])
    return scratch.keep(
        outer.groupBy("row", "group").applyInPandas(_resolve, "row long, chunk int, entry int, exit int"), "states")


def _encode_chunks(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            out, rows = [], list(zip(*(batch.column(i).to_pylist() for i in (3, 4, 5, 6))))
            parts = own.inner_parts([(data, n) for n, data, _, _ in rows])
            for (n, data, entry, exit_), part in zip(rows, parts):
                ids = own.trace_chunk(data, n, entry, exit_, part)
                score = sum(own.unknown if i in own.first_bytes else own.score_of.get(i, 0.0) for i in ids.tolist())
                out.append((ids.astype("<i4").tobytes(), len(ids), score, own.decode(ids) == data[entry: n + exit_]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *(pa.array([r[k] for r in out], t) for k, t in enumerate(
                    (pa.binary(), pa.int64(), pa.float64(), pa.bool_())))], names=_ENCODED_NAMES)

    return encode


def _encoded(docs: DataFrame, path: str, chunk: int, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> tuple[DataFrame, DataFrame]:
    """The columns of ``encode``, for texts encoded whole (with ``digest``, those of ``digests``) and for those in chunks."""
    scratch = Scratch(docs.sparkSession, "sentence-pieces")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    giant = F.octet_length("text") >= chunk
    whole = rows.where(~giant).mapInArrow(_encode_whole(path), _ENCODED)
    if digest:
        whole = whole.select("doc_id", "n_ids", F.crc32("ids").alias("ids_crc32"), F.lit(1).cast("long").alias("n_chunks"), "score", "round_trip")
    whole = scratch.keep(whole, "whole")
    if isinstance(encoder(path), MergeModel):
        chunks = scratch.keep(rows.where(giant).mapInArrow(
            _cut_naturally(path, chunk), "doc_id long, row long, chunk int, data binary"), "chunks", batch_rows=16)
        merged = scratch.keep(chunks.mapInArrow(_encode_cut(path), _ENCODED), "merged", batch_rows=CHUNKS_TOGETHER)
        scratch.drop("chunks")
        return whole, merged
    chunks = scratch.keep(rows.where(giant).mapInArrow(
        _cut(path, chunk), "doc_id long, row long, chunk int, own int, data binary"), "chunks", batch_rows=16)
    matrices = scratch.keep(chunks.select("row", "chunk", "own", "data").mapInArrow(
        _transfers(path), "row long, chunk int, matrix binary"), "matrices", batch_rows=CHUNKS_TOGETHER)
    states = boundary_states(matrices, scratch)
    return whole, scratch.keep(chunks.join(states, ["row", "chunk"]).select(
        "doc_id", "row", "chunk", "own", "data", "entry", "exit").mapInArrow(_encode_chunks(path), _ENCODED), "traced",
        batch_rows=CHUNKS_TOGETHER)


def encode(docs: DataFrame, path: str, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``row``, ``chunk``, ``ids`` (little-endian 32-bit), ``n_ids``, ``score``, ``round_trip``.

    One row per document, or per chunk of a giant one; ``row`` tells rows of ``docs`` apart.
    """
    whole, parts = _encoded(docs, path, chunk, id_col, text_col)
    return whole.unionByName(parts)


def _decoder(path: str):
    def decode(groups: pd.DataFrame) -> pd.DataFrame:
        own = model(path)
        parts = [own.decode(np.frombuffer(i, dtype="<i4")) for i in groups.sort_values("chunk")["ids"]]
        text = b"".join(parts)[1:].decode("utf-8")
        return pd.DataFrame({"doc_id": groups["doc_id"].iloc[:1], "row": groups["row"].iloc[:1], "text": [text]})

    return decode


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``row``, ``text`` from the result of ``encode``: one row per document."""
    return encoded.select("doc_id", "row", "chunk", "ids").groupBy("row").applyInPandas(
        _decoder(path), "doc_id long, row long, text string")


def _digest(groups: pd.DataFrame) -> pd.DataFrame:
    groups = groups.sort_values("chunk")
    return pd.DataFrame({
        "doc_id": groups["doc_id"].iloc[:1], "n_ids": [groups["n_ids"].sum()], "ids_crc32": [zlib.crc32(b"".join(groups["ids"]))],
        "n_chunks": [len(groups)], "score": [groups["score"].sum()], "round_trip": [bool(groups["round_trip"].all())]})


def digests(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """``doc_id``, ``n_ids``, ``ids_crc32``, ``n_chunks``, ``score``, ``round_trip``: one row per row of ``docs``.

    ``ids_crc32`` is that of a document's ids, 32-bit and little-endian. Every chunk of
    every document is decoded; ``round_trip`` says that this gives the document's bytes.
    """
    whole, parts = _encoded(docs, path, chunk, digest=True)
    return whole.unionByName(parts.groupBy("row").applyInPandas(
        _digest, "doc_id long, n_ids long, ids_crc32 long, n_chunks long, score double, round_trip boolean"))
