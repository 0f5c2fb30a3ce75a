"""Byte-level BPE ids of whole batches of texts, encoding each distinct word once.

The pre-tokeniser of this kind of vocabulary never joins characters across the start of
a word, counting the one space before it to the word. So texts are cut into segments
(a word with the space before it, or white space left between words), segments are
told apart by a 64-bit hash, and each distinct one of a chunk is encoded once: by rank,
which gives the ids of the tokenizers library, or by that library where the vocabulary
numbers its merges in another order. Texts with white space beyond ASCII, or with the name of a special token, are encoded
whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from risingtide.llm import words as W

_RARE_SPACE = "[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

_encoders: dict[str, Callable] = {}


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every segment in order, and the number of segments before each text."""
    starts, stops, _ = W.spans(data, offsets)
    # White space before each word: from the end of the last word or the start of the text.
    text_start = offsets[np.searchsorted(offsets, starts, "right") - 1]
    gap = np.maximum(np.append(0, stops[:-1]), text_start) if len(starts) else starts
    spaced = (starts > gap) & (data[np.maximum(starts - 1, 0)] == 0x20)
    heads = starts - spaced
    # A gap before a spaced word is one segment; before another word its last byte is one of its own.
    loose = (heads > gap) & ~spaced
    one = np.flatnonzero(loose)
    rest_end = np.where(loose, heads - 1, heads)
    many = np.flatnonzero(rest_end > gap)
    # White space after the last word of each text.
    last = np.searchsorted(starts, offsets[1:]) - 1
    ends = np.maximum(offsets[:-1], np.where(last >= 0, stops[np.maximum(last, 0)], 0) if len(stops) else 0)
    tail = np.flatnonzero(offsets[1:] > ends)
    all_starts = np.concatenate([heads, heads[one] - 1, gap[many], ends[tail]])
    all_stops = np.concatenate([stops, heads[one], rest_end[many], offsets[1:][tail]])
    order = np.argsort(all_starts, kind="stable")
    all_starts, all_stops = all_starts[order], all_stops[order]
    return all_starts, all_stops, np.searchsorted(all_starts, offsets)


def _byte_alphabet() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _ranked(model: dict, pattern: str):
    """The same vocabulary by rank, if its merges are numbered in order; else None."""
    import tiktoken

    alphabet, vocab = _byte_alphabet(), model["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    numbers = [vocab[a + b] for a, b in merges]
    if any(y <= x for x, y in zip(numbers, numbers[1:])):
        return None
    made = set(numbers)
    ranks = {bytes(alphabet[c] for c in t): n for t, n in vocab.items() if n in made or len(t) == 1}
    return tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


# Fixed value: how byte-level pre-tokenisers of this kind cut a text.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class _Encoder:
    def __init__(self, path: str):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        self.model = Tokenizer.from_file(path)
        self.ranked = _ranked(said["model"], PATTERN)
        self.lengths = np.zeros(self.model.get_vocab_size(), dtype=np.int64)
        for token, number in self.model.get_vocab().items():
            self.lengths[number] = len(token)
        specials = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.whole = "|".join([_RARE_SPACE, *(pc_escape(t) for t in specials)])

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        found = self.model.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=np.uint32) for x in found]

    def distinct(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the segments in one array, and where those of each begin and how many they are.

        Words are encoded in one call; those without a space before them get a line feed.
        """
        blank = (stops - starts == 1) & W.SPACE[data[starts]]
        blank |= W.SPACE[data[starts]] & W.SPACE[data[np.minimum(starts + 1, stops - 1)]]
        bare = data[starts] != 0x20
        lengths = np.where(blank, 0, stops - starts + bare)
        ends = np.cumsum(lengths)
        glued = np.full(ends[-1] if len(ends) else 0, 0x0A, dtype=np.uint8)
        own = np.where(blank, 0, stops - starts)
        run = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        glued[np.repeat(ends - own, own) + run] = data[np.repeat(starts, own) + run]
        text = glued.tobytes().decode("utf-8")
        if self.ranked is not None:
            ids = np.frombuffer(self.ranked.encode_to_numpy(text, disallowed_special=()), dtype=np.uint32)
        else:
            ids = self.plain([text])[0]
        after = np.searchsorted(np.cumsum(self.lengths[ids]), ends, "right")
        begins = np.append(0, after[:-1])[: len(ends)] + (bare & ~blank)
        counts = np.where(blank, 0, after - begins)
        if blank.any():
            raw = [data[a:b].tobytes().decode() for a, b in zip(starts[blank], stops[blank])]
            more = self.plain(raw)
            counts[blank] = [len(x) for x in more]
            begins[blank] = len(ids) + np.cumsum(counts[blank]) - counts[blank]
            ids = np.concatenate([ids, *more])
        return ids, begins, counts

    def __call__(self, texts: pa.Array, end: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Per run of texts: first and last text, all their ids (each text closed by ``end``), where each begins."""
        texts = texts.fill_null("") if texts.null_count else texts
        odd = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)
        data, offsets = W.buffers(texts)
        for first, last in W.chunks(offsets, 8 * W.CHUNK_BYTES):
            part, at = data[offsets[first]: offsets[last]], offsets[first: last + 1] - offsets[first]
            starts, stops, before = segments(part, at)
            hashes = np.concatenate([np.zeros(0, np.uint64), *self._hashes(part, at, starts, stops, before)])
            _, one, back = np.unique(hashes, return_index=True, return_inverse=True)
            pool, begins, sizes = self.distinct(part, starts[one], stops[one])
            # The end token is one more segment behind each text.
            order = np.insert(back, before[1:], len(one))
            counts, begins = np.append(sizes, 1)[order], np.append(begins, len(pool))[order]
            pool = np.append(pool, np.uint32(end))
            total = np.cumsum(counts)
            ids = pool[np.repeat(begins - (total - counts), counts) + np.arange(total[-1] if len(total) else 0)]
            ends = before[1:] + np.arange(1, last - first + 1)
            text_at = np.append(0, total[ends - 1])
            if odd[first:last].any():
                own = [ids[a:b] for a, b in zip(text_at[:-1], text_at[1:])]
                for i in np.flatnonzero(odd[first:last]):
                    own[i] = np.append(self.plain([texts[first + int(i)].as_py()])[0], np.uint32(end))
                ids = np.concatenate(own)
                text_at = np.append(0, np.cumsum([len(x) for x in own]))
            yield first, last, ids, text_at

    @staticmethod
    def _hashes(part, at, starts, stops, before):
        """Hashed in chunks, which bounds the memory of the 64-bit sums."""
        for a, b in W.chunks(at):
            lo, hi = before[a], before[b]
            yield W.span_hashes(part[at[a]: at[b]], starts[lo:hi] - at[a], stops[lo:hi] - at[a])


def pc_escape(text: str) -> str:
    """``text`` as a regular expression."""
    return "".join(c if c.isalnum() else "\\" + c for c in text)


def encoder(path: str) -> _Encoder:
    """The encoder of a vocabulary file, one per Python worker."""
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path]
