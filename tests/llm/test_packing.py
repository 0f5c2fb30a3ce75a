import random
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from llm_fixtures import document_list, no_documents, odd_documents  # noqa: F401  (fixtures)
from risingtide.llm.bpe import encoder
from risingtide.llm.packing import best_fit_decreasing, best_fit_pack, lower_bound, pack_documents, token_pieces
from risingtide.llm.queries import tokenizer_path
from risingtide.llm.tables import Scratch

ODD = ["a  b\n\nc ", " lead", " ", "\n\n x\t y", "", "don't  stop\n 's x\r\n\r\nq", "a b c", "x<|endoftext|>y", None,
       "日本 語　x", "\t\ta", " \n a\n b", "é  ê\n", "a\x1cb \x1c c", "\x85x", "'s't 'll", "1234 56a7", "\U0001f642 \U0001f642\U0001f642"]


def test_ids_are_those_of_the_tokenizers_library(document_list):
    encode = encoder(tokenizer_path())
    rng = random.Random(1)
    mixed = ["".join(rng.choice(["a", "é", " ", "\n", "\t", "'s", "9", "!", "\r\n", "  ", "Ω", " "]) for _ in range(40)) for _ in range(150)]
    texts = ODD + mixed + [r[1] for r in document_list]
    found = []
    for _, _, ids, at in encode(pa.array(texts), 2):
        found += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    assert found == [encode.model.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def best_bins(lengths, size):
    """The least number of bins, by trying all assignments."""
    for bins in range(1, len(lengths) + 1):
        for places in product(range(bins), repeat=len(lengths)):
            if max(np.bincount(places, weights=lengths, minlength=bins)) <= size:
                return bins
    return 0


def test_bounds_never_exceed_the_optimum():
    rng = random.Random(4)
    for _ in range(60):
        lengths = np.array([rng.randrange(1, 13) for _ in range(rng.randrange(1, 7))])
        best = best_bins(lengths, 12)
        bins, offsets, rooms = best_fit_decreasing(lengths, 12)
        assert lower_bound(np.bincount(lengths, minlength=13), 12) <= best <= len(rooms)
        assert (12 - np.bincount(bins, weights=lengths) == rooms).all()
    assert lower_bound(np.bincount([7, 7, 7], minlength=13), 12) == 3


@pytest.mark.parametrize("items", [50, 1 << 16])
def test_packing_is_gapless_and_near_the_bound(spark, items):
    rng = random.Random(8)
    lengths = [rng.choice([rng.randrange(1, 1025), 1024, 511, 340]) for _ in range(900)]
    scratch = Scratch(spark, "test")
    pieces = scratch.keep(spark.createDataFrame(list(enumerate(lengths)), "row long, length long"), "pieces")
    found = best_fit_pack(pieces, scratch, items=items).collect()
    assert sorted(r["row"] for r in found) == list(range(900))
    by = defaultdict(list)
    for r in found:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    bound = lower_bound(np.bincount(lengths, minlength=1025), 1024)
    assert len(by) <= bound * (1.01 if items > 900 else 1.06) + 1


def test_pieces_of_documents(spark, odd_documents, document_list, no_documents):
    path = tokenizer_path()
    model = encoder(path).model
    ids = [model.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in document_list]
    expected = []
    for row, own in zip(document_list, ids):
        starts = range(len(own) - 64 * ((len(own) - 1) // 64), len(own), 64)
        for k, (a, b) in enumerate(zip([0, *starts], [*starts, len(own)])):
            expected.append((row[0] or -1, k, a, b - a, zlib.crc32(np.array(own[a:b], "<u4").tobytes())))
    found = pack_documents(odd_documents, path, size=64, items=40).collect()
    assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == sorted(expected)
    cut = token_pieces(odd_documents.where("doc_id = 1"), path, size=64).orderBy("piece").collect()
    assert np.frombuffer(b"".join(r["ids"] for r in cut), "<u4").tolist() == ids[0]
    assert pack_documents(no_documents, path).collect() == []
