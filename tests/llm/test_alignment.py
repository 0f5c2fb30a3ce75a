import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from llm_fixtures import document_list, no_documents, odd_documents  # noqa: F401  (fixtures)
from risingtide.llm import alignment as A
from risingtide.llm.queries import tokenizer_path

PATHS = (tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def brute_tokens(text):
    """Ids and spans of both sides by the libraries alone; empty where the bytes differ."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    if not hasattr(brute_tokens, "a"):
        brute_tokens.a, brute_tokens.b = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
        brute_tokens.a.encode_special_tokens = True
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        brute_tokens.byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    a, b = brute_tokens.a, brute_tokens.b
    if not text:
        return [], []
    found = []
    for ids, raw in (
        (a.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(brute_tokens.byte[c] for c in a.id_to_token(i))),
        (b.encode(text), lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()),
    ):
        if b"".join(map(raw, ids)) != (" " + text).encode():
            return [], []
        spans, at = [], 0
        for i in ids:
            spans.append((i, at, at + len(raw(i))))
            at += len(raw(i))
        found.append(spans)
    return found


def brute(rows):
    """Every pair of tokens of a document is looked at."""
    links, counts, out = [], Counter(), []
    for _, text, *_ in rows:
        a, b = brute_tokens(text)
        own = [(i, j) for i, (_, lo, hi) in enumerate(a) for j, (_, lo2, hi2) in enumerate(b) if lo < hi2 and lo2 < hi]
        links.append([(a[i][0], b[j][0]) for i, j in own])
        counts.update(links[-1])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    for (doc_id, text, *_), own in zip(rows, links):
        a, b = brute_tokens(text)
        cuts = sorted({hi for *_, hi in a} & {hi for *_, hi in b})
        groups = [";".join("|".join(",".join(str(i) for i, _, hi in side if lo < hi <= to) for side in (a, b)) for lo, to in zip([0, *cuts], cuts))]
        out.append((doc_id, len(a), len(b), len(cuts), len(own), sum(counts[p] == most[p[1]] for p in own),
                    sum(counts[p] for p in own), hashlib.sha256(groups[0].encode()).hexdigest() if a else ""))
    return out


ODD = [None, "", " ", "\n", "a", "  two  spaces ", "<|endoftext|> and <s> </s> <unk> <0x41>", "▁ sign", "tab\tand\r\nline\n\n",
       "日本語のテキスト \U0001f642\U0001f469‍\U0001f4bb", "é é    wide", "x" * 700, "ab" * 300, "\x00 nul", "a﻿b",
       "İstanbul ﬁ ẞ", "word " * 40, "1234567890 3.14 'll 've", "ñandú　　à la"]


def key(row):
    return tuple((v is None, v or 0) for v in row[:7]) + (row[7],)


@pytest.mark.parametrize("block, lane", [(1 << 21, 512), (300, 3), (5000, 1)])
def test_digests_match_all_pairs(spark, block, lane):
    rng = random.Random(5)
    letters = "aeiouéñß \n\t.,'-日本\U0001f642" + "etaoinshrdlu" * 3
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 250))) for _ in range(40)] + ["word of words"] * 5
    rows = [(i, t, "x", None) for i, t in enumerate(texts)] + [(None, "no id", "x", 1), (0, "same id", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a string, block int").repartition(3)
    found = A.digests(docs, *PATHS, block_bytes=block, lane=lane)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(brute(rows), key=key)


def test_long_and_odd_documents(spark, odd_documents, document_list):
    wanted = [r for r in document_list if len(r[1] or "") < 3000]
    lengths = {r["doc_id"]: r["n_a"] for r in A.digests(odd_documents, *PATHS).collect()}
    for doc_id, text, *_ in document_list:
        assert lengths[doc_id] == len(brute_tokens(text)[0]) or doc_id is None
    aligned = {r["doc_id"]: r for r in A.alignments(odd_documents, *PATHS, lane=16).collect()}
    for doc_id, text, *_ in wanted:
        if doc_id is None:
            continue
        a, b = brute_tokens(text)
        row = aligned[doc_id]
        assert (row["a_ids"], row["b_ids"]) == ([x[0] for x in a], [x[0] for x in b])
        assert all(a[i][1] < b[j][2] and b[j][1] < a[i][2] for i, j in zip(row["link_a"], row["link_b"]))
        assert [a[i - 1][2] for i in row["group_a"]] == [b[j - 1][2] for j in row["group_b"]]


def test_lanes_change_nothing():
    own = A.sides(*PATHS)
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "beta", "x" * 90, "été"]) for _ in range(n)) for n in (3000, 1, 700, 2, 900)]
    data = np.frombuffer("".join(" " + t for t in texts).encode(), np.uint8)
    offsets = np.append(0, np.cumsum([len((" " + t).encode()) for t in texts]))
    one, many = (A.Aligned(own, data, offsets, lane) for lane in (1 << 40, 50))
    assert [x.tolist() for x in (one.link_a, one.link_b, one.cut, one.at_links)] == [
        x.tolist() for x in (many.link_a, many.link_b, many.cut, many.at_links)]
    assert list(one.group_texts()) == list(many.group_texts())
    ends = [np.cumsum(t.lengths[i]) for t, i in ((own.bytes_a, one.ids_a), (own.bytes_b, one.ids_b))]
    assert len(A.lanes(one.at_a, one.at_b, *ends, 50)[0]) > 60


def test_no_documents(spark, no_documents):
    assert A.digests(no_documents, *PATHS).count() == 0 and A.alignments(no_documents, *PATHS).count() == 0
    nothing = spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string")
    assert sorted(r["groups_sha256"] for r in A.digests(nothing, *PATHS).collect()) == ["", ""]
