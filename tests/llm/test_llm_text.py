import random
import re
import zlib

import numpy as np
import pyarrow as pa
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from llm_fixtures import document_list, no_documents, odd_documents  # noqa: F401  (fixtures)
from risingtide.llm import sentence_pieces as pieces
from risingtide.llm.licenses import TEMPLATES, scan_licenses
from risingtide.llm.queries import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")
TEXTS = ["", "a", "日本語テスト\U0001f642\U0001f642 x", "  two  spaces\n\n\ttab ", "x" * 200, "\r\n\r\n;\r x", "▁literal", "ÿþ é", "a\U0001f642b" * 30,
         "hello" * 40 + " w " + "ab\U0001f642" * 50, "The quick brown fox, jumped over 13 dogs."]


def plain_viterbi(model, text):
    best = [0.0] + [-np.inf] * len(text)
    for at in range(len(text)):
        for end, _, score in model.steps(text, at):
            best[end] = max(best[end], best[at] + score)
    return best[-1]


def score_of(model, ids):
    return sum(model.unknown if i in model.first_bytes else model.score_of.get(i, 0.0) for i in ids)


def test_segments_give_the_best_path():
    model = pieces.model(PATH)
    data, offsets = pieces.prefixed(pa.array(TEXTS))
    for (ids, score), a, b in zip(model.encode(data, offsets), offsets[:-1], offsets[1:]):
        text = data[a:b].tobytes()
        assert abs(score - plain_viterbi(model, text)) < 1e-6
        assert abs(score - score_of(model, ids.tolist())) < 1e-6
        assert model.decode(ids) == text


def test_scores_are_those_of_the_library_for_a_unigram_model():
    proto = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as file:
        proto.ParseFromString(file.read())
    proto.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    model, rng = pieces.model(PATH), random.Random(2)
    words = "the river runs under old stone bridges while evening light and rain carry unbelievable colours onto houses".split()
    for _ in range(40):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12)))
        data, offsets = pieces.prefixed(pa.array([text]))
        (_, score), = model.encode(data, offsets)
        assert abs(score - score_of(model, library.nbest_encode(text, nbest_size=2)[0])) < 1e-6


def test_transfer_matrices_compose():
    model = pieces.model(PATH)
    for text in TEXTS[1:]:
        data = b" " + text.encode()
        for chunk in (5, 13, 40):
            edges = sorted({next(p for p in range(e, -1, -1) if data[p] & 0xC0 != 0x80) for e in range(0, len(data), chunk)}) + [len(data)]
            scores = np.full(model.longest, -np.inf)
            scores[0] = 0
            for a, b in zip(edges[:-1], edges[1:]):
                scores = (scores[:, None] + model.transfer(data[a: b + model.longest], b - a)).max(axis=0)
            assert abs(scores[0] - plain_viterbi(model, data)) < 1e-6


def test_giant_texts_are_encoded_in_chunks(spark, odd_documents, document_list, monkeypatch):
    whole = {(r["doc_id"], r["n_ids"], round(r["score"])) for r in pieces.digests(odd_documents, PATH).collect()}
    cut = pieces.encode(odd_documents, PATH, chunk=200).cache()
    states = pieces.boundary_states
    monkeypatch.setattr(pieces, "boundary_states", lambda m, s, fanin=3: states(m, s, fanin))
    rounds = pieces.digests(odd_documents, PATH, chunk=200).collect()
    assert {(r["doc_id"], r["n_ids"], round(r["score"])) for r in rounds} == whole
    assert all(r["round_trip"] for r in rounds) and max(r["n_chunks"] for r in rounds) > 20
    back = pieces.decode(cut, PATH).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in back) == sorted((r[0] or -1, r[1] or "") for r in document_list)


def test_ids_are_those_of_the_library(spark, odd_documents, document_list):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [t for t in TEXTS if "▁" not in t] + [r[1] or "" for r in document_list] + ["ab" * 3000 + "日本語" * 900, "  " * 300 + "a\n  b"]
    own = pieces.encoder(PATH)
    data, offsets = pieces.prefixed(pa.array(texts))
    for text, (ids, _) in zip(texts, own.encode(data, offsets)):
        assert ids.tolist() == library.encode(text)
    expected = sorted((r[0] or -1, zlib.crc32(np.array(library.encode(r[1] or ""), "<i4").tobytes())) for r in document_list)
    for chunk in (pieces.CHUNK, 200):
        assert sorted((r["doc_id"] or -1, r["ids_crc32"]) for r in pieces.digests(odd_documents, PATH, chunk).collect()) == expected


def test_pieces_of_nothing(no_documents):
    assert pieces.digests(no_documents, PATH).collect() == []


def brute_licenses(text):
    def run(t):
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(5, len(w))
        return [tuple(w[i: i + k]) for i in range(len(w) - k + 1)] if w else []

    found, own = [], run(text)
    for name, template in TEMPLATES.items():
        shingles = run(template)
        length, kinds = len(shingles) + -(-len(shingles) // 4), set(shingles)
        best = max((len(kinds & set(own[p: p + length])) for p in range(len(own))), default=0)
        if 100 * best >= 75 * len(kinds):
            found.append((name, best))
    return found


def test_licenses_match_every_window(spark):
    rng, texts = random.Random(7), [None, "", "MIT", "Released under the MIT License."]
    for template in TEMPLATES.values():
        for edits in (0, 1, 2, 4, 8, 16):
            words = template.split()
            for _ in range(edits):
                words[rng.randrange(len(words))] = "other"
            filler = ["word" + str(rng.randrange(50)) for _ in range(rng.randrange(0, 40))]
            texts.append(" ".join([*filler, *words, *reversed(filler)]))
        texts.append(template.upper() + "\n" + template)
        texts.append(template[: len(template) * 4 // 5])
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, license string").repartition(3)
    found = scan_licenses(docs).collect()
    expected = sorted((i, n, b) for i, t in enumerate(texts) for n, b in brute_licenses(t))
    assert sorted((r["doc_id"], r["license"], r["n_matched"]) for r in found) == expected
    assert scan_licenses(docs.limit(0)).collect() == []


def test_merges_in_lockstep_match_the_heap():
    own = pieces.encoder(PATH)
    rng = random.Random(5)
    letters = [*"abcdehinorst", " ", "é", "ß", "語", "▁", "\n", "\U0001f600", ""]
    parts = ["".join(rng.choices(letters, k=rng.randrange(1, 60))).encode() for _ in range(400)]
    parts += [b"a" * pieces.SHORT, b"a" * (pieces.SHORT + 1), b"ab\xff\xe2\x82 x\x80", b"z"]
    data, stops = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
    ids, sizes, scores = own.solve(data, np.append(0, stops[:-1]), stops)
    for part, n, end, score in zip(parts, sizes, np.cumsum(sizes), scores):
        found = own._merge_many(list(part.decode("utf-8", "surrogateescape")))
        wanted, total = [], 0.0
        for piece in found:
            raw = piece.encode("utf-8", "surrogateescape")
            wanted += [own.pieces[raw][0]] if raw in own.pieces else own.byte_ids[list(raw)].tolist()
            total += own.pieces[raw][1] if raw in own.pieces else own.unknown
        assert ids[end - n: end].tolist() == wanted and score == total and own.decode(ids[end - n: end]) == part
    assert [len(x) for x in own.solve(data[:0], stops[:0], stops[:0])] == [0, 0, 0]
