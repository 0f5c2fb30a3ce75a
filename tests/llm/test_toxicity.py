import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from llm_fixtures import document_list, no_documents, odd_documents  # noqa: F401  (fixtures)
from risingtide.llm import toxicity as T

CLEAN = [a + b for a in ("ri", "sto", "lig", "hou", "gre", "wal", "un", "ka") for b in ("ver", "ne", "ht", "se", "en", "k", "der", "mo")]
BAD = ["vermin", "filth", "crudo"]


def made(rng, toxic, n):
    words = [rng.choice(CLEAN) for _ in range(n)]
    if toxic:
        for _ in range(rng.randrange(1, 4)):
            words.insert(rng.randrange(len(words) + 1), rng.choice([*BAD, "zorb" + rng.choice(CLEAN)]))
    return ", ".join(words).capitalize() + "."


def labelled(n, seed=4, longest=120):
    rng = random.Random(seed)
    return [(i, made(rng, i % 6 == 0, rng.randrange(3, longest)), int(i % 6 == 0)) for i in range(n)]


def test_windows_cover_every_word_and_overlap():
    sizes = [0, 1, 31, 32, 33, 56, 57, 1000, 0, 5]
    words = T.Words(pa.array([" ".join(f"w{i}" for i in range(n)) or None for n in sizes], pa.string()))
    first, size, before = words.windows()
    for k, n in enumerate(sizes):
        own = [(f - words.before[k], f - words.before[k] + s) for f, s in zip(first[before[k]: before[k + 1]], size[before[k]: before[k + 1]])]
        assert set().union(*(range(a, b) for a, b in own)) == set(range(n))
        assert all(b - a == min(n, T.WINDOW) and 0 <= a and b <= n for a, b in own)
        assert all(c < b for (_, b), (c, _) in zip(own, own[1:]))


def test_words_and_grams_follow_letters_only():
    words = T.Words(pa.array(["One, two; ONE.two", "été-one", "", None, "a"], pa.string()))
    assert words.before.tolist() == [0, 4, 6, 6, 6, 7] and words.at[[0, 2, 5]].tolist() == [words.at[0]] * 3
    grams = [set(words.grams[a:b].tolist()) for a, b in zip(words.gram_at, [*words.gram_at[1:], len(words.grams)])]
    assert len(grams) == 4 and len(grams[words.at[0]]) == 4 and len(grams[words.at[6]]) == 4


def test_gradients_match_differences():
    net, rng = T.Network(), np.random.default_rng(1)
    net.weights = {k: v[:64].astype(np.float64) if k in ("words", "grams") else v.astype(np.float64) for k, v in net.weights.items()}
    size = np.array([4, 1, 3])
    vectors = rng.normal(size=(12, T.WORD_WIDTH + T.GRAM_WIDTH))
    toxic = np.array([1.0, 0.0, 1.0])

    def loss():
        logit, kept = net.forward(net.feed(vectors).reshape(2, 3, 4, -1), size)
        return np.log1p(np.exp(-np.where(toxic == 1, logit, -logit))).sum(), logit, kept

    _, logit, kept = loss()
    grads, fed = net.backward(1 / (1 + np.exp(-logit)) - toxic, kept)
    flat = fed.reshape(2, 12, -1)
    grads["into"], grads["bias"] = vectors.T @ flat, flat.sum(axis=1, keepdims=True)
    for name, grad in grads.items():
        weight = net.weights[name]
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in weight.shape)
            own, step = weight[at], 1e-3
            weight[at] = own + step
            high = loss()[0]
            weight[at] = own - step
            low = loss()[0]
            weight[at] = own
            assert np.isclose(grad[at], (high - low) / (2 * step), rtol=0.02, atol=2e-3), name


def test_empty_places_change_nothing():
    net, rng = T.Network(), np.random.default_rng(3)
    fed = rng.normal(size=(2, 2, 6, 3 * T.HIDDEN)).astype(np.float32)
    logit, _ = net.forward(fed, np.array([6, 4]))
    assert np.allclose(logit[1], net.forward(fed[:, 1:, :4], np.array([4]))[0], atol=1e-6)


@pytest.fixture(scope="module")
def tables(spark):
    rows = labelled(900)
    docs = spark.createDataFrame([(i, t, "en", 0.5, 1) for i, t, _ in rows], "doc_id long, text string, lang string, score double, hash int")
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in rows], "doc_id long, quality int, toxic int")
    return rows, docs.repartition(3), labels


def test_held_out_documents(spark, tables):
    rows, docs, labels = tables
    found = {r["doc_id"]: r for r in T.classify(docs, labels).collect()}
    assert len(found) == len(rows)
    own = [(found[i], x) for i, _, x in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r["held_out"] for r, _ in own) and sum(r["held_out"] for r in found.values()) == len(own)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found.values())
    caught = [r["predicted"] for r, x in own if x]
    alarms = [r["predicted"] for r, x in own if not x]
    assert sum(caught) >= 0.9 * len(caught) and sum(alarms) <= 0.03 * len(alarms)


def test_odd_documents(spark, tables, odd_documents, document_list):
    _, docs, labels = tables
    model = T.train(docs, labels).value
    rng = random.Random(9)
    deep = made(rng, False, 9000) + " vermin filth " + made(rng, False, 9000)
    texts = [None, "", " \n", "...", made(rng, False, 9000), deep, "vermin filth", "日本語 \U0001f642", "x" * 50000]
    scores = model.scores(pa.array(texts, pa.string()))
    assert scores[:4].tolist() == [0, 0, 0, 0] and scores[5] > 0.5 > scores[4] and scores[6] > 0.5
    for text, score in zip(texts, scores):  # alone or with others
        assert np.isclose(model.scores(pa.array([text], pa.string()))[0], score, atol=1e-5)
    found = T.classify(odd_documents, labels.where("toxic is null or doc_id < 0")).collect()
    assert len(found) == len(document_list) and {r["score"] for r in found} == {0.0}


def test_repeated_labelled_ids_count_once(spark, tables):
    _, docs, labels = tables
    many = docs.union(docs.where("doc_id = 1").crossJoin(spark.range(300)).select(docs.columns))
    odd = labels.union(labels).union(spark.createDataFrame([(None, 1, 1), (2, 1, None), (3, 1, 7)], labels.schema))
    a, b = T.train(docs, labels).value, T.train(many, odd).value
    assert all(np.allclose(a.weights[k], b.weights[k], atol=1e-4) for k in a.weights) and a.shift == b.shift
    alone = labels.where("toxic = 0")
    assert T.train(docs, alone) == 0.0 and T.train(docs, labels.where("toxic = 1")) == 1.0
    assert isinstance(T.train(docs, labels, sample=20).value, T.Network)


def test_no_documents(spark, no_documents, tables):
    _, docs, labels = tables
    assert T.classify(no_documents, labels).count() == 0
    found = T.classify(docs, labels.limit(0))
    assert found.columns == ["doc_id", "held_out", "score", "predicted"] and found.where("score != 0").count() == 0
