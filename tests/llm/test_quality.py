import random
import re
import zlib
from collections import Counter
from math import log

import numpy as np
import pyarrow as pa

from llm_fixtures import document_list, no_documents, odd_documents  # noqa: F401  (fixtures)
from risingtide.llm import quality_classifier as classifier
from risingtide.llm.quality_rules import BASE, quality_rules
from risingtide.llm.queries import QUERIES


def brute_base(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(found[i: i + 5]) for i in range(len(found) - 4)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_base_rules(spark, odd_documents, document_list):
    trusted = spark.createDataFrame([(1,), (4,), (None,)], "doc_id long")
    found = quality_rules(odd_documents, trusted).collect()
    assert sorted((r["doc_id"] or -1, *(r[c] for c in BASE)) for r in found) == sorted(
        (r[0] or -1, *brute_base(r[1])) for r in document_list)
    for r in found:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_repeated_windows(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60))) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = quality_rules(docs, docs.select("doc_id").limit(0)).collect()
    assert {r["doc_id"]: r["n_repeat_words"] for r in found} == {i: brute_base(t)[4] for i, t in enumerate(texts)}
    assert all(r["score"] == 0 and r["kept"] != r["base_failed"] for r in found)


def test_scores_match_a_plain_count(spark, odd_documents, document_list):
    """With one bucket per n-gram (no collisions to speak of) scores follow from counts of the n-grams themselves."""
    trusted_ids = {r[0] for r in document_list[:20]}
    found = quality_rules(odd_documents, spark.createDataFrame([(i,) for i in trusted_ids], "doc_id long"), buckets=1 << 30).collect()

    def grams(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        return [*w, *zip(w, w[1:])]

    raw, target = Counter(), Counter()
    for r in document_list:
        raw.update(grams(r[1]))
        if r[0] in trusted_ids:
            target.update(grams(r[1]))
    share = sum(target.values()) / sum(raw.values())
    for r in document_list:
        own = grams(r[1])
        expected = np.mean([log((target[g] + 10) / (raw[g] * share + 10)) for g in own]) if own else 0
        assert any(r[0] == f["doc_id"] and abs(f["score"] - expected) < 1e-5 for f in found)


def test_copies_do_not_change_verdicts(spark, tmp_path):
    rng = random.Random(4)
    vocabulary = [a + b for a in ("ri", "sto", "lig", "hou", "gre", "wal") for b in ("ver", "ne", "ht", "se", "en", "k", "der")]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(40)) for _ in range(60)]
    rows = list(enumerate(texts))
    labels = spark.createDataFrame([(i, 1) for i in range(20, 60)], "doc_id long, quality int")
    copied = [(1000 + k, texts[3]) for k in range(30)]  # a third of all rows, none of them labelled

    def scores(rows, name):
        folder = tmp_path / name
        folder.mkdir()
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(folder / "documents.parquet"))
        labels.write.parquet(str(folder / "labels.parquet"))
        return {r["doc_id"]: (r["score"], r["kept"]) for r in QUERIES["op2_quality_rules"](spark, str(folder)).collect()}

    alone, among = scores(rows, "alone"), scores(rows + copied, "among")
    assert alone[3][1] and all(among[k] == alone[3] for k, _ in copied)
    assert {i: among[i] for i, _ in rows} == alone
    thrice = scores([(i + 10_000 * k if k else i, t) for i, t in rows for k in range(3)], "thrice")
    assert all(thrice[i + 10_000 * k if k else i] == alone[i] for i, _ in rows for k in range(3))


def test_rules_of_nothing(no_documents):
    assert quality_rules(no_documents, no_documents.select("doc_id")).collect() == []


def labelled(spark, n=400):
    rng = random.Random(9)
    words = ["the", "of", "and", "night", "river", "stone", "light", "carry", "house", "green", "walk", "under"]
    rows, labels = [], []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(20, 80)))
        bad = i % 4 == 0
        if bad:
            text = rng.choice([" ".join(w + "$$$" for w in text.split()), text.upper() + "!!", " | ".join(text.split())])
        rows.append((i, text))
        labels.append((i, 0 if bad else 1))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    found = {r["doc_id"]: r for r in classifier.classify(docs, labels).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in found.items())
    held = [i for i, r in found.items() if r["held_out"]]
    assert held and np.mean([found[i]["predicted"] == truth[i] for i in held]) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in found.values())


def test_held_out_labels_teach_nothing(spark):
    docs, labels = labelled(spark, 200)
    turned = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - quality else quality end as quality")
    scores = [{r["doc_id"]: r["score"] for r in classifier.classify(docs, x).collect()} for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_votes_are_the_exact_nearest():
    rng = np.random.default_rng(2)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    docs, sample, labels = unit(rng.normal(size=(30, 8))), unit(rng.normal(size=(90, 8))), rng.integers(0, 2, 90)
    found = classifier.votes(docs, sample, labels.astype(float), np.ones(90), 7)
    for d, score in zip(docs, found):
        near = sorted(range(90), key=lambda i: -(sample[i] @ d))[:7]
        weight = [np.exp(16 * (sample[i] @ d - 1)) for i in near]
        assert abs(score - np.dot(weight, labels[near]) / sum(weight)) < 1e-9


def test_classifier_on_odd_rows(spark, odd_documents, no_documents, document_list):
    labels = spark.createDataFrame([(r[0], i % 2) for i, r in enumerate(document_list[:40])] + [(1, None), (None, 1)], "doc_id long, quality int")
    found = classifier.classify(odd_documents, labels).collect()
    assert len(found) == len(document_list) and all(0 <= r["score"] <= 1 for r in found)
    assert classifier.classify(no_documents, labels).collect() == []
    assert {r["score"] for r in classifier.classify(odd_documents, labels.limit(0)).collect()} == {0.5}


def test_terms_of_empty_texts():
    found = classifier.term_counts(pa.array([None, "", "a"]))
    assert np.isfinite(found).all() and (found[0] == found[1]).all()


def test_copies_of_a_labelled_id_reach_the_driver_once(spark):
    docs, labels = labelled(spark)[:2]
    one = docs.select("doc_id", "text")
    first = one.orderBy("doc_id").limit(1)
    many = one.union(first.crossJoin(spark.range(500)).select("doc_id", "text"))
    a, b = (classifier.train(d, labels).value for d in (one, many))
    assert len(a[3]) == len(b[3]) and np.allclose(a[0], b[0], atol=1e-3)
