import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from llm_fixtures import document_list, no_documents, odd_documents  # noqa: F401  (fixtures)
from risingtide.llm import near_dedup, words
from risingtide.llm.components import components
from risingtide.llm.exact_dedup import directory, exact_duplicates
from risingtide.llm.near_dedup import near_duplicates
from risingtide.llm.tables import Scratch


def shingles(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    k = min(5, len(found))
    return {tuple(found[i: i + k]) for i in range(len(found) - k + 1)} if found else set()


def brute_components(rows):
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def test_words_and_shingles_of_whole_texts(document_list):
    texts = [r[1] for r in document_list]
    found = dict(words.shingle_sets(pa.array(texts), 5))
    assert [len(found[i]) for i in range(len(texts))] == [len(shingles(t)) for t in texts]


def test_near_duplicates_match_all_pairs(odd_documents, document_list):
    roots, sizes = brute_components(document_list)
    found = near_duplicates(odd_documents).collect()
    assert len(found) == len(document_list)
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["component_id"], r["n_shingles"], r["kept"]) == (
                roots[r["doc_id"]], sizes[r["doc_id"]], roots[r["doc_id"]] == r["doc_id"])


def test_near_duplicates_in_blocks_lose_nothing(odd_documents, document_list, monkeypatch):
    """Small blocks and no further leaders: what is left is found by the comparison in blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    monkeypatch.setattr(near_dedup, "LEADER_ROUNDS", 0)
    roots, _ = brute_components(document_list)
    found = near_duplicates(odd_documents).where("doc_id is not null").collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == roots


def test_near_duplicates_of_nothing(no_documents):
    assert near_duplicates(no_documents).collect() == []


def test_tensored_tables_catch_what_they_promise():
    """Sets at similarity 0.8 share a table in nearly all of many trials."""
    rng, hits, trials = np.random.default_rng(1), 0, 300
    factors, shifts = words.stream(7, 40) | np.uint64(1), words.stream(8, 40)
    for _ in range(trials):
        pool = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
        with np.errstate(over="ignore"):
            a, b = ((s[:, None] * factors + shifts).min(axis=0).reshape(20, 2) for s in (pool[:108], pool[12:]))
        same = (a == b).all(axis=1)
        hits += same[:10].any() and same[10:].any()
    assert hits >= trials - 3


@pytest.mark.parametrize("links", [
    [(1, 2), (2, 3), (3, 4), (9, 4), (20, 21)], [(i, i + 1) for i in range(60)], [(5, 5)], [],
    [(1, i) for i in range(2, 40)] + [(39, 50), (51, 50)],
])
def test_components(spark, links):
    found = components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test"))
    group = defaultdict(set)
    for a, b in links:
        joined = group[a] | group[b] | {a, b}
        for n in joined:
            group[n] = joined
    expected = {n: min(g) for n, g in group.items() if min(g) != n}
    assert {r["node"]: r["root"] for r in found.collect()} == expected


def test_exact_duplicates(odd_documents, document_list):
    groups = defaultdict(list)
    for r in document_list:
        groups[r[1] or ""].append(r[0])
    text_of = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    found = exact_duplicates(odd_documents, capacity=4).collect()
    assert Counter(r["text_sha256"] for r in found) == Counter(
        hashlib.sha256((r[1] or "").encode()).hexdigest() for r in document_list)
    for r in found:
        group = groups[text_of[r["text_sha256"]]]
        keep = max((i for i in group if i is not None), default=None)
        assert r["group_size"] == len(group) and r["keep_id"] == keep
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == keep)
    assert all(r["kept"] for r in found if r["group_size"] == 1)


def test_exact_duplicates_of_nothing(no_documents):
    assert exact_duplicates(no_documents).collect() == []


def test_directory_splits_overfull_buckets(spark):
    hashes = Scratch(spark, "test").keep(
        spark.range(3000).selectExpr("xxhash64(id) as hash").union(spark.range(500).selectExpr("id as hash")), "hashes")
    slots = directory(hashes, 200)
    rows = slots.collect()
    bits = rows[0]["bits"]
    assert len({r["slot"] for r in rows}) == len(rows) and len({r["depth"] for r in rows}) > 1
    counts = {r["bucket"]: r["n"] for r in hashes.selectExpr(f"shiftrightunsigned(hash, {64 - bits}) as slot").join(
        slots, "slot").groupBy("bucket").count().withColumnRenamed("count", "n").collect()}
    assert sum(counts.values()) == 3500
    # Only a bucket at the last depth may overflow.
    depth = {r["bucket"]: r["depth"] for r in rows}
    assert all(n <= 200 or depth[b] == bits for b, n in counts.items())
