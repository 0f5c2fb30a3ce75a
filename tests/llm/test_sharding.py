import zlib
from collections import Counter, defaultdict
from math import comb

import numpy as np

from llm_fixtures import document_list, no_documents, odd_documents  # noqa: F401  (fixtures)
from risingtide.llm.sharding import communication_matrix, even, hypergeometric, shards, write_shards


def test_hypergeometric_law():
    rng, trials = np.random.default_rng(3), 20_000
    found = Counter(hypergeometric(rng, 7, 12, 8) for _ in range(trials))
    for k in range(8):
        expected = trials * comb(7, k) * comb(12, 8 - k) / comb(19, 8)
        assert abs(found[k] - expected) < 5 * max(expected, 1) ** 0.5 + 5
    big = hypergeometric(rng, 4 * 10**9, 6 * 10**9, 10**6)
    assert abs(big - 400_000) < 5_000


def test_matrix_sums():
    rng = np.random.default_rng(1)
    found = communication_matrix(rng, [5, 0, 17, 9], even(31, 4))
    assert found.sum(axis=1).tolist() == [5, 0, 17, 9] and found.sum(axis=0).tolist() == [8, 8, 8, 7]


def test_exact_sizes_and_slots(odd_documents, document_list):
    found = shards(odd_documents).collect()
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in found) == sorted(
        (r[0] or -1, len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in document_list)
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1 and set(slots) == set(range(24))
    again = shards(odd_documents.repartition(7)).collect()
    assert Counter(map(tuple, found)) == Counter(map(tuple, again))


def test_many_blocks_shuffle_uniformly(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "cast(id as string) as text")
    found = shards(docs, shards=4).collect()
    assert sorted(Counter(r["shard"] for r in found).values()) == [1500] * 4
    # Neither shard nor slot follows the id.
    for name in ("shard", "slot"):
        assert abs(np.corrcoef([r["doc_id"] for r in found], [r[name] for r in found])[0, 1]) < 0.06
    for s in range(4):
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(1500))


def test_written_shards_hold_everything(spark, tmp_path):
    docs = spark.range(300).selectExpr("id as doc_id", "repeat('x', cast(id as int)) as text")
    write_shards(docs, str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select("doc_id", "text").exceptAll(docs).isEmpty() and back.count() == 300
    assert {r["shard"]: r["count"] for r in back.groupBy("shard").count().collect()} == {0: 100, 1: 100, 2: 100}


def test_shards_of_nothing(no_documents):
    assert shards(no_documents).collect() == []
