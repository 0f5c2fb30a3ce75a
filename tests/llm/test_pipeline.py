import random

from pyspark.sql import functions as F

import corpus_pipeline
from llm_fixtures import document_list, odd_documents  # noqa: F401  (fixtures)
from risingtide.llm import queries
from risingtide.llm.tables import Scratch


def test_every_operator_has_one_query():
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in queries.QUERIES) == 1


def test_stages_keep_clean_documents_and_all_columns(spark, tmp_path):
    rng = random.Random(11)
    vocabulary = [a + b for a in ("ri", "sto", "lig", "hou", "gre", "wal", "un") for b in ("ver", "ne", "ht", "se", "en", "k", "der")]
    clean = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60, 120))) for _ in range(120)]
    junk = [" ".join(w + "$$$" for w in t.split()) for t in clean[:40]]
    near = [t + " end" for t in clean[40:50]]
    texts = [*clean, *junk, *clean[20:30], *near]
    rows = [(i, t, "en", f"s{i % 3}", len(t), 0.0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1 if i < 120 else 0, 0) for i in range(160)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    scratch, kept = Scratch(spark, "test"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.keep(stage(spark, docs, str(tmp_path)), "stage")
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name != "best-fit packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"]
    assert kept["quality classifier"] >= set(range(120)) and not kept["quality classifier"] & set(range(120, 160))
    assert kept["quality rules"] == kept["quality classifier"]
    assert kept["exact dedup"] == kept["quality rules"] - set(range(20, 30))
    assert kept["MinHash near-dedup"] == kept["exact dedup"] - set(range(170, 180))
    assert kept["best-fit packing"] == kept["MinHash near-dedup"]
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in run.collect()} == kept["best-fit packing"] and run.count() == docs.count()


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def labels_at(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))


def test_rules_judge_rows_not_ids(spark, tmp_path):
    labels_at(spark, tmp_path, [(1, 1, 0), (None, 1, 0)])
    good = " ".join(f"word{i}" for i in range(30))
    texts = [(1, good), (None, good), (None, "too short"), (7, good), (7, "too short"), (8, "too short"), (8, "too short"),
             (9, good), (9, good), (10, None), (None, ""), (11, good + " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], COLUMNS)
    kept = corpus_pipeline.ruled(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted(
        (i or 0, t) for i, t in texts if t and len(t) > 20)


def test_pipeline_on_odd_and_no_rows(spark, tmp_path, odd_documents):
    labels_at(spark, tmp_path, [(i, i % 2, 0) for i in range(0)])
    odd = odd_documents.select("doc_id", "text", *(odd_documents[c] if c in odd_documents.columns else F.lit(None).cast(t).alias(c)
                                                  for c, t in (("lang", "string"), ("source", "string"), ("n_chars", "long"))))
    for name, docs in (("odd", odd), ("none", odd.limit(0))):
        for stage, function in corpus_pipeline.STAGES[1:4]:
            before = docs.count()
            docs = Scratch(spark, "odd").keep(function(spark, docs, str(tmp_path)), "stage")
            assert docs.columns == odd.columns and docs.count() <= before, (name, stage)
        packed = corpus_pipeline.packed(spark, docs, str(tmp_path))
        assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
