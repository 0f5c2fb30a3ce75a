"""Cases that earlier versions got wrong: missing dates, counts per country, equal documents, cluster-dependent models."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from risingtide.operators import durations, enrich, features, models, series, skew, snapshots, terms
from risingtide.streaming.ingest import ingest_new_files


def test_missing_dates_come_last(spark):
    df = spark.createDataFrame(
        [("k", None, "x"), ("k", "2024-01-02", "b"), ("k", "2024-01-01", "a"), ("n", None, "only")],
        "id string, day string, category string").withColumn("day", F.to_timestamp("day"))
    assert {r["id"]: r["category"] for r in snapshots.first_per_key(df, ["id"], "day").collect()} == {"k": "a", "n": "only"}
    assert {r["id"]: r["category"] for r in durations.trend_durations(df, "id", "day", "category").collect()} == {"k": "a", "n": "only"}
    assert rows(snapshots.first_values(df, ["id"], ["category"], ["day"])) == [("k", "a"), ("n", "only")]


def test_frequent_keys_are_counted_per_country(spark):
    df = spark.createDataFrame([("US", "v1")] * 3 + [("GB", "v1")] * 3 + [("GB", "v2")] * 6, "country string, video_id string")
    assert rows(enrich.sample_frequent_keys(df, "video_id", 5, 1.0, by=("country",)).distinct()) == [("GB", "v2")]
    assert len(rows(enrich.sample_frequent_keys(df, "video_id", 5, 1.0).distinct())) == 3


def test_documents_with_spaces_in_tokens_are_told_apart(spark):
    df = spark.createDataFrame([(["a b"],), (["a", "b"],), (None,)], "t array<string>")
    found = {r["term"]: r["idf"] for r in terms.tfidf_top_terms(df, "t", 10).collect()}
    # Three documents, each term in one of them: ln(4 / 2) + 1.
    assert found == pytest.approx({"a": 1.6931, "b": 1.6931, "a b": 1.6931}, abs=1e-3)


def test_models_do_not_depend_on_how_rows_are_stored(spark):
    df = spark.range(300).selectExpr("id", "cast(id % 7 as double) as a", "cast(id % 11 as double) as b", "cast((id * 37) % 101 as double) as y")
    stages = lambda: [features.VectorAssembler(inputCols=["a", "b"], outputCol="features"), models.random_forest("y", trees=4, depth=4, memory_mb=256)]
    one, two = (models.fit(stages(), part).transform(df).select("id", "prediction") for part in (df.repartition(5), df.coalesce(1)))
    assert rows(one) == rows(two)


def test_periods_that_are_not_listed_stop_the_job(spark):
    df = spark.createDataFrame([(1, "d01", 2.0), (1, "d31", 3.0)], "k int, p string, v double")
    assert rows(series.pivot_filled(df, "k", "p", "v", ["d01", "d31"])) == [(1, 2.0, 3.0)]
    with pytest.raises(Exception, match="period not listed"):
        series.pivot_filled(df, "k", "p", "v", ["d01"]).collect()


def test_more_hot_keys_than_may_be_broadcast(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_KEYS", 3)
    df = spark.range(400).selectExpr("id % 8 as k", "id")
    stats = df.groupBy("k").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n"))
    found = skew.join_per_key(df, stats, ["k"], "n", rows_per_slice=10)
    assert found.count() == 400 and found.where("top % 8 = k and top >= 392").count() == 400


def test_ingest_counts_all_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        for i in range(5):
            spark.range(i, i + 1).write.mode("append").parquet(str(tmp_path / "in"))
        args = (spark, *(str(tmp_path / n) for n in ("in", "out", "progress")), spark.range(1).schema)
        batches = ingest_new_files(*args, fmt="parquet", maxFilesPerTrigger="1")
        assert batches >= 5 and ingest_new_files(*args, fmt="parquet") == 0
        assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
