import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from risingtide.operators import indexing, sketches
from risingtide.operators.features import as_array, coded_stages, fit_transform
from risingtide.operators.kmeans import euclidean_clusters, squares_by_centroid
from risingtide.operators.split import exact_sample
from risingtide.sinks.writers import write_csv, write_csv_file, write_parquet
from risingtide.sources.readers import read_csv


def test_label_positions_with_ties_and_missing(spark):
    df = spark.createDataFrame([(x,) for x in ["b", "a", "b", "c", None, "a", None, "d"]], "label string")
    assert rows(indexing.label_index(df, "label", range_rows=2).select("label", "count", "index", "size")) == [
        ("a", 2, 0, 4), ("b", 2, 1, 4), ("c", 1, 2, 4), ("d", 1, 3, 4)]
    assert indexing.label_index(df.limit(0), "label").count() == 0


def test_a_million_labels(spark):
    df = spark.range(1_000_000).select((F.col("id") % 999_983).cast("string").alias("label"), "id")
    index = indexing.label_index(df, "label")
    found = index.agg(F.count(F.lit(1)), F.min("index"), F.max("index"), F.count_distinct("index"), F.max("size")).first()
    assert tuple(found) == (999_983, 0, 999_982, 999_983, 999_983)
    assert {r["label"] for r in index.where("index < 17").collect()} == {str(i) for i in range(17)}


def test_scaled_entries_equal_the_stages(spark):
    rng = np.random.default_rng(2)
    data = [(i, float(rng.integers(0, 9)), 3.0, f"c{rng.integers(0, 5)}", f"r{rng.integers(0, 3)}", "extra") for i in range(200)]
    df = spark.createDataFrame(data, "id long, x double, same double, channel string, region string, pos string")
    found = {(r["id"], r["pos"]): r["value"] for r in indexing.scaled_entries(
        df, "id", ["x", "same"], ["channel", "region"], range_rows=2).collect()}
    (coded,) = fit_transform(coded_stages(["x", "same"], ["channel", "region"]), df)
    want = {(r["id"], p): v for r in as_array(coded, "scaledFeatures", "v").collect() for p, v in enumerate(r["v"]) if v}
    assert found.keys() == want.keys() and all(math.isclose(found[k], want[k]) for k in want)


def test_scaled_entries_of_odd_rows(spark):
    df = spark.createDataFrame([(1, "a", 2), (2, None, 2), (3, "a", 2)], "id int, label string, x int")
    assert indexing.scaled_entries(df, "id", ["x"], ["label"]).count() == 0  # one label, no deviation
    assert indexing.scaled_entries(df.limit(0), "id", ["x"], ["label"]).count() == 0


def test_tfidf_entries_and_vectors(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a"]), (3, []), (4, None), (5, ["c", "b", "b", "b"])], "id int, tokens array<string>")
    found = {(r["id"], r["term"]): (r["index"], r["count"], r["weight"]) for r in indexing.tfidf_entries(docs, "id", "tokens").collect()}
    idf = {"b": math.log(6 / 3), "a": math.log(6 / 3), "c": math.log(6 / 2)}
    want = {(1, "a"): 2, (1, "b"): 1, (2, "a"): 1, (5, "b"): 3, (5, "c"): 1}
    assert found.keys() == want.keys()
    for (doc, term), (index, count, weight) in found.items():
        assert index == "bac".index(term) and count == want[doc, term] and math.isclose(weight, count * idf[term])
    vectors = {r["id"]: r["positions"] for r in indexing.sparse_vectors(indexing.tfidf_entries(docs, "id", "tokens"), "id").collect()}
    assert vectors == {1: [0, 1], 2: [1], 5: [0, 2]}


def test_sketches_merge_and_keep_to_their_error(spark):
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 4)).alias("key"), (F.col("id") % 5).alias("day"),
        F.when(F.col("id") % 50 == 1, F.lit(None)).when(F.col("id") % 50 == 2, F.lit(float("nan"))).otherwise(
            F.pow(F.pmod(F.col("id") * 7919, F.lit(10007)).cast("double"), F.lit(2))).alias("value"))
    probs = [0.0, 0.05, 0.5, 0.95, 1.0]
    for by in (["key"], []):
        parts = sketches.quantile_sketches(df, "value", [*by, "day"])
        found = sketches.sketch_quantiles(sketches.merged_sketches(parts, by), probs)
        errors = sketches.rank_errors(df, "value", found, probs, by).collect()
        assert len(errors) == (5 if by else 1) and all(r["error"] <= sketches.RANK_ERROR for r in errors)
    few = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("b", None), (None, 5.0)], "key string, value double")
    assert rows(sketches.sketch_quantiles(sketches.quantile_sketches(few, "value", ["key"]), [0.0, 1.0])) == [
        (None, 1, [5.0, 5.0]), ("a", 2, [1.0, 3.0])]
    wrong = spark.createDataFrame([("a", [3.0]), (None, [5.0])], "key string, quantiles array<double>")
    assert {r["key"]: r["error"] for r in sketches.rank_errors(few, "value", wrong, [0.0], ["key"]).collect()} == {"a": 0.5, None: 0.0}


@pytest.mark.parametrize("n, end_rows", [(0, 10), (1, 10), (700, 1), (700, 10_000), (5000, 10), (9999, 10)])
def test_exact_sample(spark, n, end_rows):
    df = spark.range(5000).select(F.col("id").cast("string").alias("key"), F.lit(1).alias("__x")).union(spark.createDataFrame([(None, 1)], "key string, x int"))
    got = {r["key"] for r in exact_sample(df, "key", n, "s", end_rows).collect()}
    assert got == {r["key"] for r in df.where("key is not null").orderBy(F.md5(F.concat(F.lit("s"), "key")), "key").limit(n).collect()}
    assert exact_sample(df, "key", n, "s", end_rows).count() == min(n, 5000)


def test_exact_sample_of_repeated_keys(spark):
    df = spark.range(900).select((F.col("id") % 2).alias("key"))
    assert exact_sample(df, "key", 451, end_rows=10).count() == 451 and exact_sample(df.limit(0), "key", 5).count() == 0


def test_replacing_partitions_only(spark, tmp_path):
    old = spark.createDataFrame([(1, "US"), (2, "GB"), (3, None)], "n int, country string")
    new = spark.createDataFrame([(9, "GB"), (8, "FR")], "n int, country string")
    for kind, write in (("csv", write_csv), ("parquet", write_parquet)):
        path = str(tmp_path / kind)
        write(old, path, partition_by=["country"], replace_partitions=True)
        write(new, path, partition_by=["country"], replace_partitions=True)
        read = spark.read.schema(old.schema).option("header", "true").format(kind).load(path)
        assert rows(read) == [(1, "US"), (3, None), (8, "FR"), (9, "GB")]
        write(new, path, partition_by=["country"])
        assert spark.read.schema(old.schema).option("header", "true").format(kind).load(path).count() == 2
    with pytest.raises(ValueError):
        write_parquet(old, str(tmp_path / "x"), replace_partitions=True)


def test_one_named_file(spark, tmp_path):
    df = spark.range(20).select(F.col("id").cast("int").alias("n")).repartition(4)
    path = tmp_path / "US_videos.csv"
    write_csv_file(df, str(path))
    write_csv_file(df.limit(3), str(path), mode="ignore")
    assert path.is_file() and path.read_text().startswith("n\n") and read_csv(spark, str(path), df.schema).count() == 20
    write_csv_file(df.limit(3), str(path))
    assert read_csv(spark, str(path), df.schema).count() == 3 and {p.name for p in tmp_path.iterdir()} <= {"US_videos.csv", ".US_videos.csv.crc"}


def test_euclidean_clusters(spark):
    rng = np.random.default_rng(0)
    data = [(i, (np.array([[0, 0, 9], [9, 0, 0], [0, 9, 0]][i % 3]) + rng.normal(0, 0.3, 3)).tolist()) for i in range(60)]
    found = euclidean_clusters(spark.createDataFrame([*data, (99, None)], "key int, z array<double>"), "key", "z")
    labels = {r["key"]: r["cluster"] for r in found.labelled.collect()}
    assert len(labels) == 60 and all(labels[i] == labels[i % 3] for i in range(60)) and len(set(labels.values())) == 3
    x = np.array([v for _, v in data])
    told = squares_by_centroid(found, "z").first()
    assert told["series"] == 60 and told["moved"] == 0
    assert math.isclose(told["within"] + told["between"], ((x - x.mean(axis=0)) ** 2).sum(), rel_tol=1e-9)
