import json

import pytest
from pyspark.sql import functions as F, types as T

from conftest import rows
from risingtide.schemas import VIDEOS
from risingtide.sinks import writers
from risingtide.sources import readers, records
from risingtide.streaming.ingest import ingest_new_files

HEADER = ",".join(VIDEOS.fieldNames())


def line(vid, tags="a|b", description="plain", views=10, published="2020-08-11T19:20:14Z"):
    return (
        f'{vid},"Title, {vid}",{published},ch,Channel,22,2020-08-12T00:00:00Z,{tags},'
        f"{views},1,2,3,http://t,FALSE,TRUE,{description}"
    )


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    root = tmp_path_factory.mktemp("csv")
    us = [HEADER]
    for i in range(60):
        text = f'"First ""line"" {i}\r\n\r\nsecond, line {i}\nend"' if i % 3 == 0 else f"short {i}"
        us.append(line(f"v{i}", "[None]" if i % 5 == 0 else "a|B c", text, i))
    us.insert(7, "only,three,fields")
    us.insert(9, line("extra") + ",one more")
    us.insert(11, line("badnumber", views="many"))
    (root / "US_videos.csv").write_bytes(("\r\n".join(us) + "\r\n").encode())
    (root / "GB_videos.csv").write_bytes(("\n".join([HEADER, line("g1", description='""')]) + "\n").encode())
    return root


def test_multi_line_and_list_of_files(spark, files):
    both = readers.read_videos(spark, [str(files / "US_videos.csv"), str(files / "GB_videos.csv")], typed=False)
    assert both.where("video_id LIKE 'v%' OR video_id = 'g1'").count() == 61
    single = readers.read_csv(spark, str(files / "US_videos.csv"), VIDEOS, multi_line=False)
    assert single.count() > 61


def test_country_from_file_name(spark, files):
    tagged = readers.read_countries(spark, str(files / "*_videos.csv"))
    assert {r["country"] for r in tagged.select("country").distinct().collect()} == {"US", "GB"}


@pytest.mark.parametrize("split_bytes", ["128m", "900", "150"])
def test_records_do_not_depend_on_file_splits(spark, files, split_bytes):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        good, bad = records.read_records(spark, str(files / "*_videos.csv"), VIDEOS)
        got, wrong = rows(good), sorted(r["text"] for r in bad.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    whole = readers.read_videos(spark, str(files / "*_videos.csv"))
    # A number that does not parse is null in a row that stays.
    assert got == rows(whole.where("video_id LIKE 'v%' OR video_id IN ('g1', 'badnumber')"))
    assert [r[8] for r in got if r[0] == "badnumber"] == [None]
    assert len(wrong) == 2 and any(t.startswith("only,three") for t in wrong)


_AB = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])


@pytest.mark.parametrize("split_bytes", ["128m", "64", "7"])
def test_stray_quotes_cost_one_line_of_single_line_files(spark, tmp_path, split_bytes):
    lines = ["a,b"] + [f"{i},row {i}" for i in range(40)]
    lines[3] = '2,5" pipe'
    lines[20] = '19,"open'
    lines[30] = "29,b,c"
    (tmp_path / "x.csv").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        good, bad = records.read_records(spark, str(tmp_path / "x.csv"), _AB, multi_line=False)
        found, wrong = dict(rows(good)), [tuple(r) for r in bad.collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    found.pop(19, None)
    assert set(found) == set(range(40)) - {19, 29} and found[2] == '5" pipe'
    assert all(found[i] == f"row {i}" for i in found if i != 2)
    assert ("29,b,c" in [t for _, t in wrong]) and all(f.endswith("x.csv") for f, _ in wrong) and len(wrong) <= 2


def test_single_line_files_are_split(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n" + "".join(f"{i},row {i}\n" for i in range(4000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        split, whole = (readers.read_csv(spark, str(tmp_path / "x.csv"), _AB, multi_line=m) for m in (False, True))
        assert split.rdd.getNumPartitions() > 5 and whole.rdd.getNumPartitions() == 1
        assert rows(split) == rows(whole)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_category_json_and_csv(spark, tmp_path):
    items = [{"id": "1", "snippet": {"title": "Film"}}, {"id": "10", "snippet": {"title": "Music"}}]
    (tmp_path / "US_category_id.json").write_text(json.dumps({"kind": "x", "items": items}, indent=1))
    got = readers.read_categories_json(spark, str(tmp_path / "US_category_id.json"))
    assert rows(got) == [("US", "1", "Film"), ("US", "10", "Music")]
    (tmp_path / "cat.csv").write_text('"id","title"\n1,Film & Co\n10,Music\n')
    assert rows(readers.read_categories_csv(spark, str(tmp_path / "cat.csv"))) == [(1, "Film & Co"), (10, "Music")]


def test_stopwords(spark, tmp_path):
    (tmp_path / "stop.txt").write_bytes(b"Foo\r\nbar \r\nfoo\r\n\r\n")
    assert rows(readers.read_stopwords(spark, str(tmp_path / "stop.txt"))) == [("bar",), ("foo",)]
    words = readers.stopword_list(spark, str(tmp_path / "stop.txt"))
    assert {"foo", "bar", "the"} <= set(words)


def test_dictionary_and_small_table(spark):
    df = readers.small_table(spark, [("US", '{"v1": "x", "v2": "y"}')], "country string, body string")
    assert rows(readers.dictionary_from(df, "body", "country")) == [("US", "v1", "x"), ("US", "v2", "y")]


def test_csv_sink_quotes_and_single_file(spark, tmp_path):
    df = spark.createDataFrame([(1, ' lead, "q"\nnext '), (2, None)], "id int, t string")
    path = str(tmp_path / "out")
    writers.write_csv(df.repartition(3), path, single_file=True)
    assert len(list((tmp_path / "out").glob("part-*.csv"))) == 1
    assert rows(readers.read_csv(spark, path, df.schema, multi_line=True)) == rows(df)
    writers.write_csv(df.limit(1), path, mode="ignore")
    assert readers.read_csv(spark, path, df.schema, multi_line=True).count() == 2


def test_parquet_sink_partitions_prune(spark, tmp_path):
    df = spark.createDataFrame([(1, "US"), (2, "GB")], "id int, region string")
    path = str(tmp_path / "pq")
    writers.write_parquet(df, path, partition_by=["region"])
    back = spark.read.parquet(path).where(F.col("region") == "US")
    assert rows(back.select("id")) == [(1,)]
    assert "PartitionFilters: [isnotnull(region" in back._jdf.queryExecution().executedPlan().toString()


def test_ingest_reads_each_file_once(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    source, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    (tmp_path / "in").mkdir()
    for day, text in enumerate(["a,b\n1,x\n2,y\n", "a,b\n3,z\n"]):
        (tmp_path / "in" / f"day{day}.csv").write_text(text)
        ingest_new_files(spark, source, target, progress, schema, header=True)
    assert ingest_new_files(spark, source, target, progress, schema, header=True) == 0
    assert rows(spark.read.schema(schema).parquet(target)) == [(1, "x"), (2, "y"), (3, "z")]
