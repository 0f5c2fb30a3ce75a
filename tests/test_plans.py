import datetime as dt

from pyspark.sql import functions as F

from conftest import rows
from risingtide.operators import enrich, split
from risingtide.plans import preprocess, top_rank
from risingtide.plans.durations import feature_table
from risingtide.schemas import CHANNEL_STATS

FACTS = [
    ("a", "2020-08-11T19:00:00Z", 22, 100), ("b", "2020-08-11T19:00:00Z", 24, 300),
    ("c", "2020-08-11T01:00:00Z", 24, 200), ("c", "2020-08-11T01:00:00Z", 24, 250),
    ("d", "2020-08-11T01:00:00Z", 99, 260), ("e", "2020-08-12T01:00:00Z", 22, 5),
    ("e", "2020-09-12T01:00:00Z", 22, 5), ("f", "2020-09-12T01:00:00Z", 24, 5),
]


def facts(spark):
    return spark.createDataFrame(FACTS, "video_id string, publishedAt string, categoryId int, view_count bigint")


def names(spark):
    return spark.createDataFrame([(22, "Blogs"), (24, "Shows")], "id int, name string")


def test_top_rank_and_its_sql(spark):
    got = [tuple(r) for r in top_rank.top_rank(facts(spark), names(spark), 3).collect()]
    # b, d and c are the day's top three; the unknown 99 takes a place and vanishes.
    assert got == [
        ("2020-09", "22", "Blogs", 1), ("2020-09", "24", "Shows", 1),
        ("2020-08", "24", "Shows", 2), ("2020-08", "22", "Blogs", 1),
    ]
    for n in (1, 2, 3, 10):
        a = top_rank.top_rank(facts(spark), names(spark), n).collect()
        assert a == top_rank.top_rank_sql(spark, facts(spark), names(spark), n).collect()


def test_totals(spark):
    report = top_rank.top_rank(facts(spark), names(spark), 3)
    wide = top_rank.category_totals({"US": report, "GB": report.where("type = '22'")})
    assert rows(wide) == [("Blogs", 2, 2), ("Shows", 3, None)]
    chosen = top_rank.monthly_totals(report, ["24"])
    assert rows(chosen) == [("2020-08", "Shows", "24", 2), ("2020-09", "Shows", "24", 1)]


def test_generate_top_rank_from_files(spark, tmp_path):
    from risingtide.schemas import VIDEOS

    head = ",".join(VIDEOS.fieldNames())
    line = 'v1,t,2020-08-11T19:20:14Z,c,C,22,2020-08-12T00:00:00Z,[None],10,1,1,1,l,FALSE,FALSE,"two\nlines"'
    (tmp_path / "v.csv").write_text(f"{head}\n{line}\nbroken,row\n")
    (tmp_path / "c.csv").write_text('"id","title"\n22,"Blogs, etc"\n')
    out = str(tmp_path / "out")
    top_rank.generate_top_rank(spark, str(tmp_path / "c.csv"), str(tmp_path / "v.csv"), out)
    (part,) = (tmp_path / "out").glob("part-*.csv")
    assert part.read_text() == 'date,type,name,rank_count\n2020-08,22,"Blogs, etc",1\n'


def test_lookup_miss_and_fill(spark):
    videos = spark.createDataFrame([("a", 22, None), ("b", 7, "d")], "video_id string, categoryId int, description string")
    cats = spark.createDataFrame([("22", "Blogs")], "id string, category string")
    assert rows(preprocess.preprocess(videos, cats)) == [("a", 22, "", "Blogs"), ("b", 7, "d", None)]
    assert rows(enrich.combine_category(videos.drop("description"), cats)) == [("a", "Blogs"), ("b", None)]


def test_key_set_joins_and_null_keys(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "i int, k string")
    keys = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert [r["i"] for r in enrich.keep_keys(df, keys, ["k"]).collect()] == [1]
    assert sorted(r["i"] for r in enrich.drop_keys(df, keys, ["k"]).collect()) == [2, 3]
    flags = {r["i"]: r["_merge"] for r in enrich.with_match(df, keys, ["k"]).collect()}
    assert flags == {1: "both", 2: "left_only", 3: "left_only"}


def test_splits_are_disjoint_and_complete(spark):
    df = spark.range(2_000).withColumn("channelId", F.concat(F.lit("c"), F.col("id") % 50))
    df = df.unionByName(spark.createDataFrame([(5_000, None)], df.schema))
    train, test = preprocess.split_channels(df, 0.2)
    assert train.count() + test.count() == 2_001 and test.count() > 0
    assert not {r[0] for r in train.select("channelId").distinct().collect()} & {
        r[0] for r in test.select("channelId").distinct().collect()
    }
    a, b = split.random_split(df, [0.8, 0.2], 3)
    assert a.count() + b.count() == 2_001
    assert split.random_sample(df, 0.5, 3).count() == split.random_sample(df, 0.5, 3).count()


def test_translation_rules(spark):
    videos = spark.createDataFrame(
        [("US", "v", "titel", "[NONE]", ""), ("US", "w", "alt", "x|y", "lang"), ("US", "v", "titel", "a", None)],
        "country string, video_id string, title string, tags string, description string",
    )
    words = spark.createDataFrame(
        [("US", "v", "title", "A &amp; B"), ("US", "v", "tags", "no"), ("US", "v", "description", "d"), ("GB", "w", "title", "other")],
        "country string, video_id string, field string, text string",
    )
    got = rows(enrich.translate(videos, words))
    assert got == [
        ("US", "v", "A & B", "[NONE]", ""), ("US", "v", "A & B", "no", "d"), ("US", "w", "alt", "x|y", "lang"),
    ]
    assert rows(enrich.untranslated(videos, words)) == [("US", "w")]


def test_frequent_key_sample_keeps_all_rows(spark):
    df = spark.range(600).select((F.col("id") % 40).alias("k"), "id").unionByName(
        spark.range(3).select(F.lit(99).cast("bigint").alias("k"), "id")
    )
    got = enrich.sample_frequent_keys(df, "k", 5, 0.5)
    counts = {r["k"]: r["count"] for r in got.groupBy("k").count().collect()}
    assert set(counts.values()) == {15} and 0 < len(counts) < 40 and 99 not in counts
    assert enrich.sample_frequent_keys(df, "k", 5, 1.0).count() == 600


def test_regularised_countries(spark):
    raw = spark.createDataFrame(
        [("v", "My Song!", "2020-01-01T00:00:00Z", 10, "2020-01-02T00:00:00Z", "A| b", "The best song")],
        "video_id string, title string, publishedAt string, categoryId int, trending_date string, tags string, description string",
    )
    cats = spark.createDataFrame([("10", "Music")], "id string, category string")
    parts = [preprocess.country_rows(raw, cats, c, raw.columns, stopwords=["the"]) for c in ("US", "GB")]
    got = preprocess.all_countries(parts)
    assert got.count() == 2
    first = got.where("region = 'US'").first()
    assert first["title"] == ["my", "song"] and first["tags"] == ["A", "b"] and first["description"] == ["best", "song"]
    assert first["category"] == "Music" and first["publishedAt"] == dt.datetime(2020, 1, 1)


def test_duration_features_over_regions(spark):
    t = lambda d, h=0: dt.datetime(2020, 1, d, h)
    cols = (
        "video_id string, title string, publishedAt timestamp, channelTitle string, category string, "
        "trending_date timestamp, view_count string, likes bigint, dislikes bigint, comment_count bigint, region string"
    )
    videos = spark.createDataFrame(
        [
            ("v", "t", t(1), "My Chan", "c", t(2), "9", 1, 1, 1, "US"),
            ("v", "t", t(1), "My Chan", "c", t(5), "10", 2, 1, 1, "GB"),
            ("v", "t", t(1), "My Chan", "c", t(3, 12), "7", 2, 1, 1, "US"),
            ("w", "t", t(1), "My Chan", None, t(3), "7", 2, 1, 1, "US"),
            ("x", "t", t(1), "Unknown", "c", t(3), "7", 2, 1, 1, "US"),
        ],
        cols,
    ).withColumn("view_count", F.col("view_count").try_cast("bigint"))
    stats = spark.createDataFrame([("myCHAN", 1.0, 2.0, 3.0, 4.0)], CHANNEL_STATS)
    got = feature_table(videos, stats)
    picked = got.select("video_id", "region", "becomeTrendingDuration", "endTrendingDuration", "view_count")
    assert rows(picked) == [("v", "GB", 24.0, 72.0, 10), ("v", "US", 24.0, 72.0, 9)]
    alone = feature_table(videos, stats, per_region=True).select("region", "becomeTrendingDuration", "endTrendingDuration")
    assert rows(alone) == [("GB", 96.0, 0.0), ("US", 24.0, 36.0)]


def test_file_jobs_from_raw_to_rank_metrics(spark, tmp_path):
    """Preprocess, split, train and evaluate on small files."""
    from risingtide.operators.models import decision_tree
    from risingtide.plans.view_counts import train_and_evaluate
    from risingtide.schemas import VIDEOS

    lines = [",".join(VIDEOS.fieldNames())]
    for i in range(120):
        word = "big" if i % 2 else "small"
        lines.append(
            f'v{i},t,2023-08-11T19:20:14Z,ch{i % 12},C,22,2023-08-12T00:00:00Z,{word}|x,'
            f'{1000 * (i % 2) + i},1,1,1,l,FALSE,FALSE,"{word}\ntext"'
        )
    lines.append('late,t,2023-08-11T19:20:14Z,ch1,C,22,2023-12-12T00:00:00Z,x,5,1,1,1,l,FALSE,FALSE,late')
    (tmp_path / "US_v.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "US_c.json").write_text('{"items": [{"id": "22", "snippet": {"title": "Blogs"}}]}')
    raw, cats = str(tmp_path / "US_v.csv"), str(tmp_path / "US_c.json")

    done = str(tmp_path / "processed")
    preprocess.preprocess_file(spark, raw, cats, done)
    back = spark.read.csv(done, header=True, multiLine=True, escape='"')
    assert back.count() == 121 and rows(back.select("category_name").distinct()) == [("Blogs",)]

    known, held_out = str(tmp_path / "train"), str(tmp_path / "test")
    preprocess.split_file(spark, raw, known, held_out, 0.4)
    model, found = train_and_evaluate(
        spark, [known], [held_out], decision_tree(depth=3), ["text"], str(tmp_path / "report")
    )
    n = spark.read.csv(held_out, header=True, multiLine=True, escape='"').where("video_id <> 'late'").count()
    got = found.first()
    assert got["n"] == n and 0 < n < 120 and got["mae"] < 10
    report = spark.read.csv(str(tmp_path / "report"), header=True)
    assert report.count() == min(100, n) and "predicted" in report.columns

    stacked = preprocess.load_countries(spark, {"US": (raw, cats)})
    assert rows(stacked.select("category", "region").distinct()) == [("Blogs", "US")]
