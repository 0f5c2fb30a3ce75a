import pytest
from pyspark.sql import functions as F

from conftest import rows
from risingtide.operators import ranking, snapshots


@pytest.fixture(scope="module")
def snaps(spark):
    data = [
        ("a", "2023-10-30", 1, 10), ("a", "2023-10-31", 2, 20), ("a", "2023-10-31", 3, 30),
        ("a", "2023-11-01", 4, 40), ("b", "2023-10-01", 5, 50), (None, "2023-10-02", 6, 60),
        (None, "2023-10-02", 7, 70), ("c", "2023-12-01", 8, 80),
    ]
    return spark.createDataFrame(data, "k string, d string, i int, v int")


def ids(df):
    return sorted(r["i"] for r in df.collect())


def test_cutoff_is_strict(snaps):
    assert ids(snapshots.before(snaps, "d", "2023-11-01")) == [1, 2, 3, 5, 6, 7]


def test_latest_one_and_all(snaps):
    early = snapshots.before(snaps, "d", "2023-11-01")
    assert ids(snapshots.latest_per_key(early, ["k"], "d", "first", ["i"])) == [2, 5, 6]
    assert ids(snapshots.latest_per_key(early, ["k"], "d", "all")) == [2, 3, 5, 6, 7]
    with pytest.raises(ValueError):
        snapshots.latest_per_key(early, ["k"], "d", "some")


def test_first_per_key_and_bounds(snaps):
    assert ids(snapshots.first_per_key(snaps, ["k"], "d", ["i"])) == [1, 5, 6, 8]
    got = {r["i"]: (r["first_date"], r["last_date"]) for r in snapshots.with_bounds(snaps, ["k"], "d").collect()}
    assert len(got) == 8 and got[2] == ("2023-10-30", "2023-11-01") and got[7] == ("2023-10-02", "2023-10-02")


def test_first_values_skip_missing(spark):
    df = spark.createDataFrame([("a", 1, None, "x"), ("a", 2, 5, "y")], "k string, o int, p int, q string")
    assert rows(snapshots.first_values(df, ["k"], ["p", "q"], ["o"])) == [("a", 5, "x")]


def test_typed_snapshot_never_fails_on_text(spark):
    data = [
        ("v", "2023-10-01T00:00:00Z", "2023-09-28T23:00:00Z", "FALSE", "10", "77"),
        ("w", "2023-10-02T00:00:00Z", "bad", None, "", "x"),
        ("v", "2023-11-01T00:00:00Z", "2023-09-28T23:00:00Z", "TRUE", "1", "1"),
    ]
    df = spark.createDataFrame(
        data, "video_id string, trending_date string, publishedAt string, comments_disabled string, categoryId string, view_count string"
    )
    got = snapshots.typed_snapshot(df).select(
        "video_id", "days_since_published", "comments_disabled", "categoryId", "view_count"
    )
    assert rows(got) == [("v", 3, False, 10, 77), ("w", None, None, None, None)]


def test_top_per_group_uses_a_group_limit_before_the_shuffle(spark):
    df = spark.range(1_000).withColumn("g", F.col("id") % 3)
    top = ranking.top_per_group(df, ["g"], [F.desc("id")], 2)
    assert rows(top.select("g", "id", "rank_value")) == [
        (0, 996, 2), (0, 999, 1), (1, 994, 2), (1, 997, 1), (2, 995, 2), (2, 998, 1)
    ]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_top_overall_is_one_step(spark):
    top = ranking.top_overall(spark.range(100), [F.desc("id")], 3)
    assert [r["id"] for r in top.collect()] == [99, 98, 97]
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()
