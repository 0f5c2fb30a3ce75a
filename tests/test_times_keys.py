import datetime as dt

from pyspark.sql import functions as F

from risingtide.functions import keys, times, vectors


def pair(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    return df.select(times.parse_time("a").alias("a"), times.parse_time("b").alias("b"))


def test_differences_floor_below_zero(spark):
    df = pair(spark, "2020-01-02T12:00:00Z", "2020-01-02T00:00:00Z")
    r = df.select(
        times.whole_days("a", "b"), times.calendar_days("a", "b"),
        times.inclusive_days("a", "b"), times.hours_between("a", "b"),
    ).first()
    assert tuple(r) == (-1, 0, 0, -12.0)


def test_bad_dates_are_null_and_buckets(spark):
    assert pair(spark, "no date", "2020-02-03T01:02:03Z").first()["a"] is None
    r = pair(spark, "2020-02-03T01:02:03Z", "2020-02-03T01:02:03Z").select(
        times.day_text("a"), times.month_text("a"), times.month_start("a")
    ).first()
    assert tuple(r) == ("2020-02-03", "2020-02", dt.datetime(2020, 2, 1))


def test_hash_sample_is_repeatable_and_about_right(spark):
    df = spark.range(20_000)
    n = df.where(keys.in_sample("id", 0.1)).count()
    assert 1_800 < n < 2_200
    assert n == df.repartition(7).where(keys.in_sample("id", 0.1)).count()
    assert df.where(keys.in_sample("id", 1.0)).count() == 20_000
    assert df.where(keys.in_sample("id", 0.0)).count() == 0
    nulls = spark.createDataFrame([(None,)], "k string").select(keys.in_sample("k", 1.0).alias("x"))
    assert nulls.first()["x"] is False


def test_vectors(spark):
    df = spark.createDataFrame([([0.0, 3.0], [4.0, 0.0], 1.0, 0.0)], "a array<double>, b array<double>, x double, y double")
    r = df.select(vectors.euclidean("a", "b"), vectors.share("x", "y"), vectors.share("y", "y")).first()
    assert tuple(r) == (5.0, 1.0, None)


def test_share_of_nothing_is_missing(spark):
    assert spark.range(1).select(vectors.share(F.lit(0.0), F.lit(0.0)).alias("s")).first()["s"] is None
