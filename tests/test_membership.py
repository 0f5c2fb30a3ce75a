import pytest
from pyspark.sql import functions as F

from conftest import rows
from risingtide.operators.enrich import keep_keys
from risingtide.operators.membership import maybe_listed


def test_all_listed_keys_and_few_others_pass(spark):
    df = spark.range(200_000).select("id", (F.col("id") * 7).cast("string").alias("key"), F.lit(1).alias("__bits"))
    keys = df.where("id % 20 = 3").select("key").union(spark.createDataFrame([(None,), ("beyond",)], "key string"))
    passed = maybe_listed(df, keys, ["key"])
    assert passed.columns == df.columns
    found = passed.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") % 20 == 3).alias("listed")).first()
    # These are the rows that the exchange of the join behind it gets.
    assert found["listed"] == 10_000 and found["n"] < 10_000 + 0.02 * 190_000
    plan = passed._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "Python" not in plan
    assert rows(keep_keys(df, keys, ["key"], screen=True).select("id")) == rows(df.where("id % 20 = 3").select("id"))


@pytest.mark.parametrize("screen", [False, True])
def test_several_key_columns_nulls_and_repeats(spark, screen):
    df = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "a", 2), (None, "a", 3), (1, None, 4), (1, "a", 5)], "k int, c string, n int")
    keys = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (1, None), (3, "z")], "k int, c string")
    assert rows(keep_keys(df, keys, ["k", "c"], screen=screen).select("n")) == [(0,), (5,)]
    assert keep_keys(df, keys.limit(0), ["k", "c"], screen=screen).count() == 0
    assert keep_keys(df.limit(0), keys, ["k", "c"], screen=screen).count() == 0


def test_too_many_keys_are_not_screened(spark):
    df = spark.range(10)
    assert maybe_listed(df, spark.range(5), ["id"], max_bitmaps=0) is df
