import random

import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F

from conftest import rows
from risingtide.operators import distribution, skew


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group, many equal values, some missing."""
    rng = random.Random(5)
    data = []
    for i in range(3_000):
        group = "hot" if i % 3 == 0 else f"g{rng.randrange(20)}"
        value = None if i % 50 == 0 else float(rng.choice([7, rng.randrange(200), rng.randrange(10_000)]))
        data.append((i, group, value))
    data.append((3_000, None, 1.0))
    return spark.createDataFrame(data, "id bigint, g string, v double").cache()


@pytest.mark.parametrize("range_rows", [5, 40])
def test_running_before(skewed, range_rows):
    counts = distribution.value_counts(skewed, "v", ["g"])
    got = distribution.running_before(counts, "v", "n", ["g"], range_rows=range_rows)
    w = W.partitionBy("g").orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    want = counts.select(
        "g", "v", "n", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"),
        F.sum("n").over(W.partitionBy("g")).alias("total"),
    )
    assert rows(got.select("g", "v", "n", "before", "total")) == rows(want)


def test_quantiles_per_group_and_overall(skewed):
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    local = skewed.where("v IS NOT NULL").toPandas()
    for group, q in distribution.quantiles(skewed, "v", probs, ["g"]).collect():
        mine = local[local["g"] == group]["v"] if group else local[local["g"].isna()]["v"]
        assert np.allclose(q, np.quantile(mine, probs))
    q = distribution.quantiles(skewed, "v", probs).first()["quantiles"]
    assert np.allclose(q, np.quantile(local["v"], probs))


@pytest.mark.parametrize("tiles", [2, 4, 7])
def test_exact_tiles_equal_ntile(skewed, tiles):
    known = skewed.where("v IS NOT NULL")
    got = distribution.exact_tiles(known, "v", "id", tiles).select("id", "tile")
    want = known.select("id", F.ntile(tiles).over(W.orderBy("v", "id")).alias("tile"))
    assert rows(got) == rows(want)


def test_fewer_rows_than_tiles(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 3.0)], "id bigint, v double")
    assert rows(distribution.exact_tiles(df, "v", "id", 4).select("id", "tile")) == [(1, 2), (2, 1)]


def test_quartile_edges_go_to_the_lower_bin(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5]] + [(None,)], "v double")
    got = rows(distribution.quartile_bins(df, "v"))
    assert got == [(None, None), (1.0, 1), (2.0, 1), (3.0, 2), (4.0, 3), (5.0, 4)]


def test_dense_rank_within(skewed):
    got = distribution.dense_rank_within(skewed, ["g"], "v", "r")
    want = skewed.withColumn("r", F.dense_rank().over(W.partitionBy("g").orderBy("v")).cast("bigint"))
    present = "v IS NOT NULL"
    assert got.count() == skewed.count()
    a = {r["id"]: r["r"] for r in got.where(present).collect()}
    b = {r["id"]: r["r"] for r in want.where(present).collect()}
    assert a == b


def test_box_stats(skewed):
    local = skewed.where("v IS NOT NULL AND g IS NOT NULL").toPandas()
    for r in distribution.box_stats(skewed.where("g IS NOT NULL"), "v", ["g"]).collect():
        mine = local[local["g"] == r["g"]]["v"].to_numpy()
        q1, q2, q3 = np.quantile(mine, [0.25, 0.5, 0.75])
        inside = mine[(mine >= q1 - 1.5 * (q3 - q1)) & (mine <= q3 + 1.5 * (q3 - q1))]
        assert np.allclose(
            [r["n"], r["whisker_low"], r["q1"], r["median"], r["q3"], r["whisker_high"]],
            [len(mine), inside.min(), q1, q2, q3, inside.max()],
        )


@pytest.mark.parametrize("slice_rows", [50, 10**9])
@pytest.mark.parametrize("how", ["inner", "left_semi"])
def test_join_per_key_with_and_without_slices(skewed, slice_rows, how):
    stats = skewed.groupBy("g").agg(F.max("v").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 40 OR g IS NULL")
    got = skew.join_per_key(skewed, stats, ["g"], "n", how, rows_per_slice=slice_rows)
    w = W.partitionBy("g")
    want = skewed.withColumn("top", F.max("v").over(w)).withColumn("n", F.count(F.lit(1)).over(w))
    want = want.where("n > 40 OR g IS NULL").drop("n")
    if how == "left_semi":
        want = want.drop("top")
    assert got.columns == want.columns
    assert rows(got) == rows(want)


def test_slices_split_exact_copies(spark):
    """Copies of one row must not all meet in one slice."""
    df = spark.createDataFrame([("k", 1.0)] * 4_000, "g string, v double").repartition(8)
    stats = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    got = skew.join_per_key(df, stats, ["g"], "n", rows_per_slice=500)
    assert got.count() == 4_000


def test_dense_rank_of_missing_values_comes_first(spark):
    df = spark.createDataFrame([("a", None), ("a", None)], "g string, v double")
    assert [r["r"] for r in distribution.dense_rank_within(df, ["g"], "v", "r").collect()] == [1, 1]
    mixed = df.unionByName(spark.createDataFrame([("a", 5.0), ("b", 2.0)], df.schema))
    got = distribution.dense_rank_within(mixed, ["g"], "v", "r")
    assert rows(got) == [("a", None, 1), ("a", None, 1), ("a", 5.0, 2), ("b", 2.0, 1)]
