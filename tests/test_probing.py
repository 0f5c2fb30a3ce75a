import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from risingtide.functions.text import normalised_name
from risingtide.operators import neighbours, probing
from risingtide.operators.enrich import join_on_name
from risingtide.plans.top_rank import category_totals


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")


def brute(q, x, k):
    gaps = np.sqrt(((q[:, None] - x[None]) ** 2).sum(axis=2))
    return [[int(i) for i in np.lexsort((np.arange(len(x)), g))[:k]] for g in gaps]


@pytest.mark.parametrize("cells, block", [(None, 8192), (3, 16)])
def test_all_cells_without_slack_are_nearly_exact(spark, cells, block):
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(300, 12)), rng.normal(size=(40, 12))
    x[5] = x[6] = x[7]
    q[0] = x[5]
    index, said = probing.build_index(frame(spark, x), cells=cells), {}
    got = probing.probed_neighbours(frame(spark, q), index, 4, probes=10**6, slack=6, block=block, said=said).collect()
    found = {(r["query_id"], r["rank"]): r for r in got}
    assert [[found[i, k]["point_id"] for k in range(1, 5)] for i in range(40)] == brute(q, x, 4)
    assert all(np.isclose(r["distance"], np.linalg.norm(q[r["query_id"]] - x[r["point_id"]])) for r in got)
    assert said["compared"] <= 300 * 40 and said["probes"] == said["cells"]


def test_clusters_need_few_cells(spark):
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(30, 32)) * 4
    x = middles[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 32)) * 0.3
    q = middles[rng.integers(0, 30, 100)] + rng.normal(size=(100, 32)) * 0.3
    index, said = probing.build_index(frame(spark, x)), {}
    got = probing.probed_neighbours(frame(spark, q), index, 5, said=said).collect()
    want = brute(q, x, 5)
    hits = sum(r["point_id"] in want[r["query_id"]] for r in got)
    assert hits >= 0.95 * 500 and len(got) == 500
    assert said["probes"] <= said["cells"] / 4 and said["compared"] < 0.15 * 300_000 and said["compared"] <= said["scanned"] + 300_000 / 10


def test_random_vectors_reach_the_recall_with_few_distances(spark):
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(2000, 64)), rng.normal(size=(150, 64))
    index, said = probing.build_index(frame(spark, x)), {}
    found = probing.probed_neighbours(frame(spark, q), index, 5, said=said)
    exact = spark.createDataFrame([(i, p) for i, near in enumerate(brute(q, x, 5)) for p in near], "query_id long, point_id long")
    assert probing.recall(found, exact) >= 0.9 and said["compared"] < 0.25 * 300_000


def test_one_hot_cell_is_cut_into_blocks(spark):
    x = np.zeros((500, 4))
    x[:20] = np.random.default_rng(4).normal(size=(20, 4)) * 50
    got = probing.probed_neighbours(frame(spark, x[:3]), probing.build_index(frame(spark, x)), 2, block=32).collect()
    assert {(r["query_id"], r["rank"]): r["point_id"] for r in got if r["rank"] == 1} == {(0, 1): 0, (1, 1): 1, (2, 1): 2}


def test_odd_and_missing_vectors(spark):
    bad = [None, [None, 1.0], [float("nan"), 1.0], [float("inf"), 0.0]]
    table = spark.createDataFrame([(i, v, "x") for i, v in enumerate([*bad, [0.0, 0.0], [3.0, 4.0]])], "id long, features array<double>, cell string")
    for got in (probing.probed_neighbours(table, probing.build_index(table), 5), neighbours.nearest_neighbours(table, table, 5)):
        assert rows(got.select("query_id", "point_id", "distance", "rank")) == [(4, 4, 0.0, 1), (4, 5, 5.0, 2), (5, 4, 5.0, 2), (5, 5, 0.0, 1)]
    assert probing.build_index(table.where("id < 4")) is None
    assert probing.probed_neighbours(table.where("id < 4"), probing.build_index(table), 5).count() == 0


@pytest.mark.parametrize("slice_rows", [2_000_000, 3])
def test_names_joined_in_slices(spark, slice_rows):
    left = spark.createDataFrame([(i, "Hot Channel" if i < 40 else f"C {i}") for i in range(50)] + [(99, None)], "n int, title string")
    right = spark.createDataFrame([("hotchannel", 1), ("HOT channel", 2), ("c45", 3), (None, 4), ("none", 5)], "user string, value int")
    got = join_on_name(left, right, normalised_name("title"), normalised_name("user"), rows_per_slice=slice_rows)
    assert got.columns == ["n", "title", "user", "value"]
    assert sorted((r["n"], r["value"]) for r in got.collect()) == sorted([(i, v) for i in range(40) for v in (1, 2)] + [(45, 3)])


def test_totals_of_a_country_not_listed(spark):
    report = spark.createDataFrame([("Music", "US", 2), ("Music", "FR", 1), ("News", "US", 5)], "name string, country string, rank_count long")
    assert rows(category_totals(report)) == rows(category_totals(report, countries=["FR", "US"])) == [("Music", 1, 2), ("News", None, 5)]
    for wrong in (report, report.withColumn("country", F.lit(None).cast("string"))):
        with pytest.raises(Exception, match="country not listed"):
            category_totals(wrong, countries=["US"]).collect()
