"""What a task holds, reads or sends does not follow the size of a file, a group or the table."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from risingtide.operators import indexing, models, neighbours, probing, warping
from risingtide.schemas import VIDEOS
from risingtide.sinks import writers
from risingtide.sources import readers, records


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")


def test_trees_hold_few_statistics(spark):
    for regressor in (models.decision_tree(), models.random_forest(), models.boosted_trees()):
        assert 4 * regressor.getMaxMemoryInMB() <= 2_048


def test_partitions_of_train_rows_are_small():
    # A round of boosting reads the binned rows three times, 4 bytes a feature.
    assert models.FIT_ROWS * 578 * 4 * 3 <= 200e6


def test_regions_hold_neighbouring_cells():
    rng = np.random.default_rng(1)
    centres, sizes = rng.normal(size=(60, 3)), rng.integers(0, 40, 60)
    sizes[7] = 900
    region = neighbours.regions_of(centres, sizes, 100)
    held = np.bincount(region, weights=sizes)
    assert sorted(set(region)) == list(range(len(held))) and len(held) < 40
    assert all(n <= 100 or (region == r).sum() == 1 for r, n in enumerate(held))


def test_queries_travel_by_region(spark):
    x = np.random.default_rng(2).normal(size=(60, 8))
    queries = spark.createDataFrame([(i, v.tolist(), 0, None) for i, v in enumerate(x)], "id long, vec array<double>, cell int, bound double")
    region, sizes = np.arange(30, dtype=np.int32) // 10, np.full(30, 2)
    got = neighbours._routed(queries, x[:30], np.full(30, 100.0), sizes, region, 5).collect()
    assert len(got) == 60 * 3 and sum(r["pairs"] for r in got) == 60 * 29 * 2


def test_probed_cells_in_regions(spark):
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(400, 6)), rng.normal(size=(30, 6))
    index = probing.build_index(frame(spark, x), cells=20)
    got = [rows(probing.probed_neighbours(frame(spark, q), index, 3, probes=20, slack=6, block=block)) for block in (9, 100, 8_192)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 90


def test_copies_of_a_vector_are_compared_in_little_memory():
    x = np.ones((700, 64))
    tracemalloc.start()
    row, col, gap = neighbours._nearest_in_block(x, x, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6 and (col.reshape(700, 5) == np.arange(5)).all() and not gap.any()


def test_only_the_first_copies_are_compared(spark):
    assert neighbours.first_copies(np.array([[1.0, 2], [0, 0], [1, 2], [1, 2], [0, 0], [3, 3]]), 2).tolist() == [0, 1, 2, 4, 5]
    points = np.array([[0.0, 0], [5, 5], [0, 0], [0, 0], [1, 0], [0, 0]])
    for block in (2, 100):
        got = neighbours.nearest_neighbours(frame(spark, np.zeros((3, 2))), frame(spark, points), 3, block=block)
        assert rows(got.select("query_id", "point_id", "distance")) == [(q, p, 0.0) for q in range(3) for p in (0, 2, 3)]


def test_probed_copies_of_a_vector_take_little_memory(spark):
    x = np.ones((700, 64))
    row, col = np.divmod(np.arange(490_000), 700)
    tracemalloc.start()
    gap = probing.gaps_of(x, 2 * x, row, col)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6 and (gap == 8).all()


def test_series_are_spread_by_their_work(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(50, 6)))], "id long, s array<double>").coalesce(1)
    spread = warping._spread(df, "id", 3 * 36, 500)
    assert rows(spread) == rows(df) and spread.select(F.input_file_name()).distinct().count() > 5
    assert warping.alignment_table(rng.normal(size=(9, 4)), np.zeros(4)).strides[0] == 8


def test_large_files_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "FILE_ROWS", 4)
    df = spark.range(30).select(*[
        F.concat(F.lit('a "b"\n\n'), F.col("id").cast("string")).alias(f.name) if f.name == "description"
        else F.col("id").cast("string").alias(f.name) if f.name == "video_id" else F.lit(None).cast(f.dataType).alias(f.name) for f in VIDEOS])
    for country in ("AA", "BB"):
        writers.write_csv_file(df, str(tmp_path / f"{country}_videos.csv"), large=True)
    assert len(list((tmp_path / "AA_videos.csv").glob("part-*"))) >= 8
    read = readers.read_countries(spark, str(tmp_path / "*_videos.csv"))
    want = [(c, str(i), f'a "b"\n\n{i}') for c in ("AA", "BB") for i in range(30)]
    assert rows(read.select("country", "video_id", "description")) == sorted(want)
    good, bad = records.read_records(spark, str(tmp_path / "BB_videos.csv"), VIDEOS)
    assert good.count() == 30 and bad.count() == 0
    writers.write_csv(df.coalesce(1), str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("part-*"))) == 8


def test_documents_are_shuffled_once(spark):
    docs = spark.createDataFrame([(1, ["b", "a", "b"]), (2, ["a"]), (2, ["c", "a"]), (None, ["c"]), (3, None)], "k long, t array<string>")
    vectors = indexing.sparse_vectors(indexing.tfidf_entries(docs, "k", "t"), "k")
    assert vectors._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(k#") == 1
    assert rows(vectors.select("k", "positions")) == [(None, [2]), (1, [0, 1]), (2, [0, 2])]


def test_a_round_aligns_series_with_their_own_centroid_and_few_others():
    rng = np.random.default_rng(8)
    x, old = rng.normal(size=(90, 11)), rng.normal(size=(3, 11))
    new = old + 0.01 * rng.normal(size=old.shape)
    aligner = warping.Aligner(11, 11, 90)
    tables = [warping.alignment_table(x, c) for c in new]
    costs = np.stack([t[:, -1, -1] for t in tables], axis=1)
    assert np.array_equal(warping._every_cost(x, new, warping.Aligner(11, 11, 40)), costs)
    before, slack = np.sqrt(warping._every_cost(x, old, aligner)), warping._slack(old, new)
    assert (np.abs(np.sqrt(costs) - before) <= slack + 1e-12).all()
    found = warping._Round(np.zeros(new.shape), np.zeros(new.shape, dtype=np.int64))
    found.add(x, before, slack, new, aligner)
    labels = costs.argmin(axis=1)
    for c in range(3):
        sums, hits = warping.aligned_sums(x, tables[c], np.flatnonzero(labels == c))
        assert np.allclose(found.totals[c], sums) and np.array_equal(found.hits[c], hits)
    assert found.cost == pytest.approx(costs.min(axis=1).sum()) and found.mark == warping._label_mark(x, labels)
    assert found.series == 90 and found.again < 45
    sure = warping._Round(np.zeros(new.shape), np.zeros(new.shape, dtype=np.int64))
    sure.add(x, before, np.full(3, np.inf), new, aligner)
    assert sure.again >= 180 and np.allclose(sure.totals, found.totals) and sure.far == found.far


def test_neighbours_among_codes_and_numbers_compare_few_pairs(spark):
    rng = np.random.default_rng(9)
    codes = rng.integers(0, 4, size=(4_000, 4)) * 2.5
    x = np.c_[rng.normal(size=(4_000, 2)), codes, np.full(4_000, 5_000.0)]
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, features array<double>")
    said = {}
    found = neighbours.nearest_neighbours(p.where("id % 10 = 0"), p, 4, block=500, said=said)
    got = {(r["query_id"], r["rank"]): r["point_id"] for r in found.collect()}
    for i in range(0, 4_000, 200):
        gaps = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        assert [got[i, r] for r in range(1, 5)] == np.lexsort((np.arange(4_000), gaps))[:4].tolist()
    assert said["pairs"] < 0.06 * 4_000 * 400


def test_boxes_find_the_nearest_outside_a_querys_cell():
    rng = np.random.default_rng(5)
    for n, d, places in ((5, 3, 1), (700, 4, 1), (3_000, 9, 0)):
        p, x = np.round(rng.normal(size=(n, d)), places), np.round(rng.normal(size=(40, d)), places)
        cells, own = rng.integers(0, 4, n), rng.integers(0, 4, 40)
        gaps = np.stack([np.sqrt(((p - v) ** 2).sum(axis=1)) for v in x])
        for bound in (np.full(40, np.inf), np.sort(gaps, axis=1)[:, 4], np.full(40, 0.01)):
            row, col, gap = neighbours.Searched(p).nearest(x, own, cells, bound, 5)
            for i in range(40):
                near = np.flatnonzero((cells != own[i]) & (gaps[i] <= bound[i]))
                want = near[np.lexsort((near, gaps[i][near]))][:5]
                assert col[row == i].tolist() == want.tolist() and np.array_equal(gap[row == i], gaps[i][want])
    cuts = neighbours.Cuts(p, 8)
    sizes = np.diff(np.r_[cuts.starts, len(p)])
    assert np.array_equal(cuts.part(p)[cuts.order], np.repeat(np.arange(len(sizes)), sizes))


def test_a_forests_statistics_fit_beside_stored_rows():
    # Two tasks, each with as much again while it merges, in what an executor of 1,800 MB keeps for neither rows nor shuffles.
    assert 2 * 2 * models.random_forest().getMaxMemoryInMB() <= 0.4 * (1_800 - 300)
