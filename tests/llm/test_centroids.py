import hashlib
import random

import numpy as np
import pytest

from risingtide.llm import centroids as C

COLUMNS = "vec_id long, embedding array<float>, cluster string, point int"


def brute(rows, dims, clusters, rounds, scale=64):
    kept = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v, *_ in rows
            if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in named[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        found = [nearest(v)[1] for _, v in kept]
        for n in range(len(centres)):
            own = [v for (_, v), f in zip(kept, found) if f == n]
            if own:
                centres[n] = [sum(column) // len(own) for column in zip(*own)]
    last = [nearest(v) for _, v in kept]
    sums = {n: sum(d for d, m in last if m == n) for n in range(len(centres))}
    return [(i, n, d, sums[n], sum(sums.values()), hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest())
            for (i, _), (d, n) in zip(kept, last)]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, *(x or 0 for x in r[:3])))


def odd_rows(n, dims, seed=3):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 2) for _ in range(dims)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(middles)], "c", i) for i in range(n)]
    good = [1.0] * dims
    rows += [(n, None, "c", 0), (n + 1, [], "c", 0), (n + 2, good[1:], "c", 0), (n + 3, [*good, 1.0], "c", 0),
             (n + 4, [None, *good[1:]], "c", 0), (n + 5, [float("nan"), *good[1:]], "c", 0),
             (n + 6, [float("-inf"), *good[1:]], "c", 0), (None, good, None, None), (None, None, None, None),
             (n + 7, [0.0] * dims, None, 1), (n + 8, [-0.0] * dims, None, 1)]
    return rows + rows[:4] + [(rows[0][0], rows[1][1], "c", 0)]


@pytest.mark.parametrize("n, dims, clusters, lead", [(200, 6, 7, 2), (120, 6, 16, 6), (3, 6, 16, 2), (60, 64, 16, 12)])
def test_clusters_match_all_distances(spark, n, dims, clusters, lead):
    rows = odd_rows(n, dims)
    table = spark.createDataFrame(rows, COLUMNS).repartition(3)
    found = C.cluster_vectors(table, dims=dims, clusters=clusters, lead=lead)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "compared"]
    assert ordered([tuple(r)[:6] for r in found.collect()]) == ordered(brute(rows, dims, clusters, 3))


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [x, 0.0], "c", 0) for i in range(6) for x in (0.0, 1.0, 2.0)] * 3
    table = spark.createDataFrame(rows, COLUMNS)
    for rounds in (0, 1, 3):
        found = C.cluster_vectors(table, dims=2, clusters=5, rounds=rounds)
        assert ordered([tuple(r)[:6] for r in found.collect()]) == ordered(brute(rows, 2, 5, rounds))


def test_far_centroids_are_not_compared(spark):
    rng = np.random.default_rng(1)
    middles = rng.normal(0, 4, (16, 3)) @ rng.normal(0, 1, (3, 64))
    rows = [(i, (middles[i % 16] + rng.normal(0, 0.05, 64)).tolist(), "c", 0) for i in range(640)]
    found = C.cluster_vectors(spark.createDataFrame(rows, COLUMNS), lead=4).collect()
    assert sum(r["compared"] for r in found) < 0.25 * 16 * len(found)


def test_bounds_never_exceed_distances():
    rng = np.random.default_rng(2)
    points = rng.integers(-1 << 26, 1 << 26, (300, 8))
    rotation = C.Rotation(points.mean(axis=0), np.linalg.qr(rng.normal(size=(8, 8)))[0], 3)
    centres = points[:40] + rng.integers(-2, 3, (40, 8))
    found, distance, compared = C.nearest(points, *rotation(points), centres, rotation)
    every = ((points[:, None].astype(object) - centres.astype(object)) ** 2).sum(axis=2)
    assert found.tolist() == [int(np.argmin(row)) for row in every.astype(float)] or all(
        every[i][found[i]] == min(every[i]) for i in range(len(points)))
    assert distance.tolist() == [min(row) for row in every.tolist()] and compared.max() <= 40


def test_empty_tables_and_too_large_components(spark):
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "compared"]
    for rows in ([], [(1, None, "c", 0)], [(None, [0.0] * 64, "c", 0)]):
        found = C.cluster_vectors(spark.createDataFrame(rows, COLUMNS))
        assert found.columns == names and found.count() == 0
    with pytest.raises(Exception, match="too large"):
        C.cluster_vectors(spark.createDataFrame([(1, [1e9] * 64, "c", 0)], COLUMNS)).collect()
