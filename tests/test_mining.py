import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from risingtide.functions.text import alpha_term, letter_digit_runs
from risingtide.operators import features, metrics, models, neighbours, series, terms, warping


def corpus(spark):
    rng = random.Random(3)
    docs = [[rng.choice("abcdefghij") * rng.choice([1, 2]) for _ in range(rng.randrange(12))] for _ in range(60)]
    docs += [["aa", "b", "b"]] * 40 + [[]]
    return docs, spark.createDataFrame([(d,) for d in docs], "tokens array<string>")


def test_tfidf_matches_the_textbook_form(spark):
    docs, df = corpus(spark)
    total = Counter(t for d in docs for t in d)
    vocabulary = [t for t, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:6]]
    idf = {t: math.log((1 + len(docs)) / (1 + sum(t in d for d in docs))) + 1 for t in vocabulary}
    score = Counter()
    for d in docs:
        w = {t: d.count(t) * idf[t] for t in vocabulary if t in d}
        norm = math.sqrt(sum(x * x for x in w.values()))
        for t, x in w.items():
            score[t] += x / norm
    got = {r["term"]: (r["idf"], r["score"]) for r in terms.tfidf_top_terms(df, "tokens", 6).collect()}
    assert got.keys() == idf.keys()
    for t in vocabulary:
        assert got[t] == pytest.approx((idf[t], score[t]))


def test_term_stats_and_groups(spark):
    docs, df = corpus(spark)
    got = {r["term"]: (r["count"], r["doc_count"]) for r in terms.term_stats(df, "tokens").collect()}
    assert got == {
        t: (sum(d.count(t) for d in docs), sum(t in d for d in docs)) for t in {t for d in docs for t in d}
    }
    grouped = df.withColumn("g", F.size("tokens") % 2)
    low = terms.lowest_idf_by_group(grouped, "tokens", "g", 3)
    for g in (0, 1):
        mine = [d for d in docs if len(d) % 2 == g]
        want = sorted(((-sum(t in d for d in mine), t) for t in {t for d in mine for t in d}))[:3]
        assert [r["term"] for r in low.where(F.col("g") == g).orderBy("rank").collect()] == [t for _, t in want]


def test_term_test_is_applied(spark):
    df = spark.createDataFrame([("Videos of cats cats 4k the",)], "x string")
    df = df.select(letter_digit_runs("x").alias("tokens"))
    assert rows(terms.term_counts(df, "tokens", keep=alpha_term(["the"]))) == [("cats", 2), ("of", 1)]


def test_stacked_texts(spark):
    df = spark.createDataFrame([(1, "d", "t")], "id int, description string, title string")
    assert rows(terms.stack_texts(df, ["description", "title"])) == [(1, "d"), (1, "t")]


# ---------------------------------------------------------------- neighbours


@pytest.mark.parametrize("block", [7, 8_192])
def test_neighbours_equal_brute_force(spark, block):
    rng = np.random.default_rng(1)
    points = np.round(rng.normal(size=(150, 4)), 1)
    points[20:60] = points[0]  # many copies of one point
    queries = np.vstack([np.round(rng.normal(size=(25, 4)), 1), points[:2], 100 + rng.normal(size=(3, 4))])
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "id bigint, features array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "id bigint, features array<double>")
    got = neighbours.nearest_neighbours(q, p, 5, pivots=6, block=block)
    found = {(r["query_id"], r["rank"]): (r["point_id"], r["distance"]) for r in got.collect()}
    assert len(found) == len(queries) * 5
    for i, v in enumerate(queries):
        d = np.sqrt(((points - v) ** 2).sum(axis=1))
        for rank, j in enumerate(np.lexsort((np.arange(len(d)), d))[:5], 1):
            assert found[i, rank][0] == j and found[i, rank][1] == pytest.approx(d[j])


@pytest.mark.parametrize("n", [1_000, 4_000])
def test_neighbours_in_clusters_compare_few_pairs(spark, n):
    rng = np.random.default_rng(3)
    centres = rng.normal(scale=50, size=(40, 6))
    data = centres[rng.integers(0, 40, n)] + rng.normal(size=(n, 6))
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id bigint, features array<double>")
    q, said = p.where("id % 5 = 0"), {}
    got = {(r["query_id"], r["rank"]): r["point_id"] for r in neighbours.nearest_neighbours(q, p, 4, said=said).collect()}
    for i in range(0, n, 50):
        gaps = np.sqrt(((data - data[i]) ** 2).sum(axis=1))
        assert [got[i, r] for r in range(1, 5)] == np.lexsort((np.arange(n), gaps))[:4].tolist()
    assert said["pairs"] < 0.15 * n * n / 5


def test_neighbours_fewer_points_than_k(spark):
    p = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "id bigint, features array<double>")
    got = neighbours.nearest_neighbours(p, p, 5)
    assert rows(got.select("query_id", "rank", "point_id")) == [(1, 1, 1), (1, 2, 2), (2, 1, 2), (2, 2, 1)]
    labels = p.withColumn("y", F.col("id") * 10)
    assert rows(neighbours.neighbour_mean(got, labels, "id", "y")) == [(1, 15.0), (2, 15.0)]


# ---------------------------------------------------------------- series


def dtw(a, b):
    t = np.full((len(a) + 1, len(b) + 1), np.inf)
    t[0, 0] = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i, j] = (a[i - 1] - b[j - 1]) ** 2 + min(t[i - 1, j - 1], t[i - 1, j], t[i, j - 1])
    return math.sqrt(t[-1, -1])


def test_alignment_equals_plain_warping():
    rng = np.random.default_rng(2)
    x, c = rng.normal(size=(5, 9)), rng.normal(size=9)
    table = warping.alignment_table(x, c)
    assert np.allclose(np.sqrt(table[:, -1, -1]), [dtw(r, c) for r in x])
    sums, hits = warping.aligned_sums(x, table)
    assert (hits >= 5).all() and hits.sum() <= 5 * 17 and np.isfinite(sums).all()


def test_clusters_follow_shape_not_position(spark):
    rng = np.random.default_rng(4)
    data = []
    for i in range(60):
        s, at = np.zeros(12), rng.integers(2, 7)
        if i % 3 == 0:
            s[at : at + 3] = 3
        elif i % 3 == 1:
            s[at : at + 3] = -3
        data.append((i, (s + rng.normal(scale=0.05, size=12)).tolist()))
    df = spark.createDataFrame(data, "id bigint, s array<double>").repartition(4)
    found = warping.cluster_series(df, "id", "s", k=3, max_iter=10)
    assert found.converged and found.centroids.shape == (3, 12)
    label = {r["id"]: r["cluster"] for r in found.labelled.collect()}
    total = 0.0
    for i, s in data:
        costs = [dtw(np.array(s), c) for c in found.centroids]
        assert label[i] == int(np.argmin(costs))
        total += min(costs) ** 2
    assert found.inertia == pytest.approx(total)
    again = warping.cluster_series(df.repartition(2), "id", "s", k=3, max_iter=10)
    assert np.allclose(again.centroids, found.centroids)


def test_series_fill_scale_and_trend(spark):
    df = spark.createDataFrame(
        [("a", "2020-01-05", 1.0, 1.0), ("a", "2020-01-06", 1.0, 0.0), ("a", "2020-03-01", 1.0, 1.0),
         ("b", "2020-02-01", 0.0, 0.0), ("b", "2020-03-01", 0.0, 1.0)],
        "k string, d string, x double, y double",
    ).withColumn("d", F.to_timestamp("d"))
    monthly = series.monthly_share(df, ["k"], "d", "x", "y")
    full = series.to_series(monthly, "k", "month", "score", series.period_span(monthly, "month"))
    got = {r["k"]: (r["series"], r["z"]) for r in series.with_z_scores(full).collect()}
    assert got["a"][0] == [0.75, 0.0, 0.5] and got["b"][0] == [0.0, 0.0, 0.0]
    assert np.allclose(got["a"][1], (np.array([0.75, 0, 0.5]) - 5 / 12) / np.std([0.75, 0, 0.5]))
    assert got["b"][1] == [0.0, 0.0, 0.0]
    trend = series.mean_by_cluster(full.withColumn("cluster", F.lit(0)))
    assert [r["mean"] for r in trend.orderBy("period").collect()] == [0.375, 0.0, 0.25]
    wide = series.pivot_filled(
        monthly.withColumn("m", F.date_format("month", "MM")), "k", "m", "score", ["01", "02", "03"]
    )
    assert rows(wide) == [("a", 0.75, 0.0, 0.5), ("b", 0.0, 0.0, 0.0)]


# ---------------------------------------------------------------- models


def test_metrics_equal_spark_evaluator(spark):
    from pyspark.ml.evaluation import RegressionEvaluator

    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (4.0, 3.0)], "y double, p double")
    got = metrics.regression_metrics(df, "y", "p").first()
    for name in ("mae", "mse", "r2"):
        e = RegressionEvaluator(labelCol="y", predictionCol="p", metricName=name)
        assert got[name] == pytest.approx(e.evaluate(df))
    flat = spark.createDataFrame([(1.0, 2.0)], "y double, p double")
    assert metrics.regression_metrics(flat, "y", "p").first()["r2"] is None


def test_rank_metrics(spark):
    data = [("a", 10, 0.5), ("a", 20, 0.1), ("a", 20, 0.7), ("b", 5, 9.0), ("a", 30, 0.7)] * 3
    df = spark.createDataFrame(data, "c string, y bigint, p double")
    got = metrics.rank_metrics(df, ["c"], "y", "p").first()
    # ranks of y: 1 2 2 1 3; of p: 2 1 3 1 3
    assert tuple(got) == (15, pytest.approx(3 / 5), pytest.approx(3 / 5))
    assert rows(metrics.with_ranks(df, ["c"], "y", "p").select("expected", "predicted").distinct()) == [
        (1.0, 1.0), (1.0, 2.0), (2.0, 1.0), (2.0, 3.0), (3.0, 3.0)
    ]


def test_tree_models_learn_and_reload(spark, tmp_path):
    data = [(["big"] if i % 2 else ["small"], ["t"], bool(i % 2), 1, float(100 * (i % 2))) for i in range(80)]
    df = spark.createDataFrame(
        data, "filtered_words array<string>, filtered_tags array<string>, comments_disabled boolean, categoryId int, view_count double"
    )
    for regressor in (
        models.decision_tree(depth=3), models.random_forest(trees=5, depth=3), models.boosted_trees(depth=2, maxIter=3)
    ):
        model = models.fit([*features.hashed_text_stages(), regressor], df)
        got = metrics.regression_metrics(model.transform(df), "view_count", "prediction").first()
        assert got["n"] == 80 and got["mae"] < 20
    models.save(model, str(tmp_path / "m"))
    again = models.load(str(tmp_path / "m"))
    assert rows(again.transform(df).select("prediction")) == rows(model.transform(df).select("prediction"))
    weights = models.importances(model, spark)
    assert weights.count() == 2 + features.WORD_BUCKETS + features.TAG_BUCKETS
    assert weights.agg(F.sum("weight")).first()[0] == pytest.approx(1.0)


def test_rows_with_missing_features_are_skipped(spark):
    df = spark.createDataFrame(
        [(["a"], ["b"], True, 1), (["a"], ["b"], None, 1)],
        "filtered_words array<string>, filtered_tags array<string>, comments_disabled boolean, categoryId int",
    )
    (got,) = features.fit_transform(features.hashed_text_stages(), df)
    assert got.count() == 1


def test_scaling_is_by_deviation_only(spark):
    df = spark.createDataFrame([(1.0, "x"), (3.0, "y"), (5.0, "x")], "v double, c string")
    (got,) = features.fit_transform(features.coded_stages(["v"], ["c"]), df)
    first = features.as_array(got, "scaledFeatures", "a").orderBy("v").first()["a"]
    assert first[0] == pytest.approx(1.0 / 2.0) and len(first) == 2


def test_ml_tfidf_keeps_the_term_of_each_index(spark):
    docs, df = corpus(spark)
    vectors, names = features.tfidf_vectors(df, "tokens", 1_000)
    got = {r["term"]: r["score"] for r in features.top_weighted_terms(vectors, "tfidf", names, 100).collect()}
    for t in ("aa", "b"):
        idf = math.log((len(docs) + 1) / (sum(t in d for d in docs) + 1))
        assert got[t] == pytest.approx(idf * sum(d.count(t) for d in docs))
