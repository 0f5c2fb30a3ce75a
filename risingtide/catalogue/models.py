"""Neighbours, feature vectors, tree models and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from risingtide.catalogue.base import query, table
from risingtide.catalogue.rows import duration_rows
from risingtide.catalogue.texts import STOPWORDS
from risingtide.functions.keys import hash_threshold
from risingtide.operators.durations import duration_features
from risingtide.operators.features import as_array, coded_stages, fit_transform, hashed_text_stages
from risingtide.operators.metrics import rank_metrics, regression_metrics, with_ranks
from risingtide.operators.models import boosted_trees, decision_tree, importances, load, random_forest, save
from risingtide.operators.neighbours import nearest_neighbours, neighbour_mean
from risingtide.operators.probing import build_index, probed_neighbours, recall
from risingtide.operators.split import split_by_key
from risingtide.plans.durations import forest_predictions, knn_predictions, score, with_channel_stats
from risingtide.plans.view_counts import evaluate, sample_report, train, with_tokens
from risingtide.session import materialise, work_path

# ---------------------------------------------------------------- neighbours

_TEST = f"substr(md5(cast(vec_id AS varchar)), 1, 8) < '{hash_threshold(0.2)}'"
_NEIGHBOURS = f"""
WITH e AS (SELECT vec_id, label, embedding::double[] AS v, {_TEST} AS test FROM embeddings),
p AS (SELECT q.vec_id AS query_id, t.vec_id AS point_id, q.label AS truth, t.label AS label,
             list_distance(q.v, t.v) AS distance
      FROM e q CROSS JOIN e t WHERE q.test AND NOT t.test),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, point_id) AS rank FROM p)"""


def _vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return split_by_key(table(spark, folder, "embeddings"), "vec_id", 0.2)


def _neighbours(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    points, queries = _vectors(spark, folder)
    found = nearest_neighbours(
        queries, points, 5, "vec_id", "vec_id", "embedding", "embedding"
    )
    return found, points, queries


@query(_NEIGHBOURS + " SELECT query_id, point_id, rank, round(distance, 6) AS distance FROM n WHERE rank <= 5")
def knn_neighbours(spark, folder):
    found, _, _ = _neighbours(spark, folder)
    return found.select("query_id", "point_id", "rank", F.round("distance", 6).alias("distance"))


_PREDICTED = _NEIGHBOURS + """, r AS (
  SELECT query_id, any_value(truth) AS label, avg(label) AS prediction FROM n WHERE rank <= 5 GROUP BY 1)"""


def _knn_predictions(spark: SparkSession, folder: str) -> DataFrame:
    found, points, queries = _neighbours(spark, folder)
    truth = queries.select(F.col("vec_id").alias("query_id"), "label")
    return neighbour_mean(found, points, "vec_id", "label").join(truth, "query_id")


@query(_PREDICTED + " SELECT query_id, label, round(prediction, 6) AS prediction FROM r")
def knn_predict(spark, folder):
    return _knn_predictions(spark, folder).select(
        "query_id", "label", F.round("prediction", 6).alias("prediction")
    )


@query(
    _PREDICTED
    + """ SELECT count(*) AS n, round(avg(abs(prediction - label)), 6) AS mae,
                 round(avg((prediction - label) ** 2), 6) AS mse,
                 round(1 - sum((prediction - label) ** 2) / (var_pop(label) * count(*)), 6) AS r2 FROM r"""
)
def knn_regression_metrics(spark, folder):
    found = regression_metrics(_knn_predictions(spark, folder), "label", "prediction")
    return found.select("n", *[F.round(c, 6).alias(c) for c in ("mae", "mse", "r2")])


@query(
    _NEIGHBOURS.replace("AS test FROM embeddings)", "AS test FROM embeddings WHERE vec_id % 5 <> 0)")
    + " SELECT query_id, point_id, rank, round(distance, 6) AS distance FROM n WHERE rank <= 5"
)
def knn_odd_vectors(spark, folder):
    """Neighbours in a table some of whose vectors are null or hold a null, NaN or infinite number."""
    kind = F.pmod("vec_id", F.lit(20))

    def spoilt(x, i):
        return F.when((i == 3) & (kind == 5), F.lit(float("nan"))).when((i == 3) & (kind == 10), F.lit(float("-inf"))).when(
            (i == 3) & (kind == 15), F.lit(None)).otherwise(x)

    vectors = table(spark, folder, "embeddings").withColumn(
        "embedding", F.when(kind != 0, F.transform(F.col("embedding").cast("array<double>"), spoilt)))
    points, queries = split_by_key(vectors, "vec_id", 0.2)
    found = nearest_neighbours(queries, points, 5, "vec_id", "vec_id", "embedding", "embedding")
    return found.select("query_id", "point_id", "rank", F.round("distance", 6).alias("distance"))


def _probed(spark: SparkSession, folder: str, said: dict | None = None) -> DataFrame:
    points, queries = _vectors(spark, folder)
    return probed_neighbours(queries, build_index(points, "vec_id", "embedding"), 5, "vec_id", "embedding", said=said)


@query()
def knn_probed(spark, folder):
    """Neighbours found by probing cells; see ``knn_probed_recall`` for how many of the true ones they are."""
    return _probed(spark, folder).select("query_id", "point_id", "rank", F.round("distance", 6).alias("distance"))


@query(
    _NEIGHBOURS
    + """, best AS (SELECT query_id, point_id, rank, distance FROM n WHERE rank <= 5)
SELECT count(DISTINCT query_id) AS queries, (SELECT count(*) FROM p) AS pairs, round(sum(distance), 4) AS exact_distance,
       true AS recall_above_90, true AS within_5_percent, true AS under_a_quarter_compared FROM best"""
)
def knn_probed_recall(spark, folder):
    """The probed neighbours against the exact ones: recall, distances, and the pairs whose distance was taken."""
    said: dict = {}
    found = materialise(_probed(spark, folder, said), "probed")
    exact, points, queries = _neighbours(spark, folder)
    exact = materialise(exact, "exact")
    pairs = queries.count() * points.count()
    share = recall(found, exact)
    near = found.agg(F.sum("distance").alias("found_distance"))
    return exact.agg(
        F.count_distinct("query_id").alias("queries"), F.lit(pairs).alias("pairs"), F.sum("distance").alias("exact")
    ).crossJoin(near).select(
        "queries", "pairs", F.round("exact", 4).alias("exact_distance"), F.lit(share >= 0.9).alias("recall_above_90"),
        (F.col("found_distance") <= 1.05 * F.col("exact")).alias("within_5_percent"),
        F.lit(4 * said["compared"] < pairs).alias("under_a_quarter_compared"))


# ---------------------------------------------------------------- metrics on ranks

_RANKS = """
SELECT doc_id, source, dense_rank() OVER (PARTITION BY source ORDER BY n_chars) AS expected,
       dense_rank() OVER (PARTITION BY source ORDER BY doc_id % 97) AS predicted FROM documents"""


def _guessed(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "n_chars")
    return docs.withColumn("guess", F.pmod("doc_id", F.lit(97)))


@query(f"SELECT doc_id, source, expected::double AS expected, predicted::double AS predicted FROM ({_RANKS})")
def ranks_within_group(spark, folder):
    ranked = with_ranks(_guessed(spark, folder), ["source"], "n_chars", "guess")
    return ranked.select("doc_id", "source", "expected", "predicted")


@query(
    f"""SELECT count(*) AS n, round(avg(abs(predicted - expected)), 6) AS mae,
               round(avg((predicted - expected) ** 2), 6) AS mse FROM ({_RANKS})"""
)
def rank_metrics_within_group(spark, folder):
    found = rank_metrics(_guessed(spark, folder), ["source"], "n_chars", "guess")
    return found.select("n", F.round("mae", 6).alias("mae"), F.round("mse", 6).alias("mse"))


# ---------------------------------------------------------------- feature vectors


@query()
def feature_vectors(spark, folder):
    """Hashed words and tags, and coded and scaled columns, of every document."""
    docs = _text_rows(spark, folder)
    stages = coded_stages(("lang_id", "view_count"), ("lang", "channelId"), out="coded")
    (coded,) = fit_transform(stages, docs)
    (hashed,) = fit_transform(hashed_text_stages(plain=("flag", "lang_id")), coded)
    return as_array(hashed, "scaledFeatures", "scaled").select(
        "doc_id",
        F.col("features").cast("string").alias("hashed"),
        F.array_join(F.transform("scaled", lambda x: F.round(x, 6).cast("string")), ",").alias("scaled"),
    )


_INDEXED = """
SELECT {c} AS label, count(*) AS c, row_number() OVER (ORDER BY count(*) DESC, {c}) - 1 AS idx, count(*) OVER () AS k
FROM documents GROUP BY {c}"""
# The deviation of a column that is 1 on c of n rows.
_CODED = "1 / sqrt(i.c * (n - i.c) / (n * (n - 1)))"


@query(
    f"""
WITH langs AS ({_INDEXED.format(c='lang')}), sources AS ({_INDEXED.format(c='source')}),
s AS (SELECT count(*)::double AS n, nullif(stddev_samp(length(lang)), 0) AS a, nullif(stddev_samp(n_chars), 0) AS b FROM documents),
v AS (
  SELECT doc_id, 0 AS pos, coalesce(length(lang) / a, 0) AS value FROM documents, s
  UNION ALL SELECT doc_id, 1, coalesce(n_chars / b, 0) FROM documents, s
  UNION ALL SELECT doc_id, 2 + idx, {_CODED} FROM documents JOIN langs i ON lang = label, s WHERE idx < k - 1
  UNION ALL SELECT doc_id, 2 + (SELECT count(*) - 1 FROM langs) + idx, {_CODED}
            FROM documents JOIN sources i ON source = label, s WHERE idx < k - 1)
SELECT doc_id, pos, round(value, 6) AS value FROM v WHERE value <> 0"""
)
def scaled_features(spark, folder):
    """Indexed, one-hot and scaled columns: the positions that are not zero."""
    stages = coded_stages(("lang_id", "view_count"), ("lang", "channelId"), out="coded")
    (coded,) = fit_transform(stages, _text_rows(spark, folder))
    return as_array(coded, "scaledFeatures", "scaled").select(
        "doc_id", F.posexplode("scaled").alias("pos", "value")
    ).where("value <> 0").withColumn("value", F.round("value", 6))


def _text_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as items: words of the text, language and source as tags, length as label."""
    docs = table(spark, folder, "documents")
    rows = docs.select(
        "doc_id",
        F.col("doc_id").alias("video_id"),
        F.col("source").alias("title"),
        F.col("source").alias("channelId"),
        F.col("source").alias("channelTitle"),
        "lang",
        F.concat_ws("|", "lang", "source").alias("tags"),
        F.col("text").alias("description"),
        (F.pmod("doc_id", F.lit(2)) == 0).alias("flag"),
        F.length("lang").alias("lang_id"),
        F.col("n_chars").alias("view_count"),
    )
    return with_tokens(rows, STOPWORDS)


# ---------------------------------------------------------------- tree models

_PLAIN = ("flag", "lang_id")


def _split(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return split_by_key(_text_rows(spark, folder), "channelId", 0.3)


def _predict(spark: SparkSession, folder: str, regressor) -> DataFrame:
    """Fit on the kept sources, predict the held-out ones."""
    known, held_out = _split(spark, folder)
    model = train(known, regressor, _PLAIN)
    return model.transform(held_out).select("doc_id", "channelId", "view_count", "prediction")


@query()
def tree_predict(spark, folder):
    return _predict(spark, folder, decision_tree())


@query()
def forest_predict(spark, folder):
    return _predict(spark, folder, random_forest())


@query()
def gbt_predict(spark, folder):
    return _predict(spark, folder, boosted_trees())


_HELD_OUT = f"substr(md5(source), 1, 8) < '{hash_threshold(0.3)}'"


@query(
    f"""
SELECT source AS "channelId", model, count(*) AS n, 0 AS missing, count(*) AS inside, sum(n_chars) AS expected
FROM documents, (VALUES ('tree'), ('forest')) m(model) WHERE {_HELD_OUT} GROUP BY ALL"""
)
def predictions_by_channel(spark, folder):
    """Every held-out document has a prediction, within the range of the train labels."""
    known, held_out = _split(spark, folder)
    span = known.agg(F.min("view_count").alias("a"), F.max("view_count").alias("b")).first()
    parts = []
    for name, regressor in (("tree", decision_tree(depth=10, memory_mb=512)), ("forest", random_forest(trees=5, memory_mb=512))):
        predicted = train(known, regressor, _PLAIN).transform(held_out)
        parts.append(predicted.groupBy("channelId").agg(
            F.lit(name).alias("model"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("prediction").isNull()).alias("missing"),
            F.count_if(F.col("prediction").between(span["a"], span["b"])).alias("inside"),
            F.sum("view_count").alias("expected")))
    return parts[0].unionByName(parts[1])


@query()
def tree_importances(spark, folder):
    known, _ = _split(spark, folder)
    return importances(train(known, decision_tree(depth=10, memory_mb=512), _PLAIN), spark)


@query()
def tree_saved_rank_metrics(spark, folder):
    """A saved and reloaded tree scored on ranks within held-out sources."""
    known, held_out = _split(spark, folder)
    path = work_path(spark, "model")
    save(train(known, decision_tree(depth=10, memory_mb=512), _PLAIN), path)
    return evaluate(load(path), held_out)


@query()
def tree_sample_report(spark, folder):
    known, held_out = _split(spark, folder)
    return sample_report(train(known, decision_tree(depth=10), _PLAIN), held_out)


# ---------------------------------------------------------------- duration models


def _duration_split(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows, stats = duration_rows(spark, folder)
    features = duration_features(
        with_channel_stats(rows, stats), tiebreak=["at.l_orderkey", "at.l_linenumber", "at.l_suppkey"]
    )
    # Both sides are read several times; what they are made from is worked out once.
    return split_by_key(materialise(features, "durations"), "video_id", 0.2)


@query()
def duration_knn(spark, folder):
    """Trending duration as the mean of the five nearest train rows."""
    known, held_out = _duration_split(spark, folder)
    return knn_predictions(known, held_out, ["video_id", "region"])


@query()
def duration_forest_metrics(spark, folder):
    """Random forest on the duration features: MAE, MSE and R2."""
    known, held_out = _duration_split(spark, folder)
    return score(forest_predictions(known, held_out))
