"""Models whose every result SQL can work out again: small trees, warped clusters, hashed rows.

The operators are those of the large jobs with settings that leave nothing to chance:
trees on columns of few values without sampling of rows or columns, and clusters of short
series after a fixed number of rounds.
"""

from __future__ import annotations

import warnings

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, functions as F

from risingtide.catalogue.base import query, table
from risingtide.catalogue.models import _HELD_OUT, _text_rows
from risingtide.catalogue.texts import _LOWER_STOP
from risingtide.operators.features import as_array, fit_transform, hashed_text_stages
from risingtide.operators.models import boosted_trees, decision_tree, fit, importances, load, plain_forest, random_forest, save
from risingtide.operators.series import mean_by_cluster, to_series, with_z_scores
from risingtide.operators.split import split_by_key
from risingtide.operators.warping import cluster_series
from risingtide.plans.view_counts import evaluate
from risingtide.session import work_path

# ---------------------------------------------------------------- trees

_FEATURES = ("part", "origin", "line_breaks")
_ROWS = f"""
base AS MATERIALIZED (
  SELECT doc_id, source, n_chars::double AS y, {_HELD_OUT} AS held_out,
         [doc_id % 13, CAST(substr(source, 4) AS INTEGER), least(length(text) - length(replace(text, chr(10), '')), 25)] AS f
  FROM documents)"""


def _rows(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(known, held out) documents with three features of few values each."""
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    docs = table(spark, folder, "documents").select(
        "doc_id", F.col("source").alias("channelId"), F.col("n_chars").cast("double").alias("view_count"),
        F.pmod("doc_id", F.lit(13)).alias("part"), F.substring("source", 4, 9).cast("int").alias("origin"),
        F.least(breaks, F.lit(25)).alias("line_breaks"))
    return split_by_key(docs, "channelId", 0.3)


def _fitted(known: DataFrame, regressor):
    return fit([VectorAssembler(inputCols=list(_FEATURES), outputCol="features"), regressor], known)


def _tree_sql(name: str, source: str, label: str, depth: int) -> str:
    """CTEs that grow a tree by trying all splits; ``name`` gives every row of ``source`` its leaf's mean.

    A node is split where the squares around the means fall most, ties to the first feature
    and value. Held-out rows follow the splits and take no part in them.
    """
    out = [f"{name}_n0 AS MATERIALIZED (SELECT doc_id, held_out, {label} AS y, f, 1 AS node FROM {source})"]
    for d in range(depth):
        out.append(f"""
{name}_v{d} AS (SELECT node, i, f[i] AS v, count(*) AS c, sum(y) AS s FROM {name}_n{d}, range(1, 4) t(i) WHERE NOT held_out GROUP BY ALL),
{name}_w{d} AS (
  SELECT node, i, v, sum(c) OVER upto AS cl, sum(s) OVER upto AS sl, sum(c) OVER whole AS ct, sum(s) OVER whole AS st FROM {name}_v{d}
  WINDOW upto AS (PARTITION BY node, i ORDER BY v), whole AS (PARTITION BY node, i)),
{name}_b{d} AS MATERIALIZED (
  SELECT node, i, v, gain, ct FROM (
    SELECT *, sl * sl / cl + (st - sl) * (st - sl) / (ct - cl) - st * st / ct AS gain FROM {name}_w{d} WHERE cl < ct)
  WHERE gain > 1e-6 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, i, v) = 1),
{name}_n{d + 1} AS MATERIALIZED (
  SELECT doc_id, held_out, y, f, 2 * n.node + CASE WHEN f[b.i] > b.v THEN 1 ELSE 0 END AS node
  FROM {name}_n{d} n LEFT JOIN {name}_b{d} b ON n.node = b.node)""")
    out.append(f"""
{name}_m AS (SELECT node, avg(y) AS prediction FROM {name}_n{depth} WHERE NOT held_out GROUP BY node),
{name} AS MATERIALIZED (SELECT doc_id, prediction FROM {name}_n{depth} JOIN {name}_m USING (node))""")
    return ",".join(out)


_TREE = f"WITH {_ROWS}, {_tree_sql('tree', 'base', 'y', 3)}"
_PREDICTED = "SELECT doc_id, round(prediction, 4) AS prediction FROM {name} JOIN base USING (doc_id) WHERE held_out"


@query(f"{_TREE} {_PREDICTED.format(name='tree')}")
def tree_splits(spark, folder):
    """A saved and reloaded tree of depth 3, on held-out sources."""
    known, held_out = _rows(spark, folder)
    path = work_path(spark, "model")
    save(_fitted(known, decision_tree(depth=3, memory_mb=512)), path)
    return load(path).transform(held_out).select("doc_id", F.round("prediction", 4).alias("prediction"))


@query(f"""{_TREE},
gains AS ({" UNION ALL ".join(f"SELECT i, gain FROM tree_b{d}" for d in range(3))})
SELECT i - 1 AS feature, round(sum(gain) / (SELECT sum(gain) FROM gains), 6) AS weight FROM (
  SELECT i, gain FROM gains UNION ALL SELECT i, 0 FROM range(1, 4) t(i)) GROUP BY i""")
def tree_gains(spark, folder):
    """What every feature adds to the tree."""
    known, _ = _rows(spark, folder)
    found = importances(_fitted(known, decision_tree(depth=3, memory_mb=512)), spark)
    return found.select("feature", F.round("weight", 6).alias("weight"))


@query(f"""{_TREE},
ranks AS (
  SELECT dense_rank() OVER (PARTITION BY source ORDER BY y) AS expected, dense_rank() OVER (PARTITION BY source ORDER BY prediction) AS predicted
  FROM tree JOIN base USING (doc_id) WHERE held_out)
SELECT count(*) AS n, round(avg(abs(predicted - expected)), 6) AS mae, round(avg((predicted - expected) ** 2), 6) AS mse FROM ranks""")
def tree_ranks_held_out(spark, folder):
    """Ranks within held-out sources, as the view-count job scores them."""
    known, held_out = _rows(spark, folder)
    found = evaluate(_fitted(known, decision_tree(depth=3, memory_mb=512)), held_out)
    return found.select("n", F.round("mae", 6).alias("mae"), F.round("mse", 6).alias("mse"))


@query(f"""WITH {_ROWS}, {_tree_sql('two', 'base', 'y', 2)}
SELECT model, doc_id, round(prediction, 4) AS prediction FROM two JOIN base USING (doc_id), (VALUES ('forest'), ('plain')) m(model) WHERE held_out""")
def forest_without_sampling(spark, folder):
    """Forests whose trees see all rows and columns: every tree is the tree of depth 2."""
    known, held_out = _rows(spark, folder)
    whole = dict(bootstrap=False, featureSubsetStrategy="all")
    parts = []
    for name, regressor in (
        ("forest", random_forest(trees=3, depth=2, share=1.0, memory_mb=512, **whole)),
        ("plain", plain_forest("view_count", numTrees=2, maxDepth=2, **whole)),
    ):
        parts.append(_fitted(known, regressor).transform(held_out).select(
            F.lit(name).alias("model"), "doc_id", F.round("prediction", 4).alias("prediction")))
    return parts[0].unionByName(parts[1])


@query(f"""WITH {_ROWS}, {_tree_sql('one', 'base', 'y', 2)},
rest1 AS (SELECT b.*, 2 * (y - prediction) AS miss FROM base b JOIN one USING (doc_id)), {_tree_sql('two', 'rest1', 'miss', 2)},
rest2 AS (SELECT b.*, 2 * (y - one.prediction - 0.1 * two.prediction) AS miss FROM base b JOIN one USING (doc_id) JOIN two USING (doc_id)),
{_tree_sql('three', 'rest2', 'miss', 2)},
boosted AS (SELECT doc_id, one.prediction + 0.1 * two.prediction + 0.1 * three.prediction AS prediction
            FROM one JOIN two USING (doc_id) JOIN three USING (doc_id))
{_PREDICTED.format(name='boosted')}""")
def boosted_without_sampling(spark, folder):
    """Three boosted trees of depth 2: each fits what the ones before it miss."""
    known, held_out = _rows(spark, folder)
    model = _fitted(known, boosted_trees(depth=2, share=1.0, memory_mb=512, maxIter=3))
    return model.transform(held_out).select("doc_id", F.round("prediction", 4).alias("prediction"))


# ---------------------------------------------------------------- warped clusters

_DAYS = 7
_CLUSTERS = 3
_WARP_ROUNDS = 2


def _nested(source: str, levels: list[list[str]]) -> str:
    """One subquery per level, so that each column is worked out once from those below it."""
    for columns in levels:
        source = f"(SELECT *, {', '.join(columns)} FROM {source})"
    return source


def _warp_sql(n: int) -> str:
    """CTEs of one round: the cost of aligning every series with every centroid, cell by cell, and the path back."""
    diagonals = [[(i, t - i) for i in range(1, _DAYS + 1) if 1 <= t - i <= _DAYS] for t in range(2, 2 * _DAYS + 1)]

    def cost(a: int, b: int) -> str:
        return f"d_{a}_{b}" if a and b else ("0" if a == b == 0 else "'infinity'::double")

    def cell(i: int, j: int) -> str:
        before = [cost(a, b) for a, b in ((i - 1, j - 1), (i - 1, j), (i, j - 1))]
        return f"(x[{i}] - c[{j}]) * (x[{i}] - c[{j}]) + least({', '.join(before)}) AS d_{i}_{j}"

    # A path goes back to the diagonal cell, else to the earlier value, else to the earlier position, whichever cost least.
    def came(i: int, j: int, move: int) -> str:
        diagonal, up, left = cost(i - 1, j - 1), cost(i - 1, j), cost(i, j - 1)
        return (f"({diagonal} <= {up} AND {diagonal} <= {left})", f"({up} < {diagonal} AND {up} <= {left})",
                f"({left} < {diagonal} AND {left} < {up})")[move]

    def on_path(i: int, j: int) -> str:
        after = [f"(p_{a}_{b} AND {came(a, b, move)})" for move, (a, b) in enumerate(((i + 1, j + 1), (i + 1, j), (i, j + 1)))
                 if a <= _DAYS and b <= _DAYS]
        return f"({' OR '.join(after) or 'true'}) AS p_{i}_{j}"

    places = range(1, _DAYS + 1)
    hits = ", ".join(" + ".join(f"CASE WHEN p_{i}_{j} THEN 1 ELSE 0 END" for i in places) for j in places)
    sums = ", ".join(" + ".join(f"CASE WHEN p_{i}_{j} THEN x[{i}] ELSE 0 END" for i in places) for j in places)
    pairs = f"(SELECT user_id, x, cluster, c FROM series CROSS JOIN centroids{n})"
    return f"""
near{n} AS MATERIALIZED (
  SELECT * FROM {_nested(pairs, [[cell(i, j) for i, j in line] for line in diagonals])}
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY d_{_DAYS}_{_DAYS}, cluster) = 1),
aligned{n} AS MATERIALIZED (
  SELECT cluster, [{hits}] AS hits, [{sums}] AS sums
  FROM {_nested(f"near{n}", [[on_path(i, j) for i, j in line] for line in reversed(diagonals)])}),
centroids{n + 1} AS MATERIALIZED (
  SELECT cluster, list(s / h ORDER BY j) AS c FROM (
    SELECT cluster, j, sum(sums[j]) AS s, sum(hits[j]) AS h FROM aligned{n}, range(1, {_DAYS + 1}) t(j) GROUP BY cluster, j)
  GROUP BY cluster)"""


_WEEKS = f"""
WITH means AS (SELECT user_id, dayofweek(ts) + 1 AS day, avg(value) AS m FROM events GROUP BY ALL),
grid AS (SELECT user_id, day FROM (SELECT DISTINCT user_id FROM means) CROSS JOIN range(1, {_DAYS + 1}) t(day)),
filled AS (SELECT user_id, day, coalesce(m, 0) AS v FROM grid LEFT JOIN means USING (user_id, day)),
scaled AS (SELECT user_id, day, coalesce((v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0), 0) AS z FROM filled WINDOW w AS (PARTITION BY user_id)),
series AS MATERIALIZED (SELECT user_id, list(z ORDER BY day) AS x FROM scaled GROUP BY user_id),
centroids0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY md5(CAST(user_id AS varchar)), user_id) - 1 AS cluster, x AS c
                            FROM series QUALIFY cluster < {_CLUSTERS}),"""


def _weeks(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's mean value by day of the week, scaled."""
    daily = table(spark, folder, "events").groupBy("user_id", F.dayofweek("ts").alias("day")).agg(F.avg("value").alias("mean"))
    days = F.array(*[F.lit(d) for d in range(1, _DAYS + 1)])
    return with_z_scores(to_series(daily, "user_id", "day", "mean", days))


@query(f"""{_WEEKS}{",".join(_warp_sql(n) for n in range(_WARP_ROUNDS + 1))}
SELECT user_id, cluster, round(sqrt(d_{_DAYS}_{_DAYS}), 5) AS distance FROM near{_WARP_ROUNDS}""")
def warped_weeks(spark, folder):
    """Users by the shape of their week under time warping, after two rounds: labels and distances."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        found = cluster_series(_weeks(spark, folder), "user_id", "z", _CLUSTERS, max_iter=_WARP_ROUNDS)
    return found.labelled.select("user_id", "cluster", F.round("distance", 5).alias("distance"))


@query(f"""{_WEEKS}{",".join(_warp_sql(n) for n in range(_WARP_ROUNDS + 1))},
labels AS (SELECT user_id, cluster FROM near{_WARP_ROUNDS})
SELECT cluster, day AS period, round(avg(v), 6) AS mean FROM filled JOIN labels USING (user_id) GROUP BY ALL""")
def warped_weeks_trend(spark, folder):
    """The mean unscaled week of every cluster."""
    weeks = _weeks(spark, folder)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        labels = cluster_series(weeks, "user_id", "z", _CLUSTERS, max_iter=_WARP_ROUNDS).labelled.select("user_id", "cluster")
    return mean_by_cluster(weeks.join(labels, "user_id")).withColumn("mean", F.round("mean", 6))


# ---------------------------------------------------------------- hashed rows

_TAGS = "list_filter([lower(lang), lower(source)], lambda t: length(t) >= 1)"


@query(f"""SELECT doc_id, CAST(len({_LOWER_STOP}) AS DOUBLE) AS words, CAST(len({_TAGS}) AS DOUBLE) AS tags,
           CAST(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS flag, CAST(length(lang) AS DOUBLE) AS lang_id
           FROM documents WHERE doc_id % 3 <> 0""")
def hashed_rows(spark, folder):
    """The blocks of the hashed vectors add up to the numbers of words and tags; rows with a missing column are skipped."""
    rows = _text_rows(spark, folder).withColumn("flag", F.when(F.pmod("doc_id", F.lit(3)) != 0, F.col("flag")))
    (hashed,) = fit_transform(hashed_text_stages(plain=("flag", "lang_id")), rows)

    def added(first: int, size: int):
        return F.aggregate(F.slice("v", first + 1, size), F.lit(0.0), lambda a, x: a + x)

    return as_array(hashed, "features", "v").select(
        "doc_id", added(2, 512).alias("words"), added(514, 64).alias("tags"), F.col("v")[0].alias("flag"), F.col("v")[1].alias("lang_id"))
