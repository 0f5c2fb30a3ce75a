"""Series grouped by plain Euclidean distance: the baseline beside time warping."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from risingtide.functions.vectors import euclidean
from risingtide.session import materialise

MAX_ROUNDS = 100


@dataclass(frozen=True)
class EuclideanClusters:
    """``labelled``: key, series, ``cluster`` and ``distance``; ``centroids``: ``cluster`` and ``centroid``, ``k`` rows."""

    labelled: DataFrame
    centroids: DataFrame


def euclidean_clusters(df: DataFrame, key: str, series: str, k: int = 3, seed: int = 7, max_iter: int = MAX_ROUNDS) -> EuclideanClusters:
    """``k`` clusters of equally long series by k-means, started by k-means||, until no centroid moves.

    Missing series are left out. With fewer different series than ``k`` there are fewer clusters.
    """
    spark = df.sparkSession
    data = materialise(df.select(key, series).where(F.col(series).isNotNull()), "series")
    vectors = data.withColumn("__features", array_to_vector(F.col(series)))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, tol=0.0, featuresCol="__features", predictionCol="cluster").fit(vectors)
    centroids = spark.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, centroid array<double>")
    told = model.transform(vectors).drop("__features").join(F.broadcast(centroids), "cluster")
    return EuclideanClusters(told.select(key, series, "cluster", euclidean(series, "centroid").alias("distance")), centroids)


def squares_by_centroid(clusters: EuclideanClusters, series: str) -> DataFrame:
    """One row: ``series``, ``within``, ``between`` and ``moved``.

    ``within`` adds up the squared distances to the centroids, ``between`` those of the
    centroids, each for every series of its cluster, to the mean series. Together they are
    the squares around the mean series if every centroid is the mean of its cluster.
    ``moved`` counts the series to which another centroid is nearer.
    """
    rows = materialise(clusters.labelled, "labelled")
    middle = rows.select(F.posexplode(series).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("x")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("middle"))
    every = clusters.centroids.agg(F.collect_list(F.struct("cluster", "centroid")).alias("all"))
    joined = rows.crossJoin(F.broadcast(middle)).crossJoin(F.broadcast(every))
    own = F.filter("all", lambda c: c["cluster"] == F.col("cluster"))[0]["centroid"]
    nearest = F.array_min(F.transform("all", lambda c: euclidean(F.col(series), c["centroid"])))
    return joined.select("distance", euclidean(own, "middle").alias("away"), nearest.alias("nearest")).agg(
        F.count(F.lit(1)).alias("series"), F.sum(F.col("distance") * F.col("distance")).alias("within"),
        F.sum(F.col("away") * F.col("away")).alias("between"),
        F.count_if(F.col("nearest") < F.col("distance") - 1e-9).alias("moved"))
