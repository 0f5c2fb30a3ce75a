"""Centroid clustering of integer vectors, with centroids ruled out in a rotated space.

Vectors become integers, floor(scale * x), and keep them: all sums, means, distances and
ties are exact. What is filtered is the work of finding the nearest centroid:

1. one pass sums the products of all components; its principal axes rotate the space;
2. every vector is stored with its ``lead`` leading rotated coordinates and the norm of
   the residual, all that the other coordinates hold;
3. for a vector and a centroid, the squared distance of the leading coordinates plus the
   squared difference of the residual norms is never above their squared distance. The
   centroid of the least bound is compared in integers, and then only those whose bound,
   less a margin for rounding, does not exceed that distance.

A round sends the driver the sums and counts of each cluster, clusters * (dims + 1)
numbers; vectors never leave their partition. The rotation changes no result, only how
many centroids are compared.

A vector is kept if it has exactly ``dims`` components, none null or not finite. Components
beyond 2 ** 27 after scaling raise an error: the squared distance would not fit a long. A
kept vector without an id is assigned, but is never a starting centroid. Repeated ids are
rows of their own; where they tie as starting centroids, the smaller vector comes first.
Equal distances: the centroid of the smaller number. With fewer vectors than ``clusters``
there are as many centroids as vectors; an empty table gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from risingtide.llm.tables import Scratch

DIMS = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
SEED = "1:"
# Leading rotated coordinates that are stored.
LEAD = 12
# Components of this size or more would let a squared distance leave the range of a long.
LIMIT = 1 << 27
# Vectors handed to Python at once.
TOGETHER = 8_192
# Coordinates are stored with 24 bits: a bound is wrong by less than this share of the
# square of both norms together.
_MARGIN = 2e-6


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """``id`` and ``point``, an array of integers, of all vectors that are kept."""
    vector = F.col(vector_col).cast("array<double>")
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    whole = F.transform(vector, lambda x: F.floor(
        F.when(F.abs(x * scale) < LIMIT, x * scale).otherwise(F.raise_error(F.lit("a component is too large"))
                                                              .cast("double"))).cast("int"))
    return vectors.where((F.size(vector) == dims) & ~odd).select(F.col(id_col).alias("id"), whole.alias("point"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _products(dims: int):
    """One row per partition: the summed products of all components and a constant one."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims + 1))
        for batch in batches:
            points = _matrix(batch.column(0), dims).astype(np.float64)
            points = np.column_stack([np.ones(len(points)), points])
            total += points.T @ points
        yield pa.RecordBatch.from_arrays([pa.array([total.reshape(-1)], pa.list_(pa.float64()))], names=["totals"])

    return products


def _summed(partial: DataFrame, kind: str) -> dict[int, object]:
    """The position-wise sums of an array that each partition gives one of."""
    each = partial.select(F.posexplode("totals").alias("place", "value"))
    return {r["place"]: r["total"] for r in each.groupBy("place").agg(F.sum(F.col("value").cast(kind)).alias("total")).collect()}


def principal_axes(points: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean of all points, and their axes as columns, the one of the largest variance first."""
    sums = _summed(points.select("point").mapInArrow(_products(dims), "totals array<double>"), "double")
    total = np.array([sums.get(i, 0.0) for i in range((dims + 1) ** 2)]).reshape(dims + 1, dims + 1)
    n = max(total[0, 0], 1.0)
    mean = total[0, 1:] / n
    _, axes = np.linalg.eigh(total[1:, 1:] / n - np.outer(mean, mean))
    return mean, axes[:, ::-1]


class Rotation:
    """Leading coordinates and the residual norm of points."""

    def __init__(self, mean: np.ndarray, axes: np.ndarray, lead: int):
        self.mean, self.axes, self.lead = mean, axes, min(lead, len(mean))

    def __call__(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        turned = (points - self.mean) @ self.axes
        rest = np.sqrt((turned[:, self.lead:] ** 2).sum(axis=1))
        return turned[:, : self.lead].astype(np.float32), rest.astype(np.float32)


def _rotated(rotation: Rotation, dims: int):
    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, rest = rotation(_matrix(batch.column(1), dims))
            at = np.arange(0, lead.size + 1, rotation.lead, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(pa.array(at), pa.array(lead.reshape(-1))), pa.array(rest)],
                names=["id", "point", "lead", "rest"])

    return rotate


def nearest(points: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray,
            rotation: Rotation) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid of each point, its squared distance, and how many centroids were compared."""
    lead, rest = lead.astype(np.float64), rest.astype(np.float64)
    own_lead, own_rest = (x.astype(np.float64) for x in rotation(centroids))
    norms = np.sqrt((lead ** 2).sum(axis=1) + rest ** 2)[:, None] + np.sqrt((own_lead ** 2).sum(axis=1) + own_rest ** 2)
    gaps = ((lead ** 2).sum(axis=1)[:, None] - 2 * lead @ own_lead.T + (own_lead ** 2).sum(axis=1))
    bound = gaps + (rest[:, None] - own_rest) ** 2 - _MARGIN * norms ** 2 - 1e-6

    def exact(row: np.ndarray, number: np.ndarray) -> np.ndarray:
        return ((points[row].astype(np.int64) - centroids[number]) ** 2).sum(axis=1)

    every = np.arange(len(points))
    found = bound.argmin(axis=1)
    distance = exact(every, found)
    left = bound <= distance[:, None]
    left[every, found] = False
    compared = left.sum(axis=1) + 1
    for number in range(len(centroids)):
        row = np.flatnonzero(left[:, number])
        own = exact(row, np.full(len(row), number))
        better = (own < distance[row]) | ((own == distance[row]) & (number < found[row]))
        found[row[better]], distance[row[better]] = number, own[better]
    return found, distance, compared


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray, rotation: Rotation):
    points = _matrix(batch.column(1), centroids.shape[1])
    lead = _matrix(batch.column(2), rotation.lead)
    return points, *nearest(points, lead, batch.column(3).to_numpy(), centroids, rotation)


def _sums(centroids: np.ndarray, rotation: Rotation):
    """One row per partition: for every cluster the number of its points and their sum."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), centroids.shape[1] + 1), dtype=np.int64)
        for batch in batches:
            points, cluster, _, _ = _assigned(batch, centroids, rotation)
            order = np.argsort(cluster, kind="stable")
            numbers, first = np.unique(cluster[order], return_index=True)
            if len(numbers):
                total[numbers, 0] += np.diff(np.append(first, len(cluster)))
                total[numbers, 1:] += np.add.reduceat(points[order].astype(np.int64), first, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total.reshape(-1)], pa.list_(pa.int64()))], names=["totals"])

    return add


def _labels(centroids: np.ndarray, rotation: Rotation):
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, cluster, distance, compared = _assigned(batch, centroids, rotation)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, t) for x, t in (
                    (cluster, pa.int32()), (distance, pa.int64()), (compared, pa.int32())))],
                names=["id", "cluster", "distance", "compared"])

    return label


def starting_points(points: DataFrame, clusters: int, seed: str) -> np.ndarray:
    """The points whose seeded id has the smallest sha256, in that order: ``clusters`` rows at most."""
    named = points.where("id is not null").select(F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256).alias("rank"), "point")
    return np.array([r["point"] for r in named.orderBy("rank", "point").limit(clusters).collect()], dtype=np.int64)


def moved(centroids: np.ndarray, sums: dict[int, object]) -> np.ndarray:
    """Each centroid at the exact floored mean of its points; without points it stays."""
    found, width = centroids.copy(), centroids.shape[1] + 1
    for number in range(len(centroids)):
        count = int(sums.get(number * width, 0))
        if count:
            found[number] = [int(sums[number * width + 1 + d]) // count for d in range(width - 1)]
    return found


def cluster_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, scale: int = SCALE,
    clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED, lead: int = LEAD,
) -> DataFrame:
    """The id, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256``, ``compared`` per kept vector.

    ``compared`` counts the centroids whose distance was worked out in the last assignment.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "centroids")
    points = scratch.keep(integer_vectors(vectors, id_col, vector_col, dims, scale), "points")
    centroids = starting_points(points, clusters, seed)
    names = [T.StructField(id_col, points.schema["id"].dataType), *T.StructType.fromDDL(
        "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, compared int").fields]
    if not len(centroids):
        # Without a named vector there is no centroid: no rows.
        return spark.createDataFrame([], T.StructType(names))
    rotation = Rotation(*principal_axes(points, dims), lead)
    schema = T.StructType([*points.schema.fields, *T.StructType.fromDDL("lead array<float>, rest float").fields])
    rotated = scratch.keep(points.mapInArrow(_rotated(rotation, dims), schema), "rotated", batch_rows=TOGETHER)
    for _ in range(rounds):
        sums = _summed(rotated.mapInArrow(_sums(centroids, rotation), "totals array<long>"), "decimal(20,0)")
        centroids = moved(centroids, sums)
    schema = T.StructType([points.schema["id"], *T.StructType.fromDDL("cluster int, distance long, compared int").fields])
    labels = scratch.keep(rotated.mapInArrow(_labels(centroids, rotation), schema), "labels", batch_rows=TOGETHER)
    totals = labels.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()
    inertia = sum(int(r["total"]) for r in totals)
    facts = [(r["cluster"], int(r["total"]), inertia, hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest())
             for r in totals]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return labels.withColumnRenamed("id", id_col).join(F.broadcast(facts), "cluster").select(*[f.name for f in names])
