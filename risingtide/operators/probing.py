"""Approximate k nearest neighbours: an index of cells, some of which each query probes.

The index is fitted on a bounded sample (``SAMPLE`` rows with the smallest md5 of their id)
and holds every row: the cell of its nearest centroid, and a sketch, the signs of ``BITS``
random projections. A query looks at a stated number of cells:

1. in its ``FIRST`` nearest cells all distances are taken; the k-th of them is a bound;
2. in the other probed cells sketches are compared. The share of differing bits estimates
   the angle between two vectors, and with their norms the distance. Only where this
   estimate, less ``SLACK`` of its deviations, lies within the bound is the distance taken.

No cell ever emits its pairs: near cells form regions of bounded size, a query travels once
to each region with the list of its cells there, and a task compares one block of a region
with a block of queries, cell by cell, and sends on at most k rows per query. ``probes_for`` finds the number of cells
to probe: the fewest that hold a target share of the true neighbours of up to ``ASKED``
queries, which are compared with all rows, inside the partitions, for that purpose.

On clustered vectors few cells are needed. Random vectors of many dimensions are the worst
case for any index: there, more than half of all cells have to be probed for a recall above
0.9, but distances are taken for few of the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from risingtide.functions.vectors import finite
from risingtide.operators.neighbours import _ASKED, BLOCK, blocked, chunks, first_of_rows, gaps_of, regions_of
from risingtide.operators.ranking import top_per_group
from risingtide.session import materialise

SAMPLE = 16_384
# The centroids travel with the tasks; so many at most.
MAX_CELLS = 4_096
BITS = 512
FIRST = 2
SLACK = 0.5
# Queries that set the number of probes.
ASKED = 256
TARGET = 0.97


@dataclass
class CellIndex:
    """Centroids, the middle and planes of the sketches, and the table (id, vec, cell, norm, sketch)."""

    centroids: np.ndarray
    middle: np.ndarray
    planes: np.ndarray
    table: DataFrame

    def sketch(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Norms around the middle, and the signs of all projections as 64-bit words."""
        away = vectors - self.middle
        return np.linalg.norm(away, axis=1), np.packbits(away @ self.planes > 0, axis=1).view(np.uint64)

    def order(self, vectors: np.ndarray) -> np.ndarray:
        """The cells of each vector, the nearest first."""
        return _squares(vectors, self.centroids).argsort(axis=1, kind="stable")


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x ** 2).sum(axis=1)[:, None] + (y ** 2).sum(axis=1) - 2 * x @ y.T


def _vectors(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def fit_cells(sample: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Centroids of a sample by Lloyd's rounds, from its first rows."""
    centroids = sample[:cells].copy()
    for _ in range(rounds):
        cell = _squares(sample, centroids).argmin(axis=1)
        held = np.bincount(cell, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, sample)
        centroids[held > 0] = sums[held > 0] / held[held > 0, None]
    return centroids


def build_index(points: DataFrame, id_col: str = "id", vector: str = "features", cells: int | None = None,
                bits: int = BITS, sample: int = SAMPLE) -> CellIndex | None:
    """An index of all points, None without any.

    Ids are unique. Vectors that are null, or hold a null or a number that is not finite,
    are left out. ``cells`` is the square root of the number of points unless given.
    """
    raw = materialise(points.select(
        F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("vec")).where(finite("vec")), "points")
    drawn = [r["vec"] for r in raw.orderBy(F.md5(F.col("id").cast("string")), "id").limit(sample).collect()]
    if not drawn:
        return None
    drawn = np.array(drawn)
    number = min(MAX_CELLS, len(drawn), cells or max(1, ceil(sqrt(raw.count()))))
    planes = np.random.default_rng(17).standard_normal((drawn.shape[1], -(-bits // 64) * 64))
    index = CellIndex(fit_cells(drawn, number), drawn.mean(axis=0), planes, raw)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in chunks(len(pdf), len(own.centroids)):
                some = pdf.iloc[part]
                x = _vectors(some["vec"])
                norm, sketch = own.sketch(x)
                yield some.assign(cell=_squares(x, own.centroids).argmin(axis=1).astype(np.int32), norm=norm,
                                 sketch=[s.tobytes() for s in sketch])

    own = CellIndex(index.centroids, index.middle, index.planes, None)
    kind = raw.schema["id"].dataType.simpleString()
    index.table = materialise(raw.mapInPandas(place, f"id {kind}, vec array<double>, cell int, norm double, sketch binary"), "cells")
    return index


def probes_for(index: CellIndex, queries: DataFrame, k: int, target: float = TARGET, asked: int = ASKED) -> int:
    """The fewest probed cells that hold ``target`` of the true neighbours of some of the queries.

    ``queries`` has ``id`` and ``vec``; the ``asked`` ones with the smallest md5 are taken.
    """
    chosen = queries.orderBy(F.md5(F.col("id").cast("string")), "id").limit(asked).collect()
    if not chosen:
        return 1
    wanted = np.array([r["vec"] for r in chosen])

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                gaps = _squares(wanted, _vectors(pdf["vec"]))
                near = np.argpartition(gaps, min(k, len(pdf)) - 1, axis=1)[:, :k]
                row = np.repeat(np.arange(len(wanted)), near.shape[1])
                at = near.reshape(-1)
                yield pd.DataFrame({"query": row, "gap": gaps[row, at], "cell": pdf["cell"].to_numpy()[at]})

    found = index.table.select("vec", "cell").mapInPandas(nearest, "query int, gap double, cell int")
    rows = top_per_group(found, ["query"], [F.asc("gap"), F.asc("cell")], k, "rank").select("query", "cell").collect()
    place = index.order(wanted).argsort(axis=1)
    ranks = np.sort([place[r["query"], r["cell"]] for r in rows])
    return int(ranks[max(0, ceil(target * len(ranks)) - 1)]) + 1


def _cosines(bits: int, slack: float) -> np.ndarray:
    """By the number of differing bits, the largest cosine still likely."""
    differ = np.arange(bits + 1)
    sure = np.maximum(differ - slack * np.sqrt(differ * (bits - differ) / bits), 0)
    return np.cos(np.pi * sure / bits)


def _probe(index: CellIndex, queries: DataFrame, region: np.ndarray, k: int, slack: float, block: int, result: str) -> DataFrame:
    """(id, vec, bound, target, cells) -> at most ``k`` rows per query and block of the region ``target``.

    The first row of each query and block tells how many distances were taken; it has no
    point where none was near enough.
    """
    targets = queries.sparkSession.createDataFrame([(i, int(r)) for i, r in enumerate(region)], "cell int, target int")
    points = index.table.join(F.broadcast(targets), "cell").select("id", "vec", "norm", "sketch", "cell", "target")
    own = CellIndex(index.centroids, index.middle, index.planes, None)
    bits = index.planes.shape[1]

    def compare(_, asked: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(points):
            return pd.DataFrame({"query_id": [], "point_id": [], "distance": [], "compared": []})
        points = points.sort_values("id")
        ids, x, norm = points["id"].to_numpy(), _vectors(points["vec"]), points["norm"].to_numpy()
        sketch = np.frombuffer(b"".join(points["sketch"]), dtype=np.uint64).reshape(len(points), -1)
        of = points["cell"].to_numpy()
        cells, order = np.unique(of), of.argsort(kind="stable")
        held = np.split(order, np.searchsorted(of[order], cells[1:]))
        likely, out = _cosines(bits, slack), []
        for a in range(0, len(asked), _ASKED):
            some = asked.iloc[a: a + _ASKED]
            wanted, bound = _vectors(some["vec"]), some["bound"].fillna(np.inf).to_numpy()
            q_norm, q_sketch = own.sketch(wanted)
            lists = some["cells"].to_numpy()
            row, flat = np.repeat(np.arange(len(some)), [len(c) for c in lists]), np.concatenate(lists)
            place = np.minimum(np.searchsorted(cells, flat), len(cells) - 1)
            probes = np.zeros((len(some), len(cells)), dtype=bool)
            probes[row, place] = cells[place] == flat
            taken, near = np.zeros(len(some), dtype=np.int64), []
            for cell, columns in enumerate(held):
                rows = np.flatnonzero(probes[:, cell])
                for part in chunks(len(rows), len(columns)):
                    q = rows[part]
                    differ = np.zeros((len(q), len(columns)), dtype=np.int64)
                    for word in range(sketch.shape[1]):
                        differ += np.bitwise_count(q_sketch[q, word, None] ^ sketch[None, columns, word])
                    least = q_norm[q, None] ** 2 + norm[columns] ** 2 - 2 * q_norm[q, None] * norm[columns] * likely[differ]
                    r, c = np.nonzero(least <= bound[q, None] ** 2)
                    r, c = q[r], columns[c]
                    taken += np.bincount(r, minlength=len(some))
                    gap = gaps_of(wanted, x, r, c)
                    hit = gap <= bound[r]
                    near.append(first_of_rows(k, r[hit], c[hit], gap[hit]))
            row, col, gap = first_of_rows(k, *(np.concatenate(v) for v in zip(*near))) if near else (np.zeros(0, int),) * 3
            none = np.setdiff1d(np.arange(len(some)), row)
            first = np.r_[True, row[1:] != row[:-1]][:len(row)]
            out.append(pd.DataFrame({
                "query_id": some["id"].to_numpy()[np.concatenate([row, none])],
                "point_id": pd.Series([*ids[col], *[None] * len(none)], dtype="object"),
                "distance": np.concatenate([gap, np.full(len(none), np.nan)]),
                "compared": np.concatenate([np.where(first, taken[row], 0), taken[none]]).astype(np.int64)}))
        return pd.concat(out)

    keys = ["target", "qb", "pb"]
    left, right = blocked(queries, points, block)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, result)


def probed_neighbours(
    queries: DataFrame, index: CellIndex, k: int = 5, query_id: str = "id", query_vector: str = "features",
    probes: int | None = None, target: float = TARGET, slack: float = SLACK, block: int = BLOCK, said: dict | None = None,
) -> DataFrame:
    """The ``k`` nearest points found for every query: query_id, point_id, distance, rank.

    Distances are exact; a near point may be missing where its cell is not probed or its
    sketch misleads. Ties go by point id, ids are unique, queries whose vector is null or
    not finite are left out. ``probes`` is the number of cells, ``probes_for`` the target
    unless given. ``said``, where given, gets the number of ``probes``, of pairs whose
    sketches were ``scanned`` and of those whose distance was taken (``compared``).
    """
    q = materialise(queries.select(
        F.col(query_id).alias("id"), F.col(query_vector).cast("array<double>").alias("vec")).where(finite("vec")), "queries")
    q_kind, p_kind = (df.schema["id"].dataType.simpleString() for df in (q, index.table))
    result = f"query_id {q_kind}, point_id {p_kind}, distance double, compared long"
    probes = min(probes or probes_for(index, q, k, target), len(index.centroids))
    own = CellIndex(index.centroids, index.middle, index.planes, None)

    # One number per cell, MAX_CELLS at most.
    sizes = np.zeros(len(index.centroids), dtype=np.int64)
    for r in index.table.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["cell"]] = r["n"]
    region = regions_of(index.centroids, sizes, block)

    def route(first: int, last: int):
        def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for part in chunks(len(pdf), len(sizes)):
                    some = pdf.iloc[part]
                    cells = own.order(_vectors(some["vec"]))[:, first:last]
                    row, cells = np.repeat(np.arange(len(some)), cells.shape[1]), cells.reshape(-1)
                    row, cells = row[sizes[cells] > 0], cells[sizes[cells] > 0]
                    order = np.lexsort((cells, region[cells], row))
                    row, cells = row[order], cells[order].astype(np.int32)
                    if not len(row):
                        continue
                    starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (region[cells[1:]] != region[cells[:-1]])])
                    lists = np.split(cells, starts[1:])
                    yield some.iloc[row[starts]].assign(target=region[cells[starts]], cells=lists, pairs=np.add.reduceat(sizes[cells], starts))

        return routed

    kind = f"id {q_kind}, vec array<double>, bound double, target int, cells array<int>, pairs long"
    near = materialise(q.withColumn("bound", F.lit(float("inf"))).mapInPandas(route(0, min(FIRST, probes)), kind), "routed")
    near = materialise(_probe(index, near, region, k, slack, block, result), "near")
    ranked = top_per_group(near.where("point_id IS NOT NULL"), ["query_id"], [F.asc("distance"), F.asc("point_id")], k, "rank")
    ranked = materialise(ranked, "first-cells")
    bounds = ranked.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("distance").alias("bound"))
    bounded = q.join(bounds, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    more = materialise(bounded.select("id", "vec", "bound").mapInPandas(route(FIRST, max(probes, FIRST)), kind), "routed")
    others = materialise(_probe(index, more, region, k, slack, block, result), "others")
    if said is not None:
        scanned = more.agg(F.sum("pairs")).first()[0] or 0
        first, second = (df.agg(F.sum("compared")).first()[0] or 0 for df in (near, others))
        said.update(probes=probes, cells=len(index.centroids), scanned=scanned, compared=first + second)
    both = ranked.drop("rank", "compared").unionByName(others.where("point_id IS NOT NULL").drop("compared"))
    return top_per_group(both, ["query_id"], [F.asc("distance"), F.asc("point_id")], k, "rank")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact neighbours (query_id, point_id) that were found."""
    hit = found.select("query_id", "point_id").withColumn("__hit", F.lit(1))
    return exact.select("query_id", "point_id").join(hit, ["query_id", "point_id"], "left").agg(F.avg(F.coalesce("__hit", F.lit(0)))).first()[0]
