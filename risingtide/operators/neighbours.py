"""Exact k nearest neighbours of many query vectors.

Points lie in cells, about as many as the square root of the table: halves of halves of a
sample, cut between different values. Each has a pivot, itself a point. The distance to a
query's k-th pivot, or its k-th neighbour in its own cell, bounds how far its neighbours can
be; only cells whose box and, by the triangle inequality, whose radius around the pivot reach
into that bound are looked at, each query with its own bound (after the partitioned kNN join
of Lu et al., 2012). Neighbouring cells form regions of bounded
size, and a query travels once to each region it needs, not to each cell. A cell with
many rows is cut into blocks, so every task compares two blocks of bounded size, cell by
cell, and sends on at most k rows per query.

On clustered vectors few pairs are compared. Where all distances are nearly equal, as
between random vectors of many dimensions, no exact method prunes much, and nearly all
pairs are compared, in blocks; ``probing`` has the approximate form for such tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from risingtide.functions.vectors import finite
from risingtide.operators.ranking import top_per_group
from risingtide.session import materialise

# The pivots are held by the driver and travel with the tasks; so many at most.
MAX_PIVOTS = 4_096
# Points by which cells are cut: at most so many for each, and so many numbers of them in all.
_SAMPLED = 16
_SAMPLED_NUMBERS = 1_000_000
# Rows of a side that one task holds.
BLOCK = 32_768
# Query-point pairs compared at once inside a task.
_PAIRS = 500_000
# Queries whose candidates a task collects at once.
_ASKED = 2_048
# Numbers of the differences that a task holds at once; of copies of a vector every pair is a candidate.
_NUMBERS = 500_000
# Points of the smallest box. Boxes are used where a query looks at no more than this share of them on average.
_LEAF = 32
_BOX_SHARE = 0.25
# Queries by which that is told.
_TRIED = 64


def chunks(rows: int, width: int) -> Iterator[slice]:
    """Slices of ``rows`` rows, each with about ``_PAIRS`` pairs where a row has ``width`` of them."""
    step = max(1, _PAIRS // max(1, width))
    return (slice(at, at + step) for at in range(0, rows, step))


def regions_of(centres: np.ndarray, sizes: np.ndarray, block: int) -> np.ndarray:
    """The region of each cell: near cells together, up to ``block`` rows; a larger cell is alone."""
    region, number = np.zeros(len(centres), dtype=np.int32), 0
    todo = [np.arange(len(centres))]
    while todo:
        cells = todo.pop()
        if len(cells) == 1 or sizes[cells].sum() <= block:
            region[cells] = number
            number += 1
            continue
        wide = np.ptp(centres[cells], axis=0).argmax()
        cells = cells[centres[cells, wide].argsort(kind="stable")]
        before = np.cumsum(sizes[cells])
        cut = min(max(1, int(np.searchsorted(before, before[-1] / 2))), len(cells) - 1)
        todo += [cells[cut:], cells[:cut]]
    return region


class Cuts:
    """Halves of halves of some points, cut between different values, down to parts of ``leaf`` points or equal ones."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.order = np.arange(len(points))
        axis, value, below, starts = [], [], [], []
        todo = [(0, len(points), -1)]
        while todo:
            lo, hi, parent = todo.pop()
            # The lower half of a node is the one after it, the upper half comes after that one's.
            if parent >= 0:
                below[parent] = len(axis)
            some = points[self.order[lo:hi]]
            wide = some.var(axis=0).argmax() if hi - lo > leaf and some.shape[1] else 0
            if hi - lo <= leaf or not some.shape[1] or (line := np.sort(some[:, wide]))[0] == line[-1]:
                axis.append(-1), value.append(0.0), below.append(len(starts)), starts.append(lo)
                continue
            middle = line[len(line) // 2]
            first, after = np.searchsorted(line, middle), np.searchsorted(line, middle, "right")
            cut = after if first == 0 or (after < len(line) and after + first < len(line)) else first
            inside = some[:, wide] < line[cut]
            self.order[lo:hi] = np.r_[self.order[lo:hi][inside], self.order[lo:hi][~inside]]
            axis.append(wide), value.append(line[cut]), below.append(0)
            todo += [(lo + cut, hi, len(axis) - 1), (lo, lo + cut, -1)]
        self.axis, self.value, self.below, self.starts = np.array(axis), np.array(value), np.array(below), np.array(starts)

    def part(self, x: np.ndarray) -> np.ndarray:
        """The part in which each row of ``x`` lies, by number."""
        node = np.zeros(len(x), dtype=np.int64)
        while len(inner := np.flatnonzero(self.axis[node] >= 0)):
            at = node[inner]
            lower = x[inner, self.axis[at]] < self.value[at]
            node[inner] = np.where(lower, at + 1, self.below[at])
        return self.below[node]


def _in_cells(df: DataFrame, cuts: Cuts, pivots: np.ndarray) -> DataFrame:
    """(id, vec) -> (id, vec, cell, gap): the cell and the distance from its pivot."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in chunks(len(pdf), 64):
                some = pdf.iloc[part]
                x = np.stack(some["vec"].to_numpy()).astype(float)
                cell = cuts.part(x)
                yield some.assign(cell=cell.astype(np.int32), gap=gaps_of(x, pivots, np.arange(len(x)), cell))

    kind = df.schema["id"].dataType.simpleString()
    return df.mapInPandas(assign, f"id {kind}, vec array<double>, cell int, gap double")


def _corners(cells: DataFrame) -> tuple[list, list]:
    """The radius and number of the points of each cell, and the corners of its box by component."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = {}
        for pdf in batches:
            x, of = np.stack(pdf["vec"].to_numpy()).astype(float), pdf["cell"].to_numpy()
            order = of.argsort(kind="stable")
            cell, at = np.unique(of[order], return_index=True)
            parts = zip(np.minimum.reduceat(x[order], at), np.maximum.reduceat(x[order], at),
                        np.maximum.reduceat(pdf["gap"].to_numpy()[order], at), np.diff(np.r_[at, len(of)]))
            for c, (low, high, reach, n) in zip(cell, parts):
                old = found.get(c, (low, high, reach, 0))
                found[c] = np.minimum(old[0], low), np.maximum(old[1], high), max(old[2], reach), old[3] + n
        if found:
            low, high, reach, n = zip(*found.values())
            yield pd.DataFrame({"cell": list(found), "low": list(low), "high": list(high), "reach": reach, "n": n})

    parts = cells.select("vec", "cell", "gap").mapInPandas(fold, "cell int, low array<double>, high array<double>, reach double, n long")
    # One row per cell and component reaches the driver.
    corners = parts.select("cell", F.posexplode(F.arrays_zip("low", "high")).alias("pos", "side")).groupBy("cell", "pos").agg(
        F.min("side.low").alias("low"), F.max("side.high").alias("high"))
    whole = parts.groupBy("cell").agg(F.max("reach").alias("reach"), F.sum("n").alias("n"))
    return whole.collect(), corners.collect()


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances from the differences, a component at a time."""
    squares = np.zeros((len(x), len(pivots)))
    for a, b in zip(x.T, pivots.T):
        gap = a[:, None] - b
        gap *= gap
        squares += gap
    return np.sqrt(squares, out=squares)


def _wanted(gaps: np.ndarray, reach: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Which cells can hold a point within the bound; ``reach`` is a cell's radius, negative without points."""
    # Distances that are not known rule nothing out.
    return ~(gaps - reach > bound + 1e-9 * (1.0 + gaps)) & (reach >= 0)


def _routed(queries: DataFrame, pivots: np.ndarray, reach: np.ndarray, sizes: np.ndarray, region: np.ndarray, k: int,
            boxes: Boxes | None = None) -> DataFrame:
    """(id, vec, cell, bound) -> (id, vec, cell, bound, target, pairs): the regions of other cells that a
    query's neighbours can lie in, and how many points these cells hold."""
    regions = int(region.max()) + 1

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in chunks(len(pdf), len(pivots)):
                some = pdf.iloc[part]
                x = np.stack(some["vec"].to_numpy()).astype(float)
                bound = some["bound"].to_numpy(dtype=float)
                unknown = np.flatnonzero(np.isnan(bound))
                bound[unknown] = np.inf
                if len(unknown) and len(pivots) >= k:  # pivots are points, so the k-th nearest of them is a bound
                    bound[unknown] = np.partition(_distances(x[unknown], pivots), k - 1, axis=1)[:, k - 1]
                if boxes is None:
                    row, cell = (index.ravel() for index in np.indices((len(x), len(pivots))))
                else:
                    row, cell, _ = boxes.near(x, bound)
                other = cell != some["cell"].to_numpy()[row]
                row, cell = row[other], cell[other]
                near = _wanted(gaps_of(x, pivots, row, cell), reach[cell], bound[row])
                row, cell = row[near], cell[near]
                pairs = np.bincount(row * regions + region[cell], sizes[cell], len(x) * regions).astype(np.int64).reshape(len(x), regions)
                row, target = np.nonzero(pairs)
                for at in range(0, len(row), _ASKED):
                    r, t = row[at : at + _ASKED], target[at : at + _ASKED]
                    yield some[["id", "vec", "cell"]].iloc[r].assign(bound=bound[r], target=t.astype(np.int32), pairs=pairs[r, t])

    kind = queries.schema["id"].dataType.simpleString()
    return queries.mapInPandas(route, f"id {kind}, vec array<double>, cell int, bound double, target int, pairs long")


def first_of_rows(k: int, row: np.ndarray, col: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` entries of each row with the smallest gap, ties by column, sorted."""
    order = np.lexsort((col, gap, row))
    row, col, gap = row[order], col[order], gap[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], col[keep], gap[keep]


def gaps_of(x: np.ndarray, y: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """The distance of ``x[row]`` and ``y[col]`` for each of many pairs, from the differences."""
    gap, step = np.empty(len(row)), max(1, _NUMBERS // max(1, x.shape[1]))
    for at in range(0, len(row), step):
        away = y[col[at : at + step]]
        away -= x[row[at : at + step]]
        away *= away
        gap[at : at + step] = np.sqrt(away.sum(axis=1))
    return gap


def first_copies(points: np.ndarray, k: int) -> np.ndarray:
    """The rows of ``points`` but for those that ``k`` equal rows precede, in order."""
    if not points.shape[1]:
        return np.arange(min(k, len(points)))
    whole = np.ascontiguousarray(points).view(np.dtype((np.void, points.dtype.itemsize * points.shape[1]))).ravel()
    copy = np.unique(whole, return_inverse=True)[1]
    order = copy.argsort(kind="stable")
    place = np.arange(len(order)) - np.searchsorted(copy[order], copy[order])
    return np.sort(order[place < k])


def _nearest_in_block(
    queries: np.ndarray, points: np.ndarray, k: int, bound: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and distance of each query's ``k`` nearest points, ties by column.

    One matrix product finds the candidates, with room for its rounding; their
    distances are then taken from the differences. Points farther than ``bound``
    may be left out.
    """
    q2, p2 = (queries**2).sum(axis=1), (points**2).sum(axis=1)
    rough = queries @ points.T
    rough *= -2.0
    rough += q2[:, None]
    rough += p2
    limit = np.full(len(queries), np.inf) if bound is None else bound**2
    if len(points) > k and np.isinf(limit).any():
        limit = np.minimum(limit, np.partition(rough, k - 1, axis=1)[:, k - 1])
    if np.isinf(limit).all():
        row, col = np.nonzero(np.ones_like(rough, dtype=bool))
    else:
        limit = limit * (1.0 + 1e-9) + 1e-9 * (1.0 + q2 + p2.max())
        row, col = np.nonzero(rough <= limit[:, None])
    return first_of_rows(k, row, col, gaps_of(queries, points, row, col))


def _nearest_in_cells(x: np.ndarray, wanted: np.ndarray, bound: np.ndarray, points: np.ndarray, held: list[np.ndarray],
                      k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``_nearest_in_block``, each query only with the cells it wants; ``held`` are the columns of each cell.

    What a cell gives tightens the bound for the next one.
    """
    best_gap, best_col = np.full((len(x), k), np.inf), np.zeros((len(x), k), dtype=np.int64)
    bound = bound.copy()
    for cell, columns in enumerate(held):
        asked = np.flatnonzero(wanted[:, cell])
        if not len(asked) or not len(columns):
            continue
        some = points[columns]
        for part in chunks(len(asked), len(columns)):
            at = asked[part]
            row, col, gap = _nearest_in_block(x[at], some, k, bound[at])
            if not len(row):
                continue
            found, row = np.unique(row, return_inverse=True)
            rows, old = at[found], np.repeat(np.arange(len(found)), k)
            row, col, gap = first_of_rows(
                k, np.r_[old, row], np.r_[best_col[rows].ravel(), columns[col]], np.r_[best_gap[rows].ravel(), gap])
            best_gap[rows], best_col[rows] = gap.reshape(-1, k), col.reshape(-1, k)
            bound[rows] = np.minimum(bound[rows], best_gap[rows, -1])
    row, place = np.nonzero(np.isfinite(best_gap))
    return row, best_col[row, place], best_gap[row, place]


class Boxes:
    """Boxes around points, and around pairs of neighbouring boxes, up to the one around all."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.number = len(low)
        # Lower and upper corners; what is missing to a power of two is nowhere.
        missing = ((0, (1 << (len(low) - 1).bit_length()) - len(low)), (0, 0))
        self.levels = [(np.pad(low, missing, constant_values=np.inf), np.pad(high, missing, constant_values=-np.inf))]
        while len(self.levels[-1][0]) > 1:
            low, high = self.levels[-1]
            self.levels.append((np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])))

    def near(self, x: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, box and its distance wherever a box reaches into the bound of a row."""
        row, box, gap = np.arange(len(x)), np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
        for low, high in self.levels[-2::-1]:
            row, box = np.repeat(row, 2), np.repeat(2 * box, 2)
            box[1::2] += 1
            gap, step = np.empty(len(row)), max(1, _NUMBERS // max(1, x.shape[1]))
            for at in range(0, len(row), step):
                some, held = x[row[at : at + step]], box[at : at + step]
                away = np.maximum(low[held] - some, some - high[held])
                np.maximum(away, 0.0, out=away)
                away *= away
                gap[at : at + step] = np.sqrt(away.sum(axis=1))
            inside = gap <= bound[row] * (1.0 + 1e-9)
            row, box, gap = row[inside], box[inside], gap[inside]
        there = box < self.number
        return row[there], box[there], gap[there]


class Searched(Boxes):
    """Points in small boxes."""

    def __init__(self, points: np.ndarray):
        cuts = Cuts(points, _LEAF)
        self.order, self.starts, self.points = cuts.order, cuts.starts, points[cuts.order]
        self.sizes = np.diff(np.r_[cuts.starts, len(points)])
        super().__init__(*(side.reduceat(self.points, cuts.starts) for side in (np.minimum, np.maximum)))

    def useful(self, x: np.ndarray, bound: np.ndarray) -> bool:
        some = np.unique(np.linspace(0, len(x) - 1, _TRIED).astype(int))
        return len(self.near(x[some], bound[some])[0]) <= _BOX_SHARE * len(some) * len(self.starts)

    def nearest(self, x: np.ndarray, own: np.ndarray, cells: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``_nearest_in_block``, without the points of a query's ``own`` cell; ``cells`` are those of the points.

        Nearer boxes come first, and what they give tightens the bound for the others.
        """
        row, box, gap = self.near(x, bound)
        order = np.lexsort((gap, row))
        row, box, gap = row[order], box[order], gap[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        best, bound, at, turn = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)), bound.copy(), 0, 1
        while at <= place.max(initial=-1):
            asked = np.flatnonzero((place >= at) & (place < at + turn) & (gap <= bound[row] * (1.0 + 1e-9)))
            at, turn = at + turn, 2 * turn
            for part in chunks(len(asked), _LEAF):
                some = asked[part]
                size = self.sizes[box[some]]
                r = np.repeat(row[some], size)
                spot = np.arange(len(r)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.starts[box[some]], size)
                away = gaps_of(x, self.points, r, spot)
                c = self.order[spot]
                hit = np.flatnonzero((away <= bound[r]) & (cells[c] != own[r]))
                best = first_of_rows(k, *(np.concatenate(v) for v in zip(best, (r[hit], c[hit], away[hit]))))
                # The k-th of a row, where it has so many.
                last = np.flatnonzero(np.arange(len(best[0])) - np.searchsorted(best[0], best[0]) == k - 1)
                bound[best[0][last]] = np.minimum(bound[best[0][last]], best[2][last])
        return best


def blocked(q: DataFrame, p: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with their blocks ``qb`` and ``pb`` of each ``target``: every pair of blocks meets once.

    Both are stored tables. The sizes of the targets, one row each, are read by the driver.
    """
    q_count, p_count = ({r["target"]: r["n"] for r in side.groupBy("target").agg(F.count(F.lit(1)).alias("n")).collect()} for side in (q, p))
    grid = F.broadcast(q.sparkSession.createDataFrame(
        [(t, -(-n // block), -(-p_count[t] // block)) for t, n in q_count.items() if t in p_count],
        "target int, q_blocks int, p_blocks int",
    ))

    def cut(side: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("id"), F.col(f"{own}_blocks")).cast("int").alias(f"{own}b")
        every = F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)).alias(f"{other}b")
        return side.join(grid, "target").select(*side.columns, mine, every)

    return cut(q, "q", "p"), cut(p, "p", "q")


def _in_blocks(q: DataFrame, p: DataFrame, k: int, block: int, result: str, pivots: np.ndarray, reach: np.ndarray) -> DataFrame:
    """The ``k`` nearest for every query of (id, vec, cell, bound, target) among the points of that region.

    Without a bound only the query's own cell is looked at, with one only the others.
    """

    def compare(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "point_id": [], "distance": []})
        right = right.sort_values("id")
        points = np.stack(right["vec"].to_numpy()).astype(float)
        # Of equal points only the k with the smallest ids can be among the nearest.
        kept = first_copies(points, k)
        points, ids, of = points[kept], right["id"].to_numpy()[kept], right["cell"].to_numpy()[kept]
        cells = np.unique(of)
        order = of.argsort(kind="stable")
        held = np.split(order, np.searchsorted(of[order], cells[1:]))
        alone = left["bound"].isna().all()
        parts, boxes = [], None if alone else Searched(points)
        for at in range(0, len(left), _ASKED):
            some = left.iloc[at : at + _ASKED]
            x, bound, own = np.stack(some["vec"].to_numpy()).astype(float), some["bound"].to_numpy(dtype=float), some["cell"].to_numpy()
            if boxes and (at or boxes.useful(x, bound)):
                row, col, gap = boxes.nearest(x, own, of, bound, k)
            else:
                boxes, wanted = None, own[:, None] == cells
                if alone:
                    bound = np.full(len(x), np.inf)
                else:
                    wanted = ~wanted & _wanted(_distances(x, pivots[cells]), reach[cells], bound[:, None])
                row, col, gap = _nearest_in_cells(x, wanted, bound, points, held, k)
            parts.append((some["id"].to_numpy()[row], ids[col], gap))
        return pd.DataFrame({
            name: np.concatenate([part[i] for part in parts]) for i, name in enumerate(("query_id", "point_id", "distance"))})

    keys = ["target", "qb", "pb"]
    left, right = blocked(q, p, block)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, result)


def nearest_neighbours(
    queries: DataFrame,
    points: DataFrame,
    k: int = 5,
    query_id: str = "id",
    point_id: str = "id",
    query_vector: str = "features",
    point_vector: str = "features",
    pivots: int | None = None,
    block: int = BLOCK,
    said: dict | None = None,
) -> DataFrame:
    """The ``k`` nearest points of every query: query_id, point_id, distance, rank.

    Euclidean distance, ties by point id. Ids are unique on each side. Vectors that are
    null, or hold a null or a number that is not finite, are left out. ``pivots`` is
    the square root of the number of points unless given. ``said``, where given, gets
    the number of ``pairs`` compared and of ``pivots``.
    """
    spark = queries.sparkSession
    q_raw = queries.select(
        F.col(query_id).alias("id"), F.col(query_vector).cast("array<double>").alias("vec")
    ).where(finite("vec"))
    p_raw = materialise(points.select(
        F.col(point_id).alias("id"), F.col(point_vector).cast("array<double>").alias("vec")
    ).where(finite("vec")), "points")

    q_kind = q_raw.schema["id"].dataType.simpleString()
    p_kind = p_raw.schema["id"].dataType.simpleString()
    result = f"query_id {q_kind}, point_id {p_kind}, distance double"
    rows = p_raw.count()
    pivots = min(MAX_PIVOTS, pivots or max(1, ceil(sqrt(rows))))
    # Known before the sample is read, so that what the driver holds is bounded.
    width = p_raw.select(F.max(F.size("vec"))).first()[0] or 1
    sampled = max(pivots, min(_SAMPLED * pivots, _SAMPLED_NUMBERS // max(1, width)))
    chosen = p_raw.orderBy(F.md5(F.col("id").cast("string")), "id").limit(sampled).collect()
    if not chosen:
        return spark.createDataFrame([], result + ", rank int")
    sample = np.array([row["vec"] for row in chosen], dtype=float)
    cuts = Cuts(sample, max(1, len(sample) // pivots))
    centres = sample[cuts.order[cuts.starts]]
    q, p = (materialise(_in_cells(df, cuts, centres), "cells") for df in (q_raw, p_raw))
    reach, sizes = np.full(len(centres), -1.0), np.zeros(len(centres), dtype=np.int64)
    low, high = np.full(centres.shape, np.inf), np.full(centres.shape, -np.inf)
    whole, corners = _corners(p)
    for r in whole:
        reach[r["cell"]], sizes[r["cell"]] = r["reach"], r["n"]
    for r in corners:
        low[r["cell"], r["pos"]], high[r["cell"], r["pos"]] = r["low"], r["high"]
    boxes = Boxes(low, high)
    # The region of each cell: MAX_PIVOTS rows at most.
    region = regions_of(centres, sizes, block)
    cells = [(i, int(r), int(n)) for i, (r, n) in enumerate(zip(region, sizes))]

    def targeted(side: DataFrame) -> DataFrame:
        return side.join(F.broadcast(spark.createDataFrame(cells, "cell int, target int, pairs long")), "cell")

    p = targeted(p).select("id", "vec", "cell", "target")
    alone = targeted(q).select("id", "vec", "cell", F.lit(None).cast("double").alias("bound"), "target", "pairs")
    own = _in_blocks(alone, p, k, block, result, centres, reach)
    near = materialise(top_per_group(own, ["query_id"], [F.asc("distance"), F.asc("point_id")], k, "rank"), "own-cell")
    bounds = near.groupBy("query_id").agg(F.max(F.when(F.col("rank") == k, F.col("distance"))).alias("bound"))
    bounded = q.join(bounds, q["id"] == bounds["query_id"], "left").select("id", "vec", "cell", "bound")
    routed = materialise(_routed(bounded, centres, reach, sizes, region, k, boxes), "routed")
    others = _in_blocks(routed, p, k, block, result, centres, reach)
    if said is not None:
        pairs = sum(side.agg(F.sum("pairs")).first()[0] or 0 for side in (alone, routed))
        said.update(pairs=pairs, pivots=len(centres))
    both = near.drop("rank").unionByName(others)
    return top_per_group(both, ["query_id"], [F.asc("distance"), F.asc("point_id")], k, "rank")


def neighbour_mean(
    neighbours: DataFrame, points: DataFrame, point_id: str, label: str, out: str = "prediction"
) -> DataFrame:
    """Mean label of each query's neighbours: query_id, ``out``."""
    labels = points.select(F.col(point_id).alias("point_id"), F.col(label).cast("double").alias("__label"))
    return (
        neighbours.join(labels, "point_id")
        .groupBy("query_id")
        .agg(F.avg("__label").alias(out))
    )
