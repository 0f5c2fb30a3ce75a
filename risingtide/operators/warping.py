"""k-means on equally long series under dynamic time warping.

Each round is one Spark job over the series, which are kept in blocks: tasks align their
series with the few centroids and send back sums per centroid position. Only these sums
and the centroids, ``k`` arrays, pass through the driver.

A series is always aligned with the centroid that was nearest to it, and with another one
only where that could have come nearer. Its distances to the centroids of some earlier round
are kept, and with them a bound: as an alignment has ``length`` cells at least and twice as many
at most, the distance to a centroid changes by no more than what the centroid has moved along
such an alignment. Where too many series were in doubt, the distances are taken anew.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, functions as F

from risingtide.session import materialise

# Far above the rounds that k-means needs.
MAX_ROUNDS = 1_000
# Cells of alignment tables whose moves a task holds at once, two bytes each, and numbers of one diagonal,
# of which a processor's cache holds a few.
_CELLS = 8_000_000
_DIAGONAL = 40_000
# Parts of a round's sums that the driver adds up by itself.
_PARTS = 256
# Cells of the alignment tables of all series in one stored file: a round's work is far larger
# than its bytes, by which Spark would put all series into a few tasks.
FILE_CELLS = 20_000_000


def alignment_table(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Least total squared cost of aligning each row's prefixes with the centroid's."""
    n, rows = x.shape
    cols = len(centroid)
    # Cell (i, j) is kept at [i + j, i]: a diagonal needs only the two before it, and is worked
    # out for all its cells and series at once, the series next to each other in memory.
    skewed = np.empty((rows + cols + 1, rows + 1, n))
    skewed[1:, 0] = skewed[np.arange(rows + 1), np.arange(rows + 1)] = np.inf
    skewed[0, 0] = 0.0
    values = np.ascontiguousarray(x.T)
    for d in range(2, rows + cols + 1):
        first, last = max(1, d - cols), min(rows, d - 1)
        best = np.minimum(skewed[d - 2, first - 1 : last], skewed[d - 1, first - 1 : last])
        np.minimum(best, skewed[d - 1, first : last + 1], out=best)
        cost = values[first - 1 : last] - centroid[d - 1 - np.arange(first, last + 1), None]
        np.multiply(cost, cost, out=cost)
        np.add(cost, best, out=skewed[d, first : last + 1])
    diagonal, row, one = skewed.strides
    return np.lib.stride_tricks.as_strided(skewed, (n, rows + 1, cols + 1), (one, diagonal + row, diagonal))


def aligned_sums(x: np.ndarray, table: np.ndarray, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the values aligned to each centroid position, of the rows ``of`` where given."""
    n, rows, cols = len(x), table.shape[1] - 1, table.shape[2] - 1
    sums, hits = np.zeros(cols), np.zeros(cols, dtype=np.int64)
    i, j = np.full(n, rows), np.full(n, cols)
    live = np.arange(n) if of is None else of
    while len(live):
        a, b = i[live], j[live]
        np.add.at(sums, b - 1, x[live, a - 1])
        np.add.at(hits, b - 1, 1)
        moves = np.stack([table[live, a - 1, b - 1], table[live, a - 1, b], table[live, a, b - 1]])
        move = moves.argmin(axis=0)
        i[live] = a - (move != 2)
        j[live] = b - (move != 1)
        live = live[(i[live] > 0) & (j[live] > 0)]
    return sums, hits


class Aligner:
    """Series of ``rows`` numbers aligned with centroids of ``cols``, up to ``size`` at a time, in buffers used again."""

    def __init__(self, rows: int, cols: int, size: int):
        self.rows, self.cols, self.size = rows, cols, size
        self._lines = [np.empty((rows + 1) * size) for _ in range(5)]
        self._moves = [np.empty((rows + cols + 1) * (rows + 1) * size, dtype=np.uint8) for _ in range(2)]

    def costs(self, x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """Least squared cost of aligning each row of ``x`` with the same row of ``centroids``."""
        parts = [slice(at, at + self.size) for at in range(0, len(x), self.size)]
        return np.concatenate([np.empty(0), *[self.aligned(x[p], centroids[p]) for p in parts]])

    def aligned(self, x: np.ndarray, centroids: np.ndarray, moves: bool = False) -> np.ndarray:
        """As ``costs``, of ``size`` rows at most; with ``moves`` they can be walked back.

        Cell (i, j) lies on diagonal i + j, at i, the series next to each other. A diagonal needs only the two before it.
        """
        n, rows, cols = len(x), self.rows, self.cols
        lines = [line[: (rows + 1) * n].reshape(rows + 1, n) for line in self._lines]
        values, mirrored = np.ascontiguousarray(x.T), np.ascontiguousarray(centroids.T[::-1])
        if moves:
            up, left = self._move_tables(n)
            # Where a walk ends.
            for table, end in ((up, 0), (left, 2)):
                table[: cols + 1, 0] = table[np.arange(rows + 1), np.arange(rows + 1)] = end
            up, left = up.view(bool), left.view(bool)
        lines[0][0], lines[1][:2] = 0.0, np.inf
        for d in range(2, rows + cols + 1):
            first, last = max(1, d - cols), min(rows, d - 1)
            here, before, corner = lines[d % 3], lines[(d - 1) % 3], lines[(d - 2) % 3]
            above, beside, diagonal = before[first - 1 : last], before[first : last + 1], corner[first - 1 : last]
            best, cost = lines[3][first : last + 1], lines[4][first : last + 1]
            np.minimum(diagonal, above, out=best)
            if moves:
                np.less(above, diagonal, out=up[d, first : last + 1])
                np.less(beside, best, out=left[d, first : last + 1])
            np.minimum(best, beside, out=best)
            # Row i meets position d - i of the centroid.
            np.subtract(values[first - 1 : last], mirrored[cols - d + first : cols - d + last + 1], out=cost)
            np.multiply(cost, cost, out=cost)
            np.add(cost, best, out=here[first : last + 1])
            if d <= cols:
                here[0] = np.inf
            if d <= rows:
                here[d] = np.inf
        return lines[(rows + cols) % 3][rows].copy()

    def _move_tables(self, n: int) -> list[np.ndarray]:
        cells = (self.rows + self.cols + 1) * (self.rows + 1) * n
        return [table[:cells].reshape(-1, self.rows + 1, n) for table in self._moves]

    def add_walks(self, x: np.ndarray, labels: np.ndarray, of: np.ndarray, totals: np.ndarray, hits: np.ndarray) -> None:
        """Adds the values aligned to each centroid position to ``totals`` and their number to ``hits``.

        Walks back the moves of the rows ``of`` of ``x``, which were aligned last, all a cell at a time.
        """
        n, rows, cols = len(x), self.rows, self.cols
        up, left = (table.ravel() for table in self._move_tables(n))
        # By up + 2 * left: to the corner, up, beside, beside, and staying.
        step = np.array([(2 * (rows + 1) + 1) * n, (rows + 2) * n, (rows + 1) * n, (rows + 1) * n, 0, 0])
        at = ((rows + cols) * (rows + 1) + rows) * n + of
        path = []
        while True:
            path.append(at)
            move = left.take(at)
            move += move
            move += up.take(at)
            if len(path) >= max(rows, cols) and (move >= 4).all():
                break
            at = at - step.take(move)
        cell, one = np.divmod(np.concatenate(path), n)
        d, i = np.divmod(cell, rows + 1)
        met = (i > 0) & (d > i)
        i, one = i[met], one[met]
        at = labels[one] * cols + d[met] - i - 1
        totals += np.bincount(at, x[one, i - 1], totals.size).reshape(totals.shape)
        hits += np.bincount(at, minlength=hits.size).reshape(hits.shape)


def _every_cost(x: np.ndarray, centroids: np.ndarray, aligner: Aligner) -> np.ndarray:
    """Squared distances of all rows to all centroids."""
    return np.stack([aligner.costs(x, np.broadcast_to(c, (len(x), len(c)))) for c in centroids], axis=1)


def _slack(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """By how much the distance of any series to each centroid can have changed."""
    moved = (new - old) ** 2
    return np.sqrt(moved.sum(axis=1) + (moved.shape[1] - 1) * moved.max(axis=1, initial=0.0))


@dataclass
class _Round:
    """What a round says about some of the series; parts add up."""

    totals: np.ndarray
    hits: np.ndarray
    cost: float = 0.0
    mark: int = 0
    far: tuple[float, list[float]] = (-1.0, [])
    series: int = 0
    again: int = 0

    def __add__(self, other: _Round) -> _Round:
        return _Round(self.totals + other.totals, self.hits + other.hits, self.cost + other.cost, self.mark + other.mark,
                      max(self.far, other.far), self.series + other.series, self.again + other.again)

    def add(self, x: np.ndarray, distances: np.ndarray, slack: np.ndarray, centroids: np.ndarray, aligner: Aligner) -> None:
        """Takes in the rows of ``x``, given their distances to earlier centroids that differ by ``slack``."""
        every, guess = np.arange(len(x)), distances.argmin(axis=1)
        costs = np.full(distances.shape, np.inf)
        costs[every, guess] = own = aligner.aligned(x, centroids[guess], moves=True)
        # A number that is missing rules nothing out; the margin is for rounding.
        ruled_out = (distances - slack) * (1.0 - 1e-9) > (np.sqrt(own) * (1.0 + 1e-9))[:, None] + 1e-9
        ruled_out[every, guess] = True
        row, c = np.nonzero(~ruled_out)
        costs[row, c] = aligner.costs(x[row], centroids[c])
        labels = costs.argmin(axis=1)
        aligner.add_walks(x, labels, np.flatnonzero(labels == guess), self.totals, self.hits)
        other = np.flatnonzero(labels != guess)
        if len(other):
            aligner.aligned(x[other], centroids[labels[other]], moves=True)
            aligner.add_walks(x[other], labels[other], np.arange(len(other)), self.totals, self.hits)
        self.again += len(row) + 2 * len(other)
        costs = costs[every, labels]
        self.cost += float(costs.sum())
        self.mark += _label_mark(x, labels)
        self.series += len(x)
        farthest = costs.argmax()
        self.far = max(self.far, (float(costs[farthest]), x[farthest].tolist()))


def _label_mark(x: np.ndarray, labels: np.ndarray) -> int:
    """A number that changes when a series changes its label; marks of blocks add up."""
    odd = 2 * np.arange(1, x.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    with np.errstate(over="ignore"):
        mixed = (np.ascontiguousarray(x).view(np.uint64) * odd).sum(axis=1) + labels.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return int((mixed >> np.uint64(33)).sum())


def _block_rows(length: int) -> int:
    return max(1, min(_DIAGONAL // (length + 1), _CELLS // (2 * (length + 1) ** 2)))


def _blocks(pdf: pd.DataFrame, series: str, length: int) -> Iterator[tuple[slice, np.ndarray]]:
    size = _block_rows(length)
    for at in range(0, len(pdf), size):
        part = slice(at, at + size)
        yield part, np.stack(pdf[series].iloc[part].to_numpy()).astype(float)


def _spread(data: DataFrame, key: str, cells: int, file_cells: int = FILE_CELLS) -> DataFrame:
    """The stored series again in files of bounded work, a row being ``cells`` table cells."""
    files = -(-data.count() * cells // file_cells)
    return materialise(data.repartition(files, key), "spread-series") if files > 1 else data


def _packed(data: DataFrame, length: int) -> RDD:
    """The series in blocks, as arrays; they are kept while rounds go on."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, x in _blocks(pdf, "__series", length):
                yield pd.DataFrame({"n": [len(x)], "block": [x.tobytes()]})

    packed = data.select("__series").mapInPandas(pack, "n int, block binary").rdd
    return packed.map(lambda r: np.frombuffer(r["block"]).reshape(r["n"], length)).persist(StorageLevel.MEMORY_AND_DISK)


def _with_distances(blocks: RDD, centroids: np.ndarray) -> RDD:
    """The blocks with the distances of their series to the centroids, kept as well."""
    length = centroids.shape[1]

    def measured(part: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        aligner = Aligner(length, length, _block_rows(length))
        return ((x, np.sqrt(_every_cost(x, centroids, aligner))) for x in part)

    return blocks.mapPartitions(measured).persist(StorageLevel.MEMORY_AND_DISK)


def _summary(known: RDD, slack: np.ndarray, centroids: np.ndarray) -> _Round:
    length = centroids.shape[1]

    def summarise(part: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[_Round]:
        aligner = Aligner(length, length, _block_rows(length))
        found = _Round(np.zeros(centroids.shape), np.zeros(centroids.shape, dtype=np.int64))
        for x, distances in part:
            found.add(x, distances, slack, centroids, aligner)
        yield found

    return known.mapPartitions(summarise).treeReduce(lambda a, b: a + b, 1 if known.getNumPartitions() <= _PARTS else 2)


@dataclass
class WarpedClusters:
    """Result of the clustering: labelled rows, centroids and how it ended."""

    labelled: DataFrame
    centroids: np.ndarray
    inertia: float
    rounds: int
    converged: bool


def cluster_series(
    df: DataFrame, key: str, series: str, k: int = 3, max_iter: int = MAX_ROUNDS
) -> WarpedClusters:
    """Cluster series into ``k`` groups; ``labelled`` adds ``cluster`` and ``distance``.

    The start is the ``k`` series first by the md5 of their key. A round assigns
    every series to its nearest centroid and replaces a centroid by the mean of
    the values aligned to each of its positions; a cluster without series starts
    again from the series farthest from its centroid. It ends when no label changes,
    told by a sum of hashes of all series with their labels. ``max_iter`` is a safety bound; reaching it gives a warning
    and ``converged`` false.
    """
    # Read again in every round.
    data = materialise(df.select(key, F.col(series).alias("__series")), "series")
    seeds = data.orderBy(F.md5(F.col(key).cast("string")), key).limit(k).collect()
    if not seeds:
        raise ValueError("no series to cluster")
    centroids = np.array([row["__series"] for row in seeds], dtype=float)
    length = centroids.shape[1]
    data = _spread(data, key, len(seeds) * length**2)
    inertia, rounds, converged, marks = float("inf"), 0, False, None

    blocks = _packed(data, length)
    known, measured, doubts = None, centroids, 0
    for rounds in range(1, max_iter + 1):
        current = centroids
        if known is None:
            known, measured, doubts = _with_distances(blocks, current), current, 0
        found = _summary(known, _slack(measured, current), current)
        inertia, doubts = found.cost, doubts + found.again
        before, marks = marks, found.mark
        if marks == before:
            converged = True
            break
        centroids = current.copy()
        used = (found.hits > 0).any(axis=1)
        centroids[found.hits > 0] = found.totals[found.hits > 0] / found.hits[found.hits > 0]
        if not used.all():
            centroids[used.argmin()] = found.far[1]
        # Distances taken anew cost as much as those taken since, in doubt.
        if doubts > found.series * len(seeds):
            known.unpersist()
            known = None
    for kept in (known, blocks):
        if kept is not None:
            kept.unpersist()
    if not converged:
        warnings.warn(f"clusters still change after {max_iter} rounds", stacklevel=2)

    final = centroids

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = Aligner(length, length, _block_rows(length))
        for pdf in batches:
            for part, x in _blocks(pdf, "__series", length):
                costs = _every_cost(x, final, aligner)
                labels = costs.argmin(axis=1)
                yield pd.DataFrame(
                    {
                        key: pdf[key].iloc[part].to_numpy(),
                        series: list(x),
                        "cluster": labels.astype(np.int32),
                        "distance": np.sqrt(costs[np.arange(len(x)), labels]),
                    }
                )

    kind = df.schema[key].dataType.simpleString()
    labelled = data.mapInPandas(
        label, f"`{key}` {kind}, `{series}` array<double>, cluster int, distance double"
    )
    return WarpedClusters(labelled, final, inertia, rounds, converged)
