"""Clustering around centroids, with the nearest one found by the threshold algorithm.

For each dimension the centroids lie in a list sorted by their value there. From
a vector's own value every list is walked outwards, the nearer side first; each
centroid that turns up is measured exactly. Those that haven't turned up are in
every dimension at least as far as the walk has come, so once the sum of these
distances is greater than the best exact one, nothing nearer can follow. All
numbers are integers, so ties are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import arrow_schema
from tidemark.shared import stage

#: Components lie below this size, so that squared distances of 128 dimensions fit 64 bits.
LIMIT = 1 << 27
#: Numbers that a task works on at once.
CHUNK = 1 << 19


def to_grid(vectors: DataFrame, dimensions: int, scale: int) -> DataFrame:
    """(vec_id, point): floor(scale * x) of each component of the vectors that take part.

    Left out are null vectors, those of another length and those with a null or
    non-finite component. A component too large for exact distances in 64 bits
    (2 ** 27 on the grid) is an error. Other columns are left alone.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    small = F.forall("x", lambda v: F.abs(v * scale) < LIMIT)
    checked = F.when(small, True).otherwise(F.raise_error(F.lit("a vector is too large for the grid")).cast("boolean"))
    kept = kept.where(F.when((F.size("x") == dimensions) & finite, checked).otherwise(False))
    return kept.select("vec_id", F.transform("x", lambda v: F.floor(v * scale).cast("int")).alias("point"))


@dataclass
class Lists:
    """The centroids and, for each dimension, their sorted list."""

    centroids: np.ndarray

    def __post_init__(self):
        self.order = np.argsort(self.centroids, axis=0, kind="stable")
        self.values = np.take_along_axis(self.centroids, self.order, 0)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid (of several the smallest) and squared distance."""
        k, dims = self.centroids.shape
        number = np.zeros(len(points), np.int32)
        distance = np.zeros(len(points), np.int64)
        step = max(1, CHUNK // max(k, dims))
        for at in range(0, len(points), step):
            number[at : at + step], distance[at : at + step] = self._walk(points[at : at + step])
        return number, distance

    def _walk(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k, dims = self.centroids.shape
        far = np.int64(2 * LIMIT)
        exact = np.full((len(points), k), np.iinfo(np.int64).max)
        column = np.arange(dims)
        right = np.stack([np.searchsorted(self.values[:, d], points[:, d]) for d in range(dims)], 1)
        left = right - 1
        active = np.arange(len(points))
        for _ in range(k):
            own, lo, hi = points[active], left[active], right[active]
            below = np.where(lo >= 0, own - self.values[np.maximum(lo, 0), column], far)
            above = np.where(hi < k, self.values[np.minimum(hi, k - 1), column] - own, far)
            down = below <= above
            met = self.order[np.where(down, lo, hi), column]
            left[active] -= down
            right[active] += ~down
            found = np.zeros((len(active), k), bool)
            found[np.arange(len(active))[:, None], met] = True
            found &= exact[active] == np.iinfo(np.int64).max
            row, centroid = np.nonzero(found)
            gap = own[row] - self.centroids[centroid]
            exact[active[row], centroid] = (gap * gap).sum(1)
            frontier = np.minimum(below, above)
            active = active[(frontier * frontier).sum(1) <= exact[active].min(1)]
            if not len(active):
                break
        number = exact.argmin(1)
        return number.astype(np.int32), exact[np.arange(len(points)), number]


def _points(batch: pa.RecordBatch, dimensions: int) -> np.ndarray:
    return batch.column("point").flatten().to_numpy().astype(np.int64).reshape(-1, dimensions)


@dataclass
class Clusters:
    """The vectors with cluster and squared distance, and the centroids by number."""

    assigned: DataFrame
    centroids: list[list[int]]

    def fingerprints(self) -> list[str]:
        """SHA-256 of the components of each centroid."""
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids]


SUMS = "cluster int, dimension int, total long, held long"
ASSIGNED = "vec_id long, cluster int, distance long"


def cluster(
    vectors: DataFrame, k: int = 8, rounds: int = 10, dimensions: int = 64, scale: int = 1024, salt: str = "3:"
) -> Clusters:
    """Group vectors around `k` centroids in `rounds` rounds of Lloyd's method.

    Takes vec_id and embedding; see `to_grid` for which rows take part. The
    first centroids are the `k` vectors whose `salt` and id have the smallest
    SHA-256 (of equal ids, the smaller components); rows without an id are never
    first centroids but clustered like others, and where there are fewer than
    `k` with an id, there are as many centroids. Repeated rows count each. Equal
    distances go to the smaller number; a centroid without vectors stays. An
    empty table, or one without a vector that has an id, gives no rows.

    The driver holds `k` centroids and, for each of their components, a sum.
    """
    points = stage(to_grid(vectors, dimensions, scale), "points")
    key = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    first = points.where("vec_id IS NOT NULL").withColumn("key", key).orderBy("key", "point").limit(k)
    centroids = [list(r["point"]) for r in first.select("point").collect()]
    if not centroids:
        return Clusters(points.limit(0).selectExpr("vec_id", "0 AS cluster", "0L AS distance"), [])
    for _ in range(rounds):
        moved = _move(points, centroids)
        if moved == centroids:
            break  # Nothing changes any more in the rounds that are left.
        centroids = moved
    return Clusters(stage(_assign(points, centroids), "assigned"), centroids)


def _move(points: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Each centroid as the rounded down mean of its vectors."""
    lists, schema = Lists(np.array(centroids, np.int64)), arrow_schema(SUMS)
    k, dims = lists.centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            own = _points(batch, dims)
            number, _ = lists.nearest(own)
            held += np.bincount(number, minlength=k)
            for c in np.unique(number):
                total[c] += own[number == c].sum(0)
        c, d = np.nonzero(np.broadcast_to(held[:, None] > 0, (k, dims)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int32()), pa.array(d, pa.int32()), pa.array(total[c, d]), pa.array(held[c])], schema=schema
        )

    exact = F.sum(F.col("total").cast("decimal(20,0)")).alias("total")
    sums = points.select("point").mapInArrow(run, SUMS).groupBy("cluster", "dimension").agg(exact, F.sum("held").alias("held"))
    moved = [list(c) for c in centroids]
    for row in sums.collect():
        moved[row["cluster"]][row["dimension"]] = int(row["total"]) // row["held"]
    return moved


def _assign(points: DataFrame, centroids: list[list[int]]) -> DataFrame:
    lists, schema = Lists(np.array(centroids, np.int64)), arrow_schema(ASSIGNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, distance = lists.nearest(_points(batch, lists.centroids.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number), pa.array(distance)], schema=schema)

    return points.mapInArrow(run, ASSIGNED)
