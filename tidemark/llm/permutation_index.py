"""Nearest neighbours by a permutation index.

Vectors are compared with those of their own length. A vector is known by the
order of its nearest pivots. Each shard of the vectors takes pivots from its own
rows and posts all its rows in inverted files, one for each pivot, with the
pivot's place in the row's order. A query adds up, over its own nearest pivots,
how far the places lie apart (Spearman's footrule on the leading places); the
best rows by that are ranked again by the exact cosine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.blocks import arrow_rows, arrow_schema

#: Rows of a shard that its pivots are taken from, and pivots.
SAMPLE_ROWS = 4_096
PIVOTS = 256
#: Leading places of an order that are posted.
PLACES = 64
#: Of n vectors of a length this times the root of n are ranked again for each query.
RERANKED = 12.0
MOST_SHARD_ROWS = 200_000
MOST_QUERY_ROWS = 20_000

RESULT = "query_id long, vec_id long, score double"


def valid_vectors(vectors: DataFrame, column: str) -> DataFrame:
    """(vec_id, v): vectors that can be compared, one for each id, of any length.

    Null and zero vectors, and those with a null, infinite or undefined
    component, take no part. Of rows that repeat a vec_id the largest vector
    counts; rows without vec_id take no part.
    """
    v = F.col(column).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.where(
        F.col("vec_id").isNotNull() & finite.alias("ok") & F.exists("v", lambda x: x != 0)
    )
    rows = rows.where(F.col("v").isNotNull())
    return rows.groupBy("vec_id").agg(F.max("v").alias("v"))


def choose_pivots(unit: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Different directions, each far from those before; the first row is the first."""
    chosen, nearest = [0], unit @ unit[0]
    while len(chosen) < pivots:
        at = int(nearest.argmin())
        if nearest[at] > 1 - 1e-9:
            break
        chosen.append(at)
        nearest = np.maximum(nearest, unit @ unit[at])
    return unit[chosen]


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1, keepdims=True) if len(m) else m


def _orders(unit: np.ndarray, pivots: np.ndarray, places: int) -> np.ndarray:
    """For each vector its nearest pivots, nearest first."""
    return np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :places]


class InvertedFiles:
    """For each pivot the rows that have it among their nearest, and at which place."""

    def __init__(self, unit: np.ndarray, pivots: np.ndarray, places: int):
        self.pivots, self.size = pivots, len(unit)
        self.places = min(places, len(pivots))
        orders = _orders(unit, pivots, self.places)
        flat = orders.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.row, self.place = by_pivot // self.places, by_pivot % self.places
        self.begin = np.searchsorted(flat[by_pivot], np.arange(len(pivots) + 1))

    def nearest(self, order: np.ndarray, most: int) -> np.ndarray:
        """The `most` rows with the least footrule distance to an order, ties by row.

        A pivot that only one side has among its nearest counts as one place
        beyond the last on the other side.
        """
        beyond = self.places
        # What a row loses for the query's pivots that it hasn't, and for its own that the query hasn't.
        total = np.full(self.size, 2 * beyond * (beyond + 1) // 2, np.int64)
        for place, pivot in enumerate(order.tolist()):
            a, b = self.begin[pivot], self.begin[pivot + 1]
            row, held = self.row[a:b], self.place[a:b]
            total[row] += np.abs(held - place) - (beyond - place) - (beyond - held)
        if most >= self.size:
            return np.argsort(total, kind="stable")
        limit = np.partition(total, most - 1)[most - 1]
        below = np.flatnonzero(total < limit)
        return np.r_[below, np.flatnonzero(total == limit)[: most - len(below)]]


def search(
    vectors: DataFrame,
    column: str = "embedding",
    every: int = 50,
    k: int = 5,
    reranked: float = RERANKED,
) -> DataFrame:
    """The k nearest rows of each vector whose vec_id is divisible by `every`.

    Returns query_id, rank (from 1), vec_id, score: the cosine in double
    precision, largest first, ties to the smaller vec_id; all rows of the
    query's length but its own are candidates, and a query gets fewer than k rows
    only if there are fewer. See `valid_vectors` for vectors that take no part.
    An empty table gives no rows.

    Rows are dealt to shards by a hash of the id, so many equal vectors don't
    meet in one; each block of queries is held against each shard, and only k
    rows of each come back. Nothing passes through the driver.
    """
    rows = valid_vectors(vectors, column).withColumn("n", F.size("v"))
    plan = rows.groupBy("n").agg(F.count("*").alias("total")).select(
        "n",
        F.greatest(F.ceil(F.sqrt("total") / 16), F.ceil(F.col("total") / MOST_SHARD_ROWS)).cast("long").alias("shards"),
        F.ceil(F.col("total") / (every * MOST_QUERY_ROWS)).cast("long").alias("blocks"),
        F.ceil(F.sqrt("total") * reranked).cast("long").alias("most"),
    )
    rows = rows.join(plan, "n")
    stored = rows.select("n", "vec_id", "v", F.ceil(F.col("most") / F.col("shards")).alias("most"), "blocks",
                         F.pmod(F.xxhash64("vec_id", F.lit("shard")), "shards").alias("shard"))
    stored = stored.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    queries = rows.where(F.col("vec_id") % every == 0).select(
        F.col("n").alias("length"), F.col("vec_id").alias("query_id"), F.col("v").alias("asked"), "shards",
        F.pmod(F.xxhash64("vec_id", F.lit("part")), "blocks").alias("part"),
    )
    queries = queries.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        ids, asked = left.column("vec_id").to_numpy(), right.column("query_id").to_numpy()
        if not len(ids) or not len(asked):
            return arrow_schema(RESULT).empty_table()
        most = max(k + 1, left.column("most")[0].as_py())
        order = np.argsort(ids)
        ids, held = ids[order], _matrix(left.column("v"))[order]
        query = _matrix(right.column("asked"))
        unit, asked_unit = _unit(held), _unit(query)
        sample = np.sort(np.random.default_rng(0).permutation(len(ids))[:SAMPLE_ROWS])
        files = InvertedFiles(unit, choose_pivots(unit[sample]), PLACES)
        orders = _orders(asked_unit, files.pivots, files.places)
        norms, lengths = np.linalg.norm(held, axis=1), np.linalg.norm(query, axis=1)
        out = []
        for q in range(len(asked)):
            near = files.nearest(orders[q], most)
            near = near[ids[near] != asked[q]]
            cosine = (held[near] * query[q]).sum(1) / (norms[near] * lengths[q])
            best = np.lexsort((ids[near], -cosine))[:k]
            out.extend((int(asked[q]), int(ids[near[b]]), float(cosine[b])) for b in best)
        return pa.Table.from_batches([arrow_rows(RESULT, out)])

    found = (
        stored.groupBy("n", "shard", "part").cogroup(queries.groupBy("length", "shard", "part")).applyInArrow(run, RESULT)
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best).cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
