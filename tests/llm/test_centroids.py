"""Clusters by the threshold algorithm against plain distances in Python integers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import centroids, queries
from tests.compare import connect, differences

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, k, rounds, dims, scale=1024):
    """(vec_id, cluster, distance) and centroids, straight from the definition."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * x) for x in v]))
    keyed = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), p) for i, p in kept if i is not None)
    middle = [p for _, p in keyed[:k]]

    def nearest(p):
        return min((sum((a - b) ** 2 for a, b in zip(p, c)), n) for n, c in enumerate(middle))

    for _ in range(rounds if middle else 0):
        near = [nearest(p)[1] for _, p in kept]
        for n in range(len(middle)):
            own = [p for (_, p), m in zip(kept, near) if m == n]
            if own:
                middle[n] = [sum(x) // len(own) for x in zip(*own)]
    return [(i, *nearest(p)[::-1]) for i, p in kept] if middle else [], middle


@pytest.mark.parametrize(("k", "dims", "spread"), [(8, 4, 1.0), (5, 3, 0.003), (30, 6, 0.01)])
def test_equals_plain_distances(spark, k, dims, spread):
    """Small spreads give few grid points, so many exact ties and empty clusters."""
    rng = np.random.default_rng(k)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(0, spread, (200, dims)))]
    rows += rows[:40] + [(None, rows[3][1]), (None, rows[4][1])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = centroids.cluster(df, k, 4, dims)
    want, middle = plain(rows, k, 4, dims)
    assert got.centroids == middle
    assert sorted(map(tuple, got.assigned.collect()), key=repr) == sorted(want, key=repr)


def test_walk_stops_early_and_is_exact():
    rng = np.random.default_rng(7)
    middle = rng.integers(-1000, 1000, (300, 5))
    points = middle[rng.integers(0, 300, 500)] + rng.integers(-3, 4, (500, 5))
    lists = centroids.Lists(middle)
    number, distance = lists.nearest(points)
    exact = ((points[:, None] - middle[None]) ** 2).sum(2)
    assert (number == exact.argmin(1)).all() and (distance == exact.min(1)).all()
    measured = 0

    class Counting(np.ndarray):
        def __getitem__(self, at):
            nonlocal measured
            if isinstance(at, np.ndarray) and at.ndim == 1:
                measured += len(at)
            return np.asarray(self)[at]

    lists.centroids = middle.view(Counting)
    lists.nearest(points)
    assert measured < 0.2 * 300 * 500


def test_odd_rows(spark):
    good = [(i, [float(i % 7)] * 64) for i in range(20)]
    odd = [(100, None), (101, [1.0] * 63), (102, [None, *[1.0] * 63]), (103, [float("nan")] * 64), (104, [float("inf")] * 64), (105, [])]
    df = spark.createDataFrame(good + odd, SCHEMA)
    df = df.withColumns({c: F.lit("clash") for c in ("x", "point", "key", "cluster", "distance")})
    assert sorted(r.vec_id for r in centroids.cluster(df).assigned.collect()) == list(range(20))
    few = centroids.cluster(df.where("vec_id < 3"))
    assert len(few.centroids) == 3 and {r.distance for r in few.assigned.collect()} == {0}
    for none in (df.limit(0), df.where("vec_id >= 100"), df.withColumn("vec_id", F.lit(None).cast("long"))):
        assert centroids.cluster(none).assigned.collect() == []
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame([(1, [1e9] * 64)], SCHEMA))


def test_query_equals_its_sql(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        name = "op12_threshold_centroids"
        assert differences(spark, connect(sf), name, queries.QUERIES[name], queries.ORACLES[name], sf) is None
