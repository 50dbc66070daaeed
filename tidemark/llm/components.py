"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.shared import Workspace


def components(links: DataFrame, work: Workspace) -> DataFrame:
    """(node, component) for every node of a link (a, b), given as staged: the smallest node reachable.

    Each round gives a node the smallest component among its neighbours, then the
    component of that component, until nothing changes. The smallest value of a
    group combines before the shuffle, so a node with very many links costs no
    more than others. Every round is written to the workspace, the one before goes.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
    held = work.stage(least.select("node", F.least("node", "least").alias("component")), "labels")
    while True:
        labels = held.select("node", "component")
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        closer = labels.join(near, labels["node"] == near["a"])
        closer = closer.select("node", "component", F.least("component", "near").alias("next"))
        up = labels.select(F.col("node").alias("of"), F.col("component").alias("up"))
        moved = closer.join(up, closer["next"] == up["of"])
        moved = moved.select("node", F.col("component").alias("was"), F.least("next", "up").alias("component"))
        moved = work.stage(moved, "labels")
        work.drop(held)
        held = moved
        if moved.where("was != component").isEmpty():
            return moved.select("node", "component")
