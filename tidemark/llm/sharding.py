"""Hierarchical weighted hash tree: which shard a document goes to.

Only DataFrame functions: the draws are expressions, numbering is windows over
many small groups and a sum over their counts.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.shared import stage

#: Rows of one shard that are numbered in one window group.
GROUP_ROWS = 10_000


@dataclass(frozen=True)
class Node:
    """A region, rack or shard. Only shards have a number and a weight of their own."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight

    def shards(self) -> list[int]:
        return [s for c in self.children for s in c.shards()] if self.children else [self.shard]


def uniform_tree(shards: int, per_rack: int = 4, per_region: int = 2) -> Node:
    """Shards 0 .. shards - 1 of equal weight, in racks, in regions."""
    leaves = [Node(f"shard-{i}", shard=i) for i in range(shards)]
    racks = [
        Node(f"rack-{i // per_rack}", tuple(leaves[i : i + per_rack])) for i in range(0, shards, per_rack)
    ]
    regions = [
        Node(f"region-{i // per_region}", tuple(racks[i : i + per_region])) for i in range(0, len(racks), per_region)
    ]
    return Node("root", tuple(regions))


def grow(tree: Node) -> Node:
    """One more shard, in a region of its own.

    A draw at the root can only change in favour of the new region, and no
    weight below any other node changes, so rows move into the new shard only.
    """
    number = max(tree.shards()) + 1
    leaf = Node(f"shard-{number}", shard=number)
    region = Node(f"region-of-{number}", (Node(f"rack-of-{number}", (leaf,)),))
    return replace(tree, children=(*tree.children, region))


def _draw(key: Column, node: Node) -> Column:
    """Exponential draw of the node for the key: the least one wins.

    With rates in proportion to the weights, each child wins with the
    probability of its share, and a change of one weight moves keys only from
    or to that child.
    """
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(node.name)), 11)
    uniform = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(uniform) / F.lit(node.weight)


def choose(key: Column, node: Node) -> Column:
    """The shard a key goes to, descending from `node`."""
    if not node.children:
        return F.lit(node.shard)
    children = [c for c in node.children if c.weight > 0]
    if len(children) == 1:
        return choose(key, children[0])
    draws = [_draw(key, c) for c in children]
    least = F.least(*draws)
    out = choose(key, children[-1])
    for child, draw in zip(children[-2::-1], draws[-2::-1], strict=True):
        out = F.when(draw == least, choose(key, child)).otherwise(out)
    return out


def assign(docs: DataFrame, tree: Node) -> DataFrame:
    """Put documents into the shards of a tree, and number them there.

    Takes doc_id and text. The law is `key`: doc_id and tree alone decide.
    Returns a row per input row: doc_id, size (UTF-8 bytes plus one), text_crc32,
    law, shard, slot (gapless from 0 in each shard), grown_shard (where it would
    be with one shard more).

    A null text has no bytes and the checksum of none. Rows without doc_id share
    one shard, as do rows that repeat a doc_id; each row has a slot of its own.
    An empty table gives no rows. A shard may hold any part of the rows: its
    rows are dealt round into groups of bounded size before they are numbered,
    and the groups' counts are summed up.
    """
    spark = docs.sparkSession
    key = F.col("doc_id")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        key.cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).select(
        "*",
        F.lit("key").alias("law"),
        choose(key, tree).cast("int").alias("shard"),
        choose(key, grow(tree)).cast("int").alias("grown_shard"),
        F.monotonically_increasing_id().alias("dealt"),
    )
    # Written before it is dealt out, so the dealing stays as it is.
    rows = stage(rows, "assigned")
    least = -(-4 * int(spark.conf.get("spark.sql.shuffle.partitions")) // len(tree.shards()))
    parts = max(least, -(-rows.count() // GROUP_ROWS))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("dealt"), F.lit(parts)))
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("held"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(
        F.col("shard").alias("in_shard"),
        F.col("part").alias("in_part"),
        F.coalesce(F.sum("held").over(before), F.lit(0)).alias("first"),
    )
    number = F.row_number().over(Window.partitionBy("shard", "part").orderBy("dealt")) - 1
    return (
        rows.withColumn("number", number)
        .join(first, (F.col("shard") == F.col("in_shard")) & (F.col("part") == F.col("in_part")))
        .select(
            "doc_id", "size", "text_crc32", "law", "shard",
            (F.col("first") + F.col("number")).cast("long").alias("slot"), "grown_shard",
        )
    )
