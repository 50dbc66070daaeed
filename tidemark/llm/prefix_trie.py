"""The trie of turn prefixes that conversations share.

Turns are hashed in blocks of a fixed number. Conversations are grouped by the
digests of their successive blocks, so a long shared opening costs one group for
each block and not one for each turn. Turn boundaries are looked at only in
blocks whose siblings (blocks after the same prefix) differ; a block without
siblings gives its turns as they are.

A digest of a prefix is two 64-bit numbers: the block digests before it, each
with its place, under XOR, so that running sums give all of them and a long
conversation needs no single task. Sums over subtrees need no walk of the tree:
a node belongs to its smallest member, and what a subtree holds is what its
members hold from the node on, less what belongs to smaller ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.blocks import arrow_schema
from tidemark.shared import stage

#: Turns of a block.
BLOCK = 4
#: Turns or blocks of one conversation that a window puts in order.
RUN_BITS = 10
#: Ids whose list is made in one group: those that are equal but for so many last bits.
ID_BITS = 10

_WORD = r"[^\x20\x09-\x0D]+"
_NODE = ["depth", "k1", "k2"]


def _before(df: DataFrame, key: str, part: str, sums: dict[str, Column]) -> DataFrame:
    """What the earlier parts of each key sum up to; first parts have no row."""
    totals = df.groupBy(key, part).agg(*[c.alias(n) for n, c in sums.items()])
    earlier = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    combine = {n: (F.bit_xor if n.startswith("x") else F.sum)(n).over(earlier).alias(f"{n}_before") for n in sums}
    first = F.row_number().over(Window.partitionBy(key).orderBy(part)) == 1
    return totals.select(key, part, *combine.values(), first.alias("first")).where("NOT first").drop("first")


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, words): turns from 0 on, by turn, null first.

    Null role or text counts as empty. Rows of one turn number go by the digest
    of role and text, so repeated rows are turns of their own; rows without
    conv_id belong to no conversation and are left out. Other columns are left
    alone. Texts go no further than this: a digest and a count of words remain.
    A conversation is put in order by ranges of 1024 turn numbers; only turns of
    one range meet in a task.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    part = F.when(F.col("turn").isNull(), F.lit(-(1 << 63))).otherwise(F.shiftright(F.col("turn").cast("long"), RUN_BITS))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        part.alias("part"),
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256)).alias("digest"),
        F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"),
    )
    within = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("turn", "digest")) - 1
    before = _before(turns, "conv_id", "part", {"n": F.count("*")})
    placed = turns.withColumn("within", within).join(before, ["conv_id", "part"], "left")
    pos = (F.col("within") + F.coalesce("n_before", F.lit(0))).cast("long")
    return placed.select("conv_id", pos.alias("pos"), "digest", "words")


def share_openings(turns: DataFrame, family: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first turns of another one of their family.

    Conversation c takes its first h turns from c - c % family (all it has, if
    fewer; none if there is none), then its own after its first h, where h is the
    CRC-32 of the id in decimal modulo `most`. Returns the turns and, for each
    conversation (conv_id, n_turns), how many it has now, possibly none.
    """
    turns = stage(turns, "turns")
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own")).withColumns(
        {
            "base": F.col("conv_id") - F.col("conv_id") % family,
            "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % most,
        }
    )
    heads = convs.where("conv_id = base").select("base", F.col("own").alias("offered"))
    convs = convs.join(heads, "base", "left").withColumn("taken", F.least("h", F.coalesce("offered", F.lit(0))))
    n_turns = F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    convs = stage(convs.select("conv_id", "base", "h", "taken", n_turns.cast("long").alias("n_turns")), "conversations")
    own = turns.join(convs, "conv_id").where("pos >= h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "words")
    first = turns.where((F.col("pos") < most) & (F.col("conv_id") % family == 0)).withColumnRenamed("conv_id", "base")
    first = convs.where("taken > 0").join(first, "base").where("pos < taken")
    return own.unionByName(first.select(*own.columns)), convs.select("conv_id", "n_turns")


def _blocks(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per conversation and block: the digest before it and those of its prefixes."""
    parts = turns.withColumn("block", F.floor(F.col("pos") / BLOCK)).groupBy("conv_id", "block")
    held = parts.agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "words"))).alias("held")).select(
        "conv_id", "block", F.col("held.digest").alias("digests"), F.col("held.words").alias("words"), F.size("held").alias("n")
    )
    ranges = F.sequence(F.lit(1), F.col("n"))

    def mixed(seed: int) -> Column:
        return F.transform(
            ranges, lambda t: F.xxhash64(F.lit(seed), F.col("block") * BLOCK + t, F.slice("digests", F.lit(1), t))
        )

    def sum_to(t: Column) -> Column:
        return F.aggregate(F.slice("words", F.lit(1), t), F.lit(0).cast("long"), lambda a, w: a + w)

    held = held.withColumns({"m1": mixed(1), "m2": mixed(2), "run": F.shiftright("block", RUN_BITS)})
    held = held.withColumns({"x1": F.element_at("m1", -1), "x2": F.element_at("m2", -1), "w": sum_to(F.col("n"))})
    held = stage(held, "block-digests")
    earlier = Window.partitionBy("conv_id", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = {"x1": F.bit_xor("x1"), "x2": F.bit_xor("x2"), "w": F.sum("w")}
    before = _before(held, "conv_id", "run", sums)
    zero = F.lit(0).cast("long")
    near = {f"{n}_near": F.coalesce(c.over(earlier), zero) for n, c in sums.items()}
    held = held.withColumns(near).join(before, ["conv_id", "run"], "left").join(convs, "conv_id")
    far = {n: F.coalesce(f"{n}_before", zero) for n in sums}
    held = held.withColumns(
        {
            "p1": F.col("x1_near").bitwiseXOR(far["x1"]),
            "p2": F.col("x2_near").bitwiseXOR(far["x2"]),
            "w_before": F.col("w_near") + far["w"],
        }
    )

    def key(name: str, p: str, t: Column) -> Column:
        return F.when(t > 0, F.get(F.col(name), t - 1).bitwiseXOR(F.col(p))).otherwise(F.col(p))

    turn = F.transform(
        ranges,
        lambda t: F.struct(
            (F.col("block") * BLOCK + t).cast("long").alias("depth"),
            key("m1", "p1", t).alias("k1"),
            key("m2", "p2", t).alias("k2"),
            key("m1", "p1", t - 1).alias("up1"),
            key("m2", "p2", t - 1).alias("up2"),
            (F.col("w_before") + sum_to(t - 1)).alias("before"),
            F.get("words", t - 1).alias("words"),
        ),
    )
    goes_on = F.col("n_turns") > F.col("block") * BLOCK + F.col("n")
    return held.select(
        "conv_id", "block", "p1", "p2", "n_turns", "w_before", goes_on.alias("goes_on"), turn.alias("turns"), F.element_at(turn, -1).alias("end")
    )


def _nodes(blocks: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Nodes below the root with their members: by block, by turn only where siblings differ.

    `sums` maps names to what a conversation adds to each of a block's turns, as
    arrays of `BLOCK` numbers.
    """
    added = [F.sum(F.get(c, F.lit(t))).alias(f"{n}{t}") for n, c in sums.items() for t in range(BLOCK)]
    groups = blocks.groupBy("block", "p1", "p2", "end.depth", "end.k1", "end.k2").agg(
        F.count("*").alias("n_convs"),
        F.min("conv_id").alias("conv_id"),
        F.count_if("goes_on").alias("go_on"),
        F.any_value("turns").alias("turns"),
        *added,
    )
    groups = stage(groups, "block-groups")
    forks = groups.groupBy("block", "p1", "p2").agg((F.count("*") > 1).alias("fork")).where("fork")
    marked = groups.join(forks, ["block", "p1", "p2"], "left")
    each = marked.select(
        F.coalesce("fork", F.lit(False)).alias("fork"), "n_convs", "conv_id", "go_on", F.size("turns").alias("size"),
        F.posexplode("turns").alias("t", "turn"), *[F.array(*[f"{n}{t}" for t in range(BLOCK)]).alias(n) for n in sums],
    )
    each = each.select(
        "fork", "turn.*", "n_convs", "conv_id",
        F.when(F.col("t") + 1 < F.col("size"), F.col("n_convs")).otherwise(F.col("go_on")).alias("go_on"),
        *[F.get(n, F.col("t")).alias(n) for n in sums],
    )
    same = ["up1", "up2", "before", "words"]
    refined = each.where("fork").groupBy(*_NODE).agg(
        *[F.any_value(c).alias(c) for c in same],
        F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "go_on", *sums)],
    )
    return each.where("NOT fork").drop("fork").unionByName(refined)


IDS = "depth long, k1 long, k2 long, part long, ids string"
ENDS = "depth long, k1 long, k2 long, ends_sha256 string"


def _ends(blocks: DataFrame, convs: DataFrame) -> DataFrame:
    """SHA-256 of the ids of the conversations that end at each node, in order.

    Ids meet in lists of at most 1024; a task takes the lists of a node one
    after another, so it never holds those of a whole node.
    """
    last = blocks.where("NOT goes_on").select("conv_id", "end.depth", "end.k1", "end.k2")
    zero = F.lit(0).cast("long")
    none = convs.where("n_turns = 0").select("conv_id", *[zero.alias(c) for c in _NODE])
    part = F.shiftright("conv_id", ID_BITS).alias("part")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    lists = last.unionByName(none).groupBy(*_NODE, part).agg(ids.alias("ids"))
    schema = arrow_schema(ENDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, done = None, None, []
        for batch in batches:
            for depth, k1, k2, text in zip(*(batch.column(c).to_pylist() for c in (*_NODE, "ids")), strict=True):
                if (depth, k1, k2) == now:
                    digest.update(b",")
                else:
                    if now is not None:
                        done.append((*now, digest.hexdigest()))
                    now, digest = (depth, k1, k2), hashlib.sha256()
                digest.update(text.encode())
            yield _rows(done, schema)
            done = []
        if now is not None:
            yield _rows([(*now, digest.hexdigest())], schema)

    return lists.repartition(*_NODE).sortWithinPartitions(*_NODE, "part").mapInArrow(run, ENDS)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each prefix of turns, from the empty one: its members and subtree.

    `turns` has conv_id, pos (gapless from 0), digest and words, `convs` conv_id
    and n_turns of every conversation, those without turns included. Columns:
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256, all as `op13` defines them. Without
    conversations there is no node, not even the root.
    """
    blocks = stage(_blocks(turns, convs), "blocks")
    first = _nodes(blocks, {})
    # From which depth on a conversation is the smallest member, and the words before.
    owners = first.groupBy("conv_id").agg(
        F.min_by("before", "depth").alias("borrowed"), F.max((F.col("go_on") == 0).cast("long")).alias("leaf")
    )
    words = blocks.where("NOT goes_on").select("conv_id", (F.col("end.before") + F.col("end.words")).alias("all_words"))
    zero = F.lit(0).cast("long")
    shares = convs.join(words, "conv_id", "left").join(owners, "conv_id", "left").select(
        "conv_id",
        "n_turns",
        F.coalesce("borrowed", "all_words", zero).alias("borrowed"),
        F.coalesce("leaf", zero).alias("leaf"),
    )
    shares = stage(shares, "shares")
    saved = F.transform("turns", lambda t: F.greatest(F.col("borrowed") - t["before"], zero))
    leaves = F.transform("turns", lambda _: F.col("leaf"))
    below = _nodes(blocks.join(shares.drop("n_turns"), "conv_id"), {"n_leaves": leaves, "saved_tokens": saved})
    below = below.select(*_NODE, "up1", "up2", "conv_id", "n_convs", "n_leaves", "saved_tokens")
    root = shares.agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.greatest(F.sum("leaf"), F.lit(1)).alias("n_leaves"),
        F.sum("borrowed").alias("saved_tokens"),
    ).where("n_convs > 0")
    root = root.select(*[zero.alias(c) for c in _NODE], *[F.lit(None).cast("long").alias(c) for c in ("up1", "up2")], *root.columns)
    nodes = stage(root.unionByName(below), "nodes")
    up = [(F.col("depth") - 1).alias("depth"), F.col("up1").alias("k1"), F.col("up2").alias("k2")]
    children = nodes.where("depth > 0").groupBy(*up).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("up1"), F.col("k2").alias("up2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(children, _NODE, "left").join(parents, ["depth", "up1", "up2"], "left").join(_ends(blocks, convs), _NODE, "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", zero).alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )
