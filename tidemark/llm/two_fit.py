"""Packing of whole documents into few sequences: best two fit over all lengths.

Which lengths share a sequence depends on nothing but how many pieces of each
length there are. So the corpus is counted by length (at most as many numbers as
a sequence has tokens), the driver fills sequences from these counts, and pieces
then take the places planned for their length in the order of a stable number.

A sequence is filled greedily with the longest piece that fits; then its
smallest piece gives way to two others that fill the widened gap better, as long
as that helps. A filling is repeated until one of its lengths runs out, which is
what filling one sequence after another would give: a length that isn't chosen
doesn't change the choice.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.blocks import arrow_schema, give_back, texts_only
from tidemark.llm.packing import SPECIAL, encoder
from tidemark.shared import stage

WINDOW = 1024
END = 2
PIECES = "doc_id long, piece int, start long, length long, ids binary, uid long"


def cuts(length: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be short."""
    first = length % window or window
    return [(0, min(first, length)), *((at, window) for at in range(first, length, window))]


def cut_documents(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, special: int, window: int = WINDOW, end: int = END
) -> DataFrame:
    """Pieces of at most `window` ids: doc_id, piece, start, length, ids, uid.

    Takes doc_id and text; other columns are left alone. A document's ids are
    those of its whole text and the end mark; a null or empty text has the mark
    only, so every row has a piece. Repeated rows are cut each, rows without
    doc_id keep none, an empty table gives no rows. `ids` holds little-endian
    32-bit numbers, `uid` tells pieces of one run apart. The vocabulary is sent
    to the tasks; its size doesn't grow with the input.
    """
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    schema = arrow_schema(PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(sent.value, pattern, special)
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows, held = [], 0
            texts = batch.column("text")
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                text = texts[i].as_py() or ""
                ids = tokenizer.encode(text, allowed_special="all") if SPECIAL in text else tokenizer.encode_ordinary(text)
                ids.append(end)
                data = np.array(ids, "<u4")
                for piece, (start, length) in enumerate(cuts(len(data), window)):
                    rows.append((doc, piece, start, length, data[start : start + length].tobytes(), uid))
                    uid, held = uid + 1, held + length
                    if held >= 1 << 20:
                        yield _batch(rows, schema)
                        rows, held = [], 0
            if rows:
                yield _batch(rows, schema)
            give_back()

    return texts_only(docs).mapInArrow(run, PIECES)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def fill_sequence(left: np.ndarray, window: int) -> list[int]:
    """Lengths of the next sequence, given how many pieces of each length are left."""
    left = left.copy()
    lengths = np.arange(window + 1)

    def available() -> np.ndarray:
        """The longest length left that is at most as long as each."""
        return np.maximum.accumulate(np.where(left[: window + 1] > 0, lengths, 0))

    within, filling, gap = available(), [], window
    while within[gap]:
        longest = int(within[gap])
        filling.append(longest)
        left[longest] -= 1
        gap -= longest
        if not left[longest]:
            within = available()
    while gap and len(filling) > 1:
        smallest = min(filling)
        room = gap + smallest
        first = np.flatnonzero(left[:room] > 0)[::-1]
        second = within[room - first]
        alone = (second == first) & (left[first] < 2)
        second[alone] = within[first[alone] - 1]
        total = np.where(second > 0, first + second, 0)
        best = int(np.argmax(total)) if len(total) else 0
        if not len(total) or total[best] <= smallest:
            break
        filling.remove(smallest)
        left[smallest] += 1
        for new in (int(first[best]), int(second[best])):
            filling.append(new)
            left[new] -= 1
        gap = room - int(total[best])
        within = available()
    return sorted(filling, reverse=True)


def fill_all(counts: np.ndarray, window: int) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, how many sequences are so) until no piece is left.

    `counts[n]` tells how many pieces have length n. Each filling uses up one
    length, so there are about as many as there are lengths, however many pieces.
    """
    left = np.zeros(window + 1, np.int64)
    left[: len(counts)] = counts
    out = []
    while left.any():
        filling = fill_sequence(left, window)
        each = Counter(filling)
        times = min(int(left[n]) // m for n, m in each.items())
        for n, m in each.items():
            left[n] -= m * times
        out.append((filling, times))
    return out


PLACES = "length long, low long, high long, copies long, first_sequence long, first_offset long"


def places(plan: list[tuple[list[int], int]]) -> pa.Table:
    """The places of each length in the order in which its pieces take them."""
    rows, taken, sequence = [], Counter(), 0
    for filling, times in plan:
        at = 0
        for n, copies in sorted(Counter(filling).items(), reverse=True):
            rows.append((n, taken[n], taken[n] + copies * times, copies, sequence, at))
            taken[n] += copies * times
            at += n * copies
        sequence += times
    schema = arrow_schema(PLACES)
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def place(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """`pieces` with sequence_id and offset of each in place of uid.

    Needs length (1 to `window`) and uid, which differs between rows; any other
    columns go along, ids as well. The table is written first, so repeated
    tasks find the same pieces. Only counts by length reach the driver.
    """
    spark = pieces.sparkSession
    pieces = stage(pieces, "pieces")
    counted = pieces.groupBy("length").count().collect()
    counts = np.zeros(window + 1, np.int64)
    for row in counted:
        counts[row["length"]] = row["count"]
    # A row for each length, so at most as many as a sequence has tokens. A length has
    # about as many parts as a part has pieces, so neither grows with a hot length.
    parts = [(n, 1 + isqrt(int(c))) for n, c in enumerate(counts) if c]
    parts = spark.createDataFrame(parts, "length long, parts long")
    dealt = pieces.join(F.broadcast(parts), "length").withColumn("part", F.expr("pmod(xxhash64(uid), parts)"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("length", "part").count()
    before = before.select("length", "part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("uid")) - 1
    ranked = dealt.withColumn("within", within).join(before, ["length", "part"])
    # As many rows as fillings have lengths: bounded by the window, not the corpus.
    planned = F.broadcast(spark.createDataFrame(places(fill_all(counts, window))).withColumnRenamed("length", "of"))
    rank = F.col("within") + F.col("before")
    placed = ranked.withColumn("rank", rank).join(
        planned, (F.col("of") == F.col("length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    )
    nth = F.col("rank") - F.col("low")
    return placed.select(
        *[c for c in pieces.columns if c != "uid"],
        (F.col("first_sequence") + F.floor(nth / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + (nth % F.col("copies")) * F.col("length")).cast("long").alias("offset"),
    )


def pack(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, special: int, window: int = WINDOW, end: int = END
) -> DataFrame:
    """All pieces of all documents with their ids, sequence_id and offset.

    See `cut_documents` for odd rows. No document of at most `window` ids is cut.
    """
    return place(cut_documents(docs, ranks, pattern, special, window, end), window)
