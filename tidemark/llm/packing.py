"""Packing of documents into windows, with lexical neighbours side by side.

The tokenized table is sorted by token ids drawn from each document's set in
such a way that documents that share many ids mostly share the drawn ones; runs
of it are the shards. A shard has a BM25 inverted index over token ids, with
document frequencies and mean length of the whole corpus. A seed document fills
windows of its own; the rest of its last window is filled by the unused
documents that BM25, asked with all ids of the seed, ranks nearest to it. The
last of these is cut and seeds the next window. Only the last window of a shard
isn't full; it is cut into sequences whose lengths are powers of two.
"""

from __future__ import annotations

import math
import zlib
from base64 import b64decode
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import arrow_schema, give_back, ids_back, ids_of, texts_only
from tidemark.shared import stage

WINDOW = 2048
END = 1
SPECIAL = "<|endoftext|>"
#: Tokens of a shard (one document at least), and shards of a task on large tables.
SHARD_TOKENS = 2_000_000
TASK_SHARDS = 32
#: Token ids drawn from a document that it is sorted by.
DRAWS = 3
#: A term that at least one in so many documents of a shard has is a row of a matrix.
DENSE = 8
K1, B = 1.2, 0.75


def load_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ids of a byte-level BPE vocabulary in rank order."""
    with open(path, "rb") as f:
        return {b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoder(ranks: dict[bytes, int], pattern: str, special: int) -> tiktoken.Encoding:
    """The tokenizer of a vocabulary; the special token's string in a text is that token."""
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={SPECIAL: special})


def encode(tokenizer: tiktoken.Encoding, text: str) -> np.ndarray:
    """Ids of a whole text, and the end mark."""
    return np.append(tokenizer.encode_to_numpy(text, allowed_special="all"), np.uint32(END))


def draws(size: int) -> np.ndarray:
    """For each draw a rank of all ids: the id of a set that ranks first is drawn.

    Of two sets the same id is drawn as often as their weighted Jaccard
    similarity tells, an id's weight being its place in the vocabulary, where
    common pieces come first.
    """
    u = np.random.default_rng(0).random((DRAWS, size))
    return -np.log1p(-u) / np.arange(1, size + 1)


TOKENS = "doc_id long, ids binary, drawn binary"


def tokenize(docs: DataFrame, ranks: dict[bytes, int], pattern: str, special: int) -> DataFrame:
    """(doc_id, ids, drawn): the ids of each whole text as little-endian numbers,
    and those drawn for its place among others.

    The vocabulary is sent to the tasks; its size doesn't grow with the input.
    A null text is empty and has the end mark only.
    """
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    schema = arrow_schema(TOKENS)
    size = max(len(ranks), special + 1, END + 1)
    kind = "<u2" if size <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(sent.value, pattern, special)
        order = draws(size)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids, drawn = [], []
                for text in part.column("text").to_pylist():
                    own = encode(tokenizer, text or "").astype(kind)
                    held = np.unique(own)
                    ids.append(own.tobytes())
                    # The first byte first, so that Spark sorts them as numbers.
                    drawn.append(held[order[:, held].argmin(axis=1)].astype(">u4").tobytes())
                columns = [part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(drawn, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return texts_only(docs).mapInArrow(run, TOKENS)


@dataclass
class Corpus:
    """What BM25 needs of all documents: in how many each id occurs, their number, their mean length."""

    frequencies: np.ndarray
    documents: int
    mean_length: float


def corpus_counts(tokens: DataFrame, size: int, kind: str) -> Corpus:
    """Counts over all documents; the driver gets one number for each id of the vocabulary."""
    ddl = "id int, held long"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last two places hold the documents and their tokens.
        held = np.zeros(size + 2, np.int64)
        for batch in batches:
            for data in batch.column("ids").to_pylist():
                ids = np.frombuffer(data, kind)
                held[np.unique(ids)] += 1
                held[size + 1] += len(ids)
            held[size] += batch.num_rows
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(held[at])], schema=schema)

    rows = tokens.select("ids").mapInArrow(run, ddl).groupBy("id").agg(F.sum("held").alias("held")).toArrow()
    out = np.zeros(size + 2, np.int64)
    out[rows.column("id").to_numpy()] = rows.column("held").to_numpy()
    return Corpus(out[:size], int(out[size]), out[size + 1] / max(1, out[size]))


class Index:
    """BM25 over the documents of a shard."""

    def __init__(self, documents: list[np.ndarray], corpus: Corpus):
        self.size = len(documents)
        lengths = np.fromiter(map(len, documents), np.int64, self.size)
        # Postings: a stable sort by id leaves the documents of each id in order.
        ids = np.concatenate(documents)
        doc = np.repeat(np.arange(self.size, dtype=np.uint16 if self.size <= 1 << 16 else np.uint32), lengths)
        order = np.argsort(ids, kind="stable")
        ids, doc = ids[order], doc[order]
        first = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (doc[1:] != doc[:-1])])
        count = np.diff(np.r_[first, len(ids)]).astype(np.float32)
        term, self.doc = ids[first], doc[first]
        held = corpus.frequencies[term].astype(np.float32)
        rarity = np.log1p((corpus.documents - held + 0.5) / (held + 0.5))
        relative = (lengths / corpus.mean_length).astype(np.float32)[self.doc]
        self.weight = rarity * count * (K1 + 1) / (count + K1 * (1 - B + B * relative))
        found = np.bincount(term, minlength=len(corpus.frequencies))
        self.begin = np.r_[0, np.cumsum(found)]
        common = np.flatnonzero(found * DENSE >= max(self.size, 2 * DENSE))
        self.row = np.full(len(found), -1, np.int32)
        self.row[common] = np.arange(len(common))
        # No larger than the postings it is made of, eight times over.
        self.dense = np.zeros((len(common), self.size), np.float32)
        for row, at in enumerate(common.tolist()):
            a, b = self.begin[at], self.begin[at + 1]
            self.dense[row, self.doc[a:b]] = self.weight[a:b]
        # The terms of each document that another one has too.
        shared = found[term] > 1
        term, doc = term[shared], self.doc[shared]
        ends = np.cumsum(np.bincount(doc, minlength=self.size))
        self.terms = np.split(term[np.argsort(doc, kind="stable")], ends[:-1])

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of all other documents for all different ids of one."""
        terms = self.terms[seed]
        row = self.row[terms]
        score = self.dense[row[row >= 0]].sum(axis=0, dtype=np.float32)
        rare = terms[row < 0]
        begin = self.begin[rare]
        count = self.begin[rare + 1] - begin
        before = np.cumsum(count) - count
        at = np.repeat(begin - before, count) + np.arange(count.sum())
        return score + np.bincount(self.doc[at], self.weight[at], self.size)

    def ranked(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """Unused documents that share an id with a document, best first, ties in order."""
        score = np.where(unused, self.scores(seed), 0)
        # Most windows are full after a few: the others are sorted only if they aren't.
        limit = np.partition(score, -32)[-32] if len(score) > 32 else 0
        for near in (np.flatnonzero((score > 0) & (score >= limit)), np.flatnonzero((score > 0) & (score < limit))):
            yield from near[np.argsort(-score[near], kind="stable")].tolist()


@dataclass
class Packed:
    """Pieces of a shard: document, start, length, sequence, offset."""

    window: int
    pieces: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    sequence: int = 0
    filled: int = 0

    def put(self, doc: int, start: int, length: int) -> None:
        """Add a part of a document; a full window is closed."""
        while length:
            part = min(length, self.window - self.filled)
            self.pieces.append((doc, start, part, self.sequence, self.filled))
            start, length, self.filled = start + part, length - part, self.filled + part
            if self.filled == self.window:
                self.sequence, self.filled = self.sequence + 1, 0

    def close(self) -> None:
        """Cut the window that isn't full into sequences whose lengths are powers of two."""
        at = len(self.pieces)
        while at and self.pieces[at - 1][3] == self.sequence:
            at -= 1
        last, self.pieces[at:] = self.pieces[at:], []
        left = self.filled
        room, filled = 0, 0
        for doc, start, length, _, _ in last:
            while length:
                if not room:
                    room, filled = 1 << (left.bit_length() - 1), 0
                part = min(length, room)
                self.pieces.append((doc, start, part, self.sequence, filled))
                start, length, left, room, filled = start + part, length - part, left - part, room - part, filled + part
                if not room:
                    self.sequence += 1
        self.filled = 0


def pack_shard(documents: list[np.ndarray], corpus: Corpus, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of the documents of a shard."""
    index, out = Index(documents, corpus), Packed(window)
    unused = np.ones(len(documents), bool)
    following = 0
    seed = None
    while True:
        if seed is None:
            while following < len(unused) and not unused[following]:
                following += 1
            if following == len(unused):
                break
            seed = following
            unused[seed] = False
            out.put(seed, 0, len(documents[seed]))
        if not out.filled:
            seed = None
            continue
        sequence, nearest = out.sequence, index.ranked(seed, unused)
        # The document that is cut by the window's end seeds the next one; where
        # no other shares an id, the next in order fills the window up.
        while out.sequence == sequence and (seed := next(nearest, None)) is not None:
            unused[seed] = False
            out.put(seed, 0, len(documents[seed]))
    out.close()
    return out.pieces


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, ranks: dict[bytes, int], pattern: str, special: int, window: int = WINDOW) -> DataFrame:
    """Pack the tokens of all documents into sequences of at most `window`.

    Takes doc_id and text. Returns a row per piece of a document: doc_id, start
    (ids of the document before the piece), length, ids_crc32, doc_tokens,
    sequence_id, offset (of the piece in its sequence). Each id, the end mark of
    each document included, lies in exactly one piece. Sequences are full, or
    as long as a power of two.

    A null or empty text has the end mark only. Repeated rows are packed each;
    rows without doc_id too, under no id. An empty table gives no rows. Very
    long texts are cut as often as needed. The tokenized table is written first
    and sorted by all that a row holds: a task that is repeated gives the same
    pieces. Documents that draw the same ids, any number of them, are split by a
    hash.
    """
    size = max(len(ranks), special + 1, END + 1)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    spark = docs.sparkSession
    tokens = stage(tokenize(docs, ranks, pattern, special), "tokens")
    corpus = corpus_counts(tokens, size, kind)
    sent = spark.sparkContext.broadcast(corpus)
    schema = arrow_schema(PIECES)
    parts = math.ceil(corpus.documents * corpus.mean_length / (SHARD_TOKENS * TASK_SHARDS))
    parts = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("drawn"), F.xxhash64("doc_id", "ids")]
    tokens = tokens.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "ids")

    def shards(batches: Iterator[pa.RecordBatch]):
        ids, documents, held = [], [], 0
        for batch in batches:
            for doc, data in zip(ids_of(batch.column("doc_id")).tolist(), batch.column("ids").to_pylist(), strict=True):
                ids.append(doc)
                documents.append(np.frombuffer(data, kind))
                held += len(documents[-1])
                if held >= SHARD_TOKENS:
                    yield ids, documents
                    ids, documents, held = [], [], 0
        if ids:
            yield ids, documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for ids, documents in shards(batches):
            pieces = pack_shard(documents, sent.value, window)
            sums = [zlib.crc32(documents[d][s : s + n].astype("<u4").tobytes()) for d, s, n, _, _ in pieces]
            doc, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*pieces, strict=True))
            total = np.fromiter(map(len, documents), np.int64, len(documents))[doc]
            yield pa.RecordBatch.from_arrays(
                [ids_back(np.array(ids, np.int64)[doc]), *map(pa.array, (start, length, np.array(sums, np.int64), total, sequence + first, offset))],
                schema=schema,
            )
            first += int(sequence.max()) + 1
            give_back()

    return tokens.mapInArrow(run, PIECES)
