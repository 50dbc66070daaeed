"""Documents and numbers packed into blocks, so that a shuffle moves few large rows.

A task turns its rows into arrays, cuts these by destination and sends one row
per destination. What a destination gets is bounded by the number of
destinations, `spread(spark)`, which follows `spark.sql.shuffle.partitions`.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.hashing import mix

#: Stands for a missing id; such rows count as the last ones.
NO_ID = (1 << 63) - 1
#: Bytes of text that a task looks at in one go; a longer text is taken alone.
CHUNK_BYTES = 2 << 20


def spread(spark: SparkSession) -> int:
    """Number of blocks: twice the shuffle partitions of the session."""
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts_only(docs: DataFrame, *more: str) -> DataFrame:
    """The id as a number, the text, and nothing else that the table may hold."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def ids_of(column: pa.Array) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def ids_back(ids: np.ndarray) -> pa.Array:
    ids = np.ascontiguousarray(ids, np.int64)
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one array of bytes, and where each begins."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


def give_back() -> None:
    """Return freed memory to the system.

    Spark keeps Python workers for later tasks; what one stage has freed would
    otherwise stay with them and add to what the next stages need.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # Not glibc.
        pass


def cut(ids: np.ndarray, buf: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Consecutive documents of at most `limit` bytes together, one at least."""
    at, n = 0, len(ids)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield ids[at:to], buf[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
    give_back()


def chunks(batches: Iterable[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple]:
    """(ids, bytes, offsets) of documents from batches with doc_id and text."""
    for batch in batches:
        buf, offsets = bytes_of(batch.column("text"))
        yield from cut(ids_of(batch.column("doc_id")), buf, offsets, limit)


def block_of(ids: np.ndarray, blocks: int) -> np.ndarray:
    """The block a document belongs to, by its id."""
    return (mix(ids.astype(np.uint64)) >> np.uint64(20)).astype(np.uint64) % np.uint64(blocks)


def groups(sorted_labels: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(label, from, to) of each run in sorted labels."""
    if not len(sorted_labels):
        return
    at = np.flatnonzero(np.r_[True, sorted_labels[1:] != sorted_labels[:-1]])
    for a, b in zip(at, np.append(at[1:], len(sorted_labels)), strict=True):
        yield int(sorted_labels[a]), int(a), int(b)


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as compressed differences, byte planes apart."""
    steps = np.diff(values, prepend=np.uint32(0)).astype("<u4")
    return squeeze(steps.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(expand(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


PACKED_DOCS = "block int, ids binary, lengths binary, texts binary, rest binary"


def pack_documents(docs: DataFrame, blocks: int, *more: str) -> DataFrame:
    """Whole documents by block, compressed: a few rows per task and block.

    Columns named by `more` go along.
    """

    def run(batches):
        for batch in batches:
            ids = ids_of(batch.column("doc_id"))
            for rows, buf, offsets in cut(np.arange(len(ids)), *bytes_of(batch.column("text")), 16 * CHUNK_BYTES):
                block = block_of(ids[rows], blocks)
                order = np.argsort(block, kind="stable")
                lengths = np.diff(offsets)
                out = []
                for b, lo, hi in groups(block[order]):
                    mine = order[lo:hi]
                    text = b"".join(buf[offsets[i] : offsets[i + 1]].tobytes() for i in mine)
                    rest = _ipc(batch.select(more).take(pa.array(rows[mine]))) if more else b""
                    out.append((b, ids[rows[mine]].tobytes(), lengths[mine].tobytes(), squeeze(text), rest))
                yield arrow_rows(PACKED_DOCS, out)

    return texts_only(docs, *more).mapInArrow(run, PACKED_DOCS)


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return squeeze(sink.getvalue().to_pybytes())


def _packed_rows(table: pa.Table) -> list[tuple]:
    """Rows in an order that doesn't depend on how they arrived.

    So a block that is worked on again, or after a lost executor, gives the same
    numbering.
    """
    return sorted(zip(*(table.column(c).to_pylist() for c in ("ids", "lengths", "texts", "rest")), strict=True))


def unpack_documents(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, bytes, offsets) chunks of a block."""
    for ids, lengths, texts, _ in _packed_rows(table):
        sizes = np.frombuffer(lengths, np.int64)
        offsets = np.r_[0, np.cumsum(sizes)]
        yield from cut(np.frombuffer(ids, np.int64), np.frombuffer(expand(texts), np.uint8), offsets)


def unpack_rest(table: pa.Table) -> pa.Table:
    """The columns that went along, in the order of the documents."""
    return pa.concat_tables(pa.ipc.open_stream(expand(r[3])).read_all() for r in _packed_rows(table))


_TYPES = {
    "int": pa.int32(),
    "long": pa.int64(),
    "double": pa.float64(),
    "string": pa.string(),
    "binary": pa.binary(),
    "boolean": pa.bool_(),
}


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _TYPES[t]) for n, t in (c.split() for c in ddl.split(", "))])


def arrow_rows(ddl: str, rows: list[tuple]) -> pa.RecordBatch:
    """A batch of a few rows given as tuples."""
    schema = arrow_schema(ddl)
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def arrow_table(ddl: str, *columns) -> pa.Table:
    """A table of whole columns: arrays or Arrow arrays."""
    schema = arrow_schema(ddl)
    return pa.Table.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema,
    )
