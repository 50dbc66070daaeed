"""Windows that occur more than once, found without moving all windows.

Both substring operators remove what windows of a fixed length cover if the
same window also occurs earlier. Their common plan:

1. `_anchors`: every window belongs to its minimizer (`owned_windows`), so equal
   windows meet under equal minimizers. A scan sends minimizer hashes only, a
   few bytes for each of about a twentieth of the places, to hash buckets.
2. `_repeated`: a bucket tells the document blocks which of their minimizers
   occur elsewhere too. Those with very many occurrences are marked heavy.
3. `_contexts`: a block finds the contexts of its repeated minimizers (all
   windows the minimizer owns), keeps equal ones once, and sends their hashes to
   shards by minimizer. A heavy minimizer would gather unlike contexts without
   bound in one shard; its windows go singly, each by its own hash, and equal
   ones are merged in the block before.
4. `_known`: a shard tells blocks where contexts that several have occur first.
   Where a minimizer has unlike contexts it asks one block for the text of each.
5. `_texts`: the blocks cut these out and send them.
6. `_firsts`: the shard resolver, which is the operator's own method, says for
   windows of each context where they occur first in an unlike one.
7. `_finish`: a block marks the windows whose first occurrence is earlier and
   calls the operator for each of its documents.

All rows are moved packed; a block or shard holds its share of the input, whose
size follows `spark.sql.shuffle.partitions`. Results of steps 2, 4 and 6 are
written to the shared folder, so a lost executor costs one task; what was moved
to make them is removed before the next step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.blocks import (
    arrow_rows,
    arrow_schema,
    block_of,
    chunks,
    expand,
    give_back,
    groups,
    pack_documents,
    pack_sorted,
    spread,
    squeeze,
    texts_only,
    unpack_documents,
    unpack_rest,
    unpack_sorted,
)
from tidemark.llm.hashing import (
    byte_prefix_sums,
    grams_of,
    owned_windows,
    prefix_sums,
    span_hashes,
    spans_of,
    word_bounds,
)
from tidemark.shared import shuffles_removed, stage

#: Occurrences (as sent, after merging within tasks) from which a minimizer is heavy. Each
#: window of a heavy one goes by itself, 16 times as much as the context that holds them,
#: and the larger the input the more are heavy. So many contexts are below 1 MB of text.
HEAVY = 4096
#: Bytes of text whose minimizers a task sends together, so that a bucket gets long runs.
TOGETHER = 16 << 20


@dataclass(frozen=True)
class Reading:
    """How texts are read: `words` or bytes, window length, minimizer length.

    `within` says whether a window may be removed because of an earlier start
    in its own document.
    """

    words: bool
    length: int
    gram: int
    within: bool


class Chunk:
    """One chunk of documents as symbols."""

    def __init__(self, how: Reading, ids, buf, offsets):
        self.how, self.ids, self.buf, self.offsets = how, ids, buf, offsets
        if how.words:
            self.starts, self.ends = word_bounds(buf, offsets)
            self.bounds = np.searchsorted(self.starts, offsets)
            self.prefix = prefix_sums(span_hashes(buf, self.starts, self.ends))
        else:
            self.bounds = offsets
            self.prefix = byte_prefix_sums(buf)
        self.size = len(self.prefix) - 1
        grams = grams_of(self.prefix, how.gram)
        anchor, self.first, self.last = owned_windows(grams, self.bounds, how.length, how.gram)
        self.keys = grams[anchor]
        self.doc = np.searchsorted(self.bounds, self.first, "right") - 1

    def spans(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hash of the symbols of the windows from first to last."""
        return spans_of(self.prefix, first, last + self.how.length)

    def bytes_at(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in `buf` the windows from first to last begin and end."""
        if not self.how.words:
            return first, last + self.how.length
        return self.starts[first], self.ends[last + self.how.length - 1]


def _low(keys: np.ndarray) -> np.ndarray:
    return keys.astype(np.uint32)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys >> np.uint64(32)) % np.uint64(buckets)


def _name(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket above the low half of each key."""
    return _low(keys).astype(np.uint64) | (_bucket(keys, buckets) << np.uint64(32))


def _turned(values: np.ndarray) -> bytes:
    """The bytes of numbers, first those of the lowest place of all, then the next."""
    values = np.ascontiguousarray(values)
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _turned_back(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _planes(values: np.ndarray) -> bytes:
    return squeeze(_turned(values.astype(np.int64)))


def _from_planes(data: bytes) -> np.ndarray:
    return _turned_back(expand(data), np.int64)


def _steps(values: np.ndarray) -> bytes:
    """64-bit numbers in about rising order, as differences."""
    return _planes(np.diff(values.astype(np.int64), prepend=np.int64(0)))


def _from_steps(data: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(data))


def _each(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of so many members: the group of each, and its place in there."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - (np.cumsum(counts) - counts)[group]


_ANCHORS = "bucket int, lows binary, blocks binary, twice binary"
_REPEATED = "block int, bucket int, lows binary, heavy binary"
_CONTEXTS = "shard int, block int, starts binary, lows binary, contents binary, windows binary, docs binary, places binary, sizes binary"
_FIRSTS = "block int, starts binary, froms binary, tos binary, docs binary, places binary"
_KNOWN = f"shard int, {_FIRSTS}, asked binary, sizes binary, lows binary, windows binary, counts binary, blocks binary"
_TEXTS = "shard int, block int, lengths binary, texts binary"


def _anchors(docs: DataFrame, how: Reading, blocks: int) -> DataFrame:
    """Minimizers by hash bucket, with the block of their document.

    Of the texts taken together, equal ones of one block are sent once, with a
    mark if they occur more than once in it.
    """

    def send(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        name, block, doc = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((block, name))  # Equal ones stay in order of documents.
        name, block, doc = name[order], block[order], doc[order]
        at = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (block[1:] != block[:-1])])
        twice = doc[at] != doc[np.append(at[1:], len(doc)) - 1]
        low, bucket, block = _low(name[at]), name[at] >> np.uint64(32), block[at]
        return arrow_rows(
            _ANCHORS,
            [
                (b, pack_sorted(low[i:j]), squeeze(_turned(block[i:j])), np.packbits(twice[i:j]).tobytes())
                for b, i, j in groups(bucket)
            ],
        )

    def run(batches):
        held, size, seen = [], 0, 0
        for ids, buf, offsets in chunks(batches):
            chunk = Chunk(how, ids, buf, offsets)
            if not len(chunk.keys):
                continue
            doc = chunk.doc if not how.within else np.arange(len(chunk.doc))
            held.append((_name(chunk.keys, blocks), block_of(ids, blocks).astype(np.uint32)[chunk.doc], doc + seen))
            size, seen = size + len(buf), seen + int(doc[-1]) + 1
            if size >= TOGETHER:
                yield send(held)
                held, size = [], 0
        if held:
            yield send(held)

    return texts_only(docs).mapInArrow(run, _ANCHORS)


def _repeated(anchors: DataFrame) -> DataFrame:
    """For each block, its minimizers that occur more than once anywhere."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        give_back()
        lows, blocks, twice = [], [], []
        for a, b, c in zip(*(table.column(n).to_pylist() for n in ("lows", "blocks", "twice")), strict=True):
            lows.append(unpack_sorted(a))
            blocks.append(_turned_back(expand(b), np.uint32))
            twice.append(np.unpackbits(np.frombuffer(c, np.uint8), count=len(lows[-1])))
        low, block, twice = np.concatenate(lows), np.concatenate(blocks), np.concatenate(twice)
        order = np.lexsort((block, low))
        low, block, twice = low[order], block[order], twice[order]
        start = np.r_[True, low[1:] != low[:-1]]
        group = np.cumsum(start) - 1
        count = np.bincount(group)
        held = (count > 1) | (np.bincount(group, twice) > 0)
        keep = held[group]
        low, block, heavy = low[keep], block[keep], (count >= HEAVY)[group][keep]
        one = np.r_[True, (low[1:] != low[:-1]) | (block[1:] != block[:-1])][: len(low)]
        low, block, heavy = low[one], block[one], heavy[one]
        order = np.argsort(block, kind="stable")
        low, block, heavy = low[order], block[order], heavy[order]
        bucket = key[0].as_py()
        rows = [
            (b, bucket, pack_sorted(low[i:j]), np.packbits(heavy[i:j]).tobytes()) for b, i, j in groups(block)
        ]
        return pa.Table.from_batches([arrow_rows(_REPEATED, rows)])

    return anchors.groupBy("bucket").applyInArrow(run, _REPEATED)


@dataclass
class Ranges:
    """The repeated windows of a block: owned ranges, one row each.

    `chunk` and `first` say where, `windows` how many, `place` where in the
    document, `id` of which document, `klass` the number of equal contexts,
    `key` under what the context is sent, `content` the hash of its symbols,
    `start` and `size` its bytes in the documents of the block in order. No two
    ranges have one `start`.
    """

    chunk: np.ndarray
    first: np.ndarray
    windows: np.ndarray
    place: np.ndarray
    id: np.ndarray
    key: np.ndarray
    content: np.ndarray
    start: np.ndarray
    size: np.ndarray
    klass: np.ndarray


def _in_order(docs: list[tuple[int, bytes]]) -> list[int]:
    """Order of documents, given by id and text, that doesn't depend on how they arrived."""
    return sorted(range(len(docs)), key=docs.__getitem__)


def _documents(ids: np.ndarray, buf: np.ndarray, offsets: np.ndarray) -> list[tuple[int, bytes]]:
    data, at = buf.tobytes(), offsets.tolist()
    return [(i, data[a:b]) for i, a, b in zip(ids.tolist(), at[:-1], at[1:], strict=True)]


def _bases(held: list[Chunk]) -> list[np.ndarray]:
    """For each chunk, where its documents begin if all of the block lie in order."""
    order = np.array(_in_order([d for c in held for d in _documents(c.ids, c.buf, c.offsets)]), np.int64)
    sizes = np.concatenate([np.zeros(0, np.int64), *(np.diff(c.offsets) for c in held)])
    base = np.empty(len(sizes), np.int64)
    base[order] = np.cumsum(sizes[order]) - sizes[order]
    return np.split(base, np.cumsum([len(c.ids) for c in held])[:-1]) if held else []


def _block_ranges(held: list[Chunk], keys: pa.Table, buckets: int) -> Ranges:
    known, heavy = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
    for bucket, lows, marks in zip(*(keys.column(c).to_pylist() for c in ("bucket", "lows", "heavy")), strict=True):
        low = unpack_sorted(lows)
        known.append(low.astype(np.uint64) | np.uint64(bucket << 32))
        heavy.append(np.unpackbits(np.frombuffer(marks, np.uint8), count=len(low)).astype(bool))
    known, heavy = np.concatenate(known), np.concatenate(heavy)
    order = np.argsort(known)
    known, heavy = known[order], heavy[order]
    parts = []
    for n, (chunk, base) in enumerate(zip(held, _bases(held), strict=True)):
        name = _name(chunk.keys, buckets)
        at = np.minimum(np.searchsorted(known, name), max(0, len(known) - 1))
        hit = (known[at] == name) if len(known) else np.zeros(len(name), bool)
        single = hit & heavy[at] if len(known) else hit
        whole = np.flatnonzero(hit & ~single)
        first, last, key, doc = chunk.first[whole], chunk.last[whole], chunk.keys[whole], chunk.doc[whole]
        if single.any():
            s = np.flatnonzero(single)
            each = chunk.last[s] - chunk.first[s] + 1
            begin = np.repeat(chunk.first[s] - (np.cumsum(each) - each), each) + np.arange(each.sum())
            first, last = np.r_[first, begin], np.r_[last, begin]
            key = np.r_[key, chunk.spans(begin, begin)]
            doc = np.r_[doc, np.repeat(chunk.doc[s], each)]
        begin, end = chunk.bytes_at(first, last)
        start = base[doc] + begin - chunk.offsets[doc]
        parts.append((np.full(len(first), n), first, last - first + 1, first - chunk.bounds[doc], chunk.ids[doc], key, chunk.spans(first, last), start, end - begin))
    if not parts:
        none = np.zeros(0, np.int64)
        return Ranges(none, none, none, none, none, none.astype(np.uint64), none.astype(np.uint64), none, none, none)
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    # Equal contexts under one key are a class. Its first member is the earliest one.
    place, ids, key, content, start = columns[3:8]
    order = np.lexsort((start, place, ids, content, key))
    new = np.r_[True, (key[order][1:] != key[order][:-1]) | (content[order][1:] != content[order][:-1])][: len(order)]
    klass = np.cumsum(new) - 1
    return Ranges(*(c[order] for c in columns), klass)


def _leaders(r: Ranges) -> np.ndarray:
    """Index of the earliest member of each class."""
    return np.flatnonzero(np.r_[True, r.klass[1:] != r.klass[:-1]][: len(r.klass)])


def _contexts(packed: DataFrame, repeated: DataFrame, how: Reading, blocks: int) -> DataFrame:
    """Hashes of the contexts of the repeated minimizers of each block, by shard."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()
        r = _block_ranges([Chunk(how, *c) for c in unpack_documents(left)], right, blocks)
        lead = _leaders(r)
        shard = _bucket(r.key[lead], blocks)
        order = np.lexsort((r.start[lead], shard))
        lead, shard = lead[order], shard[order]
        rows = []
        for s, i, j in groups(shard):
            at = lead[i:j]
            rows.append(
                (
                    s,
                    key[0].as_py(),
                    _steps(r.start[at]),
                    _low(r.key[at]).tobytes(),
                    r.content[at].tobytes(),
                    squeeze(r.windows[at].astype(np.uint16).tobytes()),
                    _steps(r.id[at]),
                    _planes(r.place[at]) if how.within else b"",
                    squeeze(_turned(r.size[at].astype(np.uint32))) if how.words else b"",
                )
            )
        return pa.Table.from_batches([arrow_rows(_CONTEXTS, rows)])

    return (
        packed.groupBy("block")
        .cogroup(repeated.groupBy("block"))
        .applyInArrow(run, _CONTEXTS)
    )


def _by_block(block: np.ndarray, start: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The blocks of the rows `at`, and those of each in order of their starts."""
    at = at[np.lexsort((start[at], block[at]))]
    for b, i, j in groups(block[at]):
        yield b, at[i:j]


def _tell(block: int, how: Reading, start, low, high, doc, place) -> tuple:
    """A row of `_FIRSTS`: windows low to high of the contexts at `start` occur first in `doc` at `place`."""
    return (
        block,
        _steps(start),
        squeeze(low.astype(np.uint16).tobytes()),
        squeeze(high.astype(np.uint16).tobytes()),
        _planes(doc),
        _planes(place) if how.within else b"",
    )


def _known(contexts: DataFrame, how: Reading) -> DataFrame:
    """Where contexts that several blocks have occur first, and which ones need a closer look.

    Contexts are equal if the hashes of their minimizer and of all their symbols are.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        give_back()
        parts = []
        for row in table.to_pylist():
            start, low = _from_steps(row["starts"]), np.frombuffer(row["lows"], np.uint32)
            windows = np.frombuffer(expand(row["windows"]), np.uint16).astype(np.int64)
            place = _from_planes(row["places"]) if how.within else np.zeros(len(start), np.int64)
            size = _turned_back(expand(row["sizes"]), np.uint32).astype(np.int64) if how.words else windows + how.length - 1
            parts.append((np.full(len(start), row["block"]), start, low, np.frombuffer(row["contents"], np.uint64), windows, _from_steps(row["docs"]), place, size))
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        block, start, low, content, windows, doc, place, size = columns
        order = np.lexsort((start, block, place, doc, content, low))
        block, start, low, content, windows, doc, place, size = (c[order] for c in columns)
        lead = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (content[1:] != content[:-1])])
        counts = np.diff(np.append(lead, len(low)))
        first = np.repeat(lead, counts)
        later = doc[first] < doc
        if how.within:
            later |= (doc[first] == doc) & (place[first] < place)
        # A key with one context only needs no closer look.
        other = np.r_[True, low[lead][1:] != low[lead][:-1], True]
        unlike = ~(other[:-1] & other[1:])
        lead, counts = lead[unlike], counts[unlike]
        shard, nobody = key[0].as_py(), np.zeros(0, np.int64)
        told, asked = (dict(_by_block(block, start, at)) for at in (np.flatnonzero(later), lead))
        rows = []
        for b in sorted(told.keys() | asked.keys()):
            at, ask = told.get(b, nobody), asked.get(b, nobody)
            row = _tell(b, how, start[at], windows[at] * 0, windows[at] - 1, doc[first[at]], place[first[at]])
            rows.append((shard, *row, _steps(start[ask]) if len(ask) else None, _planes(size[ask]), *(None,) * 4))
        if len(lead):
            # What the shard needs to know again once it has the texts.
            group, nth = _each(counts)
            at = lead[group] + nth
            sent = (None, _planes(start[at]), None, None, _planes(doc[at]), _planes(place[at]), None, None)
            of = (low[lead].tobytes(), squeeze(windows[lead].astype(np.uint16).tobytes()), _planes(counts))
            rows.append((shard, *sent, *of, squeeze(_turned(block[at].astype(np.uint32)))))
        return pa.Table.from_batches([arrow_rows(_KNOWN, rows)])

    return contexts.groupBy("shard").applyInArrow(run, _KNOWN)


def _texts(packed: DataFrame, known: DataFrame, how: Reading) -> DataFrame:
    """The texts that shards ask for; words are joined by a space."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()
        rows = []
        if right.num_rows:
            docs = [d for c in unpack_documents(left) for d in _documents(*c)]
            data = b"".join([docs[i][1] for i in _in_order(docs)])
            for row in right.to_pylist():
                begin = _from_steps(row["asked"])
                end = begin + _from_planes(row["sizes"])
                texts = [data[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
                if how.words:
                    texts = [b" ".join(t.split()) for t in texts]
                lengths = np.fromiter(map(len, texts), np.uint32, len(texts))
                rows.append((row["shard"], key[0].as_py(), squeeze(_turned(lengths)), squeeze(b"".join(texts))))
        return pa.Table.from_batches([arrow_rows(_TEXTS, rows)])

    asked = known.where("asked IS NOT NULL").select("block", "shard", "asked", "sizes")
    return packed.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(run, _TEXTS)


@dataclass
class Contexts:
    """The different contexts of a shard under keys that have several, and who sent them.

    Of each different context: text `texts[i]`, `key`, number of `windows`, and
    its earliest occurrence, `doc` and `place`. Of each sender: `of` (which
    context), `block`, `start`, and its own earliest occurrence.
    """

    texts: list[bytes]
    key: np.ndarray
    windows: np.ndarray
    doc: np.ndarray
    place: np.ndarray
    of: np.ndarray
    block: np.ndarray
    start: np.ndarray
    sent_doc: np.ndarray
    sent_place: np.ndarray


def _read_contexts(texts: pa.Table, senders: dict) -> Contexts:
    counts = _from_planes(senders["counts"])
    of, _ = _each(counts)
    lead = np.cumsum(counts) - counts
    start, doc, place = (_from_planes(senders[c]) for c in ("starts", "docs", "places"))
    block = _turned_back(expand(senders["blocks"]), np.uint32).astype(np.int64)
    # Each block has sent its texts in order of their starts.
    sent = []
    for row in sorted(texts.to_pylist(), key=lambda row: row["block"]):
        data, at = expand(row["texts"]), 0
        for size in _turned_back(expand(row["lengths"]), np.uint32).tolist():
            sent.append(data[at : at + size])
            at += size
    held: list[bytes] = [b""] * len(lead)
    for i, text in zip(np.lexsort((start[lead], block[lead])).tolist(), sent, strict=True):
        held[i] = text
    windows = np.frombuffer(expand(senders["windows"]), np.uint16).astype(np.int64)
    return Contexts(held, np.frombuffer(senders["lows"], np.uint32), windows, doc[lead], place[lead], of, block, start, doc, place)


#: What a resolver gives: context, first and last window, first document, first place
#: (of the first of these windows). Only contexts of which a window occurs in another
#: context need rows; equal contexts are known already.
Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _firsts(texts: DataFrame, known: DataFrame, how: Reading, resolve: Callable[[Contexts, np.ndarray], Found]) -> DataFrame:
    """Where windows of unlike contexts occur first, told to the blocks that have them later."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()
        (senders,) = right.to_pylist()
        c = _read_contexts(left, senders)
        context, low, high, doc, place = resolve(c, np.arange(len(c.texts)))
        # Each sender gets the rows of its context.
        order = np.argsort(context, kind="stable")
        begin = np.searchsorted(context[order], np.arange(len(c.texts) + 1))
        sender, nth = _each(np.diff(begin)[c.of])
        row = order[begin[c.of][sender] + nth]
        earlier = doc[row] < c.sent_doc[sender]
        if how.within:
            earlier |= (doc[row] == c.sent_doc[sender]) & (place[row] < c.sent_place[sender] + low[row])
        sender, row = sender[earlier], row[earlier]
        start, block = c.start[sender], c.block[sender]
        rows = [
            _tell(b, how, start[at], low[row[at]], high[row[at]], doc[row[at]], place[row[at]])
            for b, at in _by_block(block, start, np.arange(len(row)))
        ]
        return pa.Table.from_batches([arrow_rows(_FIRSTS, rows)])

    senders = known.where("block IS NULL").drop("block", "froms", "tos", "asked", "sizes")
    return texts.groupBy("shard").cogroup(senders.groupBy("shard")).applyInArrow(run, _FIRSTS)


def _covered(r: Ranges, held: list[Chunk], how: Reading, firsts: pa.Table) -> list[np.ndarray]:
    """For each chunk, which symbols removed windows cover."""
    lead = _leaders(r)
    order = np.argsort(r.start[lead])
    number, low, high, doc, place = ([np.zeros(0, np.int64)] for _ in range(5))
    for row in firsts.to_pylist():
        number.append(order[np.searchsorted(r.start[lead], _from_steps(row["starts"]), sorter=order)])
        low.append(np.frombuffer(expand(row["froms"]), np.uint16).astype(np.int64))
        high.append(np.frombuffer(expand(row["tos"]), np.uint16).astype(np.int64))
        doc.append(_from_planes(row["docs"]))
        place.append(_from_planes(row["places"]) if how.within else np.zeros(len(doc[-1]), np.int64))
    # What the block knows itself: the earliest member of each class.
    number.append(np.arange(len(lead)))
    low.append(np.zeros(len(lead), np.int64))
    high.append(r.windows[lead] - 1)
    doc.append(r.id[lead])
    place.append(r.place[lead])
    number, low, high, doc, place = map(np.concatenate, (number, low, high, doc, place))
    begin = np.append(lead, len(r.klass))
    row, nth = _each(np.diff(begin)[number])
    member = begin[number][row] + nth
    earlier = doc[row] < r.id[member]
    if how.within:
        earlier |= (doc[row] == r.id[member]) & (place[row] < r.place[member] + low[row])
    row, member = row[earlier], member[earlier]
    out = []
    for n, chunk in enumerate(held):
        mine = r.chunk[member] == n
        first = r.first[member[mine]]
        step = np.zeros(chunk.size + 1, np.int32)
        np.add.at(step, first + low[row[mine]], 1)
        np.add.at(step, first + high[row[mine]] + how.length, -1)
        out.append(np.cumsum(step[:-1]) > 0)
    return out


def remove_repeats(
    docs: DataFrame,
    how: Reading,
    resolve: Callable[[Contexts, np.ndarray], Found],
    finish: Callable[[Chunk, np.ndarray], Iterator[tuple]],
    ddl: str,
    more: tuple[str, ...] = (),
) -> DataFrame:
    """Rows that `finish` gives for each chunk and its covered symbols, one a document.

    Columns of the documents named by `more` go along.
    """
    blocks = spread(docs.sparkSession)
    packed = pack_documents(docs, blocks)
    with shuffles_removed(docs.sparkSession):
        repeated = stage(_repeated(_anchors(docs, how, blocks)), "repeated")
        known = stage(_known(_contexts(packed, repeated, how, blocks), how), "known")
        firsts = stage(_firsts(_texts(packed, known, how), known, how, resolve), "firsts")
    schema = T.StructType([*T.StructType.fromDDL(ddl).fields, *(docs.schema[c] for c in more)])
    told = repeated.select("block", "bucket", "lows", "heavy", *(F.lit(None).cast("binary").alias(c) for c in firsts.columns[1:]))
    for more_told in (known.where("block IS NOT NULL").select(*firsts.columns), firsts):
        told = told.unionByName(more_told, allowMissingColumns=True)

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        held = [Chunk(how, *c) for c in unpack_documents(left)]
        is_key = pa.compute.is_valid(right.column("lows"))
        r = _block_ranges(held, right.filter(is_key), blocks)
        covered = _covered(r, held, how, right.filter(pa.compute.invert(is_key)))
        rows = [x for chunk, mask in zip(held, covered, strict=True) for x in finish(chunk, mask)]
        out = pa.Table.from_batches([arrow_rows(ddl, rows)])
        if more and left.num_rows:
            rest = unpack_rest(left)
            for c in more:
                out = out.append_column(c, rest.column(c))
        return out

    packed = pack_documents(docs, blocks, *more) if more else packed
    return packed.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, schema)
