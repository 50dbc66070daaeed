"""Benchmark passages in documents, also with edits.

Texts and items are read as words. A window of a document as long as an item is
held against it as follows: windows that share too few short word runs with the
item to be within its edit limit are left out (a count filter that loses none);
the others and the item are embedded by a CGK random walk, which maps edit to
Hamming distance; windows that agree with the item on sampled places in one of
many repetitions are candidates; an exact edit distance decides. A walk drifts
with the number of edits, so a long item is embedded in pieces: of items within
the limit, one piece at least is within its share of it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import CHUNK_BYTES, arrow_rows, bytes_of, cut, ids_back, ids_of, texts_only
from tidemark.llm.hashing import byte_codes, lower, mix, prefix_sums, spans_of, symbol_grams

#: Edits allowed, as a share of the item's words.
EDITS = 0.2
#: Chance that a window at the edit limit becomes a candidate, places sampled in one
#: repetition, and the share of places that may differ at the limit.
RECALL, SAMPLED, DIFFERING = 0.9999, 3, 0.6
#: Words of a piece of an item that is embedded, at most.
PIECE_WORDS = 50
#: Items sent to tasks at once; a longer benchmark takes several passes.
ITEMS_AT_ONCE = 20_000
_SEED = 20240301
_LETTER = np.zeros(256, bool)
for _low, _high in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _LETTER[_low:_high] = True


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and where each document begins among them.

    A word is a run of letters, digits and bytes above 127; case of A to Z and
    all that stands between words don't count.
    """
    buf = lower(buf)
    solid = _LETTER[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid & (np.r_[True, ~solid[:-1]][: len(buf)] | edge[:-1]))
    ends = np.flatnonzero(solid & (np.r_[~solid[1:], True][: len(buf)] | edge[1:])) + 1
    return spans_of(prefix_sums(byte_codes(buf)), starts, ends), np.searchsorted(starts, offsets)


def edit_limit(length: int, share: float = EDITS) -> int:
    return int(length * share + 1e-9)


def gram_size(length: int, limit: int) -> int:
    """Word runs, of at most three, of which `limit` edits can't touch all."""
    return max(q for q in (1, 2, 3) if q == 1 or length - q + 1 - limit * q >= 1)


def pieces(length: int) -> list[tuple[int, int]]:
    """(from, to) of the equal pieces of an item of at most PIECE_WORDS."""
    count = max(1, -(-length // PIECE_WORDS))
    ends = [length * i // count for i in range(count + 1)]
    return list(zip(ends[:-1], ends[1:], strict=True))


@dataclass
class Items:
    """Benchmark items as words, with an index of their word runs.

    `grams[q]` are sorted hashes of runs of q words, `item` and `place` where
    they are from.
    """

    ids: list[int | None]
    words: list[np.ndarray]
    share: float
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def read(ids: list[int | None], texts: list[str | None], share: float = EDITS) -> Items:
        data = [(t or "").encode() for t in texts]
        offsets = np.r_[0, np.cumsum([len(d) for d in data])].astype(np.int64)
        hashes, bounds = words(np.frombuffer(b"".join(data), np.uint8), offsets)
        each = [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        grams = {}
        for q in (1, 2, 3):
            found = [
                (symbol_grams(w, q), np.full(len(w) - q + 1, i), np.arange(len(w) - q + 1))
                for i, w in enumerate(each)
                if len(w) and gram_size(len(w), edit_limit(len(w), share)) == q
            ]
            if found:
                h, item, place = (np.concatenate(c) for c in zip(*found, strict=True))
                order = np.argsort(h, kind="stable")
                grams[q] = (h[order], item[order], place[order])
        return Items(ids, each, share, grams)


class Embedding:
    """CGK random walks: one for each repetition, with its sampled places."""

    def __init__(self, recall: float = RECALL):
        hit = (1 - DIFFERING) ** SAMPLED
        self.repetitions = math.ceil(math.log(1 - recall) / math.log(1 - hit))

    def _stays(self, symbol: np.ndarray, repetition: int, step: np.ndarray) -> np.ndarray:
        """Whether the walk reads the symbol once more after this step."""
        return mix(symbol + np.uint64(_SEED + 1_000_003 * repetition) + step.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63) == 0

    def embed(self, windows: np.ndarray, repetition: int) -> np.ndarray:
        """Rows of 3n symbols for rows of n symbols; 0 once the row is read."""
        rows, n = windows.shape
        padded = np.concatenate([windows, np.zeros((rows, 1), np.uint64)], 1)
        at, out, row = np.zeros(rows, np.int64), np.zeros((rows, 3 * n), np.uint64), np.arange(rows)
        for step in range(3 * n):
            out[:, step] = padded[row, at]
            stays = self._stays(out[:, step], repetition, np.full(rows, step))
            at = np.where(stays, at, np.minimum(at + 1, n))
        return out

    def candidates(self, item: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Which windows meet the item in some repetition."""
        met = np.zeros(len(windows), bool)
        for r in range(self.repetitions):
            rest = np.flatnonzero(~met)
            if not len(rest):
                break
            both = self.embed(np.concatenate([item[None], windows[rest]]), r)
            # The last third is mostly padding, which any two rows share.
            sampled = np.random.Generator(np.random.PCG64(_SEED + r)).integers(0, max(1, 3 * len(item) // 2), SAMPLED)
            met[rest] = (both[1:, sampled] == both[:1, sampled]).all(1)
        return met


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, from, to) of the part of `text` with the least edit distance to the item.

    Insertions, deletions and replacements of words count one each. Of equal
    parts the one that ends first counts.
    """
    n = len(item)
    cost, begin = np.arange(n + 1), np.zeros(n + 1, np.int64)
    best = (n, 0, 0)
    for j, symbol in enumerate(text.tolist()):
        change = np.where(item == symbol, 0, 1)
        new, where = np.empty(n + 1, np.int64), np.empty(n + 1, np.int64)
        new[0], where[0] = 0, j + 1
        for i in range(1, n + 1):
            a, b, c = cost[i - 1] + change[i - 1], cost[i] + 1, new[i - 1] + 1
            if a <= b and a <= c:
                new[i], where[i] = a, begin[i - 1]
            elif b <= c:
                new[i], where[i] = b, begin[i]
            else:
                new[i], where[i] = c, where[i - 1]
        cost, begin = new, where
        if cost[n] < best[0]:
            best = (int(cost[n]), int(begin[n]), j + 1)
    return best


def _regions(place: np.ndarray, diagonal: np.ndarray, gram: np.ndarray, n: int, limit: int, least: int):
    """Parts of a document with at least `least` different runs of an item within its length.

    `place` (sorted) is where a run stands in the document, `diagonal` where the
    item would begin, `gram` which run of the item it is. Gives the beginnings in
    each part with the runs they are from.
    """
    reach = n + limit
    at, size = 0, len(place)
    parts = []
    stop = np.searchsorted(place, place + reach, "left")
    while at < size:
        if len(set(gram[at : stop[at]].tolist())) < least:
            at += 1
            continue
        end = int(stop[at])
        parts.append((at, end))
        at += 1
    joined: list[list[int]] = []
    for a, b in parts:
        if joined and a < joined[-1][1]:
            joined[-1][1] = max(b, joined[-1][1])
        else:
            joined.append([a, b])
    for a, b in joined:
        yield diagonal[a:b], gram[a:b]


def _met(symbols: np.ndarray, hashes: np.ndarray, low: int, high: int, begins: np.ndarray, gram: np.ndarray, q: int, share: float, embedding: Embedding) -> np.ndarray:
    """Where the item begins by those of its pieces that meet the document, of words low to high."""
    met = []
    # Where edits at the limit can touch all runs of a piece, no window may be left out.
    if any(gram_size(b - a, edit_limit(b - a, share)) < q for a, b in pieces(len(symbols))):
        return begins
    for a, b in pieces(len(symbols)):
        n = b - a
        starts = np.unique(begins[(gram >= a) & (gram + q <= b)]) + a
        if not len(starts):
            continue
        starts = np.clip(starts, low, max(low, high - n))
        width = min(n, high - low)
        windows = np.zeros((len(starts), n), np.uint64)
        windows[:, :width] = hashes[starts[:, None] + np.arange(width)]
        met.append(starts[embedding.candidates(symbols[a:b], windows)] - a)
    return np.concatenate(met) if met else begins[:0]


def find_items(hashes: np.ndarray, bounds: np.ndarray, items: Items, embedding: Embedding) -> list[tuple[int, int, int, int, int]]:
    """(document, item, edits, from, to), the best match of each pair within the limit."""
    hits = []
    for q, (known, item, place) in items.grams.items():
        grams = symbol_grams(hashes, q)
        if not len(grams):
            continue
        seen = np.zeros(1 << 16, bool)
        seen[known & np.uint64(0xFFFF)] = True
        maybe = np.flatnonzero(seen[grams & np.uint64(0xFFFF)])
        low, high = np.searchsorted(known, grams[maybe], "left"), np.searchsorted(known, grams[maybe], "right")
        each = high - low
        at = np.repeat(maybe, each)
        which = np.repeat(low - (np.cumsum(each) - each), each) + np.arange(each.sum())
        doc = np.searchsorted(bounds, at, "right") - 1
        inside = at + q <= bounds[doc + 1]
        hits.append((doc[inside], item[which[inside]], at[inside], place[which[inside]]))
    if not hits:
        return []
    doc, item, at, place = (np.concatenate(c) for c in zip(*hits, strict=True))
    order = np.lexsort((place, at, item, doc))
    doc, item, at, place = doc[order], item[order], at[order], place[order]
    edges = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]) if len(doc) else []
    out = []
    for a, b in zip(edges, np.append(edges[1:], len(doc)) if len(doc) else [], strict=True):
        d, i = int(doc[a]), int(item[a])
        symbols = items.words[i]
        n, limit = len(symbols), edit_limit(len(symbols), items.share)
        q = gram_size(n, limit)
        least = max(1, n - q + 1 - limit * q)
        # Runs that an item holds twice count once, in the item and in the text.
        least -= (n - q + 1) - len(np.unique(symbol_grams(symbols, q)))
        if b - a < max(1, least):
            continue
        low, high = int(bounds[d]), int(bounds[d + 1])
        best = None
        for begins, gram in _regions(at[a:b], at[a:b] - place[a:b], place[a:b], n, limit, max(1, least)):
            met = _met(symbols, hashes, low, high, begins, gram, q, items.share, embedding)
            if not len(met):
                continue
            begin, end = max(low, int(met.min()) - limit), min(high, int(met.max()) + n + limit)
            edits, x, y = best_match(symbols, hashes[begin:end])
            if edits <= limit and (best is None or edits < best[0]):
                best = (edits, begin + x - low, begin + y - low)
        if best is not None:
            out.append((d, i, *best))
    return out


def _item_parts(benchmark: DataFrame, share: float) -> Iterator[Items]:
    """The benchmark in parts of bounded size."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    parts = max(1, -(-rows.count() // ITEMS_AT_ONCE))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    for part in range(parts):
        table = rows.where(F.col("part") == part).orderBy("item_id", "text").toArrow()
        yield Items.read(table.column("item_id").to_pylist(), table.column("text").to_pylist(), share)


RESULT = "doc_id long, item_id long, edits int, item_words int, first_word long, n_words long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = EDITS) -> DataFrame:
    """Benchmark items in documents, within `share` of their words in edits.

    Takes doc_id and text, and item_id and text. Returns a row for each document
    row and item found in it: doc_id, item_id, edits, item_words, and the place
    of the best match in the document, in words. Every whole text is searched.

    Items without words, and null or empty texts, are never found. Items of one
    text are each found; rows that repeat are each searched. Of equally good
    places the first counts. An empty table gives no rows. The benchmark goes to
    the tasks in parts of at most ITEMS_AT_ONCE items.
    """
    out = None
    for items in _item_parts(benchmark, share):
        sent = docs.sparkSession.sparkContext.broadcast(tuple(vars(items).values()))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            embedding, items = Embedding(), Items(*sent.value)
            for batch in batches:
                ids = ids_of(batch.column("doc_id"))
                buf, offsets = bytes_of(batch.column("text"))
                for own, part, at in cut(ids, buf, offsets, CHUNK_BYTES // 2):
                    found = find_items(*words(part, at), items, embedding)
                    doc = ids_back(own[[f[0] for f in found]] if found else own[:0]).to_pylist()
                    yield arrow_rows(
                        RESULT,
                        [
                            (name, items.ids[i], edits, len(items.words[i]), first, last - first)
                            for name, (_, i, edits, first, last) in zip(doc, found, strict=True)
                        ],
                    )

        part = texts_only(docs).mapInArrow(run, RESULT)
        out = part if out is None else out.unionAll(part)
    return out


def remove_leaks(docs: DataFrame, benchmark: DataFrame, share: float = EDITS) -> DataFrame:
    """The rows of documents in which no benchmark item is found, with all their columns."""
    for items in _item_parts(benchmark, share):
        sent = docs.sparkSession.sparkContext.broadcast(tuple(vars(items).values()))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            embedding, items = Embedding(), Items(*sent.value)
            for batch in batches:
                buf, offsets = bytes_of(batch.column("text"))
                clean = np.ones(batch.num_rows, bool)
                for rows, part, at in cut(np.arange(batch.num_rows), buf, offsets, CHUNK_BYTES // 2):
                    clean[rows[[f[0] for f in find_items(*words(part, at), items, embedding)]]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
