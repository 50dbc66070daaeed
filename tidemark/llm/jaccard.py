"""N-gram Jaccard join by parity sketches.

A document is the set of its word shingles. Each shingle flips a bit of a
parity sketch, so the Hamming distance of two sketches is at most the number of
shingles in which the sets differ. For documents of one size band the similarity
limits that number d. A second sketch has more than d parts; a shingle falls to
one part and flips three bits of the 64 there, so similar documents agree in a
whole part, and meet there. Pairs that meet are held against each other by the
Hamming distance of their parity sketches, then by the exact sets.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import (
    CHUNK_BYTES,
    arrow_rows,
    arrow_schema,
    bytes_of,
    chunks,
    cut,
    expand,
    give_back,
    groups,
    pack_sorted,
    spread,
    squeeze,
    texts_only,
    unpack_sorted,
)
from tidemark.llm.components import components
from tidemark.llm.hashing import grams_of, lower, mix, prefix_sums, span_hashes, spans_of, word_bounds
from tidemark.shared import Workspace, stage

#: Ratio of the ends of a size band.
BAND_RATIO = 1.3
#: Bits that a shingle flips in its part.
FLIPS = 3
#: Ids up to which a list is broadcast (8 bytes each), and members up to which a star is one piece.
BROADCAST_IDS = 500_000
STAR_ROWS = 1_024


@dataclass(frozen=True)
class Rule:
    """Shingles of `k` words; documents link when over * intersection >= share * union."""

    k: int = 5
    share: int = 80
    over: int = 100

    def differing(self, size: int) -> int:
        """Most shingles in which linked sets of at most `size` can differ."""
        return 2 * size * (self.over - self.share) // (self.over + self.share)

    def differing_sizes(self, a, b):
        """Most shingles in which linked sets of the sizes a and b can differ; takes arrays."""
        return (a + b) * (self.over - self.share) // (self.over + self.share)

    def parts(self, size: int) -> int:
        """Parts of a sketch: two more than can differ, and some for parts left empty."""
        d = self.differing(size)
        return d + 2 + -(-d // 16)

    def words(self, size: int) -> int:
        """Words of a parity sketch, of 64 bits for 24 shingles."""
        return max(4, -(-size // 24))

    def linked(self, common: int, a: int, b: int) -> bool:
        return self.over * common >= self.share * (a + b - common)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, and where each begins.

    Words are `[^\\x20\\x09-\\x0D]+` with A to Z in lower case. A document with
    fewer than k words has all of them as one shingle, one without words none.
    """
    buf = lower(buf)
    starts, ends = word_bounds(buf, offsets)
    prefix = prefix_sums(span_hashes(buf, starts, ends))
    bounds = np.searchsorted(starts, offsets)
    grams = grams_of(prefix, k)
    count = np.diff(bounds)
    doc = np.repeat(np.arange(len(count)), np.maximum(count - k + 1, 0))
    whole = np.repeat(bounds[:-1] - (np.cumsum(np.maximum(count - k + 1, 0)) - np.maximum(count - k + 1, 0)), np.maximum(count - k + 1, 0)) + np.arange(len(doc))
    few = np.flatnonzero((count > 0) & (count < k))
    doc = np.r_[doc, few]
    hashes = np.r_[grams[whole] if len(grams) else np.zeros(0, np.uint64), spans_of(prefix, bounds[few], bounds[few + 1])]
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])][: len(doc)]
    doc, hashes = doc[new], hashes[new]
    return hashes, np.searchsorted(doc, np.arange(len(count) + 1))


def sketch(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The sketch in parts of one set, given sorted: `parts` words of 64 bits."""
    out = np.zeros(parts, np.uint64)
    if len(hashes):
        part = ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        spread_ = mix(hashes)
        flips = np.zeros(len(hashes), np.uint64)
        for j in range(FLIPS):
            flips ^= np.uint64(1) << ((spread_ >> np.uint64(6 * j)) & np.uint64(63))
        at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        out[part[at].astype(np.int64)] = np.bitwise_xor.reduceat(flips, at)
    return out


def parity(hashes: np.ndarray, words: int) -> np.ndarray:
    """The parity sketch of a set: each shingle flips one of 64 * `words` bits."""
    bits = 64 * words
    at = ((mix(hashes + np.uint64(3)) >> np.uint64(32)) * np.uint64(bits)) >> np.uint64(32)
    odd = (np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.uint64)


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text, has_id. A row without an id gets a negative one from a hash of its text.

    So it stands for its own text and for no other row without an id.
    """
    rows = texts_only(docs)
    own = F.xxhash64("text").bitwiseOR(F.lit(-1 << 63))
    return rows.select(F.coalesce("doc_id", own).alias("doc_id"), "text", F.col("doc_id").isNotNull().alias("has_id"))


SKETCHES = "doc_id long, has_id boolean, n long, sign_a long, sign_b long, bands binary, parities binary"


def _signs(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two checksums of each set."""
    out = np.zeros((2, len(bounds) - 1), np.uint64)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        out[0, some] = np.add.reduceat(mix(hashes + np.uint64(1)), bounds[:-1][some])
        out[1, some] = np.bitwise_xor.reduceat(mix(hashes + np.uint64(2)), bounds[:-1][some])
    return out.view(np.int64)


def bands_of(size: int, rule: Rule) -> list[int]:
    """The size band of a set, and those above with sets that can be similar.

    None in which only equal sets can link.
    """
    if not size:
        return []
    first = last = bisect_right(_ENDS, size) - 1
    while rule.linked(size, size, band_sizes(last + 1)[0]):
        last += 1
    return [b for b in range(first, last + 1) if rule.differing(band_sizes(b)[1])]


def sketches(docs: DataFrame, rule: Rule) -> DataFrame:
    """Per document: set size, two checksums, its size bands and a parity sketch for each."""
    schema = arrow_schema(SKETCHES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, (rows, buf, offsets) in (
            (b, c) for b in batches for c in cut(np.arange(b.num_rows), *bytes_of(b.column("text")), CHUNK_BYTES // 2)
        ):
            own_rows = batch.select(["doc_id", "has_id"]).slice(int(rows[0]), len(rows))
            hashes, bounds = shingle_sets(buf, offsets, rule.k)
            n, signs, bands, words = np.diff(bounds), _signs(hashes, bounds), [], []
            for i, size in enumerate(n.tolist()):
                own = bands_of(size, rule)
                found = [parity(hashes[bounds[i] : bounds[i + 1]], rule.words(band_sizes(b)[1])) for b in own]
                bands.append(np.array(own, np.int32).tobytes())
                words.append(np.concatenate(found).tobytes() if found else b"")
            yield pa.RecordBatch.from_arrays(
                [*own_rows.columns, pa.array(n), pa.array(signs[0]), pa.array(signs[1]), pa.array(bands, pa.binary()), pa.array(words, pa.binary())],
                schema=schema,
            )

    return _texts(docs).mapInArrow(run, SKETCHES)


def _band_ends(largest: int = 1 << 40) -> tuple[int, ...]:
    ends = [1]
    while ends[-1] <= largest:
        ends.append(max(ends[-1] + 1, int(np.ceil(ends[-1] * BAND_RATIO))))
    return tuple(ends)


_ENDS = _band_ends()


def band_sizes(band: int) -> tuple[int, int]:
    """Least and largest set size of a band."""
    return _ENDS[band], _ENDS[band + 1] - 1


def without_near_duplicates(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The documents that come first in their group, with all their columns.

    Of each group of `near_duplicates` the rows with the smallest doc_id stay;
    rows without doc_id all do.
    """
    found, work = _near_duplicates(docs, rule)
    found = found.where("doc_id != component_id")
    gone = stage(found.select(F.col("doc_id").alias("id")).distinct(), "gone")
    work.drop_all()
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(gone, F.col("doc_id").cast("long") == gone["id"], "left_anti")


def rows_of(table: DataFrame, ids: DataFrame, few: bool) -> DataFrame:
    """Rows of a table whose doc_id is in `ids` (column id).

    A list of at most BROADCAST_IDS, `few`, is sent to the tasks, so that large
    rows needn't move; beyond that both sides are shuffled.
    """
    wanted = F.broadcast(ids) if few else ids
    return table.join(wanted, table["doc_id"] == wanted["id"], "left_semi")


_POSTINGS = "bucket int, lows binary, docs binary, bands binary"


def _words_by_band(bands: bytes, words: bytes, size) -> dict[int, np.ndarray]:
    """The words of each band; `size` gives their number from the band's largest set."""
    out, all_words, at = {}, np.frombuffer(words, np.uint64), 0
    for band in np.frombuffer(bands, np.int32).tolist():
        n = size(band_sizes(band)[1])
        out[band] = all_words[at : at + n]
        at += n
    return out


def _part_keys(band: int, words: np.ndarray, rule: Rule) -> np.ndarray:
    """Keys of the parts of a sketch.

    Empty parts say little. Linked documents agree in more parts than are left
    out here, unless so many are empty that these must count too.
    """
    differing = rule.differing(band_sizes(band)[1])
    part = np.flatnonzero(words)
    if len(words) - len(part) >= len(words) - differing:
        part = np.arange(len(words))
    return mix(mix(words[part] + np.uint64(band)) + part.astype(np.uint64))


def _postings(docs: DataFrame, rule: Rule, buckets: int) -> DataFrame:
    """Part keys of all different sets, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, buf, offsets in chunks(batches, CHUNK_BYTES // 2):
            hashes, bounds = shingle_sets(buf, offsets, rule.k)
            signs = _signs(hashes, bounds)
            # Equal sets are one class already; their first one stands for them.
            order = np.lexsort((ids, signs[1], signs[0]))
            new = np.r_[True, (signs[0][order][1:] != signs[0][order][:-1]) | (signs[1][order][1:] != signs[1][order][:-1])]
            keys, docs, bands = [], [], []
            for i in order[new[: len(order)]].tolist():
                own = hashes[bounds[i] : bounds[i + 1]]
                for band in bands_of(len(own), rule):
                    keys.append(_part_keys(band, sketch(own, rule.parts(band_sizes(band)[1])), rule))
                    docs.append(np.full(len(keys[-1]), ids[i]))
                    bands.append(np.full(len(keys[-1]), band, np.uint8))
            if not keys:
                continue
            key, doc, band = map(np.concatenate, (keys, docs, bands))
            low, bucket = key.astype(np.uint32), (key >> np.uint64(32)) % np.uint64(buckets)
            order = np.lexsort((doc, low, bucket))
            low, bucket, doc, band = low[order], bucket[order], doc[order], band[order]
            yield arrow_rows(
                _POSTINGS,
                [
                    (k, pack_sorted(low[i:j]), squeeze(doc[i:j].view(np.uint8).reshape(-1, 8).T.tobytes()), squeeze(band[i:j].tobytes()))
                    for k, i, j in groups(bucket)
                ],
            )

    return _texts(docs).mapInArrow(run, _POSTINGS)


_STARS = "band int, center long, doc long"
_MET = _STARS + ", several boolean"


def _stars(postings: DataFrame) -> DataFrame:
    """For documents that meet under a key, the smallest of them, and each other one with it.

    `several` tells of a member that met others than the center under a key: only
    such members can be like each other without being held against the center.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        give_back()
        lows, docs, bands = [], [], []
        for a, b, c in zip(*(table.column(n).to_pylist() for n in ("lows", "docs", "bands")), strict=True):
            lows.append(unpack_sorted(a))
            docs.append(np.ascontiguousarray(np.frombuffer(expand(b), np.uint8).reshape(8, -1).T).view(np.int64).ravel())
            bands.append(np.frombuffer(expand(c), np.uint8))
        low, doc, band = map(np.concatenate, (lows, docs, bands))
        order = np.lexsort((doc, band, low))
        low, doc, band = low[order], doc[order], band[order]
        start = np.r_[True, (low[1:] != low[:-1]) | (band[1:] != band[:-1])]
        center = doc[np.flatnonzero(start)][np.cumsum(start) - 1]
        more = center != doc
        several = (np.bincount(np.cumsum(start) - 1, more) > 1)[np.cumsum(start) - 1]
        band, center, doc, several = band[more], center[more], doc[more], several[more]
        order = np.lexsort((~several, doc, center, band))
        band, center, doc, several = band[order], center[order], doc[order], several[order]
        new = np.r_[True, (band[1:] != band[:-1]) | (center[1:] != center[:-1]) | (doc[1:] != doc[:-1])][: len(doc)]
        return pa.table(
            [pa.array(band[new].astype(np.int32)), *(pa.array(x[new]) for x in (center, doc, several))], schema=arrow_schema(_MET)
        )

    return _united(postings.groupBy("bucket").applyInArrow(run, _MET))


def _united(stars: DataFrame) -> DataFrame:
    return stars.groupBy("band", "center", "doc").agg(F.max("several").alias("several"))


def _near(left: np.ndarray, right: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which sketches of `right` differ from `left` in at most `most` shingles each."""
    return np.bitwise_count(left[None] ^ right).sum(1, dtype=np.int64) <= most


_PAIRS = "a long, b long"


def _near_stars(rows: DataFrame, rule: Rule) -> DataFrame:
    """The stars' members whose words, or a part of them, allow a link with the center."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            most = rule.differing_sizes(batch.column("n").to_numpy(), batch.column("center_n").to_numpy())
            for a, b, limit in zip(*(batch.column(c).to_pylist() for c in ("words", "center_words")), most, strict=True):
                kept.append(bool(_near(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)[None], limit)[0]))
            yield batch.select(["band", "center", "doc"]).filter(pa.array(kept, pa.bool_()))

    apart, whole = F.abs(F.col("n") - F.col("center_n")), F.col("n") + F.col("center_n")
    rows = rows.where(apart * (rule.over + rule.share) <= whole * (rule.over - rule.share))
    return rows.select("band", "center", "doc", "n", "center_n", "words", "center_words").mapInArrow(run, _STARS)


def _star_pairs(stars: DataFrame, words: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) of a star's center and member whose sketches allow a link.

    A third of the words bounds the difference too and leaves few unlike pairs;
    only for the others the whole sketches move.
    """
    lead = words.withColumn("words", F.expr("substring(words, 1, int(8 * ceil(length(words) / 24)))"))
    near = _near_stars(_with_words(stars, lead), rule)
    near = _near_stars(_with_words(near, words), rule)
    return near.select(F.least("center", "doc").alias("a"), F.greatest("center", "doc").alias("b")).distinct()


def _cross_pairs(
    doc: np.ndarray, component: np.ndarray, size: np.ndarray, words: np.ndarray, side: np.ndarray | None, rule: Rule, forest: bool
) -> list[tuple[int, int]]:
    """Pairs of different components whose sketches allow a link.

    With `side`, only pairs of the two sides. With `forest`, of all pairs that
    would join the same components only the first.
    """
    out, up = [], {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i in range(len(doc) - 1):
        other = component[i + 1 :] != component[i]
        if side is not None:
            other &= side[i + 1 :] != side[i]
        most = rule.differing_sizes(size, size[i])
        other &= np.abs(size[i + 1 :] - size[i]) <= most[i + 1 :]
        j = np.flatnonzero(other) + i + 1
        # A first look at a few parts spares most of the work.
        for part in (slice(0, 8), slice(None)):
            j = j[_near(words[i][part], words[j][:, part], most[j])] if len(j) else j
        for k in j.tolist():
            if forest:
                x, y = root(int(component[i])), root(int(component[k]))
                if x == y:
                    continue
                up[x] = y
            out.append((min(int(doc[i]), int(doc[k])), max(int(doc[i]), int(doc[k]))))
    return out


_FOUND = "band int, center long, a long, b long"
_PACKED = "band int, center long, own int, docs binary, components binary, sizes binary, words binary"


def _members_of(table: pa.Table) -> tuple[np.ndarray, ...]:
    words = np.frombuffer(b"".join(table.column("words").to_pylist()), np.uint64)
    return *(table.column(c).to_numpy() for c in ("doc", "component", "n")), words.reshape(table.num_rows, -1)


def _rest_pairs(members: DataFrame, mixed: DataFrame, most: int, rule: Rule, buckets: int, forest: bool) -> DataFrame:
    """Pairs (band, center, a, b) within stars, between components, whose sketches allow a link.

    `members` are rows (band, center, doc, component, n, words, held); held is how
    many a star has, in `mixed` for each star, and `most` the largest. A star of
    more than STAR_ROWS is cut into blocks, which are packed and held against each
    other pair by pair.
    """

    def small(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("band", "ascending"), ("center", "ascending"), ("doc", "ascending")])
        band, center = table.column("band").to_numpy(), table.column("center").to_numpy()
        at = np.flatnonzero(np.r_[True, (band[1:] != band[:-1]) | (center[1:] != center[:-1])])
        out: list[tuple[int, int, int, int]] = []
        for i, j in zip(at.tolist(), [*at[1:].tolist(), len(band)], strict=True):
            star = int(band[i]), int(center[i])
            out.extend((*star, a, b) for a, b in _cross_pairs(*_members_of(table.slice(i, j - i)), None, rule, forest))
        return pa.Table.from_batches([arrow_rows(_FOUND, out)])

    def packed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("doc")
        row = (*(k.as_py() for k in key), *(x.tobytes() for x in _members_of(table)))
        return pa.Table.from_batches([arrow_rows(_PACKED, [row])])

    def large(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("own", "docs", "components", "sizes", "words")), strict=True))
        doc, component, size = (np.concatenate([np.frombuffer(r[c], np.int64) for r in rows]) for c in (1, 2, 3))
        words = np.frombuffer(b"".join(r[4] for r in rows), np.uint64).reshape(len(doc), -1)
        side = np.repeat([r[0] for r in rows], [len(r[1]) // 8 for r in rows]) if len(rows) > 1 else None
        star = key[0].as_py(), key[1].as_py()
        found = _cross_pairs(doc, component, size, words, side, rule, forest)
        return pa.Table.from_batches([arrow_rows(_FOUND, [(*star, a, b) for a, b in found])])

    few = members.where(F.col("held") <= STAR_ROWS).drop("held")
    few = few.withColumn("bucket", F.pmod(F.xxhash64("band", "center"), F.lit(buckets)))
    found = few.groupBy("bucket").applyInArrow(small, _FOUND)
    if most <= STAR_ROWS:
        return found
    blocks = F.ceil(F.col("held") / F.lit(STAR_ROWS)).cast("int")
    many = members.where(F.col("held") > STAR_ROWS).withColumn("own", F.pmod(F.xxhash64("doc"), blocks).cast("int"))
    sizes = mixed.where(F.col("held") > STAR_ROWS).select("band", "center", blocks.alias("blocks"))
    many = many.drop("held").groupBy("band", "center", "own").applyInArrow(packed, _PACKED)
    many = many.join(sizes, ["band", "center"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = many.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("blocks", "other")
    return found.unionByName(many.groupBy("band", "center", "low", "high").applyInArrow(large, _FOUND))


def _verify(docs: DataFrame, pairs: DataFrame, rule: Rule, work: Workspace) -> DataFrame:
    """Those of the different pairs (a, b) whose exact sets link, written.

    A set is made once and goes to each pair that it is in; both sets of a pair
    meet in one exchange.
    """
    ddl = "doc long, hashes binary"

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, buf, offsets in chunks(batches, CHUNK_BYTES // 2):
            hashes, bounds = shingle_sets(buf, offsets, rule.k)
            yield arrow_rows(ddl, [(i, hashes[a:b].tobytes()) for i, a, b in zip(own.tolist(), bounds[:-1], bounds[1:], strict=True)])

    def linked(left: set[bytes], right: set[bytes]) -> bool:
        for x, y in ((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x in left for y in right):
            if rule.linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)):
                return True
        return False

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A pair may go on in the next batch. Sets are large: few rows at a time.
        pair, held = None, (set(), set())
        for batch in (b.slice(at, 200) for b in batches for at in range(0, b.num_rows, 200)):
            out = []
            for a, b, doc, found in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "doc", "hashes")), strict=True):
                if (a, b) != pair:
                    if linked(*held):
                        out.append(pair)
                    pair, held = (a, b), (set(), set())
                held[doc != a].add(found)
            yield arrow_rows(_PAIRS, out)
        if linked(*held):
            yield arrow_rows(_PAIRS, [pair])

    count, least = pairs.agg(F.count("*"), F.min("a")).first()
    few = 2 * count <= BROADCAST_IDS
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("doc"))
    ids = ends.select(F.col("doc").alias("id"))
    texts = _texts(docs)
    # Rows that repeat an id: a class stands for its smallest id, whose rows may differ.
    # Those without one are equal where their stand-in, which is negative, is.
    found = rows_of(texts.where("has_id"), ids, few)
    if count and least < 0:
        found = found.unionByName(rows_of(texts.where("NOT has_id"), ids, few).dropDuplicates(["doc_id"]))
    met = found.mapInArrow(sets, ddl).join(F.broadcast(ends) if few else ends, "doc")
    met = met.select("a", "b", "doc", "hashes").repartition("a", "b").sortWithinPartitions("a", "b")
    return work.stage(met.mapInArrow(check, _PAIRS), "links")


def near_duplicates(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The group of near duplicates of each document.

    Takes doc_id and text. Two documents link when the Jaccard similarity of
    their word shingle sets is at least share / over of the rule. Returns a row
    per input row: doc_id, n_shingles (size of its set), component_id (smallest
    doc_id reachable over links, itself included), links (how many classes of
    equal sets its own was found linked with while the groups were joined).

    A document without words, or with a null text, has the empty set and links
    with nothing. Equal sets are one class from the start, so copies are never
    paired. Rows that repeat a doc_id are one document. Rows without one tie no
    others together: each is a document of its own text. All of them are shown
    with the smallest component that one of them is in, which is null if they
    link with nothing that has an id. An empty table gives no rows.
    """
    rows, _ = _near_duplicates(docs, rule)
    nameless = F.col("doc_id").isNull() & (F.col("n_shingles") > 0)
    least = rows.where(nameless).agg(F.min("component_id")).first()[0]
    return rows.withColumn("component_id", F.when(nameless, F.lit(least).cast("long")).otherwise(F.col("component_id")))


def _near_duplicates(docs: DataFrame, rule: Rule) -> tuple[DataFrame, Workspace]:
    """The rows of `near_duplicates`, and the tables that they are read from.

    Here a row without an id has the component of its own text.
    """
    spark = docs.sparkSession
    work, buckets = Workspace(spark), spread(spark)
    table = work.stage(sketches(docs, rule), "sketches")
    sign = ["n", "sign_a", "sign_b"]
    first = F.min(F.when(F.col("has_id"), F.col("doc_id")))
    classes = table.where("n > 0").groupBy(*sign).agg(F.coalesce(first, F.min("doc_id")).alias("class"), first.alias("first"))
    classes = work.stage(classes, "classes")
    # Rows that repeat an id with other texts tie their classes together.
    several = table.where("n > 0 AND has_id").groupBy("doc_id").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in sign for f in (F.min, F.max)))
    several = several.where(" OR ".join(f"min_{c} != max_{c}" for c in sign))
    ties = table.join(several.select("doc_id"), "doc_id", "left_semi").join(classes, sign)
    ties = ties.where(F.col("doc_id") != F.col("class")).select(F.col("class").alias("a"), F.col("doc_id").alias("b"))

    ties = work.stage(ties.distinct(), "ties")
    first_stars = work.stage(_stars(_postings(docs, rule, buckets)), "stars")
    # Documents stand for their classes; those of one class need no link.
    heads = first_stars.select(F.col("doc").alias("id")).union(first_stars.select("center")).distinct()
    met = work.stage(rows_of(table, heads, 2 * first_stars.count() <= BROADCAST_IDS).join(classes, sign), "met")
    # Sketches are kept once: from here on in `words`.
    slim = work.stage(table.drop("bands", "parities"), "signs")
    work.drop(table)
    table, stars, words = slim, _as_classes(first_stars, met, work), _words(met, rule, work)
    work.drop(first_stars, met)
    pairs = work.stage(_star_pairs(stars, words, rule), "pairs")
    links = _verify(docs, pairs, rule, work).unionByName(ties)
    # The center has been held against all; the others only need each other.
    stars = stars.where("several").drop("several")
    labels = components(links, work)
    tested = pairs
    for forest in (True, False):
        members, mixed = _mixed(stars, labels, work)
        most = mixed.agg(F.max("held")).first()[0]
        if most is None:
            break
        # Both written first, so the join may split the rows of a large star.
        members = members.join(mixed, ["band", "center"])
        members = members.join(words, (members["band"] == words["of_band"]) & (members["doc"] == words["of_doc"]))
        members = members.select("band", "center", "doc", "component", "n", "words", "held")
        found = _rest_pairs(members, mixed, most, rule, buckets, forest)
        if forest:
            # A star without such a pair has none either once components have grown.
            found = work.stage(found, "found")
            stars = stars.join(found.select("band", "center").distinct(), ["band", "center"], "left_semi")
        more = work.stage(found.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        if more.isEmpty():
            continue
        tested = tested.unionByName(more)
        new = _verify(docs, more, rule, work)
        if new.isEmpty():
            continue
        links = links.unionByName(new)
        labels = components(links, work)
    count = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("links"))
    labels = labels.join(count, "node", "left").withColumnsRenamed({"node": "class"})
    # Stand-ins of rows without an id are no name for a component.
    firsts = classes.join(labels, "class").groupBy("component").agg(F.min("first").alias("lowest"))
    labels = labels.join(work.stage(firsts, "firsts"), "component").select("class", F.col("lowest").alias("component"), "links")
    known = work.stage(classes.join(labels, "class", "left"), "known")
    # Nothing else is read any more.
    work.drop_all(keep=(table, known))
    own = F.when(F.col("has_id"), F.col("doc_id"))
    rows = table.join(known, sign, "left").select(
        own.alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "first", own).alias("component_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("links"),
    )
    return rows, work


def _as_classes(stars: DataFrame, met: DataFrame, work: Workspace) -> DataFrame:
    """Stars of classes: center and members by the smallest id of their class."""
    of = met.groupBy("doc_id").agg(F.min("class").alias("class"))
    member = of.select(F.col("doc_id").alias("doc"), F.col("class").alias("member"))
    middle = of.select(F.col("doc_id").alias("center"), F.col("class").alias("middle"))
    rows = stars.join(member, "doc").join(middle, "center").where("member != middle")
    rows = rows.select("band", F.col("middle").alias("center"), F.col("member").alias("doc"), "several")
    return work.stage(_united(rows), "class-stars")


def _words(met: DataFrame, rule: Rule, work: Workspace) -> DataFrame:
    """(of_band, of_doc, n, words): size and parity sketch of each class in each of its bands."""
    ddl = "of_band int, of_doc long, n long, words binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, n, bands, words in zip(*(batch.column(c).to_pylist() for c in ("class", "n", "bands", "parities")), strict=True):
                out.extend((b, doc, n, w.tobytes()) for b, w in _words_by_band(bands, words, rule.words).items())
            yield arrow_rows(ddl, out)

    return work.stage(met.select("class", "n", "bands", "parities").mapInArrow(run, ddl).distinct(), "words")


def _with_words(stars: DataFrame, words: DataFrame) -> DataFrame:
    mine = words.withColumnsRenamed({"of_band": "band", "of_doc": "doc"})
    its = words.withColumnsRenamed({"of_band": "band", "of_doc": "center", "n": "center_n", "words": "center_words"})
    return stars.join(mine, ["band", "doc"]).join(its, ["band", "center"])


def _mixed(stars: DataFrame, labels: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """All members with their components; the stars (band, center, held) whose members aren't within one."""
    every = stars.join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    every = work.stage(every, "members")
    state = every.groupBy("band", "center").agg(
        F.count("*").alias("held"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    return every, work.stage(state.where("low != high").drop("low", "high"), "mixed")
