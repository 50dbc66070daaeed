"""Repeated word spans by suffix automata of reference shards."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import NO_ID
from tidemark.llm.repeats import Chunk, Contexts, Reading, remove_repeats

Place = tuple[int, int]


class SuffixAutomaton:
    """All substrings of some sequences, each with its earliest end.

    `add` takes a sequence and the (document, place) of its first symbol. After
    `settle`, `statistics` gives for each place of a text the longest match that
    ends there, and `earliest` where a match occurs first.
    """

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.first: list[Place | None] = [None]

    def _state(self, length: int, next_: dict[int, int], link: int) -> int:
        self.next.append(next_)
        self.link.append(link)
        self.length.append(length)
        self.first.append(None)
        return len(self.link) - 1

    def _split(self, p: int, symbol: int, q: int) -> int:
        """The state of the strings of p and the symbol, cut off from q if q has longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, symbol: int) -> int:
        known = self.next[last].get(symbol)
        if known is not None:
            return self._split(last, symbol, known)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, symbol, self.next[p][symbol])
        return new

    def add(self, symbols: list[int], doc: int, place: int) -> None:
        last = 0
        for at, symbol in enumerate(symbols, place):
            last = self._extend(last, symbol)
            held = self.first[last]
            if held is None or (doc, at) < held:
                self.first[last] = (doc, at)

    def settle(self) -> None:
        """Hand the earliest ends on to all suffixes."""
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            up, held = self.link[v], self.first[v]
            if up > 0 and held is not None and (self.first[up] is None or held < self.first[up]):
                self.first[up] = held

    def statistics(self, symbols: list[int], most: int):
        """(length, state) of the longest match ending at each place, cut to `most`."""
        v = held = 0
        for symbol in symbols:
            while v and symbol not in self.next[v]:
                v = self.link[v]
                held = self.length[v]
            v = self.next[v].get(symbol, 0)
            held = held + 1 if v else 0
            if held >= most:
                held = most
                while self.length[self.link[v]] >= most:
                    v = self.link[v]
            yield held, v


def _resolver(length: int):
    def resolve(c: Contexts, unlike: np.ndarray):
        out: list[tuple[int, int, int, int, int]] = []
        order = unlike[np.argsort(c.key[unlike], kind="stable")]
        keys = c.key[order]
        edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True]) if len(order) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            members = order[a:b].tolist()
            ids: dict[bytes, int] = {}
            texts = [[ids.setdefault(w, len(ids)) for w in c.texts[i].split()] for i in members]
            docs, places = c.doc[order[a:b]].tolist(), c.place[order[a:b]].tolist()
            automaton = SuffixAutomaton()
            for symbols, doc, place in zip(texts, docs, places, strict=True):
                automaton.add(symbols, doc, place)
            automaton.settle()
            first = automaton.first
            for i, symbols, doc, place in zip(members, texts, docs, places, strict=True):
                run = None
                for end, (held, state) in enumerate(automaton.statistics(symbols, length)):
                    if held < length:
                        continue
                    window = end - length + 1
                    d, e = first[state]
                    if d == doc and e == place + end:
                        run = None
                        continue
                    shift = e - end  # the place of the context's first symbol there
                    if run is not None and run[2] == window - 1 and run[3] == d and run[5] == shift:
                        run[2] = window
                    else:
                        run = [i, window, window, d, e - length + 1, shift]
                        out.append(run)
        found = np.array([r[:5] for r in out], np.int64).reshape(-1, 5)
        return tuple(found[:, j] for j in range(5))

    return resolve


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, new_text string"


def _finish(keep_text: bool):
    def finish(chunk: Chunk, covered: np.ndarray):
        data = chunk.buf.tobytes()
        for i, doc in enumerate(chunk.ids.tolist()):
            lo, hi = int(chunk.bounds[i]), int(chunk.bounds[i + 1])
            text = data[chunk.offsets[i] : chunk.offsets[i + 1]]
            words = text.split()
            mask = covered[lo:hi]
            removed = int(mask.sum())
            if removed:
                words = [words[j] for j in np.flatnonzero(~mask).tolist()]
            kept = b" ".join(words)
            yield (
                None if doc == NO_ID else doc,
                hi - lo,
                removed,
                hashlib.sha256(kept).hexdigest(),
                (kept if removed else text).decode("utf-8", "replace") if keep_text else None,
            )

    return finish


def without_repeated_spans(docs: DataFrame, length: int = 20) -> DataFrame:
    """The documents with `remove_repeated_spans` carried out on their texts.

    All columns stay; n_chars, if there is one, follows the text. Documents of
    which nothing is left go. The other columns travel with the texts, so
    nothing is joined.
    """
    row = F.struct(*(c for c in docs.columns if c != "text"))
    rows = docs.select("doc_id", "text", F.struct(row.alias("row"), F.col("text").isNull().alias("missing")).alias("rest"))
    found = remove_repeated_spans(rows, length, more=("rest",)).where("n_words = 0 OR n_removed < n_words")
    out = []
    for c in docs.columns:
        held = F.col("rest").getField("row").getField(c)
        if c == "text":
            held = F.when(~F.col("rest").getField("missing"), F.col("new_text"))
        elif c == "n_chars":
            length_now = F.char_length("new_text").cast(docs.schema[c].dataType)
            held = F.when(F.col("n_removed") > 0, length_now).otherwise(held)
        out.append(held.alias(c))
    return found.select(*out)


def remove_repeated_spans(
    docs: DataFrame, length: int = 20, keep_text: bool = True, more: tuple[str, ...] = ()
) -> DataFrame:
    """Remove spans of `length` or more words that occur earlier.

    Takes a table with doc_id and text; other columns don't matter. Words are
    `[^\\x20\\x09-\\x0D]+`, unchanged. A word goes if a window of `length` words
    covers it that also starts earlier: in a document with a smaller doc_id, or
    before it in the same one. Returns a row per input row: doc_id, n_words,
    n_removed, kept_sha256 (of the kept words joined by one space) and, with
    `keep_text`, new_text: the text as it was if nothing is removed, else the
    kept words joined by one space. Columns named by `more` are passed through.

    A null text has no words. Rows without doc_id count as one document after
    all others. Rows that repeat a doc_id are the same document. An empty table
    gives no rows.

    A reference shard is what shares its minimizers; its automaton knows of each
    span where it occurs first, and matching statistics of the shard's contexts
    are taken against it. So a document meets only shards with which it shares
    something, however large the reference is.
    """
    how = Reading(words=True, length=length, gram=max(1, min(5, length)), within=True)
    return remove_repeats(docs, how, _resolver(length), _finish(keep_text), RESULT, more)
