"""Removal of repeated bytes and words against the definition, and its parts."""

import hashlib
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

import tidemark.llm.repeats as repeats
from tidemark.llm import hashing
from tidemark.llm.blocks import pack_documents
from tidemark.llm.substring_automaton import SuffixAutomaton, remove_repeated_spans
from tidemark.llm.substring_intervals import maximal_repeats, remove_repeated_bytes, suffix_array
from tidemark.shared import shuffles_removed

SMALL = "/root/testdata/sf0.001/documents.parquet"


def covered(rows, length, within):
    """(id, symbols) -> which symbols earlier windows cover, by the definition."""
    first = {}
    for i, s in sorted(rows, key=lambda r: r[0]):
        for j in range(len(s) - length + 1):
            first.setdefault(tuple(s[j : j + length]), (i, j))
    out = []
    for i, s in rows:
        mask = [False] * len(s)
        for j in range(len(s) - length + 1):
            f = first[tuple(s[j : j + length])]
            if f < (i, j) if within else f[0] < i:
                mask[j : j + length] = [True] * length
        out.append((i, s, mask))
    return out


def words_of(text):
    return [w.encode() for w in re.findall("[^\x20\x09-\x0d]+", text or "")]


def expected_words(rows, length):
    out = []
    for i, s, m in covered([(i, words_of(t)) for i, t in rows], length, True):
        kept = b" ".join(w for w, x in zip(s, m) if not x)
        out.append((i, len(s), sum(m), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def expected_bytes(rows, length):
    out = []
    for i, s, m in covered([(i, (t or "").encode()) for i, t in rows], length, False):
        spans = sum(x and not (j and m[j - 1]) for j, x in enumerate(m))
        kept = bytes(c for c, x in zip(s, m) if not x)
        out.append((i, len(s), sum(m), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got_words(df, length=20):
    return sorted(tuple(r)[:4] for r in remove_repeated_spans(df, length).collect())


def got_bytes(df, length=50):
    return sorted(tuple(r)[:5] for r in remove_repeated_bytes(df, length).collect())


@pytest.fixture(params=[repeats.HEAVY, 3])
def heavy(request, monkeypatch):
    monkeypatch.setattr(repeats, "HEAVY", request.param)


def test_given_documents(spark, heavy):
    df = spark.read.parquet(SMALL)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert got_words(df) == expected_words(rows, 20)
    assert got_bytes(df) == expected_bytes(rows, 50)


def test_odd_rows(spark):
    """Nulls, empty and blank texts, ties, shared edges, characters of several bytes, a long text."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (5, "a b c d e f g h"), (3, "x b c d e y"), (9, None), (10, ""), (11, " \t\n\x0b\x0c\r"),
        (12, "é ü b c d e ñ\x00z é ü b"), (2, "b c d e"), (-4, "b c d e f"), (13, "a a a a a a a a"), (14, long),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"block": F.lit("clash"), "kept": F.lit(1), "lows": F.lit(None).cast("string")}
    )
    assert got_words(df, 3) == expected_words(rows, 3)
    short = [r for r in rows if r[0] != 14]
    assert got_bytes(df.where("doc_id != 14"), 5) == expected_bytes(short, 5)


def test_rows_without_id_and_repeated_ids(spark):
    rows = [(None, "p q r s t"), (1, "p q r s t"), (1, "p q r s t"), (None, "p q r s t")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.n_removed) for r in remove_repeated_spans(df, 3).collect()))
    assert got == [(False, 0), (False, 0), (True, 5), (True, 5)]
    got = sorted(((r.doc_id is None, r.n_removed) for r in remove_repeated_bytes(df, 4).collect()))
    assert got == [(False, 0), (False, 0), (True, 9), (True, 9)]


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert got_words(df) == [] and got_bytes(df) == []


def _texts(n, seed):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(3000)]
    return [" ".join(rng.choice(words, 150)) for _ in range(n)]


def _moved(df):
    """Bytes of all binary columns."""
    sizes = [F.sum(F.length(c)) for c, kind in df.dtypes if kind == "binary"]
    return sum(x or 0 for x in df.agg(*sizes).first())


def test_repeated_texts_move_as_hashes(spark):
    """What goes to the shards for a context that several blocks have is less than its text."""
    texts = _texts(40, 2)
    rows = [(100 * c + i, t) for c in range(6) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    how = repeats.Reading(words=False, length=50, gram=20, within=False)
    repeated = repeats._repeated(repeats._anchors(df, how, 16))
    contexts = repeats._contexts(pack_documents(df, 16), repeated, how, 16)
    assert _moved(contexts) < 1.5 * sum(len(t) for _, t in rows)
    assert got_bytes(df) == expected_bytes(rows, 50)


def test_minimizers_of_many_chunks_go_together(spark, monkeypatch):
    """Rows of a task's minimizers don't grow with its chunks, so buckets get long runs."""
    monkeypatch.setattr("tidemark.llm.blocks.chunks.__defaults__", (1 << 12,))
    rows = list(enumerate(_texts(60, 3)))
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    how = repeats.Reading(words=False, length=50, gram=20, within=False)
    assert repeats._anchors(df, how, 16).count() == 16


def test_unlike_contexts_of_copies(spark, heavy):
    """Texts that share words and passages, each several times, with ids that repeat or are missing."""
    texts = _texts(12, 4)
    mixed = [a[: len(a) // 2] + b[len(b) // 3 :] for a, b in zip(texts, texts[1:])]
    rows = [(i, t) for i, t in enumerate(texts + mixed + texts[:5] + mixed[:5])]
    rows += [(3, texts[3]), (3, mixed[2]), (7, "  ".join(texts[8].split())), (50, "\t".join(texts[9].split()))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_bytes(df) == expected_bytes(rows, 50)
    unique = [r for r in rows if r[0] not in (3, 7)]
    assert got_words(df.where("doc_id NOT IN (3, 7)"), 8) == expected_words(unique, 8)


def test_shuffle_files_go_with_their_query(spark, tmp_path):
    import os

    from tidemark.shared import stage

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def files():
        return {f for d in local for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_") and f.endswith(".data")}

    held = files()
    with shuffles_removed(spark):
        assert stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "shuffled").count() == 7
        assert stage(spark.range(1000).repartition(5, "id"), "shuffled").count() == 1000
    assert not files() - held
    assert spark.conf.get(key, None) == before


def test_interval_tree_gives_all_maximal_repeats():
    rng = np.random.default_rng(1)
    for _ in range(20):
        texts = ["".join(rng.choice(list("ab"), rng.integers(1, 25))) for _ in range(4)]
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        begin = np.cumsum([0] + [len(t) for t in texts])[:-1]
        of = np.repeat(np.arange(4), [len(t) for t in texts])
        left = np.array([len(texts[o]) for o in of]) - (np.arange(len(data)) - begin[of])
        before = np.r_[-1, data[:-1].astype(np.int64)]
        before[begin] = -1
        array = suffix_array(data, left, np.arange(len(data)))
        size, low, high = maximal_repeats(array, before, 3)
        got = {
            (data[array.starts[a] : array.starts[a] + n].tobytes().decode(), frozenset(array.starts[a : b + 1].tolist()))
            for n, a, b in zip(size, low, high)
        }
        want = set()
        for t in texts:
            for i in range(len(t)):
                for j in range(i + 3, len(t) + 1):
                    s = t[i:j]
                    at = [b + k for b, u in zip(begin, texts) for k in range(len(u)) if u.startswith(s, k)]
                    ends = {(u[k + len(s) : k + len(s) + 1] or f"end{n}{k}") for n, u in enumerate(texts) for k in range(len(u)) if u.startswith(s, k)}
                    starts = {(u[k - 1] if k else f"begin{n}") for n, u in enumerate(texts) for k in range(len(u)) if u.startswith(s, k)}
                    if len(at) > 1 and len(ends) > 1 and len(starts) > 1:
                        want.add((s, frozenset(int(x) for x in at)))
        assert got == want


def test_matching_statistics():
    automaton = SuffixAutomaton()
    automaton.add([1, 2, 3, 4], 7, 0)
    automaton.add([9, 2, 3, 4, 5], 3, 10)
    automaton.settle()
    found = [(n, automaton.first[v] if n else None) for n, v in automaton.statistics([2, 3, 4, 5, 8, 1, 2, 3], 3)]
    assert [n for n, _ in found] == [1, 2, 3, 3, 0, 1, 2, 3]
    assert found[2][1] == (3, 13) and found[3][1] == (3, 14) and found[7][1] == (7, 2)


def _owners_one_by_one(grams, bounds, length, k):
    """(minimizer, first, last) of each run of windows, straight from the definition."""
    bits = max(1, int(bounds[-1]).bit_length())
    out = []
    for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        for first in range(begin, end - length + 1):
            anchor = min(range(first, first + length - k + 1), key=lambda i: (int(grams[i]) >> bits, i))
            if out and out[-1][0] == anchor and out[-1][2] == first - 1 >= begin:
                out[-1][2] = first
            else:
                out.append([anchor, first, first])
    return out


@pytest.mark.parametrize("piece", [7, 64, 1 << 14])
@pytest.mark.parametrize("length, k", [(50, 20), (12, 12), (1, 1), (9, 4)])
def test_pieces_give_the_same_minimizers(monkeypatch, piece, length, k):
    monkeypatch.setattr(hashing, "_PIECE", piece)
    rng = np.random.default_rng(piece + length)
    sizes = [0, 3, length, length - 1, 200, 0, 61, length + 1, 0]
    buf = rng.integers(0, 3, sum(sizes)).astype(np.uint8)
    bounds = np.r_[0, np.cumsum(sizes)]
    prefix = hashing.byte_prefix_sums(buf)
    assert (prefix == hashing.prefix_sums(hashing.byte_codes(buf))).all()
    grams = hashing.grams_of(prefix, k)
    at = np.arange(len(grams))
    down = hashing._power_table("down", hashing._INVERSE, len(prefix))
    assert (grams == hashing.mix((prefix[at + k] - prefix[at]) * down[at])).all()
    found = hashing.owned_windows(grams, bounds, length, k)
    assert np.stack(found, 1).tolist() == _owners_one_by_one(grams, bounds, length, k)


def test_minimizers_are_found_in_a_few_bytes_a_place():
    buf = np.random.default_rng(1).integers(0, 256, 1 << 20).astype(np.uint8)
    bounds = np.arange(0, len(buf) + 1, 1 << 12)
    grams = hashing.grams_of(hashing.byte_prefix_sums(buf), 20)
    tracemalloc.start()
    try:
        hashing.owned_windows(grams, bounds, 50, 20)
        assert tracemalloc.get_traced_memory()[1] < 8 * len(buf), "a copy of all hashes goes through memory"
    finally:
        tracemalloc.stop()
