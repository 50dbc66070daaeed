"""Near duplicates against all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

import tidemark.llm.jaccard as jaccard
import tidemark.shared as shared
from tidemark.llm.jaccard import Rule, near_duplicates, without_near_duplicates

RULES = [Rule(3, 90, 100), Rule(5, 80, 100)]


def shingles(text, k):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if len(words) >= k else frozenset([tuple(words)])


def groups_by_pairs(rows, rule):
    sets = [(i, shingles(t, rule.k)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and rule.over * len(a & b) >= rule.share * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return sorted((i, len(s), root(i)) for i, s in sets)


def found(df, rule):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df, rule).collect())


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("rule", RULES)
def test_chains_copies_and_all_sizes(spark, rule, monkeypatch):
    """Near copies around the threshold, chains, tiny documents; small stars and lists."""
    monkeypatch.setattr(jaccard, "STAR_ROWS", 8)
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    rng, rows, n = random.Random(5), [], 0
    for size in (1, 2, 3, 4, 6, 9, 12, 20, 35, 60, 110, 400):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for _ in range(14):
            n += 1
            rows.append((n * 7 % 1009, edited(rng, base, rng.randrange(1 + max(1, size // 20)))))
        step = list(base)
        for _ in range(8):
            n += 1
            step[rng.randrange(size)] = f"y{rng.randrange(10**6)}"
            rows.append((n * 7 % 1009, " ".join(step).upper()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = groups_by_pairs(rows, rule)
    assert found(df, rule) == want
    kept = sorted(r.doc_id for r in without_near_duplicates(df.withColumn("n", F.lit(1)), rule).collect())
    assert kept == sorted(i for i, _, c in want if i == c)


def test_low_similarity(spark):
    """Sets that lie more than a band of sizes apart link too."""
    rng, rows = random.Random(6), []
    for n in range(30):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 300))]
        rows += [(2 * n, " ".join(base)), (2 * n + 1, " ".join(base[: 2 + int(len(base) * rng.uniform(0.5, 0.7))]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rule = Rule(3, 55, 100)
    want = groups_by_pairs(rows, rule)
    assert found(df, rule) == want and 5 < sum(i != c for i, _, c in want) < 30


def test_one_id_with_several_texts(spark):
    """Each text of a repeated id links with its like."""
    rng, rows, want = random.Random(7), [], []
    for n in range(20):
        texts = [[f"w{rng.randrange(10**6)}" for _ in range(100)] for _ in range(2)]
        rows += [(10 * n + k, edited(rng, t, 1)) for k, t in enumerate(texts, 1)] + [(10 * n, " ".join(t)) for t in texts]
        want += [10 * n] * 4
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.component_id for r in near_duplicates(df, Rule(5, 80, 100)).collect()) == want


def test_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert found(df, RULES[1]) == groups_by_pairs(rows, RULES[1])


def test_odd_rows(spark):
    """Nulls, blanks, repeated rows and ids, no id, clashing columns."""
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = [
        (4, None), (5, ""), (6, " \n"), (7, "one"), (8, "ONE "), (9, "a b c d"), (9, "a b c d"), (3, "A B C D"),
        (11, long), (12, long + " end"), (1, "p q r s"), (2, "t u v w"), (1, "t u v w"),
        (None, "only here now"), (None, "a b c d"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"n": F.lit("clash"), "class": F.lit(1), "component": F.lit(2), "band": F.lit(0)}
    )
    got = sorted(((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in near_duplicates(df, RULES[0]).collect()))
    assert got == sorted(
        [
            (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 1, 7), (8, 1, 7), (9, 2, 3), (9, 2, 3), (3, 2, 3),
            (11, 29_998, 11), (12, 29_999, 11), (1, 2, 1), (2, 2, 1), (1, 2, 1), (-1, 1, 3), (-1, 2, 3),
        ]
    )


def test_rows_without_id_merge_no_others(spark):
    """Unlike documents stay, whatever rows without an id hold; these link only by their own text."""
    rng, rows = random.Random(8), []
    for i in range(40):
        base = [f"u{rng.randrange(10**6)}" for _ in range(60)]
        rows += [(100 + i, " ".join(base)), (None, " ".join(base)), (None, edited(rng, base, 1))]
        if i % 2:
            rows.append((200 + i, edited(rng, base, 1)))
        rows += [(None, " ".join(f"v{i}x{j}" for j in range(20)))] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for rule in RULES:
        named = [(i, t) if i is not None else (1000 + n, t) for n, (i, t) in enumerate(rows)]
        want = [x for x in groups_by_pairs(named, rule) if x[0] < 1000]
        got = near_duplicates(df, rule).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == want
        assert len(got) == len(rows) and {r.component_id for r in got if r.doc_id is None} == {100}
        kept = [r.doc_id for r in without_near_duplicates(df, rule).collect()]
        assert sorted(i for i in kept if i is not None) == [i for i, _, c in want if i == c]
        assert kept.count(None) == sum(i is None for i, _ in rows)


def test_tables_written(spark, monkeypatch):
    """Each table written on the way costs a task and a file per shuffle partition, however small it is."""
    written, write = [], shared._stage
    monkeypatch.setattr(shared, "_stage", lambda df, path: written.append(path.rsplit("/", 1)[1].rsplit("-", 1)[0]) or write(df, path))
    rng, rows = random.Random(9), []
    for n in range(6):
        base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        rows += [(20 * n + k, edited(rng, base, k % 3)) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, RULES[1]) == groups_by_pairs(rows, RULES[1])
    assert len(written) <= 20 and written.count("links") <= 3


def test_sets_of_many_pairs(spark):
    """A set in very many pairs, rows that repeat an id, rows without one; more pairs than are looked at in one go."""
    rng = random.Random(10)
    base = [f"w{rng.randrange(10**6)}" for _ in range(40)]
    rows = [(0, " ".join(base))] + [(i, edited(rng, base, 1) if i % 3 else f"other {i} text") for i in range(1, 500)]
    rows += [(3, rows[1][1])] * 4 + [(5, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    nameless = [(None, " ".join(base))] * 3
    df = df.union(spark.createDataFrame(nameless, "doc_id long, text string"))
    own = jaccard._texts(df).where("NOT has_id").first()["doc_id"]
    ends = [(0, i) for i in range(1, 500)] + [(own, i) for i in range(500)]
    with shared.Workspace(spark) as work:
        pairs = work.stage(spark.createDataFrame(ends, "a long, b long").coalesce(1), "pairs")
        got = sorted(tuple(r) for r in jaccard._verify(df, pairs, Rule(3, 80, 100), work).collect())
    sets = {}
    for i, text in rows + [(own, " ".join(base))]:
        sets.setdefault(i, set()).add(shingles(text, 3))
    near = lambda x, y: 100 * len(x & y) >= 80 * len(x | y)
    assert got == sorted((a, b) for a, b in ends if any(near(x, y) for x in sets[a] for y in sets[b]))
    assert 600 < len(got) < len(ends)


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert found(df, RULES[0]) == []


def test_sketches_bound_the_difference():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 300)).astype(np.uint64))
        drop = rng.integers(0, len(a))
        b = np.unique(np.r_[a[drop:], rng.integers(0, 1 << 62, rng.integers(0, 20)).astype(np.uint64)])
        differing = len(np.setxor1d(a, b))
        x, y = jaccard.parity(a, 8), jaccard.parity(b, 8)
        assert int(np.bitwise_count(x ^ y).sum()) <= differing
        assert int((jaccard.sketch(a, 40) != jaccard.sketch(b, 40)).sum()) <= differing
