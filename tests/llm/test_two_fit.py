"""Packing by best two fit: coverage, the plan against one sequence at a time, odd rows."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import packing, queries, two_fit


def packed(df):
    ranks = packing.load_ranks(queries.BYTE_BPE_RANKS)
    return two_fit.pack(df, ranks, public_tokenizers.PATTERN, queries.END_OF_TEXT)


def one_at_a_time(lengths, window):
    """The method in its plainest form: lists, one sequence after another."""
    left, out = sorted(lengths, reverse=True), []
    while left:
        own, gap = [], window
        for n in list(left):
            if n <= gap:
                own.append(n)
                left.remove(n)
                gap -= n
        while gap and len(own) > 1:
            small = min(own)
            pairs = [
                (a + b, a, b)
                for i, a in enumerate(left)
                for b in left[i + 1 :]
                if small < a + b <= gap + small
            ]
            if not pairs:
                break
            total, a, b = max(pairs)
            own.remove(small)
            for n in (a, b):
                left.remove(n)
                own.append(n)
            left = sorted([*left, small], reverse=True)
            gap = gap + small - total
        out.append(sorted(own, reverse=True))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_one_sequence_after_another(seed):
    rng = np.random.default_rng(seed)
    window = 40
    lengths = rng.integers(1, window + 1, 150).tolist() if seed % 2 else (1 + rng.geometric(0.15, 150) % window).tolist()
    plan = two_fit.fill_all(np.bincount(lengths, minlength=window + 1), window)
    assert [f for f, times in plan for _ in range(times)] == one_at_a_time(lengths, window)
    assert len(plan) <= 3 * window


def test_few_sequences_and_few_fillings():
    rng = np.random.default_rng(1)
    lengths = np.minimum(1024, rng.lognormal(5, 1.2, 200_000).astype(int) + 1)
    plan = two_fit.fill_all(np.bincount(lengths, minlength=1025), 1024)
    used = sum(t for _, t in plan)
    assert used <= 1.001 * -(-int(lengths.sum()) // 1024) + 1 and len(plan) < 6 * 1024
    assert all(sum(f) <= 1024 for f, _ in plan)


def covers(pieces, ids):
    """Each id in one piece, only the first piece short, sequences gapless."""
    seen, sequences, numbers = Counter(), {}, Counter()
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.piece)):
        own = ids[p.doc_id][p.start : p.start + p.length]
        assert p.piece == numbers[p.doc_id] and p.start == seen[p.doc_id] and len(own) == p.length > 0
        assert np.frombuffer(p.ids, "<u4").tolist() == own
        assert p.piece == 0 or p.length == 1024
        numbers[p.doc_id] += 1
        seen[p.doc_id] += p.length
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert seen == {i: len(x) for i, x in ids.items()}
    assert all(numbers[i] == -(-len(x) // 1024) for i, x in ids.items())
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(sequences)


def test_every_id_once(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = [(-1, None), (-2, ""), (-3, "lorem ipsum dolor " * 4000), (-4, "é <|endoftext|> ñ\x00z"), (-5, " \n")]
    df = df.union(spark.createDataFrame(odd, "doc_id long, text string")).repartition(3)
    ids = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2] for r in df.collect()}
    used = covers(packed(df).collect(), ids)
    total = sum(map(len, ids.values()))
    assert used <= 1.01 * total / 1024 + 1


def test_odd_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "no id"), (None, None), (2, "x" * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.withColumns({c: F.lit(f"clash {c}") for c in ("length", "uid", "sequence_id", "offset", "ids", "part")})
    got = packed(df)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    got = got.collect()
    assert Counter(p.doc_id for p in got if p.piece == 0) == {1: 2, None: 2, 2: 1}
    assert len({(p.sequence_id, p.offset) for p in got}) == len(got)
    assert packed(df.limit(0)).count() == 0


def test_query_gives_the_digests(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {(p.doc_id, p.piece): (p.length, zlib.crc32(p.ids)) for p in packed(docs).collect()}
    rows = queries.QUERIES["op11_two_fit_packing"](spark, "/root/testdata/sf0.001").collect()
    assert {(p.doc_id, p.piece): (p.length, p.ids_crc32) for p in rows} == want
