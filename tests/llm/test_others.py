"""Packing, decontamination, search, URL rules, token counts, toxicity, sharding: odd rows and brute force."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from tidemark.llm import contamination, packing, permutation_index, queries, sharding, token_counts, toxicity, url_filter

LONG = "lorem ipsum dolor " * 4000
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (4, "one two"), (None, "no id"), (5, LONG), (6, "é <|endoftext|> ñ\x00z")]


@pytest.fixture
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.withColumns({"ids": F.lit("clash"), "score": F.lit(1), "size": F.lit(2), "lang": F.lit(None).cast("string")})


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def test_packing_covers_every_id_once(spark, odd, empty):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for df in (odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "text"), given):
        ids = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1] for r in df.collect()}
        pieces = queries.pack(df).collect()
        seen, sequences = {i: 0 for i in ids}, {}
        for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
            own = ids[p.doc_id][p.start : p.start + p.length]
            assert p.start == seen[p.doc_id] and len(own) == p.length > 0 and p.doc_tokens == len(ids[p.doc_id])
            assert p.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
            seen[p.doc_id] += p.length
            sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        assert seen == {i: len(x) for i, x in ids.items()}
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048 and at & (at - 1) == 0
    assert queries.pack(odd).agg(F.sum("length")).first()[0] > 0
    assert queries.pack(empty).count() == 0


def test_leaks_with_edits(spark, odd, empty):
    item = [f"word{i}" for i in range(30)]
    edits = {0: item, 3: ["Word0!", *item[1:5], *item[7:20], "x", *item[20:]], 6: [*item[:3], "a", "b", "c", "d", "e", "f", *item[9:]]}
    far = [*item[:3], *[f"q{i}" for i in range(7)], *item[10:]]
    pad = [f"z{i}" for i in range(50)]
    rows = [(n, " ".join([*pad[:n], *w, *pad[n:]])) for n, w in edits.items()] + [(50, " ".join([*pad, *far])), (51, " ".join(item[:20]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(item).upper()), (10, None), (11, "..."), (None, " ".join(item))], "item_id long, text string")
    got = sorted((r.doc_id, r.edits) for r in contamination.find_leaks(docs, bench).collect() if r.item_id == 9)
    assert [d for d, _ in got] == [0, 3, 6] and [e for _, e in got] == [0, 3, 6]
    assert sorted(r.doc_id for r in contamination.remove_leaks(docs, bench).collect()) == [50, 51]
    assert contamination.find_leaks(odd, bench).count() == 0 and contamination.find_leaks(empty, bench).count() == 0
    assert contamination.remove_leaks(odd, bench).columns == odd.columns
    assert contamination.find_leaks(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize(("length", "count"), [(40, 20), (59, 20), (150, 20), (300, 6), (600, 1)])
def test_leaks_of_all_lengths_at_the_limit(length, count):
    """Deletions, insertions and both, as many as are allowed; exact distances say that all are leaks."""
    rng, limit = np.random.default_rng(length), contamination.edit_limit(length)
    missed = {}
    for kind in ("deletions", "insertions", "both"):
        missed[kind] = 0
        for _ in range(count):
            item = [f"w{x}" for x in rng.integers(0, 5000, length)]
            cut = {"deletions": limit, "insertions": 0, "both": limit // 2}[kind]
            gone = set(rng.choice(length, cut, replace=False).tolist())
            text = [w for i, w in enumerate(item) if i not in gone]
            for _ in range(limit - cut):
                text.insert(rng.integers(1, len(text)), f"x{rng.integers(5000)}")
            pad = [f"z{x}" for x in rng.integers(0, 5000, 60)]
            data = " ".join([*pad, *text, *pad]).encode()
            hashes, bounds = contamination.words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
            found = contamination.find_items(hashes, bounds, contamination.Items.read([1], [" ".join(item)]), contamination.Embedding())
            missed[kind] += not (found and found[0][2] <= limit)
    assert not any(missed.values()), missed


def test_search_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(600, 16))
    m[100:300] = m[0]
    rows = [(i, v.tolist()) for i, v in enumerate(m)]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0, None] * 8), (1004, [1.0]), (None, [1.0] * 16), (50, m[50].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"v": F.lit(1), "shard": F.lit("x")})
    got = permutation_index.search(df).collect()
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    right = 0
    for q in range(0, 600, 50):
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        score = unit @ unit[q]
        score[q] = -9
        best = np.lexsort((np.arange(600), -np.round(score, 12)))[:5]
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5]
        right += sum(score[v] >= score[best[-1]] - 1e-9 for _, v, _ in own)
        assert all(abs(score[v] - s) < 1e-12 for _, v, s in own)
    assert right >= 0.9 * 60 and {r.query_id for r in got} == set(range(0, 600, 50))
    assert permutation_index.search(df.limit(0)).count() == 0


def test_search_recall_where_few_are_ranked_again(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(20_000, 48))
    m[5000:10_000] = m[4000] + rng.normal(size=(5000, 48)) / 4
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    table = pa.table({"vec_id": np.arange(len(m)), "embedding": m.tolist()})
    got = permutation_index.search(spark.createDataFrame(table)).collect()
    assert permutation_index.RERANKED * math.sqrt(len(m)) < len(m) / 10
    found = {(r.query_id, r.vec_id): r.score for r in got}
    right = 0
    for q in range(0, len(m), 50):
        score = unit @ unit[q]
        score[q] = -9
        best = np.argsort(-score, kind="stable")[:5]
        right += sum((q, int(v)) in found and abs(found[q, int(v)] - score[v]) < 1e-12 for v in best)
    assert len(got) == 5 * 400 and right >= 0.95 * len(got)


def test_search_within_each_length(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=(8, 3, 5)[i % 3]).tolist()) for i in range(300)] + [(350, [2.0] * 7)]
    got = permutation_index.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    vectors = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    for q in range(0, 300, 50):
        score = {i: float(v @ vectors[q]) for i, v in vectors.items() if len(v) == len(vectors[q]) and i != q}
        best = sorted(score, key=lambda i: (-score[i], i))[:5]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == best
    assert not [r for r in got if r.query_id == 350]


def test_url_rules_and_list(spark):
    rows = [
        (1, "http://Example.ORG/en/1?x"), (2, "https://a.example.org/es/"), (3, "x://b.org"), (4, "s://shop.com/fr/q#t"),
        (5, "s://shop.com/de/q"), (6, "s://www.bad.net/en/7.html#top"), (7, "s://bad.net/en/7/"), (8, None), (9, "no scheme"), (10, "s://notexample.org/en/1"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"block": F.lit(1), "hit": F.lit("x")})
    listed = spark.createDataFrame([("bad.net/en/7",), (None,)], "listed string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, listed).collect()}
    assert got[1] == ("example.org", "/en/1", "example.org/en/1", "block") and got[2][2:] == ("example.org/es/", "block")
    assert got[3] == ("b.org", "", None, "allow") and got[4][2:] == ("com/fr/", "allow") and got[5][2:] == ("com/de/", "block")
    assert got[6][2:] == (None, "block") and got[7][2:] == (None, "block")
    assert got[8] == got[9] == ("", "", None, "allow") and got[10][2:] == ("org/", "allow")
    assert {r.verdict for r in url_filter.judge(pages.where("page_id > 5"), listed.limit(0)).collect()} == {"allow"}


def test_token_counts_equal_the_tokenizer(spark, odd, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
    exact = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    vocabulary = token_counts.read_vocabulary(path)
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in given.collect()} | {10**6: "日本 🙂🙂  x\n", 10**6 + 1: "  a  "}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in token_counts.count_tokens(df, vocabulary).collect():
        want = exact.encode("▁" + texts[r.doc_id].replace(" ", "▁"), add_special_tokens=False).ids
        assert r.n_tokens == len(want)
    assert token_counts.count_tokens(odd, vocabulary).count() == len(ODD)
    assert token_counts.count_tokens(empty, vocabulary).count() == 0


def test_toxicity_on_held_out_rows(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    fitted = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, fitted).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows)
    assert right >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    got = toxicity.score(odd, fitted).collect()
    assert len(got) == len(ODD) and all(r.predicted == 0 for r in got)
    assert toxicity.reject_toxic(odd, fitted).columns == odd.columns and toxicity.score(empty, fitted).count() == 0
    assert toxicity.score(odd, toxicity.fit(empty, labels.limit(0))).count() == len(ODD)


def test_thresholds_count_every_labelled_row(spark):
    """Also of languages that are rare in the sample, and texts too long for it; against plain Python."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(1500):
        lang = ("en", "en", "en", "es", "de", None)[i % 6] if i % 10 else "xx"
        toxic = int(rng.random() < (0.4 if lang != "xx" else 0.02))
        words = [f"w{x}" for x in rng.integers(0, 300, 30)]
        if rng.random() < (0.8 if toxic else 0.15):
            words[rng.integers(30)] = f"bad{rng.integers(4)}"
        rows.append((i, " ".join(words * (200 if lang == "de" else 1)), lang, toxic))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    fitted = toxicity.fit(df.select("doc_id", "text", "lang"), df.select("doc_id", "toxic"), sample_rows=200)
    score = {r.doc_id: r.score for r in toxicity.score(df, fitted).where("NOT held_out").collect()}
    assert len(fitted.learnt) == 160 and not set(fitted.learnt.tolist()) - set(score)
    want = {}
    for lang in ("en", "es", "de", "", "xx"):
        own = [(score[i], toxic) for i, _, x, toxic in rows if (x or "") == lang and i in score and i not in fitted.learnt]
        if sum(t for _, t in own) < 20:
            continue

        def f1(at):
            return 2 * sum(t for s, t in own if s >= at) / (sum(s >= at for s, _ in own) + sum(t for _, t in own))

        tried = sorted({0.7, *(x / 100 for x in range(5, 100, 5))})
        best = max(map(f1, tried))
        want[lang] = min((x for x in tried if f1(x) >= best - 1e-12), key=lambda x: abs(x - 0.7))
    assert sorted(want) == ["", "de", "en", "es"]
    assert fitted.thresholds == pytest.approx(want)
    kept = {r.doc_id for r in toxicity.reject_toxic(df, fitted).collect()}
    assert {i for i, s in score.items() if s < want.get(rows[i][2] or "", 0.7)} == kept & set(score)


def test_hash_tree(spark, odd, empty):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("ab é").alias("text")).union(odd.select("doc_id", "text"))
    rows = sharding.assign(df, sharding.uniform_tree(16)).collect()
    assert len(rows) == 4000 + len(ODD) and {r.law for r in rows} == {"key"}
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert sorted(by) == list(range(16)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert 150 < sum(r.grown_shard == 16 for r in rows) < 330
    first = next(r for r in rows if r.doc_id == 100)
    assert (first.size, first.text_crc32) == (6, zlib.crc32("ab é".encode()))
    assert next(r for r in rows if r.size == 1).text_crc32 == 0
    assert sharding.assign(empty, sharding.uniform_tree(16)).count() == 0


def plain_scores(documents, seed):
    """BM25 of all documents for all different ids of one, over the whole list."""
    sets = [Counter(d.tolist()) for d in documents]
    mean = sum(map(len, documents)) / len(documents)
    held = Counter(i for s in sets for i in s)
    out = []
    for s, d in zip(sets, documents, strict=True):
        total = 0.0
        for i in sets[seed]:
            if i in s:
                rarity = math.log(1 + (len(documents) - held[i] + 0.5) / (held[i] + 0.5))
                total += rarity * s[i] * 2.2 / (s[i] + 1.2 * (0.25 + 0.75 * len(d) / mean))
        out.append(total)
    return out


def corpus_of(documents, size):
    held = np.zeros(size, np.int64)
    for d in documents:
        held[np.unique(d)] += 1
    return packing.Corpus(held, len(documents), sum(map(len, documents)) / len(documents))


def test_windows_take_the_nearest_of_plain_bm25(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    tokenizer = packing.encoder(packing.load_ranks(queries.BYTE_BPE_RANKS), public_tokenizers.PATTERN, queries.END_OF_TEXT)
    documents = [packing.encode(tokenizer, r.text or "") for r in docs]
    corpus = corpus_of(documents, queries.END_OF_TEXT + 1)
    scores = {s: plain_scores(documents, s) for s in range(len(documents))}
    index = packing.Index(documents, corpus)
    for seed in range(0, len(documents), 10):
        others = np.arange(len(documents)) != seed
        assert np.allclose(index.scores(seed)[others], np.array(scores[seed])[others], rtol=1e-4, atol=1e-3)
        order = list(index.ranked(seed, others))
        assert sorted(order) == [i for i, x in enumerate(scores[seed]) if x > 0 and i != seed]
        assert all(scores[seed][a] >= scores[seed][b] - 1e-2 for a, b in zip(order, order[1:]))
    # Each document that follows in a window is the nearest one left to the window's seed.
    pieces = [p for p in packing.pack_shard(documents, corpus) if p[1] == 0]
    full = max(sequence for _, _, _, sequence, _ in pieces) - 12
    placed, seed, window, taken = set(), None, None, 0
    for doc, _, _, sequence, offset in pieces:
        if sequence >= full:
            break
        if seed is not None and offset:
            if sequence != window:
                seed, window = last, sequence
            left = [x for i, x in enumerate(scores[seed]) if i not in placed]
            assert scores[seed][doc] >= max(left) - 1e-2
            taken += 1
        else:
            seed, window = doc, sequence
        placed.add(doc)
        last = doc
    assert taken > 20


def test_like_documents_meet_in_packing(spark):
    # Forty families, mixed up; a third of all rows repeat one text.
    rng = np.random.default_rng(1)
    bases = [rng.choice(["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(4000)], 120) for _ in range(40)]
    rows = []
    for i in range(1200):
        words = bases[0].copy() if i % 3 == 0 else bases[rng.integers(40)].copy()
        if i % 3:
            words[rng.integers(120)] = f"w{i}"
        rows.append((i, " ".join(words)))
    got = packing.tokenize(
        spark.createDataFrame(rows, "doc_id long, text string"), packing.load_ranks(queries.BYTE_BPE_RANKS),
        public_tokenizers.PATTERN, queries.END_OF_TEXT,
    ).collect()
    drawn = {r.doc_id: bytes(r.drawn) for r in got}
    family = {i: t.split()[:3] for i, t in rows}
    pairs = [(a, b) for a in range(1200) for b in (a + 1, a + 2, a + 3) if b < 1200 and family[a] == family[b]]
    assert len({drawn[i] for i in range(0, 1200, 3)}) == 1
    assert sum(drawn[a][:4] == drawn[b][:4] for a, b in pairs) >= 0.9 * len(pairs)
