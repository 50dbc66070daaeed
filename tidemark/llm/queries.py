"""One query for each operator over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers
from pyspark.sql import functions as F

from tidemark.llm import centroids, contamination, jaccard, packing, permutation_index, prefix_trie
from tidemark.llm import sharding, token_counts, toxicity, two_fit, url_filter
from tidemark.llm.substring_automaton import remove_repeated_spans
from tidemark.llm.substring_intervals import remove_repeated_bytes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OP1_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE [array_to_string(ws[i:i + 2], ' ') for i in range(1, len(ws) - 1)] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
r AS (SELECT doc_id, g, n, row_number() OVER (PARTITION BY doc_id ORDER BY c, g) AS k
      FROM s JOIN (SELECT g, count(*) AS c FROM s GROUP BY g) USING (g) JOIN n USING (doc_id)),
p AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b
      FROM (SELECT * FROM r WHERE 10 * k <= n + 10) AS x JOIN (SELECT * FROM r WHERE 10 * k <= n + 10) AS y USING (g)
      WHERE x.doc_id < y.doc_id AND 10 * x.n >= 9 * y.n AND 10 * y.n >= 9 * x.n),
i AS (SELECT a, b, count(*) AS c FROM p JOIN s AS x ON x.doc_id = a JOIN s AS y ON y.doc_id = b AND y.g = x.g GROUP BY a, b),
e AS (SELECT a, b FROM i JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
sym AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
walk AS (SELECT doc_id AS a, doc_id AS c FROM d UNION SELECT sym.b, walk.c FROM walk JOIN sym ON sym.a = walk.a WHERE walk.c < sym.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(c) AS c FROM walk GROUP BY a) AS m ON m.a = d.doc_id
"""


@query("op1_parity_sketch_join", _OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of three-word shingles have a Jaccard similarity of 0.9."""
    rule = jaccard.Rule(k=3, share=90, over=100)
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), rule).drop("links")


_OP2_SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
t AS (SELECT doc_id, h, unnest(range(1, length(h) // 2 + 1)) AS p FROM h),
s AS (SELECT doc_id, p, substr(h, 2 * p - 1, 2) AS b, substr(h, 2 * p - 1, 100) AS s FROM t),
f AS (SELECT doc_id, p, b,
             CASE WHEN length(s) = 100 AND min(doc_id) OVER (PARTITION BY s) < doc_id THEN 1 ELSE 0 END AS r
      FROM s),
c AS (SELECT doc_id, p, b, max(r) OVER (PARTITION BY doc_id ORDER BY p
                                        ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS cut FROM f),
e AS (SELECT *, cut - coalesce(lag(cut) OVER (PARTITION BY doc_id ORDER BY p), 0) AS step FROM c),
g AS (SELECT doc_id, sum(cut) AS n_removed, count(*) FILTER (step = 1) AS n_spans,
             string_agg(b, '' ORDER BY p) FILTER (cut = 0) AS kept
      FROM e GROUP BY doc_id)
SELECT h.doc_id, (length(h.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM h LEFT JOIN g USING (doc_id)
"""


@query("op2_substring_intervals", _OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte strings of 50 that a document with a smaller id has too."""
    return remove_repeated_bytes(table(spark, sf_dir, "documents"), 50, keep_text=False).drop("kept")


_OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d),
s AS (SELECT doc_id, p, w,
             string_agg(w, ' ') OVER n AS s, count(*) OVER n AS c FROM t
      WINDOW n AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
f AS (SELECT doc_id, p, w,
             CASE WHEN c = 20 AND row_number() OVER (PARTITION BY s, c ORDER BY doc_id, p) > 1
                  THEN 1 ELSE 0 END AS r FROM s),
e AS (SELECT doc_id, p, w, max(r) OVER (PARTITION BY doc_id ORDER BY p
                                        ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS cut FROM f),
g AS (SELECT doc_id, sum(cut) AS n_removed, string_agg(w, ' ' ORDER BY p) FILTER (cut = 0) AS kept
      FROM e GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""


@query("op8_substring_automata", _OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 20 words that start earlier somewhere."""
    return remove_repeated_spans(table(spark, sf_dir, "documents"), 20, keep_text=False).drop("new_text")


#: Where the public vocabularies lie; the operators take them as a parameter.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
BYTE_BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
END_OF_TEXT = 50256


def pack(docs: DataFrame) -> DataFrame:
    """Sequences of at most 2048 ids of the byte-level vocabulary."""
    ranks = packing.load_ranks(BYTE_BPE_RANKS)
    return packing.pack(docs, ranks, public_tokenizers.PATTERN, END_OF_TEXT)


@query("op3_retrieval_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids, beside lexical neighbours."""
    return pack(table(spark, sf_dir, "documents"))


@query("op4_edit_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in documents, with at most a fifth of their words edited."""
    return contamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_permutation_index")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth."""
    return permutation_index.search(table(spark, sf_dir, "embeddings"))


#: Labels of hosts whose pages make the list of blocked URLs.
LISTED_SITES = ("ads-track", "adult-x", "casino-win", "free-bets", "spam-farm")
_CANONICAL = r"""nullif(regexp_replace({host}, '^(www|m)\.', ''), '')
    || regexp_replace(regexp_replace({path}, '/+$', ''), '\.html$', '')"""
_OP6_SQL = r"""
WITH parts AS (SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
c AS (SELECT *, CANONICAL AS canonical FROM parts),
listed AS (SELECT DISTINCT canonical FROM c
           WHERE list_has_any(string_split(host, '.'), ['ads-track', 'adult-x', 'casino-win', 'free-bets', 'spam-farm'])),
ruled AS (SELECT *, CASE
    WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM c)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN canonical IN (SELECT canonical FROM listed WHERE canonical IS NOT NULL) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
""".replace("CANONICAL", _CANONICAL.format(host="host", path="path"))


@query("op6_url_bloom", _OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allow or block every page by rules, then by the list of URLs on listed sites."""
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.listed_sites(pages, LISTED_SITES))


@query("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram tokens of every document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), token_counts.read_vocabulary(PIECES))


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from labelled rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


@query("op10_hash_tree")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 16 shards, and where it would be with 17."""
    return sharding.assign(table(spark, sf_dir, "documents"), sharding.uniform_tree(16))


@query("op11_two_fit_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 ids, only longer ones cut."""
    docs = table(spark, sf_dir, "documents")
    pieces = two_fit.cut_documents(docs, packing.load_ranks(BYTE_BPE_RANKS), public_tokenizers.PATTERN, END_OF_TEXT)
    return two_fit.place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def _op12_sql(k: int = 8, rounds: int = 10) -> str:
    """Every round as two tables: vectors with their centroid, and the centroids moved."""
    steps = [
        r"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id,
        list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS p FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY key, p) - 1 AS c, p
    FROM (SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS key, p FROM v WHERE vec_id IS NOT NULL)
    QUALIFY row_number() OVER (ORDER BY key, p) <= {k})""",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, vec_id, v.p, c, list_sum(list_transform(list_zip(v.p, q.p),
        lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS distance FROM v CROSS JOIN c{i} AS q
    QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, c) = 1)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT q.c, coalesce(m.p, q.p) AS p FROM c{i} AS q LEFT JOIN (
        SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY d) AS p FROM (
            SELECT c, d, sum(x) AS s, count(*) AS n FROM (
                SELECT c, unnest(p) AS x, unnest(range(64)) AS d FROM a{i}) GROUP BY c, d) GROUP BY c) AS m USING (c))""")
    return ",\n".join(steps) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
       CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(q.p, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} AS q USING (c)"""


@query("op12_threshold_centroids", _op12_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of 64 components around eight centroids after ten rounds."""
    found = centroids.cluster(table(spark, sf_dir, "embeddings"))
    sums = found.assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()
    total = sum(r["inertia"] for r in sums)
    prints = found.fingerprints()
    rows = [(r["cluster"], r["inertia"], total, prints[r["cluster"]]) for r in sums]
    by = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.assigned.join(F.broadcast(by), "cluster")  # A row for each centroid.


_OP13_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL),
g AS (SELECT conv_id, turn, sha256(length(role) || ':' || role || ':' || text) AS g,
             len(regexp_extract_all(text, '[^ 	-]+')) AS w FROM t),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) - 1 AS pos FROM g),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(
          list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT)),
          lambda a, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: CASE
              WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(a, b)), 4294967295::BIGINT), 4294967295) % 4 AS h FROM o),
r AS (SELECT c.conv_id, o.pos, o.g, o.w FROM c JOIN o ON o.conv_id = c.base WHERE o.pos < c.h
      UNION ALL SELECT o.conv_id, o.pos, o.g, o.w FROM c JOIN o USING (conv_id) WHERE o.pos >= c.h),
s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS d, g, w FROM r),
p AS (SELECT conv_id, d, w, string_agg(g, '') OVER (PARTITION BY conv_id ORDER BY d) AS key FROM s
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (SELECT d, key, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w FROM p GROUP BY d, key),
e AS (SELECT d, key, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends
      FROM (SELECT * FROM p QUALIFY d = max(d) OVER (PARTITION BY conv_id)) GROUP BY d, key),
k AS (SELECT d - 1 AS d, substr(key, 1, 64 * (d - 1)) AS key, count(*) AS n FROM n WHERE d > 0 GROUP BY 1, 2),
u AS (SELECT n.d AS own, n.key AS k0, n_convs, w, k.n IS NULL AS leaf, unnest(range(0, n.d + 1)) AS d FROM n LEFT JOIN k USING (d, key)),
z AS (SELECT d, substr(k0, 1, 64 * d) AS key, sum((n_convs - 1) * w) AS saved, count(*) FILTER (leaf) AS leaves FROM u GROUP BY 1, 2)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n_convs,
       coalesce(k.n, 0) AS n_children, z.leaves AS n_leaves, CAST(z.saved AS BIGINT) AS saved_tokens,
       coalesce(e.ends, sha256('')) AS ends_sha256
FROM n JOIN z USING (d, key) LEFT JOIN k USING (d, key) LEFT JOIN e USING (d, key)
LEFT JOIN n AS up ON n.d > 0 AND up.d = n.d - 1 AND up.key = substr(n.key, 1, 64 * (n.d - 1))
"""


@query("op13_prefix_trie", _OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefixes that conversations share, after every 20th lends up to three turns to its family."""
    turns = prefix_trie.ordered_turns(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(*prefix_trie.share_openings(turns, family=20, most=4))
