"""The trie of shared turn prefixes against a plain one in Python."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes(df):
    turns = prefix_trie.ordered_turns(df)
    got = prefix_trie.trie(*prefix_trie.share_openings(turns, family=20, most=4))
    assert got.columns == COLUMNS
    return sorted(map(tuple, got.collect()), key=repr)


def plain(rows):
    held = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).digest()
            held.setdefault(c, []).append(((turn is not None, turn or 0), digest, (role, text)))
    turns = {c: [t for *_, t in sorted(own)] for c, own in held.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - c % 20 if c >= 0 else c + (-c) % 20
        built[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members = {}
    for c, own in built.items():
        for d in range(len(own) + 1):
            members.setdefault(own[:d], []).append(c)
    out = []
    for key, own in members.items():
        below = [k for k in members if k[: len(key)] == key]
        saved = sum((len(members[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) for k in below if k)
        leaves = sum(not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in below) for k in below)
        ends = ",".join(str(c) for c in sorted(own) if len(built[c]) == len(key))
        up = min(members[key[:-1]]) if key else None
        children = sum(len(k) == len(key) + 1 for k in below)
        out.append((min(own), len(key), up, len(own), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def made(seed, n, longest=11, words=2):
    """Conversations that copy a beginning of an earlier one, then go their own way or stop."""
    rng = random.Random(seed)
    all_turns, rows = [], []
    for i in range(n):
        c = rng.choice([i, i, 5000 + i, -i - 1])
        own = list(rng.choice(all_turns))[: rng.randint(0, longest)] if all_turns and rng.random() < 0.7 else []
        own += [(rng.choice("ab"), " ".join(rng.choice("xyz") for _ in range(rng.randint(0, words)))) for _ in range(rng.randint(0, 5))]
        all_turns.append(own)
        rows += [(c, t, *turn) for t, turn in enumerate(own)]
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_equals_a_plain_trie(spark, seed, monkeypatch):
    if seed == 1:  # Runs of few turns and ids, so that sums cross them.
        monkeypatch.setattr(prefix_trie, "RUN_BITS", 1)
        monkeypatch.setattr(prefix_trie, "ID_BITS", 2)
    rows = made(seed, 60)
    assert nodes(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_odd_rows(spark):
    rows = [
        (1, 0, "user", "hi there"), (1, 0, "user", "hi there"), (1, None, None, None), (1, 1, "", "a  b\x00c"),
        (2, None, None, None), (2, None, "user", None), (2, 5, None, "x"), (2, -3, None, "y " * 20000),
        (None, 0, "user", "lost"), (3, 0, "user", None), (45, 7, "z", "end"), (7, 0, "user", "é ñ"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    clashing = df.withColumns({c: F.lit("clash") for c in ("pos", "digest", "part", "words", "depth", "k1", "block", "base")})
    assert nodes(clashing) == plain(rows)
    assert nodes(df.limit(0)) == [] and nodes(df.where("conv_id IS NULL")) == []


def test_long_and_many(spark):
    """One conversation of 3000 turns, 300 copies of another, all turnless, one only."""
    long = [(0, t, "u", f"w{t} x") for t in range(3000)] + [(6, t, "u", f"w{t} x") for t in range(2995)]
    got = nodes(spark.createDataFrame(long, SCHEMA))
    assert len(got) == 3001 and got[0][:2] == (0, 0) and {g[3] for g in got} == {1, 2}
    copies = [(c, t, "u", f"t{t}") for c in range(0, 6000, 20) for t in range(6)]
    df = spark.createDataFrame(copies, SCHEMA)
    assert nodes(df) == plain(copies)
    bare = [(c, 0, "u", "a") for c in (1, 2, 3, 4, 5, 6, 7, 8, 9) if zlib.crc32(str(c).encode()) % 4]
    assert nodes(spark.createDataFrame(bare, SCHEMA)) == plain(bare)
    assert len(plain(bare)) == 1


def test_sql_equals_the_plain_trie():
    rows = made(9, 50)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(con.execute(queries.ORACLES["op13_prefix_trie"]).fetchall(), key=repr) == plain(rows)
