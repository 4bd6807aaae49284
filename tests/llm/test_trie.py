"""The conversation prefix trie against brute force and its SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from quirework.llm import prefix_trie, sql

TURNS = "conv_id long, turn long, role string, text string, rep string, depth string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            digest = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()
            own.setdefault(c, []).append(((turn is not None, turn or 0, digest), (role or "", text or "")))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def brute(convs):
    """Nodes of a walked trie: members by prefix, sums by recursion over children."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for key in members:
        if key:
            children.setdefault(key[:-1], []).append(key)
    below = {}
    for key in sorted(members, key=len, reverse=True):
        last = len(key[-1][1].encode()) if key else 0
        kids = [below[k] for k in children.get(key, ())]
        below[key] = ((len(members[key]) - 1) * last + sum(k[0] for k in kids), sum(k[1] for k in kids) or 1)
    out = []
    for key, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(key))
        parent = min(members[key[:-1]]) if key else None
        out.append((min(own), len(key), parent, len(own), len(children.get(key, ())), below[key][1], below[key][0], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def built(df):
    conv = F.col("conv")
    return prefix_trie.build_with_openings(df, conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9, 8)


@pytest.fixture(scope="module")
def turns(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(60), rng.choice([None, *range(12)]), rng.choice(["user", "bot", None]), rng.choice(["a", "b", "é" * 40, "", None]), "x", "y") for _ in range(500)]
    rows += [(c, t, "user", "same", "x", "y") for c in range(100, 160) for t in range(c % 13)]
    rows += [(1003, 4, "bot", "w" * 300_000, "x", "y"), (1003, 4, "bot", "w" * 300_000, "x", "y"), (None, 1, "bot", "lost", "x", "y"), (-7, None, None, None, "x", "y")]
    return rows, spark.createDataFrame(rows, TURNS).repartition(5)


def test_rebuilt_conversations_equal_brute_force_and_sql(turns):
    rows, df = turns
    got = rows_of(built(df))
    assert got == brute(rebuilt(rows))
    con = duckdb.connect()
    con.register("conversations", df.toArrow())
    assert got == sorted(tuple(r) for r in con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({sql.OP11_PREFIX_TRIE})").fetchall())


def test_plain_trie_and_one_long_conversation(spark, monkeypatch):
    """Segments of eight turns, so that one conversation has many; it holds most rows."""
    monkeypatch.setattr(prefix_trie, "SEGMENT", 8)
    rng = random.Random(6)
    base = [rng.choice("abc") for _ in range(137)]
    convs = {c: base[: rng.randrange(138)] + [rng.choice("xy")] * rng.randrange(3) for c in range(2, 30)} | {1: base, 40: base, 41: []}
    rows = [(c, i, "user", t, "x", "y") for c, v in convs.items() for i, t in enumerate(v)]
    got = rows_of(prefix_trie.build(spark.createDataFrame(rows, TURNS).repartition(4)))
    assert got == brute({c: [("user", t) for t in v] for c, v in convs.items() if v})


def test_nothing(spark):
    empty = spark.createDataFrame([], TURNS)
    assert rows_of(prefix_trie.build(empty)) == [] and tuple(prefix_trie.build(empty).columns) == COLUMNS
    assert rows_of(prefix_trie.build(spark.createDataFrame([(None, 1, "a", "b", "", "")], TURNS))) == []


def test_pieces_of_a_node_are_hashed_in_order(spark):
    """More members than a batch holds end at one node."""
    n = 25_000
    members = spark.range(n).select(F.lit(0).cast("long").alias("rep"), F.lit(1).cast("long").alias("depth"), ((F.col("id") * 7919) % n).alias("conv"))
    (row,) = prefix_trie._ends(members.repartition(6)).collect()
    assert row["ends_sha256"] == hashlib.sha256(",".join(map(str, range(n))).encode()).hexdigest()
