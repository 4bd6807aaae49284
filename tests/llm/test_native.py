"""Source mixing and quotation linking."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quirework.llm import mixing, quotes, sql

DOCS = "doc_id long, text string, source string, size string"


def water_fill(weights, caps, budget):
    """Rounds of sharing and clamping."""
    targets, open_ = dict.fromkeys(weights, 0.0), set(weights)
    while open_:
        left = budget - sum(caps[s] for s in weights if s not in open_)
        total = sum(weights[s] for s in open_)
        share = {s: left * weights[s] / total for s in open_}
        over = {s for s in open_ if share[s] > caps[s]}
        if not over:
            return {s: share.get(s, caps[s]) for s in weights}
        open_ -= over
    return caps


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(i, "w " * (1 + i * 7 % 40), f"s{i % 4}", "x") for i in range(4000)]
    rows += [(i, "a b\tc\n", "big", "x") for i in range(5000, 9000)] + [(9001, None, None, None), (9002, " ", "s0", "x"), (9003, "u " * 100_000, "s1", "x"), (7, "w " * 8, "s3", "x"), (7, "w " * 8, "s3", "x"), (None, "n o", None, "x")]
    docs = spark.createDataFrame(rows, DOCS)
    return rows, mixing.mix(docs).collect(), docs


def test_targets_are_those_of_rounds(mixed):
    rows, out, _ = mixed
    sizes = {}
    for _, text, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    want = water_fill(weights, {s: 2 * n for s, n in sizes.items()}, 1.5 * sum(sizes.values()))
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])


def test_taken_meets_targets(mixed):
    rows, out, docs = mixed
    assert len(out) == len(rows)
    for source in {r["source"] for r in out}:
        own = [r for r in out if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own) / 2 + 1
        assert all(r["taken"] == r["size"] * r["copies"] <= 2 * r["size"] for r in own)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))


def test_mixing_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    (r,) = mixing.mix(spark.createDataFrame([(1, None, None, None)], DOCS)).collect()
    assert (r["size"], r["target"], r["taken"]) == (0, 0, 0)


MESSAGES = "conv_id long, turn long, role string, text string, depth string"


def test_quotes_are_linked_and_removed(spark):
    rows = [
        (1, 0, "a", "Hello  there\nSecond line", None),
        (1, 1, "b", "On Monday a wrote:\n> hello there\n> second LINE\nMy answer", "x"),
        (1, 2, "c", "> > Hello there\n> > second line\n> my answer\nI disagree", "x"),
        (1, 3, "d", "> Second line\n> made up\nOnly one line quoted", "x"),
        (1, 4, "e", ">nowhere said\nLost", "x"),
        (2, 0, "a", "My answer", "x"),
        (2, 1, "b", "> hello there\nother conversation", "x"),
        (3, 0, "a", None, None),
        (None, 5, "a", "> My answer\nno conversation", "x"),
    ]
    out = quotes.conversations(spark.createDataFrame(rows, MESSAGES)).collect()
    by = {(r["conv_id"], r["turn"]): r for r in out}
    assert {k: (r["parent_turn"], r["root_turn"], r["depth"], r["n_quotes"], r["n_linked"]) for k, r in by.items()} == {
        (1, 0): (None, 0, 0, 0, 0), (1, 1): (0, 0, 1, 1, 1), (1, 2): (1, 0, 2, 2, 2), (1, 3): (0, 0, 1, 1, 1), (1, 4): (None, 4, 0, 1, 0),
        (2, 0): (None, 0, 0, 0, 0), (2, 1): (None, 1, 0, 1, 0), (3, 0): (None, 0, 0, 0, 0), (None, 5): (None, 5, 0, 1, 0),
    }
    assert [by[1, t]["text"] for t in range(5)] == ["Hello  there\nSecond line", "My answer", "I disagree", "Only one line quoted", "Lost"]
    assert [r["turn"] for r in out if r["conv_id"] == 1] == [0, 1, 3, 2, 4]


def test_random_conversations_equal_sql(spark, tmp_path):
    rng = random.Random(7)
    rows = []
    for conv in range(40):
        said = []
        for turn in range(rng.randint(1, 9)):
            lines = []
            for _ in range(rng.randint(0, 4)):
                if said and rng.random() < 0.6:
                    part = rng.choice(said).split("\n")
                    marks = rng.choice([">", "> ", ">> ", "> > ", " >\t"])
                    lines += [rng.choice(["a wrote:", "Am Montag schrieb b :"])] * (rng.random() < 0.3) + [marks + x.upper() for x in part[: rng.randint(1, len(part))]]
                else:
                    lines.append(" ".join(rng.choice(["yes", "no", "Maybe", "é"]) for _ in range(rng.randint(0, 3))))
            text = rng.choice(["\n", "\r\n"]).join(lines)
            said.append(text)
            rows.append((conv % 30 if rng.random() < 0.97 else None, turn, rng.choice("ab"), text if rng.random() < 0.95 else None))
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    found = con.sql(sql.OP3_QUOTE_LINKING)
    got = quotes.conversations(spark.read.parquet(path)).select(*found.columns).collect()
    want = found.fetchall()
    a, b = sorted(map(str, map(tuple, got))), sorted(map(str, want))
    assert [x for x in zip(a, b) if x[0] != x[1]][:3] == [] and len(a) == len(b)
    assert sum(r["n_linked"] for r in got) > 50 and max(r["depth"] for r in got) > 1


def test_a_long_chain_and_a_hot_conversation(spark):
    rows = [(1, t, "a", f"> line {t - 1}\nline {t}" if t else "line 0", "x") for t in range(70)]
    rows += [(2, t, "a", "same first turn" if t % 2 else "> same first turn\nyes", "x") for t in range(1, 2001)]
    out = quotes.conversations(spark.createDataFrame(rows, MESSAGES))
    deep = {r["turn"]: (r["root_turn"], r["depth"]) for r in out.filter("conv_id = 1").collect()}
    assert deep == {t: (0, t) for t in range(70)}
    assert out.filter("conv_id = 2 AND parent_turn = 1").count() == 1000


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, 0, "a", "x y", "q")] * 3 + [(1, 1, "b", "> x y\nz", "q")] * 2
    out = quotes.conversations(spark.createDataFrame(rows, MESSAGES))
    assert out.count() == 5 and out.filter("parent_turn = 0").count() == 2
    assert quotes.conversations(spark.createDataFrame([], MESSAGES)).count() == 0
    assert quotes.parse(spark.createDataFrame([(1, 0, "a", ">" * 50_000 + "\n" + "w " * 200_000, None)], MESSAGES)).select(F.size("passages")).first()[0] == 2


def test_empty_originals_dont_match(spark):
    rows = [(1, 0, "a", "", None), (1, 1, "b", ">\n>  \n", None)]
    assert [r["n_quotes"] for r in quotes.conversations(spark.createDataFrame(rows, MESSAGES)).collect()] == [0, 0]
