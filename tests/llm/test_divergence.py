"""The source divergence audit against brute force and its SQL."""

import random
import re
from collections import Counter

import duckdb
import pytest

from quirework.llm import divergence, sql

DOCS = "doc_id long, text string, lang string, source string, rank string, count string"
COLUMNS = ("lang", "source", "part", "item", "value", "rank")
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, top):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for _, text, lang, source, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for *_, terms in own for t in set(terms))
        kept = {t for t, n in seen.items() if n >= min_docs}
        counts = {s: Counter(t for _, s2, terms in own if s2 == s for t in terms if t in kept) for s in {d[1] for d in own}}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        whole, shares = share(sum(counts.values(), Counter())), {s: share(c) for s, c in counts.items()}
        for s, p in shares.items():
            pairs = [(sum(abs(p[t] - q[t]) for t in kept), s2) for s2, q in shares.items() if s2 != s]
            terms = [(p[t] - whole[t], t) for t in kept if counts[s][t] and p[t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = ["the", "The", "Éa", "éa", "ünd", "z", "x_y", "it's", "日本", "1st", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))]
    rows = []
    for i in range(900):
        lang, source = rng.choice(["en", "en", "fr", None]), rng.choice(["big", "big", "big", "s1", "s2", "s3", None, ""])
        pool = words[: rng.choice([12, 40, 70])]
        rows.append((i, rng.choice([" ", "\n", "-", "1"]).join(rng.choices(pool, k=rng.randrange(30))), lang, source, "r", "c"))
    rows += [(1, None, "en", "silent", "r", "c"), (2, "", "de", "alone", "r", "c"), (3, "a " * 30_000, "de", "b", "r", "c"), (3, "a", "de", "b", "r", "c"), (None, "q" * 50_000, "en", "s1", "r", "c")]
    return rows, spark.createDataFrame(rows, DOCS).repartition(4)


def test_equals_brute_force_and_sql(docs):
    rows, df = docs
    got = rows_of(divergence.audit(df))
    assert got == brute(rows, 30, 50) and {r[2] for r in got} == {"pair", "term"}
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    assert got == sorted(tuple(r) for r in con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({sql.OP12_SOURCE_DIVERGENCE})").fetchall())


def test_small_blocks_tiles_and_slices_change_nothing(docs, monkeypatch):
    """Several automata, two sources a tile, few postings a task."""
    for name, value in (("BLOCK", 600), ("TILE", 2), ("TASK", 40), ("SLICE", 2000)):
        monkeypatch.setattr(divergence, name, value)
    rows, df = docs
    assert rows_of(divergence.audit(df, min_docs=2, top=7)) == brute(rows, 2, 7)


def test_shares_of_large_counts_are_exact(spark):
    from pyspark.sql import functions as F

    n, total, terms = 10**15 + 7, 3 * 10**15 + 1, 10**7
    row = spark.range(1).select(divergence._share(F.lit(n), F.lit(total), F.lit(terms)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (n + 5) // (total + 5 * terms)


def test_nothing(spark):
    empty = divergence.audit(spark.createDataFrame([], DOCS))
    assert empty.count() == 0 and set(empty.columns) == set(COLUMNS)
    got = rows_of(divergence.audit(spark.createDataFrame([(1, "a", "en", "x", "", ""), (2, None, "en", "y", "", "")], DOCS)))
    assert got == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
