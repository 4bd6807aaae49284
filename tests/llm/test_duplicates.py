"""Substring deduplication, the n-gram join and decontamination, against brute force."""

import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from quirework.llm import components, decontamination, ngram_join, substring_dedup, tokens

DOCS = "doc_id long, text string, n string, bucket string, kept string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], DOCS)


def near_copies(rng, n, vocabulary=400):
    words = [f"w{i}" for i in range(vocabulary)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            own = list(rng.choice(out))
            for _ in range(rng.randint(0, 4)):
                if own:
                    own[rng.randrange(len(own))] = rng.choice(words)
            if rng.random() < 0.3:
                own = own[: rng.randint(1, len(own))] if own else own
        else:
            own = [rng.choice(words) for _ in range(rng.choice([1, 3, 5, 6, 9, 14, 30, 60, 90]))]
        out.append(own)
    return [" ".join(x) for x in out]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = near_copies(rng, 260)
    rows = [(i * 3 - 90, t) for i, t in enumerate(texts)]
    hot = " ".join(f"hot{i}" for i in range(60))
    rows += [(2000 + i, f"{hot} own{i}") for i in range(150)] + [(3000 + i, hot) for i in range(120)]
    rows += [(4000, None), (4001, ""), (4002, " \t\n"), (4003, "lang " * 5000 + "x" * 20000), (None, hot), (None, None), (4004, "A b\x0bC d e f"), (4005, "a B c D e F"), (4006, "a b c d e f")]
    return rows + [rows[5], rows[5], (rows[7][0], "another text under the same id with enough words to have a window of its own")]


def shingle_set(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_substring_dedup(spark, rows):
    firsts = {}
    cut = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in cut:
        for k in range(len(w) - 12):
            if i is not None:
                firsts[tuple(w[k : k + 13])] = min(i, firsts.get(tuple(w[k : k + 13]), i))
    want = []
    for i, w in cut:
        gone = {k + j for k in range(len(w) - 12) if i is not None and firsts[tuple(w[k : k + 13])] < i for j in range(13)}
        want.append((str(i), len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    out = substring_dedup.deduplicate(docs_of(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in out) == sorted(want)
    assert substring_dedup.deduplicate(docs_of(spark, [])).count() == 0


def test_fingerprinting_holds_a_small_block(monkeypatch):
    """Blocks of 8 MB took some 254 MB of numpy arrays each; an executor has several workers beside its heap."""
    rng = np.random.default_rng(1)
    words = np.array([f"w{i}" for i in range(5000)])
    texts = [" ".join(words[rng.integers(0, 5000, 4000)]) for _ in range(800)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(800), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    tracemalloc.start()
    try:
        n = sum(b.num_rows for b in substring_dedup._pieces(13, 64, 64, 8)(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n and most < 192 << 20


def test_many_buckets_and_small_blocks_change_nothing(spark, rows, monkeypatch):
    plain = sorted(map(str, substring_dedup.deduplicate(docs_of(spark, rows)).collect()))
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 3000)
    assert sorted(map(str, substring_dedup.deduplicate(docs_of(spark, rows), batches=7).collect())) == plain


def test_more_buckets_than_a_table_of_spark_may_have(spark, rows, monkeypatch):
    """131,072 buckets, on 8 shelves, and blocks cut into 64 pieces: the removed windows are the same, and history isn't shuffled."""
    monkeypatch.setattr(substring_dedup, "FAN", 64)
    docs = spark.createDataFrame([r for r in rows if r[0] is not None], "doc_id long, text string").dropDuplicates(["doc_id"])
    found = []
    for buckets in (1, 1 << 17):
        index = substring_dedup.FingerprintIndex(spark, buckets, shelves=8)
        gone = [index.by_document(index.ingest(docs.filter(f"doc_id {x} 1000")), 1 << 20).collect() for x in ("<", ">=")]
        one = [(r["doc_id"], sorted(tokens.unpack(r["pos"], r["n"]).tolist())) for rows in gone for r in rows]
        found.append(sorted(one))
        if buckets > 1:
            index.compact()
            plan = index._run(index.runs[0][1]).groupBy("shelf", "bucket").applyInArrow(substring_dedup._compact, substring_dedup.PIECE)._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and index.shelves == 8
        index.drop()
    assert found[0] == found[1] and found[0]


def test_rows_sent_do_not_grow_with_buckets(spark, rows, monkeypatch):
    monkeypatch.setattr(substring_dedup, "FAN", 16)
    docs = spark.createDataFrame([r for r in rows if r[0] is not None], "doc_id long, text string").coalesce(1)
    n = [docs.mapInArrow(substring_dedup._pieces(13, min(b, 16), min(b, 16), 2), substring_dedup.PIECE).filter("kind = 0").count() for b in (16, 1 << 18)]
    assert n[0] == n[1] <= 16
    packed = [substring_dedup.FingerprintIndex(spark, b, shelves=4).fingerprinted(docs, 1).filter("kind = 0").agg({"n": "sum"}).first()[0] for b in (1, 1 << 10)]
    assert packed[0] == packed[1]


def test_an_index_is_opened_again(spark, tmp_path):
    rng = random.Random(3)
    shared = [" ".join(f"s{k}w{j}" for j in range(20)) for k in range(4)]
    texts = [f"a{i} b{i} " + " ".join(rng.sample(shared, 2)) for i in range(40)]
    path = str(tmp_path / "index")
    batch = lambda low, high: docs_of(spark, [(i, texts[i]) for i in range(low, high)])
    found = lambda frame: {(int(d), int(p)) for r in frame.collect() for d, p in zip(*substring_dedup._read(r.asDict())[:2], strict=True)}
    index, got = substring_dedup.FingerprintIndex(spark, 4, 13, path), set()
    for i, low in enumerate(range(0, 40, 8)):
        if i in (2, 3):
            index = substring_dedup.FingerprintIndex.open(spark, path)
        if len(index.runs) > 1:
            both = index._run(index.runs[-1][1]).union(index._run(index.runs[-2][1])).groupBy("shelf", "bucket")
            assert "Exchange" not in both.applyInArrow(substring_dedup._compact, substring_dedup.PIECE)._jdf.queryExecution().toString()
            with substring_dedup._by_shelf(spark):
                plan = spark.createDataFrame([], substring_dedup.PIECE).groupBy("shelf", "bucket").cogroup(both).applyInArrow(substring_dedup._merge(1), substring_dedup.PIECE)
                assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
        got |= found(index.ingest(batch(low, low + 8)))
        assert len({level for level, _ in index.runs}) >= len(index.runs) - 1
    first, want = {}, set()
    for i, t in enumerate(texts):
        w = t.split()
        for p in range(len(w) - 12):
            if first.setdefault(tuple(w[p : p + 13]), i) < i:
                want.add((i, p))
    assert got == want and len(want) > 100
    with pytest.raises(ValueError, match="ids must be above"):
        index.ingest(batch(30, 40))
    index.drop()


def brute_join(rows):
    nodes = [(i, shingle_set(t)) for i, t in rows if i is not None]
    links = {k: [] for k in range(len(nodes))}
    for a in range(len(nodes)):
        for b in range(a):
            p, q = nodes[a][1], nodes[b][1]
            if p and q and 100 * len(p & q) >= 75 * len(p | q):
                links[a].append(b)
                links[b].append(a)
    out, seen = [], {}
    for start in range(len(nodes)):
        if start not in seen:
            part, todo = {start}, [start]
            while todo:
                for b in links[todo.pop()]:
                    if b not in part:
                        part.add(b)
                        todo.append(b)
            seen |= dict.fromkeys(part, min(nodes[k][0] for k in part))
        out.append((str(nodes[start][0]), len(nodes[start][1]), str(seen[start]), len(links[start])))
    return out + [("None", len(shingle_set(t)), "None", 0) for i, t in rows if i is None]


def joined(spark, rows):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["n_links"]) for r in ngram_join.join(docs_of(spark, rows)).collect())


def test_ngram_join(spark, rows):
    assert joined(spark, rows) == sorted(brute_join(rows))


@pytest.mark.parametrize("limit", [10, 1000])
def test_any_boundary_gives_the_same_links(spark, monkeypatch, limit):
    rows = list(enumerate(near_copies(random.Random(9), 200, vocabulary=60)))
    monkeypatch.setattr(ngram_join, "boundary", lambda sets: limit)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 7)
    monkeypatch.setattr(ngram_join, "BUCKET_BYTES", 4000)
    assert joined(spark, rows) == sorted(brute_join(rows))


def test_joining_nothing(spark):
    assert ngram_join.join(docs_of(spark, [])).count() == 0
    assert joined(spark, [(1, None), (2, "")]) == [("1", 0, "1", 0), ("2", 0, "2", 0)]


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    want = {x: find(x) for e in edges for x in e if find(x) != x}
    assert {r["a"]: r["b"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()} == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain(text):
    return re.sub(" +", " ", "".join(c.lower() if c.isalnum() else " " for c in text)).strip()


def within(pattern, text, most):
    """Least edits of pattern against any part of text."""
    row = np.zeros(len(text) + 1, int)
    for c in pattern:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        for j, d in enumerate(text, 1):
            new[j] = min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1)
        row = new
    return row.min() <= most


ITEM = "The quick brown fox jumps over the lazy dog, while seven wizards brew 42 potions at midnight in Zürich!"
SHORT = "Exactly forty-five characters long, this one!"
BENCH = "item_id long, text string, doc_id string"


def test_decontamination_finds_edited_passages(spark):
    rng = random.Random(8)
    rows, want = [], set()
    letters = "abcdefghijklmnopqrstuvwxyz "
    for i in range(60):
        own = list(ITEM[: 95 + i % 6])
        for _ in range(i % 11):
            k = rng.randrange(len(own))
            own[k : k + 1] = rng.choice([[], [rng.choice(letters)], [own[k], rng.choice(letters)]])
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 90))) + "\n" + "".join(own) + "\t" + "".join(rng.choice(letters) for _ in range(rng.randint(0, 90)))
        rows.append((i, text))
        p, t = plain(ITEM), plain(text)
        _, window, edits = decontamination.CLASSES[0]
        if any(within(p[a : a + window], t, edits) for a in range(len(p) - window + 1)):
            want.add((i, 1))
    rows += [(100, "so: EXACTLY  forty five\ncharacters long   this one, yes"), (101, None), (102, ""), (103, "w" * 300_000), (104, "quick brown fox jumps over the lazy dog"), (105, "This is: Too\nSHORT."), (106, "too shortly, hence not too sho rt")]
    rows += [rows[3]]
    bench = spark.createDataFrame([(1, ITEM, "x"), (2, SHORT, "x"), (3, None, None), (4, "too short", None), (5, "?!", None), (6, "", None)], BENCH)
    found = decontamination.matches(docs_of(spark, rows), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want | {(100, 2), (105, 4)}
    copies = [(r["item_id"], r["start"], r["end"], r["edits"]) for r in found if r["doc_id"] == 3]
    assert sorted(copies[::2]) == sorted(copies[1::2]) and len(copies) == 2 * len(set(copies))
    texts = dict(rows)
    (hit,) = [r for r in found if r["doc_id"] == 100]
    assert plain(texts[100][hit["start"] : hit["end"]]) == plain(SHORT)
    kept = decontamination.clean(docs_of(spark, rows), bench)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows} - {d for d, _ in want} - {100, 105}
    assert kept.columns == ["doc_id", "text", "n", "bucket", "kept"]


def test_a_benchmark_of_several_blocks(spark):
    rng = random.Random(1)
    items = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "rho", "pi"]) + str(rng.randrange(99)) for _ in range(16)) for _ in range(40)]
    bench = spark.createDataFrame([(i, t, None) for i, t in enumerate(items)] + [(99, items[0], None)], BENCH)
    docs = docs_of(spark, [(i, f"before {t} after") for i, t in enumerate(items)] + [(77, items[3])])
    assert len(list(decontamination.index_blocks(bench, block_bytes=900))) > 3
    for size in (decontamination.BLOCK_BYTES, 900):
        rows = decontamination.matches(docs, bench, block_bytes=size).collect()
        assert {(r["doc_id"], r["item_id"]) for r in rows} == {(i, i) for i in range(40)} | {(0, 99), (77, 3)} and len(rows) == 42
        assert all(r["edits"] == 0 and r["start"] == (0 if r["doc_id"] == 77 else 7) for r in rows)
        assert decontamination.clean(docs.union(docs_of(spark, [(500, None), (501, "clean")])), bench, block_bytes=size).count() == 2
    short = bench.union(spark.createDataFrame([(200, "tiny", None)], BENCH))
    assert {r["item_id"] for r in decontamination.matches(docs_of(spark, [(1, "a tiny one"), (2, "tinyer")]), short, block_bytes=900).collect()} == {200}
    empty = spark.createDataFrame([], BENCH)
    assert decontamination.matches(docs, empty).count() == 0 and decontamination.clean(docs, empty).count() == 41


def test_periodic_texts_cost_in_proportion():
    items = ["lorem ipsum " * 40, "a" * 3000, "abab " * 30 + "then the end of it all comes"]
    points = decontamination._plain_items(pa.array(items))
    indexes = [decontamination.Index.of(60, 3, [0, 1, 2], points)]
    took = []
    for n in (3000, 12_000):
        began = time.process_time()
        found = decontamination.scan(pa.array(["x " + "lorem ipsum " * (n // 12), "a" * n, "b" * n, "abab " * (n // 5)]), indexes)
        took.append(time.process_time() - began)
        assert [(r, i, e) for r, i, _, _, e in found] == [(0, 0, 0), (1, 1, 0), (3, 2, 0)]
        assert abs(found[1][3] - found[1][2] - n) <= 3 and abs(found[0][3] - found[0][2] - n) <= 6
    assert took[1] < 8 * took[0] + 0.5 and took[1] < 20


def test_parts_of_shared_qgrams_lose_nothing(monkeypatch):
    rng = random.Random(6)
    item = "".join(rng.choice("abcd ") for _ in range(300))
    texts = []
    for _ in range(30):
        own = list(item[rng.randrange(100) : rng.randrange(150, 300)])
        for _ in range(rng.randrange(8)):
            own[rng.randrange(len(own))] = rng.choice("abcd")
        texts.append("".join(rng.choice("abcd ") for _ in range(rng.randrange(200))) + "".join(own) + "".join(rng.choice("abcd ") for _ in range(50)))
    indexes = [decontamination.Index.of(60, 3, [7], decontamination._plain_items(pa.array([item])))]
    whole = decontamination.scan(pa.array(texts), indexes)
    monkeypatch.setattr(decontamination, "TRIPLES", 50)
    monkeypatch.setattr(decontamination, "ALIGNED", 3)
    assert decontamination.scan(pa.array(texts), indexes) == whole and len(whole) > 10


def test_words_are_cut_like_the_pattern():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab \t\n\x0b\x0c\r é漢") for _ in range(rng.randrange(30))) for _ in range(300)] + [None, "", "x" * 100_000]
    words = tokens.cut(pa.array(texts))
    got = [words.data[a:b].tobytes().decode() for a, b in zip(words.start, words.stop, strict=True)]
    assert got == [w for t in texts for w in WORD.findall(t or "")]
    assert words.count.tolist() == [len(WORD.findall(t or "")) for t in texts]
    hashed = tokens.hash_words(words)
    assert len(set(hashed.tolist())) == len(set(got))
    a = np.sort(np.random.default_rng(0).integers(0, 2**64, 999, dtype=np.uint64))
    assert (tokens.unpack_sorted(tokens.pack_sorted(a), 999) == a).all() and (tokens.unpack(tokens.pack(a), 999) == a).all()


def test_tables_of_bits_are_united_in_parts(spark):
    """Of many tasks, each with its own items, the union is that of one task with all; what reaches the driver is the table's size, whatever the items are."""
    texts = [f"item {i} of the benchmark, with words of its own like {i * 7919} and {i * 104729}" for i in range(200)]
    rows = lambda n: spark.createDataFrame([(t,) for t in texts], "text string").repartition(n).mapInArrow(decontamination._bits(22), "part int, bits binary, short boolean")
    united = lambda df: sorted((r["part"], bytes(r["bits"]), r["short"]) for r in df.groupBy("part").applyInArrow(decontamination._either, "part int, bits binary, short boolean").collect())
    one, many = united(rows(1)), united(rows(9))
    assert one == many and len(one) == decontamination.PARTS and sum(len(b) for _, b, _ in one) == 1 << 19 and any(any(b) for _, b, _ in one)
