"""Trained operators: held-out accuracy, exact parts against brute force, and edge cases."""

import math
import os
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from measure_recall import recall

from quirework.llm import folds, language, language_model, neighbours, toxicity

DOCS = "doc_id long, text string, lang string, score string, label string"
SYLLABLES = {"aa": ["ka", "to", "mi", "su"], "bb": ["strug", "wen", "hof"], "cc": ["eau", "oux", "ille"]}


def prose(rng, lang, n):
    common = {"aa": ["no", "wa", "ga"], "bb": ["und", "der", "ist"], "cc": ["le", "et", "les"]}[lang]
    return " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


EDGES = [(9000, None, "aa", "x", None), (9001, "", None, "x", "y"), (9002, " 12 !? \n", "bb", "x", "y"), (9003, "Z" * 50_000 + " und der " * 20_000, None, "x", "y"), (None, "und der ist", None, "x", "y")]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows = [(i, prose(rng, lang, rng.randint(3, 60)), lang, "x", "y") for i in range(240) for lang in [rng.choice(list(SYLLABLES))]]
    return rows + rows[:4] + EDGES


def crc(i, by):
    return zlib.crc32(("" if i is None else str(i)).encode()) % by


def test_folds(spark, corpus):
    rows = spark.createDataFrame(corpus, DOCS).select("doc_id", folds.remainder("doc_id", 5).alias("r")).collect()
    assert all(r["r"] == crc(r["doc_id"], 5) for r in rows)


def test_language(spark, corpus):
    docs = spark.createDataFrame(corpus, DOCS)
    model = language.train(docs.filter(folds.remainder("doc_id", 3) != 1))
    assert model.langs == ["aa", "bb", "cc"]
    out = language.predict(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "label", "lang_pred", "score"] and out.count() == len(corpus)
    rows = out.collect()
    held = [r for r in rows if r["lang"] and crc(r["doc_id"], 3) == 1 and r["doc_id"] < 9000]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    edge = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows if r["doc_id"] is None or r["doc_id"] >= 9000}
    assert edge[9000] == edge[9001] == edge[9002] == ("und", 0.0) and edge[9003][0] == edge[None][0] == "bb"
    assert all(0 <= r["score"] <= 1 for r in rows)


def brute_language(rows, texts):
    """lang and score of texts, from counts of words and n-grams of rows (text, lang)."""
    cut = lambda t: "".join(c.lower() if unicodedata.category(c)[0] in "LM" else " " for c in t or "").split()
    grams = lambda w, n: [w] if n == 0 else [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)]
    langs = sorted({lang for _, lang in rows if lang is not None})
    counts = [{lang: Counter(g for t, own in rows if own == lang for w in cut(t) for g in grams(w, n)) for lang in langs} for n in range(6)]
    worst = [max((-math.log10(c / sum(t.values())) for t in table.values() for c in t.values()), default=0) + 1 for table in counts]

    def cost(g, n, lang):
        table = counts[n][lang]
        return -math.log10(table[g] / sum(table.values())) if table[g] else worst[n]

    out = []
    for t in texts:
        if not any(unicodedata.category(c)[0] == "L" for c in t or ""):
            out.append(("und", 0.0))
            continue
        total = dict.fromkeys(langs, 0.0)
        words = cut(t)
        for w in words:
            for n in (0, 5, 4, 3, 2, 1):
                known = [g for g in grams(w, n) if any(counts[n][lang][g] for lang in langs)]
                if known:
                    for lang in langs:
                        total[lang] += sum(cost(g, n, lang) for g in known) / len(known)
                    break
        mean = {lang: total[lang] / len(words) for lang in langs}
        best = min(langs, key=lambda lang: (mean[lang], lang))
        out.append((best, 1 / sum(math.exp(-8.0 * (mean[lang] - mean[best])) for lang in langs)))
    return out


def test_language_against_counting(spark, corpus):
    rows = [(t, lang) for _, t, lang, *_ in corpus[:60]] + [("Über ÉTÉ\u2014naïve", "bb"), ("e\u0301t\u00e9, l'eau!", "cc")]
    texts = [t for _, t, *_ in corpus[60:120]] + ["über", "ÜBER \u2014 x", "漢字", "\u0301 1", None, "", "\u201cno\u201d wa2ga", "qqqq", "ka ka"]
    model = language.train(spark.createDataFrame([(i, t, lang, "", "") for i, (t, lang) in enumerate(rows)], DOCS))
    out = language.predict(spark.createDataFrame([(i, t, None, "", "") for i, t in enumerate(texts)], DOCS), model).orderBy("doc_id").collect()
    for r, (lang, score) in zip(out, brute_language(rows, texts), strict=True):
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-4, (texts[r["doc_id"]], r, lang, score)


def test_ties_between_languages(spark):
    model = language.train(spark.createDataFrame([(1, "same words", "zz", "", ""), (2, "same words", "yy", "", "")], DOCS))
    (r,) = language.predict(spark.createDataFrame([(1, "same", None, "", "")], DOCS), model).collect()
    assert (r["lang_pred"], r["score"]) == ("yy", 0.5)


def test_language_of_unseen_words_and_without_training(spark, corpus):
    docs = spark.createDataFrame(corpus, DOCS)
    model = language.train(docs)
    unseen = spark.createDataFrame([(1, "strugwenhofstrugwenhof", None, "", ""), (2, "millouxeauoux", None, "", ""), (3, "漢字", None, "", "")], DOCS)
    assert [r["lang_pred"] for r in language.predict(unseen, model).orderBy("doc_id").collect()][:2] == ["bb", "cc"]
    nothing = language.train(spark.createDataFrame([], DOCS))
    assert {r["lang_pred"] for r in language.predict(docs, nothing).collect()} == {"und"}


def test_the_sample_is_bounded(spark):
    labels = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    some, counts = folds.about(labels, "label", "doc_id", 500)
    got = {r["label"]: r["count"] for r in some.groupBy("label").count().collect()}
    assert counts == {0: 18_000, 1: 2_000} and all(350 < n < 650 for n in got.values())


def test_toxicity(spark, monkeypatch):
    rng = random.Random(5)
    bad = ["idiot", "moron", "trashy", "loserly"]
    rows, labels = [], []
    for i in range(500):
        toxic = rng.random() < 0.3
        words = prose(rng, rng.choice(list(SYLLABLES)), rng.randint(20, 60)).split()
        if toxic:
            for _ in range(max(2, len(words) // 12)):
                words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words), None, "x", "y"))
        labels.append((i, int(toxic), 1))
    docs = spark.createDataFrame(rows + EDGES + [(600, "no wa idiots und morons der ga trashyy wa", None, "x", "y")], DOCS)
    frame = spark.createDataFrame(labels + [(0, labels[0][1], None), (9001, None, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, frame.filter(folds.remainder("doc_id", 5) != 0))
    out = toxicity.score(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "label", "score"]
    got = {r["doc_id"]: r["score"] for r in out.collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[600] >= 0.5  # misspellings
    held = [(t, got[i] >= 0.5) for i, t, _ in labels if crc(i, 5) == 0]
    assert sum(t == p for t, p in held) >= 0.93 * len(held)
    assert got[9000] == got[9001] < 0.5
    again = toxicity.train(docs.repartition(5), frame.filter(folds.remainder("doc_id", 5) != 0))
    assert np.allclose(again.bucket_scores(), model.bucket_scores())
    none = toxicity.train(docs, frame.filter("false"))
    assert all(r["score"] < 1e-5 for r in toxicity.score(docs, none).collect())
    assert toxicity.score(spark.createDataFrame([], DOCS), model).count() == 0


def test_toxicity_is_fitted_in_a_task(spark, monkeypatch):
    """The sample's bags of n-grams, some 45 MB, took up the driver's memory."""
    fit, driver = toxicity.fit, os.getpid()

    def elsewhere(bags, counts):
        assert os.getpid() != driver
        return fit(bags, counts)

    monkeypatch.setattr(toxicity, "fit", elsewhere)
    docs = spark.createDataFrame([(i, "und der idiot" if i % 2 else "und der ist", None, "x", "y") for i in range(40)], DOCS)
    model = toxicity.train(docs, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int"))
    assert model.vectors.shape == (toxicity.BUCKETS, toxicity.DIM) and model.weights.shape == (toxicity.DIM, 2)
    assert all((r["score"] >= 0.5) == bool(r["doc_id"] % 2) for r in toxicity.score(docs, model).collect())


def test_toxicity_against_plain_sums(spark):
    """Scores follow from the model's vectors by the definition, word by word; at a probability of one half the text is rejected."""
    rng = np.random.default_rng(4)
    model = toxicity.Model(rng.normal(size=(toxicity.BUCKETS, toxicity.DIM)).astype(np.float32), rng.normal(size=(toxicity.DIM, 2)).astype(np.float32), np.array([0.3, -0.2]))
    texts = ["Some words, some MORE words", "éa b", "x", None, "", "w" * 3000 + " ok"]
    rows = [(i, t, None, "x", "y") for i, t in enumerate(texts)] + [(0, texts[0], None, "x", "y")]
    got = toxicity.score(spark.createDataFrame(rows, DOCS), model).collect()
    assert len(got) == len(rows) and len({r["score"] for r in got if r["doc_id"] == 0}) == 1

    def buckets(word):
        marked = f"<{word}>"
        lists = [[word], *([marked[i : i + n] for i in range(len(marked) - n + 1)] for n in toxicity.NGRAMS)]
        out = []
        for n, own in zip((0, *toxicity.NGRAMS), lists, strict=True):
            for g in own:
                if n == 0:
                    h = int(toxicity.tokens.hash_words(toxicity.tokens.cut(toxicity.pa.array([g])))[0])
                else:
                    h = n << 32
                    h = ord(g[0]) + h
                    for c in g[1:]:
                        h = (h * 0xD1B54A32D192ED03 + ord(c)) % 2**64
                    h = int(toxicity.tokens.mix(np.array([h], np.uint64))[0])
                out.append(h % toxicity.BUCKETS)
        return out

    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in r["text"] or ""))
        hidden = sum((model.vectors[buckets(w)].astype(float).mean(0) for w in words), np.zeros(toxicity.DIM)) / (len(words) + toxicity.PSEUDO)
        logits = hidden @ model.weights + model.bias
        assert abs(r["score"] - 1 / (1 + math.exp(logits[0] - logits[1]))) < 1e-5
    even = toxicity.Model(model.vectors * 0, model.weights, np.zeros(2))
    assert {r["score"] for r in toxicity.score(spark.createDataFrame(rows, DOCS), even).collect()} == {0.5}


def test_language_model(spark, corpus):
    docs = spark.createDataFrame(corpus, DOCS)
    out = language_model.score(docs, folds.remainder("doc_id", 10) != 0).collect()
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    words = [(i, [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(lower)), b""]) for i, t, *_ in corpus]
    counts = Counter(w for i, ws in words if crc(i, 10) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), crc(i, 10) == 0, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for i, ws in words)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
    held = [r for r in out if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 9000]  # the base gives a word of 50,000 letters what it gives any unknown one
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in out)
    assert language_model.score(spark.createDataFrame([], DOCS), F.lit(True)).count() == 0
    alone = language_model.score(docs.limit(3), F.lit(False)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in alone)


class Restaurants:
    """The same hierarchy, sampled customer by customer."""

    def __init__(self, rng):
        self.rng, self.sizes, self.customers, self.tables = rng, {}, Counter(), Counter()

    def settings(self, name):
        m = language_model
        return {"c": (m.CONTEXT_DISCOUNT, m.CONTEXT_STRENGTH), "r": (m.WORD_DISCOUNT, m.WORD_STRENGTH), "s": (m.SPELL_DISCOUNT, m.SPELL_STRENGTH)}[name[0]]

    def parents(self, name, dish):
        if name[0] == "c":
            return [(("r",), dish)]
        if name[0] == "r":
            text = b" " * language_model.ORDER + dish + b" "
            return [(("s", text[i - language_model.ORDER : i]), text[i]) for i in range(language_model.ORDER, len(text))]
        return [(("s", name[1][1:]), dish)] if name[1] else []

    def p(self, name, dish):
        above = math.prod(self.p(*x) for x in self.parents(name, dish)) if name != ("s", b"") else 1 / 256
        d, strength = self.settings(name)
        own = self.sizes.get((name, dish), [])
        return (sum(own) - d * len(own) + (strength + d * self.tables[name]) * above) / (strength + self.customers[name])

    def add(self, name, dish):
        own = self.sizes.setdefault((name, dish), [])
        d, strength = self.settings(name)
        above = math.prod(self.p(*x) for x in self.parents(name, dish)) if name != ("s", b"") else 1 / 256
        weights = [s - d for s in own] + [(strength + d * self.tables[name]) * above]
        at = self.rng.choices(range(len(weights)), weights)[0]
        self.customers[name] += 1
        if at < len(own):
            own[at] += 1
            return
        own.append(1)
        self.tables[name] += 1
        for x in self.parents(name, dish):
            self.add(*x)

    def remove(self, name, dish):
        own = self.sizes[name, dish]
        at = self.rng.choices(range(len(own)), own)[0]
        own[at] -= 1
        self.customers[name] -= 1
        if not own[at]:
            del own[at]
            self.tables[name] -= 1
            for x in self.parents(name, dish):
                self.remove(*x)


def test_language_model_against_a_sampler_of_single_customers(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    follow = {w: rng.choices(words, k=3) for w in words}
    rows = []
    for i in range(110):
        text = [rng.choice(words)]
        for _ in range(rng.randint(3, 25)):
            text.append(rng.choice(follow[text[-1]]) if rng.random() < 0.6 else rng.choice(words[: rng.randint(1, 60)]))
        rows.append((i, " ".join(text + ["so", "it", "ends"] * 2 + ["unheard" + str(i)] * (i % 7 == 0)), None, "x", "y"))
    pairs = lambda t: list(zip([b"", *t.encode().split()], [*t.encode().split(), b""]))
    customers = [(("c", u), w) for i, t, *_ in rows if crc(i, 4) for u, w in pairs(t)]
    asked = [(i, ("c", u), w) for i, t, *_ in rows for u, w in pairs(t)]
    brute, total, kept = Restaurants(rng), Counter(), 0
    for x in customers:
        brute.add(*x)
    for sweep in range(24):
        for x in customers:
            brute.remove(*x)
            brute.add(*x)
        if sweep >= 8 and sweep % 2:
            kept += 1
            for x in set(a[1:] for a in asked):
                total[x] += brute.p(*x)
    want = Counter()
    for i, *x in asked:
        want[i] += math.log10(total[tuple(x)] / kept)
    got = {r["doc_id"]: r["score"] for r in language_model.score(spark.createDataFrame(rows, DOCS), folds.remainder("doc_id", 4) != 0).collect()}
    for fold in (True, False):
        some = [i for i, *_ in rows if (crc(i, 4) == 0) == fold]
        ours, theirs = sum(got[i] for i in some), sum(want[i] for i in some)
        assert abs(ours - theirs) < 0.015 * abs(theirs), (fold, ours, theirs)
        assert all(abs(got[i] - want[i]) < 0.06 * abs(want[i]) for i in some)


def test_split_contexts_and_many_buckets_change_little(spark, corpus, monkeypatch):
    docs = spark.createDataFrame(corpus[:-3], DOCS)
    rows = lambda: {(str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)): r["score"] for r in language_model.score(docs, folds.remainder("doc_id", 10) != 0).collect()}
    plain = rows()
    monkeypatch.setattr(language_model, "BUCKET_BYTES", 4000)
    monkeypatch.setattr(language_model, "CHUNK_BYTES", 6000)
    dealt = rows()
    assert plain.keys() == dealt.keys() and abs(sum(plain.values()) - sum(dealt.values())) < 0.01 * abs(sum(plain.values()))


def test_spelling_is_a_distribution():
    rng = np.random.default_rng(2)
    words = [bytes(rng.choice(list(b"abcd"), rng.integers(0, 9))) for _ in range(400)]
    sizes = np.array([len(w) for w in words])
    keys, _ = language_model.spelling_keys(np.frombuffer(b"".join(words), np.uint8), sizes)
    distinct, counts = np.unique(keys, return_counts=True)
    spelling = language_model.seat_spelling(distinct, counts, 0)
    for context in (b"  ", b" a", b"ab", b"zz"):
        base = int.from_bytes(context, "big") << 8
        total = spelling.probabilities(np.arange(base, base + 256, dtype=np.uint64)).sum(0)
        assert np.allclose(total, 1, atol=1e-4)


def sequential_tables(rng, customers, strength, p, d, sweeps):
    """Mean tables of one dish, sampled customer by customer; strength without the dish's own tables."""
    sizes, seen = [], []
    for _ in range(customers):
        weights = [s - d for s in sizes] + [(strength + d * len(sizes)) * p]
        at = rng.choices(range(len(weights)), weights)[0]
        sizes = sizes + [1] if at == len(sizes) else [s + (k == at) for k, s in enumerate(sizes)]
    for _ in range(sweeps):
        for _ in range(customers):
            at = rng.choices(range(len(sizes)), sizes)[0]
            sizes = [s - (k == at) for k, s in enumerate(sizes) if s > (k == at)]
            weights = [s - d for s in sizes] + [(strength + d * len(sizes)) * p]
            at = rng.choices(range(len(weights)), weights)[0]
            sizes = sizes + [1] if at == len(sizes) else [s + (k == at) for k, s in enumerate(sizes)]
        seen.append(len(sizes))
    return np.mean(seen[len(seen) // 5 :])


def expected_tables(customers, strength, p, d):
    """Mean tables of one dish: over t, ways to sit at t tables times the weight of opening them."""
    ways = np.array([0.0])
    with np.errstate(divide="ignore"):
        for c in range(1, customers):
            ways = np.logaddexp(np.r_[-np.inf, ways], np.r_[ways, -np.inf] + np.log(np.maximum(c - d * np.arange(1, c + 2), 1e-300)))
    weight = ways + np.cumsum(np.log((strength + d * np.arange(customers)) * p))
    weight = np.exp(weight - weight.max())
    return (weight * np.arange(1, customers + 1)).sum() / weight.sum()


CASES = [(2, 4.0, 0.2, 0.8), (7, 30.0, 0.05, 0.8), (40, 8.0, 0.3, 0.4), (64, 5.0, 0.1, 0.0), (150, 12.0, 0.2, 0.5), (400, 100.0, 0.05, 0.7), (1024, 30.0, 0.1, 0.8), (2500, 20.0, 0.2, 0.2), (1500, 1e5, 0.05, 0.8), (3000, 1e4, 0.4, 0.7), (2000, 50.0, 0.9, 0.8), (5000, 10.0, 0.2, 0.7), (5000, 5.0, 1e-9, 0.4)]


@pytest.mark.parametrize(("customers", "strength", "p", "d"), CASES)
def test_seating(customers, strength, p, d):
    want = expected_tables(customers, strength, p, d)
    if customers <= 64:
        assert abs(sequential_tables(random.Random(3), customers, strength, p, d, 3000) - want) < 0.06 * want
    many, seen = 400, []
    seats = language_model.Seating(np.full(many, customers), d, np.random.default_rng(1))
    for i in range(12):
        seats.sweep(np.full(many, strength), np.full(many, p))
        assert (seats.tables >= 1).all() and (seats.tables <= customers).all()
        if i >= language_model.BURN_IN:
            seen.append(seats.tables.mean())
    assert abs(np.mean(seen) - want) < max(0.02, 0.03 * want), (np.mean(seen), want)


VECTORS = "vec_id long, embedding array<float>, rank string, label string"


def brute(rows, k, dim):
    kept = [(i, np.pad(np.array(v, float), (0, dim - len(v)))) for i, v, *_ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, v in kept:
        if q % 20 == 0:
            out.setdefault(q, sorted(((-float(v @ w), i) for i, w in kept if i != q))[:k])
    return out


@pytest.mark.parametrize("norms", [False, True])
def test_neighbours(spark, norms):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 16)) + 3 * rng.normal(size=(8, 16))[rng.integers(0, 8, 3000)]
    x = x * rng.uniform(0.5, 2, (3000, 1)) if norms else x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(np.float32(c)) for c in v], "r", "l") for i, v in enumerate(x)]
    rows += [(5000 + i, rows[40][1], "r", "l") for i in range(900)]
    rows += [(8000, None, "r", "l"), (8020, [0.0] * 16, "r", "l"), (8040, [math.nan] * 16, "r", "l"), (8060, [1.0, None] * 8, "r", "l"), (8080, [1.0] * 3, None, "l"), (8100, [], "r", "l"), (8120, [math.inf] * 16, "r", "l"), (None, rows[3][1], "r", "l")]
    out = neighbours.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0).collect()
    got, vectors = {}, {i: np.pad(np.array(v, float), (0, 16 - len(v))) for i, v, *_ in rows if v and None not in v}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert abs(r["score"] - vectors[r["query_id"]] @ vectors[r["vec_id"]]) < 1e-9
    want = brute(rows, 20, 16)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.95 * 20 * len(want)
    if not norms:
        assert [i for i, _ in got[40]] == [5000 + i for i in range(20)]
        assert [i for i, _ in got[5000]] == [40, *range(5001, 5020)]


def test_neighbours_of_very_unequal_norms(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(8000, 64))
    x *= np.exp(rng.normal(0, 0.3, (8000, 1))) / np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(np.float32(c)) for c in v], "r", "l") for i, v in enumerate(x)]
    got = {}
    for r in neighbours.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    sims = x[::20] @ x.T
    sims[np.arange(400), np.arange(0, 8000, 20)] = -np.inf
    best = np.argpartition(-sims, 20, 1)[:, :20]
    hits = sum(len(got[20 * i] & set(b.tolist())) for i, b in enumerate(best))
    assert hits >= 0.9 * 20 * 400


def test_rounds_do_the_work(spark):
    rng = np.random.default_rng(8)
    rows = {i: v.tolist() for i, v in enumerate(rng.normal(size=(5000, 32)))}
    frame = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    scratch = neighbours.Scratch(spark, "test")
    nodes = frame.select(F.col("vec_id").alias("node"), F.col("embedding").alias("v"))
    share = {}
    for rounds in (0, 2, None):
        found = {}
        for r in neighbours.build(nodes, 32, 5000, 6.0, scratch, rounds).collect():
            ids, nbrs = np.frombuffer(r["a"], np.int64), np.frombuffer(r["d"], np.int64).reshape(-1, neighbours.K)
            found.update({int(i): set(n[:20].tolist()) for i, n in zip(ids, nbrs, strict=True) if i % 20 == 0})
        share[rounds] = recall(rows, found)
    assert share[0] < 0.5 < share[2] < share[None] and share[None] >= 0.9
    got = {}
    for r in neighbours.search(frame, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert recall(rows, got) >= 0.97


def test_search_sends_messages_and_not_the_graph(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 8))
    steps, superstep = [], neighbours.superstep

    def counted(rows, work):
        out = superstep(rows, work)
        steps.append({r["kind"]: r["bytes"] for r in out.groupBy("kind").agg(F.sum(sum(F.length(p) for p in "abcdef")).alias("bytes")).collect()})
        return out

    monkeypatch.setattr(neighbours, "superstep", counted)
    monkeypatch.setattr(neighbours, "BEAM", 80)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(vectors, F.col("vec_id") % 20 == 0, rounds=1).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert recall(dict(enumerate(x)), got) >= 0.97
    # Three steps start the graph, four are its round: only those that make or change lists return them.
    assert [neighbours.GRAPH in s for s in steps[:7]] == [True, True, True, False, False, False, True]
    search = steps[7:]
    assert len(search) > 4 and not any(neighbours.GRAPH in s for s in search)


def test_neighbours_are_scored_in_double_precision(spark):
    rows = [(i, [1e30 * (1 + i * 1e-12), 1e-30, float(i % 3)]) for i in range(50)] + [(7, [1.0, 1.0]), (7, [2.0, 1.0]), (20, [1e30 * (1 + 20 * 1e-12), 1e-30, 2.0])]
    out = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    first = [r for r in out if r["query_id"] == 0]
    assert [r["vec_id"] for r in sorted(first, key=lambda r: r["rank"])] == list(range(49, 29, -1))
    assert all(r["score"] == 1e30 * (1e30 * (1 + r["vec_id"] * 1e-12)) for r in first)
    assert len(out) == 20 * 4


def test_few_or_no_neighbours(spark):
    few = spark.createDataFrame([(i, [1.0, float(i)], "r", "l") for i in range(21)], VECTORS)
    out = neighbours.search(few, F.col("vec_id") % 20 == 0).collect()
    assert sorted((r["query_id"], r["rank"]) for r in out) == [(q, k) for q in (0, 20) for k in range(1, 21)]
    assert [r["vec_id"] for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == 20] == list(range(19, -1, -1))
    assert neighbours.search(spark.createDataFrame([], VECTORS), F.lit(True)).count() == 0
    assert neighbours.search(few.limit(1), F.lit(True)).count() == 0
