"""A hierarchical Pitman-Yor language model and the log probabilities it gives to texts.

The word before is the context of a word (the empty word, which ends a text,
stands before its first one, too). Each context is a restaurant whose dishes are
the words that follow it. All context restaurants share one parent, the root
restaurant of words. Its base measure spells a word byte by byte: each context
of up to ORDER preceding bytes is a restaurant whose parent is the one of the
context one byte shorter; the last parent is uniform. Every table of a
restaurant is a customer of its parent. The order of the spelling is fixed, so
its dishes are at most 256 ** (ORDER + 1), whatever the corpus.

Seating is sampled by Gibbs. In a sweep all customers of every dish leave and
are seated again by the Chinese restaurant rule: the number of their tables is
drawn from its distribution given all else, in which the ways to share so many
tables are counted by generalised Stirling numbers; which customer sits where
changes no probability. Beyond SMALL customers these numbers come from their
saddle point. All dishes are drawn at once, against the tables of their
restaurant before the sweep. Parents' probabilities are
exchanged after ROUNDS of sweeps. The probability of a word in its context is
averaged over SAMPLES seatings, and a text's score is the sum of the log10 of
these averages.

Documents are dealt out in chunks by the hash of id and text. A word has a
number, by the bucket of its hash and, within that, by how frequent it is; words
live in their buckets, where the root seats them. Contexts live in buckets by
the hash of their number; those with HOT or more words after them are split by
the next word, and their tables are summed over the parts. A chunk sends its
distinct pairs of context and word with their training counts, and gets back a
log probability for each, in the order in which it asked. What is shuffled
grows with the chunks' distinct pairs, beside the texts.

Defined results: a null or blank text is one end token. A null id is held out,
if the train column says so for it. Without training text no word is known and
the model is the uniform spelling. Repeated rows are scored each, and train
each. Empty tables give empty results. Columns other than id and text are
ignored. Ties don't occur; the seed fixes all draws.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .packets import ROW, Inbox, row, superstep, table, write
from .store import Scratch

ORDER, SAMPLES, BURN_IN, APART, ROUNDS = 2, 3, 3, 1, 1
CONTEXT_DISCOUNT, CONTEXT_STRENGTH = 0.8, 1.0
WORD_DISCOUNT, WORD_STRENGTH = 0.7, 10.0
SPELL_DISCOUNT, SPELL_STRENGTH = 0.4, 1.0
#: Customers of a dish up to which Stirling numbers are exact.
SMALL = 1024
#: Training tokens after a context from which it is split.
HOT = 1 << 19
CHUNK_BYTES, BUCKET_BYTES = 6 << 20, 24 << 20
#: Dishes times tables drawn at once.
DRAWN = 1 << 19
U64 = tokens.U64
WORDS, LEXICON, NAMES, PAIRS, CONTEXTS, ASKED, TABLES, ROOT, CELLS, BASE, SEATED, HOT_SUM, LOGS = range(13)
CELL_PARTS = 16


@functools.cache
def stirling_ratios(discount: float) -> np.ndarray:
    """At c, t - 1: log of the ways of c customers to sit at t + 1 tables by those to sit at t (generalised Stirling numbers); -inf where there is none."""
    ways, out = np.zeros(1), np.full((SMALL + 1, SMALL - 1), -np.inf, np.float32)
    for c in range(1, SMALL):
        with np.errstate(divide="ignore"):
            ways = np.logaddexp(np.r_[-np.inf, ways], np.r_[ways, -np.inf] + np.log(np.maximum(c - discount * np.arange(1, c + 2), 1e-300)))
        out[c + 1, :c] = np.diff(ways)
    return out


@functools.cache
def asymptotic_ratios(discount: float) -> tuple[np.ndarray, np.ndarray]:
    """The same for many customers, times t, as a function of log(c / t): pairs to interpolate between.

    By the saddle point z of the generating function f(z) ** t / t!, f(z) = (1 - (1 - z) ** d) / d: the ratio
    nears f(z) / t, where z f'(z) / f(z) = c / t.
    """
    s = -np.geomspace(1e-9, 700, 8192)  # log(1 - z)
    f = np.log(-np.expm1(discount * s) / discount)
    return np.log(-np.expm1(s)) + (discount - 1) * s - f, f


class Seating:
    """Customers of many dishes, and how many tables each dish has."""

    def __init__(self, customers: np.ndarray, discount: float, rng: np.random.Generator):
        self.discount, self.rng = discount, rng
        self.customers = customers.astype(np.int64)
        self.tables = (self.customers > 0).astype(np.int64)
        small = np.flatnonzero((self.customers > 1) & (self.customers <= SMALL))
        self._small = small[np.argsort(self.customers[small], kind="stable")]
        self._large = np.flatnonzero(self.customers > SMALL)

    def sweep(self, strength: np.ndarray, p: np.ndarray) -> None:
        """All customers are seated again. strength: of each dish, that of a new table in its restaurant without the dish's own tables; p: the parent's probability of the dish."""
        ratios, low = stirling_ratios(self.discount), 0
        size = self.customers[self._small]
        while low < len(size):
            high = min(low + max(1, DRAWN // int(size[low])), len(size))
            high = min(low + max(1, DRAWN // int(size[high - 1])), len(size))
            own, width = self._small[low:high], int(size[high - 1])
            with np.errstate(divide="ignore"):
                each = np.log(strength[own][:, None] + self.discount * np.arange(1, width)) + np.log(p[own])[:, None]
            self._draw(own, np.ones(len(own), np.int64), ratios[size[low:high], : width - 1] + each)
            low = high
        if len(self._large):
            self._sweep_large(strength[self._large], p[self._large])

    def _draw(self, dishes: np.ndarray, least: np.ndarray, steps: np.ndarray) -> None:
        """Draws tables from the least upwards; steps: log of the weight of one table more by that of so many."""
        weight = np.cumsum(steps, axis=1)
        top = np.maximum(0.0, weight.max(1, initial=0.0))
        ends = np.exp(-top)[:, None] + np.concatenate([np.zeros((len(dishes), 1)), np.cumsum(np.exp(weight - top[:, None]), axis=1)], axis=1)
        drawn = self.rng.random(len(dishes)) * ends[:, -1]
        self.tables[dishes] = least + (ends[:, :-1] <= drawn[:, None]).sum(1)

    def _sweep_large(self, strength: np.ndarray, p: np.ndarray) -> None:
        """Large dishes: as in sweep, within a window around the likeliest number of tables, and by asymptotic ratios."""
        customers = self.customers[self._large].astype(np.float64)
        p = np.maximum(p, 1e-300)
        known, logs = asymptotic_ratios(self.discount)

        def step(c: np.ndarray, t: np.ndarray, s: np.ndarray, p: np.ndarray) -> np.ndarray:
            t = np.minimum(t, c - 1)
            return np.interp(np.log(c / t), known, logs) - np.log(t) + np.log((s + self.discount * t) * p)

        low, high = np.ones(len(customers)), customers - 1
        for _ in range(64):  # more tables get less and less likely
            middle = np.sqrt(low * high)
            up = step(customers, middle, strength, p) > 0
            low, high = np.where(up, middle, low), np.where(up, high, middle)
        mode = np.floor(low)
        ahead = np.maximum(1.0, mode / 50)
        bend = (step(customers, mode, strength, p) - step(customers, mode + ahead, strength, p)) / ahead
        reach = np.ceil(8 / np.sqrt(np.maximum(bend, 1e-12))) + 8
        reach = np.minimum(reach, customers).astype(np.int64)
        order, at = np.argsort(reach, kind="stable"), 0
        while at < len(order):
            width = 2 * int(reach[order[at]])
            own = order[at : at + max(1, DRAWN // width)]
            width = 2 * int(reach[own[-1]])
            own = own[: max(1, DRAWN // width)]
            width = 2 * int(reach[own[-1]])
            least = np.maximum(1, mode[own] - width // 2)
            t = least[:, None] + np.arange(width)
            steps = step(customers[own][:, None], t, strength[own][:, None], p[own][:, None])
            self._draw(self._large[own], least.astype(np.int64), np.where(t < customers[own][:, None], steps, -np.inf))
            at += len(own)


@dataclass
class Spelling:
    """Of each order, the dishes (context and next byte) and contexts, with one column for each sample."""

    keys: list[np.ndarray]
    seated: list[np.ndarray]  # customers - discount * tables
    contexts: list[np.ndarray]
    total: list[np.ndarray]  # strength + customers
    spare: list[np.ndarray]  # strength + discount * tables

    def probabilities(self, keys: np.ndarray) -> np.ndarray:
        """Of each context and next byte (the last in the lowest byte), by sample."""
        p = np.full((len(keys), SAMPLES), 1 / 256)
        for k in range(len(self.keys)):
            own = keys & U64((1 << (8 * (k + 1))) - 1)
            at = np.minimum(np.searchsorted(self.contexts[k], own >> U64(8)), len(self.contexts[k]) - 1)
            known = np.flatnonzero(self.contexts[k][at] == own >> U64(8))
            at, own = at[known], own[known]
            dish = np.minimum(np.searchsorted(self.keys[k], own), len(self.keys[k]) - 1)
            served = np.where((self.keys[k][dish] == own)[:, None], self.seated[k][dish], 0)
            p[known] = (served + self.spare[k][at] * p[known]) / self.total[k][at]
        return p

    def word_logs(self, spelled: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Log of what the base measure gives each word, by sample; long words have less than a float can hold."""
        keys, word = spelling_keys(spelled, sizes)
        distinct, number = np.unique(keys, return_inverse=True)
        logs = np.log(self.probabilities(distinct))
        return np.stack([np.bincount(word, logs[number, s], len(sizes)) for s in range(SAMPLES)], 1)


def seat_spelling(keys: np.ndarray, counts: np.ndarray, seed: int) -> Spelling:
    """Gibbs samples of the spelling restaurants. keys: sorted contexts of ORDER bytes and a next byte; counts: customers of each."""
    rng = np.random.default_rng(seed)
    if not len(keys):
        return Spelling([], [], [], [], [])
    levels, up, of_context, contexts = ([None] * (ORDER + 1) for _ in range(4))
    levels[ORDER] = keys
    for k in range(ORDER, -1, -1):
        contexts[k], of_context[k] = np.unique(levels[k] >> U64(8), return_inverse=True)
        if k:
            levels[k - 1], up[k] = np.unique(levels[k] & U64((1 << (8 * k)) - 1), return_inverse=True)
    d, strength = SPELL_DISCOUNT, SPELL_STRENGTH
    seats: list[Seating | None] = [None] * (ORDER + 1)
    tables_of = lambda k: np.bincount(of_context[k], seats[k].tables, len(contexts[k]))
    customers_of = lambda k: np.bincount(of_context[k], seats[k].customers, len(contexts[k]))

    def below(k: int) -> np.ndarray:
        """Parent probabilities of the dishes of order k."""
        p = np.full(len(levels[0]), 1 / 256)
        for j in range(k):
            s, of = seats[j], of_context[j]
            p = ((s.customers - d * s.tables + (strength + d * tables_of(j)[of]) * p) / (strength + customers_of(j))[of])[up[j + 1]]
        return p

    customers, kept = counts, [[], [], []]
    for k in range(ORDER, -1, -1):
        seats[k] = Seating(customers, d, rng)
        if k:
            customers = np.bincount(up[k], seats[k].tables, len(levels[k - 1]))
    for i in range(BURN_IN + APART * SAMPLES):
        for k in range(ORDER, -1, -1):
            if k < ORDER:
                had = seats[k].tables
                seats[k] = Seating(np.bincount(up[k + 1], seats[k + 1].tables, len(levels[k])), d, rng)
                seats[k].tables = np.clip(had, seats[k].tables, seats[k].customers)
            for _ in range(1 if k == ORDER else 2):
                seats[k].sweep(strength + d * (tables_of(k)[of_context[k]] - seats[k].tables), below(k))
        if i >= BURN_IN and (i - BURN_IN) % APART == APART - 1:
            kept[0].append([s.customers - d * s.tables for s in seats])
            kept[1].append([strength + customers_of(k) for k in range(ORDER + 1)])
            kept[2].append([strength + d * tables_of(k) for k in range(ORDER + 1)])
    stacked = [[np.stack([one[k] for one in part], 1).astype(np.float32) for k in range(ORDER + 1)] for part in kept]
    return Spelling(levels, stacked[0], contexts, stacked[1], stacked[2])


def spelling_keys(spelled: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every byte of every word and its end: the ORDER bytes before it and it, and the word. Spaces stand before and after a word."""
    ends = np.cumsum(sizes + ORDER + 1)
    data = np.full(int(ends[-1]) if len(ends) else 0, 32, U64)
    word = np.repeat(np.arange(len(sizes)), sizes + ORDER + 1)
    inside = np.arange(len(data)) - (ends - sizes - ORDER - 1)[word]
    data[(inside >= ORDER) & (inside < (sizes + ORDER)[word])] = spelled
    key = np.zeros(len(data), U64)
    for j in range(ORDER + 1):
        key[j:] |= data[: len(data) - j] << U64(8 * j)
    own = inside >= ORDER
    return key[own], word[own]


def _bytes_of(spelled: np.ndarray, sizes: np.ndarray, some: np.ndarray) -> np.ndarray:
    """The bytes of some words of many."""
    start, size = (np.cumsum(sizes) - sizes)[some], sizes[some]
    return spelled[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def _ints(packed: bytes, n: int) -> np.ndarray:
    return tokens.unpack(packed, n).astype(np.int64)


class Chunk:
    """The texts of a chunk as tokens, and its distinct words in the order of their hashes. The first of these is the empty word."""

    def __init__(self, docs: pa.Table):
        self.docs = docs.combine_chunks()
        words = tokens.cut(self.docs.column("text"), lower=True)
        hashed = tokens.hash_words(words)
        self.n, self.count = len(words.count), words.count
        self.train = self.docs.column("train").to_numpy(zero_copy_only=False).astype(bool)
        token = np.zeros(len(hashed) + self.n, U64)
        token[np.arange(len(hashed)) + words.doc] = hashed
        self.doc = np.repeat(np.arange(self.n), self.count + 1)
        self.hashes, first, self.of = np.unique(np.r_[U64(0), token], return_index=True, return_inverse=True)
        self.of = self.of[1:]
        place = np.r_[-1, np.where(np.r_[self.doc[1:] != self.doc[:-1], True], -1, np.arange(len(token)) - self.doc)][first]
        place[0] = -1
        self.sizes = np.where(place >= 0, (words.stop - words.start)[np.maximum(place, 0)] if len(hashed) else 0, 0)
        self._start = np.where(place >= 0, words.start[np.maximum(place, 0)] if len(hashed) else 0, 0)
        self._data = words.data

    def edges(self, buckets: int) -> np.ndarray:
        """Where the words of each bucket start."""
        return np.array([0, len(self.hashes)]) if buckets == 1 else np.searchsorted(self.hashes >> U64(64 - (buckets.bit_length() - 1)), np.arange(buckets + 1, dtype=U64))

    def spelled(self, low: int, high: int) -> np.ndarray:
        size = self.sizes[low:high]
        return self._data[np.repeat(self._start[low:high] - (np.cumsum(size) - size), size) + np.arange(size.sum())]

    def named(self, names: Inbox, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The number and the training count of each distinct word."""
        number, count = np.zeros(len(self.hashes), U64), np.zeros(len(self.hashes), np.int64)
        edges = self.edges(buckets)
        for r in names.rows.get(NAMES, ()):
            own = slice(edges[r["source"]], edges[r["source"] + 1])
            number[own] = tokens.unpack(r["a"], r["n"]) * U64(buckets) + U64(r["source"])
            count[own] = _ints(r["b"], r["n"])
        if len(number) and int(number.max()) >> 32:
            raise OverflowError("words have numbers beyond 2 ** 32, so a pair of them no longer fits into 64 bits")
        return number, count

    def pairs(self, number: np.ndarray, count: np.ndarray, buckets: int) -> Pairs:
        before = np.r_[0, self.of[:-1]]  # what stands before a text's first word is the end of another, the empty word
        key, of = np.unique(number[before] << U64(32) | number[self.of], return_inverse=True)
        uses = np.bincount(of, self.train[self.doc], len(key)).astype(np.int64)
        after = np.zeros(len(key), np.int64)
        after[of] = count[before]
        context, word = key >> U64(32), key & U64(0xFFFFFFFF)
        share = tokens.mix(word.copy()) % (after // HOT + 1).astype(U64)
        bucket = (tokens.mix(context ^ share << U64(40)) & U64(buckets - 1)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return Pairs(key[order], uses[order], after[order], np.searchsorted(bucket[order], np.arange(buckets + 1)), place[of])


@dataclass
class Pairs:
    """Distinct pairs of context and word, by bucket: the context's number in the upper half of the key; training uses, those of the context; where buckets start; and the pair of each token."""

    key: np.ndarray
    uses: np.ndarray
    after: np.ndarray
    edges: np.ndarray
    of: np.ndarray


def _pack_pairs(key: np.ndarray, uses: np.ndarray, after: np.ndarray) -> tuple[bytes, ...]:
    """Sorted pairs: contexts, how many words follow each, the words, their uses, and the contexts' uses."""
    context = key >> U64(32)
    start = np.flatnonzero(np.r_[np.ones(min(1, len(key)), bool), context[1:] != context[:-1]])
    return tokens.pack_sorted(context[start]), tokens.pack(np.diff(np.r_[start, len(key)])), tokens.pack(key & U64(0xFFFFFFFF)), tokens.pack(uses), tokens.pack(after[start])


@dataclass
class Contexts:
    """Sorted pairs of a bucket: keys and uses; contexts, the number of each pair's context among them, and all training uses of each."""

    key: np.ndarray
    uses: np.ndarray
    context: np.ndarray
    of: np.ndarray
    after: np.ndarray

    @staticmethod
    def read(r: dict) -> Contexts:
        size = _ints(r["b"], r["count"])
        context = tokens.unpack_sorted(r["a"], r["count"])
        of = np.repeat(np.arange(len(context)), size)
        return Contexts(context[of] << U64(32) | tokens.unpack(r["c"], r["n"]), _ints(r["d"], r["n"]), context, of, _ints(r["e"], r["count"]))

    def words(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct words, by bucket and place in it: these two, the number of each pair's word among them, and where buckets start."""
        word = self.key & U64(0xFFFFFFFF)
        distinct, of = np.unique((word % U64(buckets)) << U64(32) | word // U64(buckets), return_inverse=True)
        bucket = (distinct >> U64(32)).astype(np.int64)
        return bucket, distinct & U64(0xFFFFFFFF), of, np.searchsorted(bucket, np.arange(buckets + 1))


def _words(buckets: int):
    """The distinct words of a chunk with their training counts and bytes, to their buckets."""

    def run(docs: pa.Table) -> pa.Table:
        chunk, own = docs.column("chunk")[0].as_py(), Chunk(docs)
        counts = np.bincount(own.of, own.train[own.doc], len(own.hashes)).astype(np.int64)
        edges = own.edges(buckets)
        return table([row(b, WORDS, high - low, tokens.pack_sorted(own.hashes[low:high]), tokens.pack(counts[low:high]), tokens.pack(own.sizes[low:high]), own.spelled(low, high), source=chunk) for b, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if high > low])

    return run


def _number_words(inbox: Inbox) -> list[tuple]:
    """Of a bucket, the words, frequent ones first; and to each chunk the places and counts of its words."""
    rows = inbox.rows[WORDS]
    hashes = [tokens.unpack_sorted(r["a"], r["n"]) for r in rows]
    _, first, of = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    counts = np.bincount(of, np.concatenate([_ints(r["b"], r["n"]) for r in rows])).astype(np.int64)
    sizes = np.concatenate([_ints(r["c"], r["n"]) for r in rows])
    order = np.argsort(-counts, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    spelled = _bytes_of(inbox.of(WORDS, "d", np.uint8), sizes, first[order])
    out = [row(inbox.bundle, LEXICON, len(order), tokens.pack(counts[order]), tokens.pack(sizes[first[order]]), spelled, source=(counts > 0).sum(), count=counts.sum())]
    ends = np.cumsum([0, *map(len, hashes)])
    for r, low, high in zip(rows, ends[:-1], ends[1:], strict=True):
        own = of[low:high]
        out.append(row(r["source"], NAMES, r["n"], tokens.pack(place[own]), tokens.pack(counts[own]), source=inbox.bundle))
    return out


def _pairs(buckets: int):
    """The distinct pairs of a chunk, to the buckets of their contexts."""

    def run(docs: pa.Table, names: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return table([])
        chunk, own = docs.column("chunk")[0].as_py(), Chunk(docs)
        pairs = own.pairs(*own.named(Inbox(names), buckets), buckets)
        out = []
        for b in np.flatnonzero(np.diff(pairs.edges)):
            s = slice(pairs.edges[b], pairs.edges[b + 1])
            packed = _pack_pairs(pairs.key[s], pairs.uses[s], pairs.after[s])
            out.append(row(b, PAIRS, s.stop - s.start, *packed, source=chunk, count=len(np.unique(pairs.key[s] >> U64(32)))))
        return table(out)

    return run


def _tables_up(bundle: int, contexts: Contexts, seated: np.ndarray, buckets: int) -> list[tuple]:
    """The tables of each word, summed over a bucket's contexts, as customers of the root; seated: by sample."""
    _, place, of, edges = contexts.words(buckets)
    total = np.stack([np.bincount(of, seated[:, s], len(place)) for s in range(seated.shape[1])], 1).astype(np.int64)
    return [row(b, TABLES, edges[b + 1] - edges[b], tokens.pack_sorted(place[edges[b] : edges[b + 1]]), tokens.pack(total[edges[b] : edges[b + 1]].ravel()), source=bundle) for b in np.flatnonzero(np.diff(edges))]


def _gather(buckets: int):
    """The distinct pairs of a bucket; which of them each chunk asks for; and as first seating one table for each."""

    def run(inbox: Inbox) -> list[tuple]:
        read = [Contexts.read(r) for r in inbox.rows[PAIRS]]
        key, of = np.unique(np.concatenate([c.key for c in read]), return_inverse=True)
        uses = np.bincount(of, np.concatenate([c.uses for c in read]), len(key)).astype(np.int64)
        after = np.zeros(len(key), np.int64)
        after[of] = np.concatenate([c.after[c.of] for c in read])
        packed = _pack_pairs(key, uses, after)
        state = row(inbox.bundle, CONTEXTS, len(key), *packed, count=len(np.unique(key >> U64(32))))
        ends = np.cumsum([0, *(len(c.key) for c in read)])
        asked = [row(inbox.bundle, ASKED, high - low, tokens.pack(of[low:high]), source=r["source"]) for r, low, high in zip(inbox.rows[PAIRS], ends[:-1], ends[1:], strict=True)]
        contexts = Contexts(key, uses, *np.unique(key >> U64(32), return_inverse=True), after)
        return [state, *asked, *_tables_up(inbox.bundle, contexts, (uses > 0)[:, None], buckets)]

    return run


@dataclass
class Shared:
    """What all buckets of words need: the spelling, and by sample all customers and tables of the root."""

    spelling: Spelling
    customers: np.ndarray
    tables: np.ndarray


def _seat_root(shared, seed: int):
    """Seats the tables of all contexts as customers of the root; before there is a spelling, each word at one table.

    Root tables are sent, spelled out, as customers of the spelling restaurants.
    """

    def run(inbox: Inbox) -> list[tuple]:
        if LEXICON not in inbox.rows:
            return []
        (words,) = inbox.rows[LEXICON]
        n, known = words["n"], shared.value
        sizes, spelled = _ints(words["b"], n), np.frombuffer(words["c"], np.uint8)
        messages = inbox.rows.get(TABLES, [])
        width = 1 if known is None else SAMPLES
        customers = np.zeros((n, width), np.int64)
        for r in messages:
            customers[tokens.unpack_sorted(r["a"], r["n"]).astype(np.int64)] += _ints(r["b"], r["n"] * width).reshape(-1, width)
        tables = (customers > 0).astype(np.int64)
        if known is not None:
            rng = np.random.default_rng([seed, inbox.bundle])
            logs = known.spelling.word_logs(spelled, sizes)
            for s in range(SAMPLES):
                seats = Seating(customers[:, s], WORD_DISCOUNT, rng)
                others = known.tables[min(s, len(known.tables) - 1)]
                for _ in range(BURN_IN):
                    seats.sweep(WORD_STRENGTH + WORD_DISCOUNT * (others - seats.tables), np.exp(logs[:, s]))
                tables[:, s] = seats.tables
        out = inbox.kept(LEXICON)
        out.append(row(inbox.bundle, ROOT, n, tokens.pack(customers.ravel()), tokens.pack(tables.ravel()), np.stack([customers.sum(0), tables.sum(0)]).astype(np.int64)))
        out += [row(inbox.bundle, ASKED, r["n"], r["a"], source=r["source"]) for r in messages]
        keys, word = spelling_keys(spelled, sizes)
        times = tables[word, -1]
        distinct, number = np.unique(keys[times > 0], return_inverse=True)
        return out + _cells(distinct, np.bincount(number, times[times > 0], len(distinct)).astype(np.int64))

    return run


def _cells(keys: np.ndarray, counts: np.ndarray) -> list[tuple]:
    part = (tokens.mix(keys.copy()) % U64(CELL_PARTS)).astype(np.int64)
    return [row(p, CELLS, (part == p).sum(), tokens.pack_sorted(keys[part == p]), tokens.pack(counts[part == p])) for p in np.unique(part)]


def _sum_cells(inbox: Inbox) -> list[tuple]:
    keys = np.concatenate([tokens.unpack_sorted(r["a"], r["n"]) for r in inbox.rows[CELLS]])
    counts = np.concatenate([_ints(r["b"], r["n"]) for r in inbox.rows[CELLS]])
    distinct, number = np.unique(keys, return_inverse=True)
    total = np.bincount(number, counts, len(distinct)).astype(np.int64)
    return [row(inbox.bundle, CELLS, len(distinct), tokens.pack_sorted(distinct), tokens.pack(total))]


def learn_shared(read: Callable[..., DataFrame], seed: int) -> Shared:
    """The spelling restaurants of all root tables; there are at most 256 ** (ORDER + 1) dishes to collect."""
    width = SAMPLES
    rows = superstep(read(CELLS), _sum_cells).collect()
    keys = np.concatenate([np.zeros(0, U64), *(tokens.unpack_sorted(r["a"], r["n"]) for r in rows)])
    counts = np.concatenate([np.zeros(0, np.int64), *(_ints(r["b"], r["n"]) for r in rows)])
    by_key = np.argsort(keys)
    totals = read(ROOT).select("c").mapInArrow(_add_totals, "at int, total long").groupBy("at").agg(F.sum("total").alias("total")).orderBy("at").collect()
    totals = np.array([r["total"] for r in totals] or [0] * 2 * width, np.float64).reshape(2, -1)
    return Shared(seat_spelling(keys[by_key], counts[by_key], seed), totals[0], totals[1])


def _add_totals(batches):
    for batch in batches:
        for r in batch.to_pylist():
            total = np.frombuffer(r["c"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["at", "total"])


def _base(shared):
    """To each bucket of contexts, the log of the root's probability of its words, by sample."""

    def run(inbox: Inbox) -> list[tuple]:
        known = shared.value
        if LEXICON not in inbox.rows:
            return []
        (words,), (root,) = inbox.rows[LEXICON], inbox.rows[ROOT]
        n = words["n"]
        logs = known.spelling.word_logs(np.frombuffer(words["c"], np.uint8), _ints(words["b"], n))
        width = len(known.tables)
        customers, tables = (_ints(root[c], n * width).reshape(n, width) for c in ("a", "b"))
        with np.errstate(divide="ignore"):
            p = np.logaddexp(np.log(customers - WORD_DISCOUNT * tables), np.log(WORD_STRENGTH + WORD_DISCOUNT * known.tables) + logs[:, :width]) - np.log(WORD_STRENGTH + known.customers)
        return [row(r["source"], BASE, r["n"], p[tokens.unpack_sorted(r["a"], r["n"]).astype(np.int64)].astype(np.float32), source=inbox.bundle) for r in inbox.rows.get(ASKED, ())]

    return run


def _log_base(inbox: Inbox, contexts: Contexts, buckets: int, width: int) -> np.ndarray:
    """Of each pair, the log of the root's probability of its word, by sample."""
    return inbox.of(BASE, "a", np.float32, width)[contexts.words(buckets)[2]].astype(np.float64)


def _seat_contexts(buckets: int, width: int, seed: int):
    """Seats the customers of a bucket's contexts. Of a context that is split, the tables elsewhere are taken to be as many for each customer as here."""

    def run(inbox: Inbox) -> list[tuple]:
        (state,) = inbox.rows[CONTEXTS]
        contexts = Contexts.read(state)
        p = np.exp(_log_base(inbox, contexts, buckets, width)).mean(1)
        n = len(contexts.context)
        seats = Seating(contexts.uses, CONTEXT_DISCOUNT, np.random.default_rng([seed, inbox.bundle]))
        split = contexts.after >= HOT
        scale = np.where(split, contexts.after / np.maximum(1, np.bincount(contexts.of, contexts.uses, n)), 1.0)
        kept = []
        for i in range(BURN_IN + APART * SAMPLES):
            total = np.bincount(contexts.of, seats.tables, n) * scale
            seats.sweep(CONTEXT_STRENGTH + CONTEXT_DISCOUNT * (total[contexts.of] - seats.tables), p)
            if i >= BURN_IN and (i - BURN_IN) % APART == APART - 1:
                kept.append(seats.tables.copy())
        tables = np.stack(kept, 1)
        out = [row(inbox.bundle, SEATED, len(tables), tokens.pack(tables.ravel()))]
        for at in np.flatnonzero(split):
            context = contexts.context[at : at + 1]
            here = tables[contexts.of == at].sum(0)
            out.append(row(int((tokens.mix(context.copy()) & U64(buckets - 1))[0]), HOT_SUM, 1, context, here.astype(np.int64), source=inbox.bundle))
        return out + _tables_up(inbox.bundle, contexts, tables, buckets)

    return run


def _sum_hot(inbox: Inbox) -> list[tuple]:
    """To each part of a split context, the tables of all parts."""
    context, tables = inbox.of(HOT_SUM, "a", U64), inbox.of(HOT_SUM, "b", np.int64, SAMPLES)
    _, of = np.unique(context, return_inverse=True)
    total = np.stack([np.bincount(of, tables[:, s]) for s in range(SAMPLES)], 1)[of].astype(np.int64)
    return [row(r["source"], HOT_SUM, 1, r["a"], total[i], source=inbox.bundle) for i, r in enumerate(inbox.rows[HOT_SUM])]


def _answer(buckets: int):
    """To each chunk, the log10 of the averaged probabilities of the pairs that it asked for."""

    def run(inbox: Inbox) -> list[tuple]:
        if CONTEXTS not in inbox.rows:
            return []
        (state,), (seated,) = inbox.rows[CONTEXTS], inbox.rows[SEATED]
        contexts = Contexts.read(state)
        tables = _ints(seated["a"], seated["n"] * SAMPLES).reshape(-1, SAMPLES)
        base = _log_base(inbox, contexts, buckets, SAMPLES)
        total = np.stack([np.bincount(contexts.of, tables[:, s], len(contexts.context)) for s in range(SAMPLES)], 1)
        total[np.searchsorted(contexts.context, inbox.of(HOT_SUM, "a", U64))] = inbox.of(HOT_SUM, "b", np.int64, SAMPLES)
        each = np.empty((SAMPLES, len(contexts.key)))
        with np.errstate(divide="ignore"):
            for s in range(SAMPLES):
                spare = np.log(CONTEXT_STRENGTH + CONTEXT_DISCOUNT * total[:, s])
                each[s] = np.logaddexp(np.log(contexts.uses - CONTEXT_DISCOUNT * tables[:, s]), spare[contexts.of] + base[:, s])
        logs = np.logaddexp.reduce(each, 0) - np.log(SAMPLES) - np.log(CONTEXT_STRENGTH + contexts.after)[contexts.of]
        logs = (logs / np.log(10)).astype(np.float32)
        return [row(r["source"], LOGS, r["n"], logs[_ints(r["a"], r["n"])], source=inbox.bundle) for r in inbox.rows[ASKED]]

    return run


RESULT = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}


def _score(n_tokens: int, n_types: int, buckets: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({c: pa.array([], t) for c, t in RESULT.items()})
        own, inbox = Chunk(docs), Inbox(answers)
        number, count = own.named(inbox, buckets)
        pairs = own.pairs(number, count, buckets)
        logs = inbox.of(LOGS, "a", np.float32).astype(np.float64)[pairs.of]
        uses = count[own.of]
        plain = np.log10((uses + 0.1) / (n_tokens + 0.1 * (n_types + 1)))
        values = (own.docs.column("doc_id"), ~own.train, own.count + 1, np.bincount(own.doc, uses > 0, own.n).astype(np.int64), np.bincount(own.doc, plain, own.n), np.bincount(own.doc, logs, own.n))
        return pa.table({c: v if isinstance(v, pa.ChunkedArray) else pa.array(v, t) for (c, t), v in zip(RESULT.items(), values, strict=True)})

    return run


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """One row (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each document.

    train: whether a document is learned from. score is the model's log10
    probability of the text, base_score that of a smoothed unigram.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    bytes_ = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    chunks = int(bytes_ // CHUNK_BYTES) + 1
    buckets = 1 << int(bytes_ // BUCKET_BYTES).bit_length()
    dealt = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
    words = write(scratch, superstep(dealt.groupBy("chunk").applyInArrow(_words(buckets), ROW), _number_words), "words")
    total = words(LEXICON).agg(F.sum("source").alias("types"), F.sum("count").alias("tokens")).first()
    n_types, n_tokens = int(total["types"] or 0), int(total["tokens"] or 0)
    asked = dealt.groupBy("chunk").cogroup(words(NAMES).groupBy("bundle")).applyInArrow(_pairs(buckets), ROW)
    pairs = write(scratch, superstep(asked, _gather(buckets)), "pairs")
    root = write(scratch, superstep(words(LEXICON).union(pairs(TABLES)), _seat_root(spark.sparkContext.broadcast(None), seed)), "root0")
    shared, width = learn_shared(root, seed), 1
    base = superstep(root(LEXICON, ROOT, ASKED), _base(spark.sparkContext.broadcast(shared)))
    for i in range(1, ROUNDS + 1):
        seated = write(scratch, superstep(pairs(CONTEXTS).union(base), _seat_contexts(buckets, width, seed + i)), f"seated{i}")
        root = write(scratch, superstep(words(LEXICON).union(seated(TABLES)), _seat_root(spark.sparkContext.broadcast(shared), seed + i)), f"root{i}")
        scratch.drop(f"root{i - 1}", f"seated{i - 1}")
        shared, width = learn_shared(root, seed + i), SAMPLES
        base = superstep(root(LEXICON, ROOT, ASKED), _base(spark.sparkContext.broadcast(shared)))
    hot = superstep(seated(HOT_SUM), _sum_hot)
    state = pairs(CONTEXTS, ASKED).union(seated(SEATED)).union(base).union(hot)
    logs = write(scratch, superstep(state, _answer(buckets)), "logs")
    scratch.drop("pairs", f"seated{ROUNDS}", f"root{ROUNDS}")
    out = dealt.groupBy("chunk").cogroup(words(NAMES).union(logs(LOGS)).groupBy("bundle")).applyInArrow(_score(n_tokens, n_types, buckets), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
