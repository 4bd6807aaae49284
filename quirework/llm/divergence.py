"""Source divergence audit: how far the sources of a language differ in their words.

Two passes over the texts. The first counts, for each language, in how many
documents each term occurs; terms of at least ``min_docs`` documents are kept.
The second recounts occurrences of kept terms by an Aho-Corasick automaton: in
texts whose delimiters are single spaces, with one before and after, each kept
term padded by a space on both sides is found wherever it stands as a whole
term. Counts are postings, a row for each source of a language and kept term
that occurs there; whatever doesn't occur is implied.

A term's share is ``1 + floor(10**9 * (count + 5) / (N + 5 * V))``, with N the
group's occurrences and V the language's kept terms; integers only. Two sources
differ by the sum of absolute differences over all kept terms. A term in neither
gives the difference of the two shares of a term that is absent, so that sum is
V times this, corrected by postings: for a term in one of them only by its
place among the other's constants, for a term in both pair by pair of one
term's postings. The work for it is dealt out by a hash of the term and by
tiles of 256 sources.

Texts are read in slices of about 4 MB, and counts are summed within a task, so a
hot source or a very common term is one number a task; occurrences travel as packed
arrays of up to 4096 terms of a group. The kept terms are cut into
blocks of at most BLOCK bytes by a hash (a block with a single longer term is
larger); one block at a time is collected and sent to all tasks, which then scan
all texts. All else stays distributed.

Defined results: a null text, lang or source is the empty one. A text without
terms counts for nothing, but its group has a row for each other source of its
language. A language without kept terms has differences of 0. An empty table
gives an empty result. Columns other than the named ones are ignored, rows that
share an id are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .store import Scratch

#: Bytes of text counted at once, bytes of terms in one automaton, sources of a tile, postings compared in one task (about).
SLICE, BLOCK, TILE, TASK = 4 << 20, 16 << 20, 256, 250_000
#: Bytes of counts that a task holds before it sends them, terms whose counts travel together, and tasks whose counts of these are added up first.
HELD, PART, FIRST = 8 << 20, 4096, 4096
UNIT, PRIOR = 1_000_000_000, 5
_FREQUENCY = "lang string, term string, docs long"
_PACKED = "lang string, source string, part int, n int, ids binary, counts binary"
_SHARE = "lang string, a int, b int, value long"
#: A-Z as a-z, every other ASCII byte but letters as a space.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def _texts(documents: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    named = {"text": text_col, "lang": lang_col, "source": source_col}
    return documents.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for n, c in named.items()])


def _terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct terms of some texts; of each occurrence, its text's place and its term's."""
    words = tokens.cut(texts, lower=True, letters=True)
    size = words.stop - words.start
    ends = np.cumsum(size)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(words.start - (ends - size), size)
    solid = pa.py_buffer(words.data[at].tobytes())
    offsets = pa.py_buffer(np.r_[0, ends].astype(np.int64))
    found = pa.Array.from_buffers(pa.large_utf8(), len(size), [None, offsets, solid]).dictionary_encode()
    return found.dictionary, words.doc, found.indices.to_numpy()


def _document_frequencies(size: int, held: int):
    def one(part: pa.RecordBatch) -> pa.Table:
        distinct, doc, term = _terms(part.column("text"))
        langs = part.column("lang").dictionary_encode()
        n = max(1, len(distinct))
        pairs = np.unique(doc * n + term)
        found, docs = np.unique(langs.indices.to_numpy()[pairs // n].astype(np.int64) * n + pairs % n, return_counts=True)
        return pa.table({"lang": langs.dictionary.take(pa.array(found // n)), "term": pc.cast(distinct.take(pa.array(found % n)), pa.string()), "docs": pa.array(docs, pa.int64())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list[pa.Table] = []
        for part in (part for batch in batches for part in tokens.slices(batch, "text", size)):
            now.append(one(part))
            if sum(t.nbytes for t in now) > held:
                now = [_summed(now)]
                if now[0].nbytes > held // 2:
                    yield from now.pop().to_batches()
        if now:
            yield from _summed(now).to_batches()

    return count


def _summed(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by(["lang", "term"]).aggregate([("docs", "sum")]).rename_columns({"docs_sum": "docs"}).select(["lang", "term", "docs"])


def kept_terms(texts: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term) of at least min_docs documents of the language."""
    return texts.select("text", "lang").mapInArrow(_document_frequencies(SLICE, HELD), _FREQUENCY).groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).select("lang", "term")


@lru_cache(maxsize=1)
def _automata(block: Broadcast) -> dict[str, tuple[ahocorasick.Automaton, list[str]]]:
    """By language. Bytes stand as one character each, so nothing need be decoded. A worker keeps those of one block."""
    out = {}
    for lang, terms in block.value.items():
        automaton = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            automaton.add_word(f" {term.encode().decode('latin-1')} ", i)
        automaton.make_automaton()
        out[lang] = automaton, terms
    return out


def _totals(ids: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids, ascending, and the sums of their counts."""
    i, n = np.concatenate(ids), np.concatenate(counts)
    order = np.argsort(i, kind="stable")
    i, n = i[order], n[order]
    start = np.flatnonzero(np.r_[len(i) > 0, i[1:] != i[:-1]])
    return i[start], np.add.reduceat(n, start) if len(start) else n


def _packed(groups: dict[tuple[str, str], list[tuple[np.ndarray, np.ndarray]]]) -> pa.RecordBatch:
    """Counts of each group as packed arrays of the terms of one part."""
    rows = []
    for (lang, source), found in groups.items():
        ids, counts = _totals(*map(list, zip(*found, strict=True)))
        edges = np.r_[np.flatnonzero(np.r_[True, ids[1:] // PART != ids[:-1] // PART]), len(ids)]
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            rows.append((lang, source, int(ids[low]) // PART, high - low, tokens.pack_sorted(ids[low:high]), tokens.pack(counts[low:high])))
    columns = list(zip(*rows, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["lang", "source", "part", "n", "ids", "counts"])


def _occurrences(block: Broadcast, size: int, held: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata, groups, waiting = _automata(block), {}, 0
        for part in (part for batch in batches for part in tokens.slices(batch, "text", size)):
            data, at = tokens.raw(part.column("text"))
            plain = data.tobytes().translate(_PLAIN)
            texts: dict[tuple[str, str], list[bytes]] = {}
            for lang, source, low, high in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                if lang in automata and low < high:
                    texts.setdefault((lang, source), []).append(plain[low:high])
            for (lang, source), own in texts.items():
                found = np.fromiter(map(itemgetter(1), automata[lang][0].iter(f" {b' '.join(own).decode('latin-1')} ")), np.int32)
                if len(found):
                    ids, counts = np.unique(found, return_counts=True)
                    groups.setdefault((lang, source), []).append((ids, counts.astype(np.int32)))
                    waiting += 8 * len(ids) + 200
            if waiting > held:
                yield _packed(groups)
                groups, waiting = {}, 0
        if groups:
            yield _packed(groups)

    return count


def _added(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed counts of one group and part, summed one by one."""
    total = np.zeros(PART, np.int64)
    lang, source, part = (k.as_py() for k in key[:3])
    for batch in batches:
        for n, ids, counts in zip(*(batch.column(c).to_pylist() for c in ("n", "ids", "counts")), strict=True):
            total[tokens.unpack_sorted(ids, n).astype(np.int64) - part * PART] += tokens.unpack(counts, n).astype(np.int64)
    ids = np.flatnonzero(total)
    one = [(lang, source, part, len(ids), tokens.pack_sorted(ids + part * PART), tokens.pack(total[ids]))]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*one, strict=True), (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["lang", "source", "part", "n", "ids", "counts"])


def _unpacked(block: Broadcast):
    """Packed counts as one row a term."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = {lang: pa.array(t, pa.string()) for lang, t in block.value.items()}
        for batch in batches:
            for lang, source, n, ids, counts in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "n", "ids", "counts")), strict=True):
                at = pa.array(tokens.unpack_sorted(ids, n).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), terms[lang].take(at), pa.array(tokens.unpack(counts, n).astype(np.int64))], ["lang", "source", "term", "count"])

    return unpack


def _blocks(kept: DataFrame) -> tuple[Column, int]:
    """A block for each term, such that no block has more than BLOCK bytes, and how many there are."""
    size = F.octet_length("term") + F.octet_length("lang") + 16
    total = kept.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    blocks = max(1, -(-total["bytes"] // BLOCK))
    while True:
        block = F.pmod(F.xxhash64("lang", "term"), F.lit(blocks))
        over = kept.groupBy(block.alias("block")).agg(F.sum(size).alias("bytes"), F.count("*").alias("n")).filter((F.col("bytes") > BLOCK) & (F.col("n") > 1))
        if blocks == 1 or over.isEmpty():
            return block, blocks
        blocks *= 2


def postings(texts: DataFrame, kept: DataFrame, scratch: Scratch) -> DataFrame:
    """(lang, source, term, count) of kept terms, where they occur. kept is read once for each block."""
    spark = texts.sparkSession
    block, blocks = _blocks(kept)
    parts = []
    for b in range(blocks):
        terms: dict[str, list[str]] = {}
        rows = kept.filter(block == b).toArrow()
        for lang, term in zip(rows.column("lang").to_pylist(), rows.column("term").to_pylist(), strict=True):
            terms.setdefault(lang, []).append(term)
        sent = spark.sparkContext.broadcast(terms)
        found = texts.filter(F.col("lang").isin(*terms)) if terms else texts.limit(0)
        # In two steps, so that no task adds up all of a hot source.
        packed = found.mapInArrow(_occurrences(sent, SLICE, HELD), _PACKED).withColumn("salt", F.floor(F.spark_partition_id() / FIRST))
        packed = packed.groupBy("lang", "source", "part", "salt").applyInArrow(_added, _PACKED).groupBy("lang", "source", "part").applyInArrow(_added, _PACKED)
        parts.append(scratch.write(packed.mapInArrow(_unpacked(sent), "lang string, source string, term string, count long"), f"postings{b}"))
        sent.unpersist()
    return reduce(DataFrame.union, parts)


def _share(count: Column, total: Column, terms: Column) -> Column:
    wide = (count.cast("decimal(20,0)") + PRIOR) * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", wide, F.greatest(total.cast("decimal(20,0)") + F.lit(PRIOR) * terms.cast("decimal(18,0)"), F.lit(1))) + 1


def _compared(table: pa.Table, size: int) -> pa.Table:
    """Of one block of terms and two tiles, for each pair of sources a < b, what postings add to V times the difference of their constants.

    Rows with a term are postings (source's place, its share); those without name a source and its constant.
    Tiles have size sources.
    """
    place, share = (table.column(c).to_numpy() for c in ("place", "share"))
    term = pc.fill_null(table.column("term").combine_chunks().dictionary_encode().indices, -1).to_numpy()
    tile = table.column("tile_a")[0].as_py(), table.column("tile_b")[0].as_py()
    named = np.sort(place[term < 0])
    constant = np.zeros(len(named), np.int64)
    constant[np.searchsorted(named, place[term < 0])] = share[term < 0]
    used = term >= 0
    order = np.lexsort((place[used], term[used]))
    at, share, term = np.searchsorted(named, place[used][order]), share[used][order], term[used][order]
    m = len(named)
    value = np.zeros((m, m), np.int64)  # [i, j]: of terms of i
    gap = np.abs(constant[:, None] - constant[None, :])
    for i in range(m):
        own = np.sort(share[at == i])
        if len(own):
            sums = np.r_[0, np.cumsum(own)]
            k = np.searchsorted(own, constant)
            value[i] = constant * k - sums[k] + (sums[-1] - sums[k]) - constant * (len(own) - k) - gap[i] * len(own)
    value += value.T
    # Terms in both were taken for terms in one of them, twice.
    for step in range(1, m):
        low = np.flatnonzero(term[step:] == term[:-step]) if len(term) > step else np.zeros(0, np.int64)
        if not len(low):
            break
        i, j = at[low], at[low + step]
        p, q = share[low], share[low + step]
        np.add.at(value, (i, j), np.abs(p - q) - np.abs(p - constant[j]) - np.abs(q - constant[i]) + gap[i, j])
    i, j = np.nonzero(np.triu(np.ones((m, m), bool), 1))
    if tile[0] != tile[1]:
        some = (named[i] // size) != (named[j] // size)
        i, j = i[some], j[some]
    return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(i), pa.string()), "a": pa.array(named[i], pa.int32()), "b": pa.array(named[j], pa.int32()), "value": pa.array(value[i, j], pa.int64())})


def _pairs(shares: DataFrame, sources: DataFrame, rows: int) -> DataFrame:
    """(lang, a, b, value) for each two sources of a language, by their places, a < b."""
    blocks = max(1, -(-rows // TASK))
    tiles = F.floor((F.col("sources") - 1) / TILE)
    own = F.floor(F.col("place") / TILE)
    with_tiles = F.transform(F.sequence(F.lit(0).cast("long"), tiles), lambda t: F.named_struct(F.lit("tile_a"), F.least(t, own), F.lit("tile_b"), F.greatest(t, own)))
    key = ["lang", "tile_a", "tile_b", "block"]
    found = shares.select("lang", "place", "share", "term", F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block"), F.explode(with_tiles).alias("tiles"))
    of_all = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    constants = sources.select("lang", "place", F.col("constant").alias("share"), F.lit(None).cast("string").alias("term"), of_all.alias("block"), with_tiles.alias("tiles"))
    constants = constants.withColumn("tiles", F.explode("tiles"))
    work = found.unionByName(constants).select("*", "tiles.tile_a", "tiles.tile_b").drop("tiles")
    size = TILE
    return work.groupBy(*key).applyInArrow(lambda group: _compared(group, size), _SHARE).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 30, top: int = 50) -> DataFrame:
    """Rows (lang, source, part, item, value, rank), the largest value first.

    Part "pair": how far each other source of the language is. Part "term": the
    top kept terms that the source uses more than its language does.
    """
    scratch = Scratch(documents.sparkSession, "divergence")
    texts = _texts(documents, text_col, lang_col, source_col)
    kept = scratch.write(kept_terms(texts, min_docs), "kept")
    counts = scratch.write(postings(texts, kept, scratch), "postings")
    group = ["lang", "source"]
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    used = counts.groupBy(*group).agg(F.sum("count").alias("total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    sources = texts.select(*group).distinct().join(used, group, "left").join(sizes, "lang", "left")
    places = Window.partitionBy("lang").orderBy("source")
    sources = sources.select(*group, zero("total").alias("total"), zero("terms").alias("terms"), (F.row_number().over(places) - 1).alias("place"), F.count("*").over(Window.partitionBy("lang")).alias("sources"))
    constant = F.when(F.col("terms") > 0, _share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(0)
    sources = scratch.write(sources.withColumn("constant", constant), "sources")
    shares = counts.join(sources, group).withColumn("share", _share(F.col("count"), F.col("total"), F.col("terms")))
    shares = scratch.write(shares.select(*group, "place", "sources", "term", "count", "share"), "shares")

    whole = sources.groupBy("lang").agg(F.sum("total").alias("total"), F.first("terms").alias("terms"))
    expected = shares.groupBy("lang", "term").agg(F.sum("count").alias("count")).join(whole, "lang").select("lang", "term", _share(F.col("count"), F.col("total"), F.col("terms")).alias("expected"))
    terms = shares.join(expected, ["lang", "term"]).filter(F.col("share") > F.col("expected"))
    terms = terms.select(*group, F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("share") - F.col("expected")).alias("value"))

    pairs = _pairs(shares, sources, shares.count())
    name = lambda p: sources.select("lang", F.col("place").alias(p), F.col("source").alias(f"source_{p}"), F.col("constant").alias(f"constant_{p}"), *(["terms"] if p == "a" else []))
    pairs = pairs.join(name("a"), ["lang", "a"]).join(name("b"), ["lang", "b"])
    value = F.col("value") + F.col("terms") * F.abs(F.col("constant_a") - F.col("constant_b"))
    both = F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item")))
    pairs = pairs.select("lang", value.alias("value"), F.inline(both)).select(*group, F.lit("pair").alias("part"), "item", "value")

    ranks = Window.partitionBy(*group).orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(ranks)).unionByName(terms)
