"""Benchmark decontamination by the q-gram lemma.

Texts are compared as lower-case letters and digits with single spaces between.
A document is contaminated by an item if some window of w characters of the
item occurs in it with at most e edits, w and e by the item's length (60 and 3;
items under 60 characters: 40 and 2; under 40: 24 and 1). An item of under 24
characters counts if it occurs whole and unedited, at the borders of words.

A window with e edits shares at least w - q + 1 - q * e of its q-grams, and
their diagonals (place in the document less place in the item) differ by e at
most. So documents are filtered three times: stretches with too few q-grams of
any item are passed over; in the rest, shared q-grams are counted in diagonal
bands of width 2 * (e + 1) that overlap by half; and the windows of bands that
hold enough are verified by banded alignment, many at once. Windows that an item
repeats are sought once, and equal stretches of text are aligned once, so
periodic texts cost in proportion to their length. Shared q-grams are handled in
parts of TRIPLES, whatever they are.

Items are indexed in blocks of BLOCK_BYTES of benchmark text, of which one at a
time is collected, broadcast, applied and let go. Where there are several, the
documents are read once, against a table of bits of all items' q-grams (of 4 to
32 Mbit; tables of the tasks are united part by part); only those with a stretch of enough of them are
written, and each block is applied to these. Documents are handled one by one,
whole, and nothing of them is gathered.

Defined results: null and blank texts are clean; null and blank items match
nothing. Items with equal texts are all reported. Repeated rows are reported
each. An occurrence is the union of overlapping windows of one item, its edits
are those of the best window; of windows with equally few the one that starts
first counts. Empty tables give empty results. Offsets are code points of the
document, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .store import Scratch

Q = 8
#: (shortest item, window, edits)
CLASSES = ((60, 60, 3), (40, 40, 2), (24, 24, 1))
BLOCK_BYTES, SLICE_BYTES = 1 << 20, 3 << 20
#: Size of a table of q-grams, as a power of two; shared q-grams handled at once; windows aligned at once.
#: Bits of the table of all items' q-grams: at least and at most, as powers of two; between, eight for each byte of the benchmark. It travels to the driver in PARTS parts.
BITS, MOST_BITS, PARTS = 22, 25, 64
TRIPLES, ALIGNED = 1 << 20, 1 << 14
_STEP = tokens.U64(0xD1B54A32D192ED03)
_PLAIN = np.array([ord(c.lower()) if (c := chr(i)).isalnum() and len(c.lower()) == 1 else i if c.isalnum() else 32 for i in range(1 << 16)], dtype=np.uint32)
_PLAIN[0xD800:0xE000] = 32


def plain(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Comparable characters of all texts in a row; of each, its code point's place in its text; and each text's first."""
    data, at = tokens.raw(texts)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at]
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    points = np.where(points < 1 << 16, _PLAIN[np.minimum(points, (1 << 16) - 1)], points)
    keep = points != 32
    keep[1:] |= points[:-1] != 32
    edge = begins[:-1][begins[:-1] < len(points)]
    keep[edge] = points[edge] != 32
    kept = np.flatnonzero(keep)
    first = np.searchsorted(kept, begins)
    return points[kept], kept - np.repeat(begins[:-1], np.diff(first)), first


def qgrams(points: np.ndarray) -> np.ndarray:
    """Hashes of Q = 8 consecutive characters, by doubling."""
    if len(points) < Q:
        return np.zeros(0, tokens.U64)
    h, step = points.astype(tokens.U64), _STEP
    for k in (1, 2, 4):
        h = h[:-k] * step + h[k:]
        step = tokens.U64(int(step) ** 2 % 2**64)
    return tokens.mix(h)


class Stretches:
    """Hashes of any stretch of some characters, from running sums."""

    def __init__(self, points: np.ndarray):
        odd = tokens.U64(int(_STEP) | 1)
        self._power = np.cumprod(np.r_[tokens.U64(1), np.full(len(points), odd, tokens.U64)])
        inverse = np.cumprod(np.r_[tokens.U64(1), np.full(len(points), pow(int(odd), -1, 1 << 64), tokens.U64)])
        self._sum = np.cumsum(np.r_[tokens.U64(0), (points.astype(tokens.U64) + tokens.U64(1)) * inverse[: len(points)]])

    def hash(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return tokens.mix((self._sum[high] - self._sum[low]) * self._power[low] ^ (high - low).astype(tokens.U64) << tokens.U64(48))


def _spans(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers from each low, so many of each."""
    return np.repeat(low - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


@dataclass
class Short:
    """Items that must occur whole: those of one length, by the hash of their characters."""

    size: int
    hashes: np.ndarray
    ids: list[list[int]]

    @staticmethod
    def of(ids: list[int], points: list[np.ndarray]) -> list[Short]:
        out = []
        for size in sorted({len(p) for p in points} - {0}):
            own: dict[int, list[int]] = {}
            for i, p in zip(ids, points, strict=True):
                if len(p) == size:
                    own.setdefault(int(Stretches(p).hash(np.array([0]), np.array([size]))[0]), []).append(i)
            out.append(Short(size, np.array(sorted(own), tokens.U64), [own[h] for h in sorted(own)]))
        return out

    def found(self, stretches: Stretches, points: np.ndarray, first: np.ndarray, starts: np.ndarray, row: np.ndarray) -> Iterator[tuple]:
        """(row, item id, start, end, edits) at the starts of words."""
        ends = starts + self.size
        some = ends <= first[row + 1]
        starts, ends, row = starts[some], ends[some], row[some]
        whole = (ends == first[row + 1]) | (points[np.minimum(ends, len(points) - 1)] == 32)
        starts, ends, row = starts[whole], ends[whole], row[whole]
        h = stretches.hash(starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        for k in np.flatnonzero(self.hashes[at] == h):
            for i in self.ids[at[k]]:
                yield int(row[k]), i, int(starts[k]), int(ends[k]), 0


@dataclass
class Index:
    """Items of one class: their characters one after the other, which places start a window that the item doesn't repeat, and the places of each q-gram."""

    window: int
    edits: int
    ids: np.ndarray
    points: np.ndarray
    first: np.ndarray
    kept: np.ndarray
    hashes: np.ndarray
    edges: np.ndarray
    place: np.ndarray
    table: np.ndarray

    @property
    def least(self) -> int:
        return self.window - Q + 1 - Q * self.edits

    @staticmethod
    def of(window: int, edits: int, ids: list[int], points: list[np.ndarray]) -> Index:
        first = np.concatenate([[0], np.cumsum([len(p) for p in points])])
        data = np.concatenate(points)
        kept, covered = np.zeros(len(data), bool), np.zeros(len(data) + 1, np.int64)
        for low, p in zip(first, points, strict=False):
            starts = np.arange(len(p) - window + 1)
            _, own = np.unique(Stretches(p).hash(starts, starts + window), return_index=True)
            kept[low + own] = True
            covered[low + own] += 1
            covered[low + own + window - Q + 1] -= 1
        place = np.flatnonzero(np.cumsum(covered)[:-1] > 0)
        h = qgrams(data)[place]
        order = np.argsort(h, kind="stable")
        hashes, start = np.unique(h[order], return_index=True)
        return Index(window, edits, np.array(ids, np.int64), data, first, kept, hashes, np.r_[start, len(h)], place[order].astype(np.int32), bit_table(hashes, np.zeros(1 << BITS, bool)))

    def shared(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shared q-grams (place in the text, number of the q-gram) in stretches that hold enough of them."""
        at = dense(h, self.table, self.window, self.edits)
        number = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        known = self.hashes[number] == h[at]
        return at[known], number[known]

    def windows(self, at: np.ndarray, place: np.ndarray, row: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows to verify, from shared q-grams: place in the items, row, least diagonal and how many."""
        width, n = 2 * (self.edits + 1), self.least
        none = (np.zeros(0, np.int64),) * 4
        if len(at) < n:
            return none
        at, place, row, item = (np.concatenate([x, x]) for x in (at, place, row, item))
        half = np.repeat([0, self.edits + 1], len(at) // 2)
        diagonal = at - place
        band = (diagonal + half) // width * 2 + (half > 0)
        order = np.lexsort((at, band, item, row))
        at, item, band, row, diagonal = at[order], item[order], band[order], row[order], diagonal[order]
        i, j = np.arange(len(at) - n + 1), np.arange(n - 1, len(at))
        k = np.flatnonzero((row[i] == row[j]) & (item[i] == item[j]) & (band[i] == band[j]) & (at[j] - at[i] <= self.window - Q + self.edits))
        if not len(k):
            return none
        own = np.lib.stride_tricks.sliding_window_view(diagonal, n)
        least, most = own[k].min(1), own[k].max(1)
        low = np.maximum(self.first[item[k]], at[k + n - 1] - least + Q - self.window)
        high = np.minimum(at[k] - least, self.first[item[k] + 1] - self.window)
        size = np.maximum(0, high - low + 1)
        start, of = _spans(low, size), np.repeat(np.arange(len(k)), size)
        start, of = start[self.kept[start]], of[self.kept[start]]
        order = np.lexsort(((most - least)[of], least[of], start))
        start, of = start[order], of[order]
        once = np.r_[np.ones(min(1, len(of)), bool), (start[1:] != start[:-1]) | (least[of[1:]] != least[of[:-1]]) | (most[of[1:]] != most[of[:-1]])]
        start, of = start[once], of[once]
        return start, row[k[of]], least[of], (most - least)[of]

    def occurrences(self, points: np.ndarray, first: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Verified windows as columns (row, item, start, end, edits)."""
        at, number = self.shared(h)
        row = np.searchsorted(first, at, side="right") - 1
        inside = at + Q <= first[row + 1]
        at, number, row = at[inside], number[inside], row[inside]
        size = self.edges[number + 1] - self.edges[number]
        total, low, out = np.cumsum(size), 0, []
        while low < len(at):
            high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + TRIPLES, side="right")))
            # Parts overlap by a window, and go on at least one q-gram beyond that.
            back = int(np.searchsorted(at, at[low] - self.window - self.edits))
            s = slice(back, high)
            place = self.place[_spans(self.edges[number[s]], size[s])].astype(np.int64)
            out.append(self._verified(np.repeat(at[s], size[s]), place, np.repeat(row[s], size[s]), points, first))
            low = high
        return np.unique(np.concatenate([np.zeros((0, 5), np.int64), *out]), axis=0)

    def _verified(self, at: np.ndarray, place: np.ndarray, row: np.ndarray, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        start, row, least, spread = self.windows(at, place, row, np.searchsorted(self.first, place, side="right") - 1)
        low, high = first[row], first[row + 1]
        base = start + least - self.edits
        reach = np.arange(self.window + 4 * self.edits + 2)  # spread is less than 2 * (edits + 1)
        weights = tokens.mix(reach.astype(tokens.U64) + tokens.U64(1)) | tokens.U64(1)
        key = tokens.mix(start.astype(tokens.U64) << tokens.U64(8) ^ spread.astype(tokens.U64))
        for c in (slice(i, i + ALIGNED) for i in range(0, len(start), ALIGNED)):
            at = base[c, None] + reach
            inside = (at >= low[c, None]) & (at < high[c, None])
            key[c] ^= tokens.mix((np.where(inside, points[np.where(inside, at, 0)].astype(tokens.U64) + tokens.U64(1), tokens.U64(0)) * weights).sum(1, dtype=tokens.U64))
        _, once, of = np.unique(key, return_index=True, return_inverse=True)
        edits, s, e = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*(align(self, points, start[c], base[c], spread[c], low[c], high[c]) for c in (once[i : i + ALIGNED] for i in range(0, len(once), ALIGNED))), strict=True)) if len(once) else (np.zeros(0, np.int64),) * 3
        hit = np.flatnonzero(edits[of] <= self.edits)
        own = of[hit]
        item = np.searchsorted(self.first, start[hit], side="right") - 1
        return np.stack([row[hit], item, base[hit] + s[own], np.minimum(base[hit] + e[own], high[hit]), edits[own]], 1)


def bit_table(hashes: np.ndarray, out: np.ndarray) -> np.ndarray:
    """The table out with the places of some hashes set."""
    out[(hashes >> tokens.U64(65 - len(out).bit_length())).astype(np.int64)] = True
    return out


def dense(h: np.ndarray, bits: np.ndarray, window: int, edits: int) -> np.ndarray:
    """Places of q-grams that the table has, in stretches of a window that hold enough of them."""
    if not len(h):
        return np.zeros(0, np.int64)
    member = bits[(h >> tokens.U64(65 - len(bits).bit_length())).astype(np.int64)]
    total = np.concatenate([[0], np.cumsum(member, dtype=np.int32)])
    ends = np.minimum(np.arange(len(h)) + window - Q + 1 + edits, len(h))
    full = np.flatnonzero(total[ends] - total[:-1] >= window - Q + 1 - Q * edits)
    change = np.zeros(len(h) + 1, np.int32)
    change[full] = 1
    np.subtract.at(change, ends[full], 1)
    return np.flatnonzero(member & (np.cumsum(change)[:-1] > 0))


def align(index: Index, points: np.ndarray, start: np.ndarray, base: np.ndarray, spread: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best occurrence of each window (its start in the items) whose diagonals stay within base to base + spread and twice the edits: edits, and start and end from base.

    low and high: the text's bounds among points.
    """
    n, width, big = len(start), int(spread.max()) + 2 * index.edits + 1, index.edits + 1
    column = np.arange(width)
    real = column <= spread[:, None] + 2 * index.edits
    at = base[:, None] + column
    cost = np.where(real & (at >= low[:, None]) & (at <= high[:, None]), 0, big).astype(np.int16)
    begin = np.broadcast_to(column, cost.shape).astype(np.int16)
    for i in range(index.window):
        inside = (at + i >= low[:, None]) & (at + i < high[:, None])
        other = ~inside | (points[np.where(inside, at + i, 0)] != index.points[start + i][:, None])
        new, origin = cost + other, begin.copy()
        drop = cost[:, 1:] + 1 < new[:, :-1]
        new[:, :-1][drop], origin[:, :-1][drop] = cost[:, 1:][drop] + 1, begin[:, 1:][drop]
        for k in range(1, width):
            skip = inside[:, k] & (new[:, k - 1] + 1 < new[:, k])
            new[skip, k], origin[skip, k] = new[skip, k - 1] + 1, origin[skip, k - 1]
        cost, begin = np.where(real, np.minimum(new, big), big).astype(np.int16), origin
        if (cost > index.edits).all():
            break
    best = np.argmin(cost.astype(np.int64) * 65536 + begin * 256 + column, axis=1)
    every = np.arange(n)
    return cost[every, best].astype(np.int64), begin[every, best].astype(np.int64), index.window + best


def scan(texts: pa.Array, indexes: list[Index | Short]) -> list[tuple[int, int, int, int, int]]:
    """(row, item id, start, end, edits) of each occurrence; overlapping windows of an item are one."""
    points, origin, first = plain(texts)
    h = qgrams(points)
    if any(isinstance(x, Short) for x in indexes):
        stretches = Stretches(points)
        words = np.union1d(1 + np.flatnonzero(points[:-1] == 32), first[:-1])
        words = words[words < len(points)]
        words = words[points[words] != 32]
    out = []
    for index in indexes:
        if isinstance(index, Short):
            found = list(index.found(stretches, points, first, words, np.searchsorted(first, words, side="right") - 1))
        else:
            found = [(r, int(index.ids[i]), s, e, edits) for r, i, s, e, edits in merged(index.occurrences(points, first, h)).tolist()]
        out += [(r, i, int(origin[s]), int(origin[e - 1]) + 1, edits) for r, i, s, e, edits in found]
    return sorted(out)


def merged(found: np.ndarray) -> np.ndarray:
    """Unions of overlapping spans of one row and item, with the least edits of each; found is sorted by row, item and start."""
    if not len(found):
        return found
    row, item, start, end, edits = found.T
    step = int(end.max()) + 1
    group = np.cumsum(np.r_[0, (row[1:] != row[:-1]) | (item[1:] != item[:-1])])
    upto = np.maximum.accumulate(group * step + end)
    opens = np.flatnonzero(np.r_[True, (group * step + start)[1:] > upto[:-1]])
    last = np.r_[opens[1:], len(found)] - 1
    return np.stack([row[opens], item[opens], start[opens], upto[last] - group[last] * step, np.minimum.reduceat(edits, opens)], 1)


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")


def _plain_items(texts: pa.Array) -> list[np.ndarray]:
    points, _, first = plain(texts)
    each = [points[s:e] for s, e in zip(first[:-1], first[1:], strict=True)]
    return [p[:-1] if len(p) and p[-1] == 32 else p for p in each]


def index_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[Index | Short]]:
    """Indexes of all items, block by block of about block_bytes of text; an item longer than that is a block of its own.

    Items of more than one block are written out by block first, so each block reads its own alone.
    """
    items = _items(benchmark, id_col, text_col)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    scratch = Scratch(benchmark.sparkSession, "items") if blocks > 1 else None
    if scratch:
        dealt = items.distinct().withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
        scratch.write(dealt.repartition("block"), "items", ["block"])
        items = benchmark.sparkSession.read.schema("id long, text string, block long").parquet(scratch.path("items"))
    for b in range(blocks):
        rows = (items.filter(F.col("block") == b).select("id", "text") if scratch else items.distinct()).orderBy("id", "text").collect()
        each = _plain_items(pa.array([r["text"] for r in rows], pa.string()))
        out, above = [], np.inf
        for shortest, window, edits in CLASSES:
            some = [i for i, p in enumerate(each) if shortest <= len(p) < above]
            above = shortest
            if some:
                out.append(Index.of(window, edits, [rows[i]["id"] for i in some], [each[i] for i in some]))
        some = [i for i, p in enumerate(each) if len(p) < above]
        yield out + Short.of([rows[i]["id"] for i in some], [each[i] for i in some])


def _bits(power: int):
    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The packed table of a task's items' q-grams, in parts, and whether some item is a short one."""
        bits, short = np.zeros(1 << power, bool), False
        for batch in batches:
            for p in _plain_items(batch.column("text")):
                if len(p) >= CLASSES[-1][0]:
                    bit_table(qgrams(p), bits)
                else:
                    short |= len(p) > 0
        packed = np.packbits(bits).reshape(PARTS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(PARTS, dtype=np.int32)), pa.array([p.tobytes() for p in packed], pa.binary()), pa.array([short] * PARTS)], ["part", "bits", "short"])

    return table


def _either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The union of one part of many tables."""
    total, short, part = None, False, None
    for batch in batches:
        for own, bits, some in zip(*(batch.column(c).to_pylist() for c in ("part", "bits", "short")), strict=True):
            one = np.frombuffer(bits, np.uint8)
            total, short, part = one.copy() if total is None else total | one, short or some, own
    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary()), pa.array([short])], ["part", "bits", "short"])


def _suspects(docs: DataFrame, items: DataFrame, text_bytes: int) -> DataFrame:
    """docs (doc_id, text) that have a stretch of q-grams as any class asks for; all, if some item is a short one."""
    spark = docs.sparkSession
    power = min(MOST_BITS, max(BITS, (8 * text_bytes).bit_length()))
    ddl = "part int, bits binary, short boolean"
    found = items.select("text").mapInArrow(_bits(power), ddl).groupBy("part").applyInArrow(_either, ddl).toArrow().sort_by("part")
    if not found.num_rows or any(found.column("short").to_pylist()):
        return docs
    bits = np.unpackbits(np.frombuffer(b"".join(found.column("bits").to_pylist()), np.uint8)).astype(bool)
    shared = spark.sparkContext.broadcast(np.packbits(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            for part in tokens.slices(batch, "text", SLICE_BYTES):
                points, _, first = plain(part.column("text"))
                h = qgrams(points)
                stay = np.zeros(part.num_rows, bool)
                for _, window, edits in CLASSES:
                    stay[np.searchsorted(first, dense(h, bits, window, edits), side="right") - 1] = True
                yield part.filter(pa.array(stay))

    return docs.mapInArrow(run, docs.schema)


_FOUND = ["doc_id", "item_id", "start", "end", "edits"]


def _scanned(docs: DataFrame, shared) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, "text", SLICE_BYTES):
                found = scan(part.column("text"), shared.value)
                ids = part.column("doc_id").take(pa.array([f[0] for f in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([f[k] for f in found], pa.int64()) for k in range(1, 5))], _FOUND)

    return docs.mapInArrow(run, ", ".join(f"{n} long" for n in _FOUND))


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row (doc_id, item_id, start, end, edits) for each occurrence of an item in a document."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = _items(benchmark, "item_id", "text")
    context = docs.sparkSession.sparkContext
    text_bytes = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if text_bytes <= block_bytes:
        (indexes,) = index_blocks(benchmark, block_bytes=block_bytes)
        return _scanned(docs, context.broadcast(indexes))
    scratch = Scratch(docs.sparkSession, "leaks")
    suspects, out = scratch.write(_suspects(docs, items, text_bytes), "suspects"), None
    for b, indexes in enumerate(index_blocks(benchmark, block_bytes=block_bytes)):
        shared = context.broadcast(indexes)
        part = scratch.write(_scanned(suspects, shared), f"block{b}")
        shared.destroy()
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without those that contain an item; rows and columns are kept as they are."""
    if (_items(benchmark, "item_id", "text").agg(F.sum(F.octet_length("text"))).first()[0] or 0) > block_bytes:
        # Whether a document is contaminated depends on its text alone, so a hash of the text tells which to drop.
        texts = docs.select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
        name = "_" * (1 + max(map(len, docs.columns)))
        dirty = matches(texts, benchmark, "h", "text", block_bytes).select(F.col("doc_id").alias(name)).distinct()
        return docs.join(dirty, F.xxhash64(text_col) == F.col(name), "left_anti")
    (indexes,) = index_blocks(benchmark, block_bytes=block_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(indexes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, text_col, SLICE_BYTES):
                stay = np.ones(part.num_rows, bool)
                stay[[f[0] for f in scan(part.column(text_col), shared.value)]] = False
                yield part.filter(pa.array(stay))

    return docs.mapInArrow(run, docs.schema)
