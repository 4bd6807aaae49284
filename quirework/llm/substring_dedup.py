"""Substring deduplication by a log-structured index of window fingerprints.

A window is k consecutive words of one document. The index holds the windows
of all earlier batches as sorted immutable runs, cut into buckets by the top
bits of a 64-bit fingerprint. A new batch of documents (a range of ids, so all
history has smaller ids) is fingerprinted, dealt out by bucket and there
merge-joined with the runs of the bucket. Runs are stored bucket by bucket
(bucketed tables), so ingesting shuffles the new batch alone; history is read
where it is. A match of fingerprints is verified by a check word of 32 bits from
other hashes of the same words' bytes, and the positions found are compared
with the check words of the document's own text before any word goes. The
batch's new windows become a run; two runs of one level are compacted into one
of the next, bucket by bucket without a shuffle, so an ingest meets at most
log2(batches) + 1 runs. The index lives in a folder and can be opened again by
another session, to ingest further batches.

Fingerprints travel as packed blocks, not rows: a sorted block is kept as byte
planes of its differences. A map task sends a window only with its smallest
document of a block (later ones are known to be repeats there and then), so a
passage shared by a third of all documents reaches its bucket as one entry for
each block of text. Where there are more buckets than FAN, blocks are cut into
FAN coarse pieces, and these, many blocks together, into buckets; positions to
remove reach their documents in the same two steps. A run's table has a file for
each shelf of neighbouring buckets, at most SHELVES, so there is no limit to the
number of buckets.

Defined results: a null text has no words. A row with a null id is kept whole
and takes nothing from others. Rows that share an id don't remove each other's
words. Texts of fewer than k words have no window. Empty tables give empty
results. Columns other than id and text are ignored. Ids must ascend from batch
to batch; a batch that repeats an earlier id is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .store import Scratch, shuffle_files_dropped

#: chunk: of positions to remove, the chunk of documents that they are for.
PIECE = "shelf int, bucket int, kind int, n int, chunk int, base long, h binary, tag binary, doc binary, pos binary"
ENTRY, GONE, RUN = 0, 1, 2
_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
_CHECK_STEP, _CHECK_SEED = 0xA0761D6478BD642F, 0x5851F42D4C957F2D
#: Bytes of text fingerprinted at once, bytes of text that words are removed from at once, and bytes of text for each bucket of the index.
BLOCK_BYTES, REMOVE_BYTES, BUCKET_BYTES = 4 << 20, 2 << 20, 12 << 20
#: Files that a run's table is dealt out to, at most (Spark allows 100,000), pieces that one block of text is cut into, at most, and bytes of text behind what is cut anew at once.
SHELVES, FAN, CUT_BYTES = 1 << 15, 1 << 11, 16 << 20
_ARROW = pa.schema([("shelf", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), ("chunk", pa.int32()), ("base", pa.int64()), *((x, pa.binary()) for x in ("h", "tag", "doc", "pos"))])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def _fingerprints(texts: pa.Array, k: int) -> tuple[tokens.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words; then of each window its fingerprint, check word and first word's number."""
    words = tokens.cut(texts)
    hashed, doc = tokens.hash_words(words), words.doc
    h, at = tokens.windows(hashed, doc, k)
    check, _ = tokens.windows(tokens.hash_words(words, _CHECK_SEED), doc, k, _CHECK_STEP)
    return words, h, (check >> tokens.U64(32)).astype(np.uint32), at


def _grouped(h: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal (h, tag) together, and where each group starts in it."""
    order = np.argsort(h, kind="stable")
    hs, ts = h[order], tag[order]
    same = hs[1:] == hs[:-1]
    if np.any(same & (ts[1:] != ts[:-1])):
        order = np.lexsort((tag, h))
        hs, ts = h[order], tag[order]
        same = (hs[1:] == hs[:-1]) & (ts[1:] == ts[:-1])
    return order, np.flatnonzero(np.r_[len(hs) > 0, ~same])


def _runs_of(sorted_keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each key of a sorted array and where it stands."""
    start = np.flatnonzero(np.r_[len(sorted_keys) > 0, sorted_keys[1:] != sorted_keys[:-1]])
    for low, high in zip(start.tolist(), [*start[1:].tolist(), len(sorted_keys)], strict=False):
        yield int(sorted_keys[low]), slice(low, high)


def _buckets(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> tokens.U64(64 - (buckets.bit_length() - 1))).astype(np.int64) if buckets > 1 else np.zeros(len(h), np.int64)


def _entry_rows(h: np.ndarray, tag: np.ndarray, doc: np.ndarray, pos: np.ndarray, buckets: int, shelves: int) -> list[tuple]:
    """Windows sorted by h, packed by bucket."""
    base, per = int(doc.min()) if len(doc) else 0, max(1, buckets // shelves)
    return [
        (b // per, b, ENTRY, s.stop - s.start, 0, base, tokens.pack_sorted(h[s]), tokens.pack(tag[s]), tokens.pack((doc[s] - base).view(tokens.U64)), tokens.pack(pos[s]))
        for b, s in _runs_of(_buckets(h, buckets))
    ]


def _gone_rows(place: tuple[int, int], doc: np.ndarray, pos: np.ndarray, tag: np.ndarray, chunks: int) -> list[tuple]:
    """Positions to remove, packed by chunk of documents. place: the shelf and bucket they are kept in until they are read."""
    chunk = (tokens.mix(doc.view(tokens.U64).copy()) & tokens.U64(chunks - 1)).astype(np.int64)
    order = np.argsort(chunk, kind="stable")
    doc, pos, tag = doc[order], pos[order], tag[order]
    out = []
    for c, part in _runs_of(chunk[order]):
        base = int(doc[part].min())
        out.append((*place, GONE, part.stop - part.start, c, base, b"", tokens.pack(tag[part]), tokens.pack((doc[part] - base).view(tokens.U64)), tokens.pack(pos[part])))
    return out


def _read(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, pos and tag of a piece."""
    n = row["n"]
    return tokens.unpack(row["doc"], n).view(np.int64) + row["base"], tokens.unpack(row["pos"], n), tokens.unpack(row["tag"], n).astype(np.uint32)


def _pieces(k: int, buckets: int, shelves: int, chunks: int):
    """Windows of each block of text, by bucket; repeats within a block are gone at once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, "text", BLOCK_BYTES):
                words, h, tag, at = _fingerprints(part.column("text"), k)
                ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                owner = words.doc[at]
                doc, pos = ids[owner], at - words.first[owner]
                order, start = _grouped(h, tag)
                if not len(order):
                    continue
                h, tag, doc, pos = h[order], tag[order], doc[order], pos[order]
                least = np.repeat(np.minimum.reduceat(doc, start), np.diff(np.r_[start, len(doc)]))
                late = doc > least
                some = int(h[0] % tokens.U64(buckets))
                rows = _gone_rows((some // max(1, buckets // shelves), some), doc[late], pos[late], tag[late], chunks)
                yield _rows(rows + _entry_rows(h[~late], tag[~late], doc[~late], pos[~late], buckets, shelves))

    return cut


def _cut_anew(buckets: int, shelves: int, fan: int):
    """Pieces of a coarse bucket, from many blocks of text, by bucket."""

    def cut(group: pa.Table) -> pa.Table:
        pieces = group.to_pylist()
        fine, per = buckets // fan, max(1, buckets // shelves)
        out = [(p["bucket"] * fine // per, p["bucket"] * fine, *(p[c] for c in _ARROW.names[2:])) for p in pieces if p["kind"] == GONE]
        if entries := [p for p in pieces if p["kind"] == ENTRY]:
            h = np.concatenate([tokens.unpack_sorted(p["h"], p["n"]) for p in entries])
            doc, pos, tag = (np.concatenate(x) for x in zip(*map(_read, entries), strict=True))
            order = np.argsort(h, kind="stable")
            out += _entry_rows(h[order], tag[order], doc[order], pos[order], buckets, shelves)
        return pa.Table.from_batches([_rows(out)])

    return cut


def _chunked_anew(chunks: int):
    """Positions of a coarse chunk of documents, from many buckets, by chunk."""

    def cut(group: pa.Table) -> pa.Table:
        doc, pos, tag = (np.concatenate(x) for x in zip(*map(_read, group.to_pylist()), strict=True))
        return pa.Table.from_batches([_rows(_gone_rows((0, 0), doc, pos, tag, chunks))])

    return cut


def _slices(text_bytes: int, parts: int) -> Column:
    """A number by which the rows of each of parts keys are cut into groups that stand for about CUT_BYTES of text."""
    return F.pmod(F.spark_partition_id(), F.lit(max(1, text_bytes // (parts * CUT_BYTES))))


def _known(run_h: np.ndarray, run_tag: np.ndarray, h: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """Which (h, tag) the sorted run holds."""
    hit = np.zeros(len(h), dtype=bool)
    if not len(run_h):
        return hit
    at = np.searchsorted(run_h, h)
    open_ = np.flatnonzero((at < len(run_h)))
    while len(open_):
        i = at[open_]
        equal = run_h[i] == h[open_]
        match = equal & (run_tag[i] == tag[open_])
        hit[open_[match]] = True
        open_ = open_[equal & ~match]
        at[open_] += 1
        open_ = open_[at[open_] < len(run_h)]
    return hit


def _merge(chunks: int):
    def merge(batch: pa.Table, runs: pa.Table) -> pa.Table:
        pieces = batch.to_pylist()
        out = [tuple(p[c] for c in _ARROW.names) for p in pieces if p["kind"] == GONE]
        entries = [p for p in pieces if p["kind"] == ENTRY]
        if entries:
            h = np.concatenate([tokens.unpack_sorted(p["h"], p["n"]) for p in entries])
            doc, pos, tag = (np.concatenate(x) for x in zip(*map(_read, entries), strict=True))
            order, start = _grouped(h, tag)
            h, tag, doc, pos = h[order], tag[order], doc[order], pos[order]
            size = np.diff(np.r_[start, len(h)])
            known = np.zeros(len(start), dtype=bool)
            for p in runs.to_pylist():
                known |= _known(tokens.unpack_sorted(p["h"], p["n"]), tokens.unpack(p["tag"], p["n"]).astype(np.uint32), h[start], tag[start])
            gone = np.repeat(known, size) | (doc > np.repeat(np.minimum.reduceat(doc, start), size))
            place = entries[0]["shelf"], entries[0]["bucket"]
            out += _gone_rows(place, doc[gone], pos[gone], tag[gone], chunks)
            new = start[~known]
            if len(new):
                out.append((*place, RUN, len(new), 0, 0, tokens.pack_sorted(h[new]), tokens.pack(tag[new]), b"", b""))
        return pa.Table.from_batches([_rows(out)])

    return merge


def _compact(group: pa.Table) -> pa.Table:
    pieces = group.to_pylist()
    h = np.concatenate([tokens.unpack_sorted(p["h"], p["n"]) for p in pieces])
    tag = np.concatenate([tokens.unpack(p["tag"], p["n"]) for p in pieces]).astype(np.uint32)
    order, start = _grouped(h, tag)
    new = order[start]
    return pa.Table.from_batches([_rows([(pieces[0]["shelf"], pieces[0]["bucket"], RUN, len(new), 0, 0, tokens.pack_sorted(h[new]), tokens.pack(tag[new]), b"", b"")])])


@contextmanager
def _by_shelf(spark):
    """Within this block, groups by shelf and bucket are brought together by shelf alone, as runs are stored."""
    before = spark.conf.get(_ALL_KEYS, "true")
    spark.conf.set(_ALL_KEYS, "false")
    try:
        yield
    finally:
        spark.conf.set(_ALL_KEYS, before)


class FingerprintIndex:
    """Sorted immutable runs of window fingerprints in a folder that driver and executors share."""

    def __init__(self, spark, buckets: int, k: int = 13, path: str | None = None, shelves: int | None = None):
        """A new index; path: its folder, which stays; without one, it goes with the program.

        buckets and shelves are powers of two; a shelf, one task's share of a
        run, holds neighbouring buckets, which are merged one after the other.
        """
        self.spark, self.k, self.buckets, self.chunks = spark, k, buckets, max(1, buckets // 8)
        self.shelves = min(buckets, shelves or SHELVES)
        self.scratch = Scratch(spark, "index") if path is None else Scratch.at(spark, path)
        self.runs: list[tuple[int, str]] = []  # level, table
        self.batches, self.last = 0, None
        self._prefix = f"quirework_run_{uuid.uuid4().hex[:12]}_"

    @staticmethod
    def open(spark, path: str) -> FingerprintIndex:
        """The index that a session left in a folder."""
        (r,) = spark.read.json(f"{path}/state.json", multiLine=True).collect()
        index = FingerprintIndex(spark, r["buckets"], r["k"], path, r["shelves"])
        index.runs, index.batches, index.last = [(x["level"], x["table"]) for x in r["runs"]], r["batches"], r["last"]
        for _, name in index.runs:
            index._register(name)
        return index

    def save(self) -> None:
        """Records the runs in the folder, so that it can be opened again; the file is replaced at once."""
        state = {"buckets": self.buckets, "shelves": self.shelves, "k": self.k, "batches": self.batches, "last": self.last, "runs": [{"level": n, "table": t} for n, t in self.runs]}
        self.scratch.text("state.json", json.dumps(state))

    def _run(self, name: str) -> DataFrame:
        # The filter lets all rows pass. It reads them row by row: Spark doesn't keep the buckets of a union of column batches.
        return self.spark.table(self._prefix + _plain(name)).filter("n > 0")

    def _register(self, name: str) -> None:
        """Makes a table of the files of a run; Spark reads it bucket by bucket, alone or in a union with others."""
        at = self.scratch.path(f"{name}/part=run")
        self.scratch.make(f"{name}/part=run")
        self.spark.sql(f"CREATE TABLE {self._prefix}{_plain(name)} ({PIECE}) USING parquet CLUSTERED BY (shelf) SORTED BY (shelf, bucket) INTO {self.shelves} BUCKETS LOCATION '{at}'")

    def _write(self, pieces: DataFrame, name: str) -> None:
        """Writes pieces in files by bucket, those of runs apart from the rest."""
        pieces, written = pieces.withColumn("part", F.when(F.col("kind") == RUN, "run").otherwise("gone")), f"{self._prefix}written"
        with shuffle_files_dropped(self.spark), _by_shelf(self.spark):
            pieces.write.format("parquet").option("compression", "zstd").option("path", self.scratch.path(name)).partitionBy("part").bucketBy(self.shelves, "shelf").sortBy("shelf", "bucket").mode("overwrite").saveAsTable(written)
        self.spark.sql(f"DROP TABLE {written}")
        self._register(name)

    def _forget(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._prefix}{_plain(name)}")

    def compact(self) -> None:
        """Merges runs of equal level until there are none."""
        while len(self.runs) > 1 and self.runs[-1][0] == self.runs[-2][0]:
            (level, a), (_, b) = self.runs[-2:]
            name = f"{a}-{b}"
            self._write(self._run(a).union(self._run(b)).groupBy("shelf", "bucket").applyInArrow(_compact, PIECE), name)
            self.runs[-2:] = [(level + 1, name)]
            self.save()
            for old in (a, b):
                self._forget(old)
                self.scratch.drop(f"{old}/part=run")

    def fingerprinted(self, docs: DataFrame, text_bytes: int) -> DataFrame:
        """The batch's windows by bucket. A block of text is cut into FAN pieces at most; more buckets are cut from the pieces of many blocks, so that rows stay large however many buckets there are."""
        fan, chunks = min(self.buckets, FAN), min(self.chunks, FAN)
        if fan == self.buckets:
            return docs.mapInArrow(_pieces(self.k, fan, self.shelves, chunks), PIECE)
        coarse = docs.mapInArrow(_pieces(self.k, fan, fan, chunks), PIECE).withColumn("slice", _slices(text_bytes, fan))
        return coarse.groupBy("bucket", "slice").applyInArrow(_cut_anew(self.buckets, self.shelves, fan), PIECE)

    def by_document(self, pieces: DataFrame, text_bytes: int) -> DataFrame:
        """Repeated windows as ingest() returns them, one row (doc_id, n, pos, tag) for each document."""
        if self.chunks > FAN:
            pieces = pieces.withColumn("slice", _slices(text_bytes, FAN)).groupBy("chunk", "slice").applyInArrow(_chunked_anew(self.chunks), PIECE)
        return pieces.groupBy("chunk").applyInArrow(_by_document, "doc_id long, n int, pos binary, tag binary")

    def ingest(self, docs: DataFrame) -> DataFrame:
        """Adds a batch (doc_id, text). Returns its repeated windows, packed by chunk of documents: those in an earlier batch, or in a document of this batch with a smaller id."""
        docs = docs.select("doc_id", "text").filter("doc_id IS NOT NULL")
        ids = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.sum(F.octet_length("text")).alias("bytes")).first()
        if self.last is not None and ids["low"] is not None and ids["low"] <= self.last:
            raise ValueError(f"ids must be above {self.last}, which an earlier batch had; {ids['low']} is not")
        self.compact()
        name = f"batch{self.batches}"
        new = self.fingerprinted(docs, ids["bytes"] or 0)
        runs = self.spark.createDataFrame([], PIECE)
        for i, (_, run) in enumerate(self.runs):
            runs = runs.union(self._run(run)) if i else self._run(run)
        self._write(new.groupBy("shelf", "bucket").cogroup(runs.groupBy("shelf", "bucket")).applyInArrow(_merge(min(self.chunks, FAN)), PIECE), name)
        self.runs.append((0, name))
        self.batches += 1
        self.last = ids["high"] if ids["high"] is not None else self.last
        self.save()
        return self.spark.read.schema(PIECE + ", part string").parquet(self.scratch.path(name)).filter("part = 'gone'").drop("part")

    def drop(self) -> None:
        for _, name in self.runs:
            self._forget(name)
        self.scratch.drop("")


def _plain(name: str) -> str:
    return name.replace("-", "_")


def _by_document(group: pa.Table) -> pa.Table:
    doc, pos, tag = (np.concatenate(x) for x in zip(*map(_read, group.to_pylist()), strict=True))
    order = np.argsort(doc, kind="stable")
    doc, pos, tag = doc[order], pos[order], tag[order]
    start = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    edges = np.r_[start, len(doc)]
    each = [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return pa.table({"doc_id": pa.array(doc[start]), "n": pa.array(np.diff(edges).astype(np.int32)), "pos": pa.array([tokens.pack(pos[s]) for s in each], pa.binary()), "tag": pa.array([tokens.pack(tag[s]) for s in each], pa.binary())})


def _remove(k: int):
    out_schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, "text", REMOVE_BYTES):
                words, _, check, at = _fingerprints(part.column("text"), k)
                count, first = words.count, words.first
                change = np.zeros(first[-1] + 1, np.int32)
                tags = np.full(first[-1], -1, np.int64)
                tags[at] = check
                for i, (m, pos, tag) in enumerate(zip(part.column("n").to_pylist(), part.column("pos").to_pylist(), part.column("tag").to_pylist(), strict=True)):
                    if m:
                        p = tokens.unpack(pos, m).astype(np.int64)
                        ok = p < count[i]
                        p = np.unique(p[ok][tags[first[i] + p[ok]] == tokens.unpack(tag, m)[ok].astype(np.int64)])
                        change[first[i] + p] += 1
                        change[first[i] + p + k] -= 1
                stay = np.cumsum(change)[:-1] == 0
                left = np.concatenate([[0], np.cumsum(stay)])
                removed = count - (left[first[1:]] - left[first[:-1]])
                kept = []
                for i, text in enumerate(part.column("text").to_pylist()):
                    own = (text or "").encode().split()
                    kept.append(b" ".join(compress(own, stay[first[i] : first[i + 1]].tolist()) if removed[i] else own).decode())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], schema=out_schema)

    return remove


def deduplicate(docs: DataFrame, k: int = 13, batches: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, n_words, n_removed, kept) for each document: its words less those covered by a window that also starts in a document with a smaller id.

    The table is fed to the index in batches of ascending ids.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000).alias("cuts")).first()
    buckets = 1 << max(0, ((size["bytes"] or 0) // BUCKET_BYTES).bit_length())
    index = FingerprintIndex(spark, buckets, k)
    cuts = sorted(set(size["cuts"] or []))
    found = []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        batch = docs if low is None else docs.filter(F.col("doc_id") > low)
        found.append(index.ingest(batch if high is None else batch.filter(F.col("doc_id") <= high)))
    pieces = found[0]
    for more in found[1:]:
        pieces = pieces.union(more)
    scratch = Scratch(spark, "gone")
    by_doc = scratch.write(index.by_document(pieces, size["bytes"] or 0), "by_doc")
    index.drop()
    joined = docs.join(by_doc, "doc_id", "left").select("doc_id", "text", "n", "pos", "tag")
    return joined.mapInArrow(_remove(k), "doc_id long, n_words long, n_removed long, kept string")
