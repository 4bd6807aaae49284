"""N-gram Jaccard self-join: a size-aware heavy-light join on word shingles.

Two documents link when 100 * |A and B| >= 75 * |A or B| for their sets of
five-word shingles. Steps:

1. Every text is cut into its set. Equal sets are one class from here on.
2. Shingle hashes are dealt out by their top bits and counted. Only shingles
   that occur in several documents are sent back, with a class of their
   frequency; the rest can't be shared. A set whose shared shingles are fewer
   than three quarters of it links with none and is done.
3. The sets that are left are ordered, rare shingles first, and joined by
   size. Light sets (up to a boundary) enumerate all 2-subsets of a prefix in
   which any partner shares at least two shingles. Heavy sets scan the
   inverted lists of a prefix in which any partner shares at least one. The
   boundary is the one of least estimated cost, from the numbers of subsets,
   postings and list entries of each size.
4. Sets are grouped in blocks of near neighbours (by the leading document of
   most of their lists; small neighbourhoods join a far larger one that they
   share a list with), and large neighbourhoods are split by hash. Blocks that share
   a subset or a list are paired and all pairs across them verified exactly
   by products of incidence matrices. A block pair returns stars, not pairs.
5. Stars are joined to components in Spark.

Any pair that links shares a prefix shingle, so no link is lost; no list or
bucket is capped. Within a block of text a shingle of 64 documents or more is
sent to its bucket once, and its documents are told without it, so the hottest
lines don't gather in one task. Hashes have 64 bits, signatures of sets 128.

Defined results: null or blank texts have an empty set, link with nothing and
are their own component. A row with a null id takes no part and gets a null
component. Rows that share an id are separate documents; those that share text
as well are one row with that many copies. Equal rows are linked copies. Empty tables give empty results. Columns other than id and text are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .components import components
from .store import Scratch

PIECE = "bucket int, kind int, n int, base long, h binary, key binary, x binary, y binary, ids binary"
ENTRY, HOT, REPLY, PROFILE = 0, 1, 2, 3
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 12 << 20
#: Documents of one block of text that share a shingle, from which it isn't sent to its bucket for each.
HOT_DOCS = 64
#: Sets in a block, about.
BLOCK_SETS = 384
#: A neighbourhood this many times as large as one it shares a list with takes that in, so that it isn't paired with each of many small ones.
ABSORBS = 4
SET = "key long, n int, m int, toks binary, prefix array<long>"
_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), ("base", pa.int64()), *((x, pa.binary()) for x in ("h", "key", "x", "y", "ids"))])
_SHORT = 0x8BB84B93962EACC9


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of all shingles (with repeats) and the text of each, in order of texts."""
    words = tokens.cut(texts, lower=True)
    hashed, count, first = tokens.hash_words(words), words.count, words.first
    h, at = tokens.windows(hashed, words.doc, k)
    doc = np.searchsorted(first, at, side="right") - 1
    parts, docs = [h], [doc]
    for c in range(1, k):
        some = np.flatnonzero(count == c)
        if len(some):
            short = hashed[first[some]].copy()
            for j in range(1, c):
                short = short * tokens.U64(0xD1B54A32D192ED03) + hashed[first[some] + j]
            parts.append(tokens.mix(short + tokens.U64(c * _SHORT % 2**64)))
            docs.append(some)
    if len(parts) > 1:
        h, doc = np.concatenate(parts), np.concatenate(docs)
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
    return h, doc, len(count)


def _chunked(key: np.ndarray, chunks: int) -> tuple[np.ndarray, np.ndarray]:
    chunk = (tokens.mix(key.view(tokens.U64).copy()) & tokens.U64(chunks - 1)).astype(np.int64)
    order = np.argsort(chunk, kind="stable")
    return order, np.searchsorted(chunk[order], np.arange(chunks + 1))


def _replies(key: np.ndarray, h: np.ndarray, level: np.ndarray, chunks: int) -> list[tuple]:
    order, edges = _chunked(key, chunks)
    key, h, level = key[order], h[order], level[order]
    out = []
    for c in np.flatnonzero(np.diff(edges)):
        s = slice(edges[c], edges[c + 1])
        base = int(key[s].min())
        out.append((int(c), REPLY, edges[c + 1] - edges[c], base, tokens.pack(h[s]), tokens.pack((key[s] - base).view(tokens.U64)), tokens.pack(level[s]), b"", b""))
    return out


def _profiles(key: np.ndarray, ids: np.ndarray, n: np.ndarray, hi: np.ndarray, lo: np.ndarray, chunks: int) -> list[tuple]:
    order, edges = _chunked(key, chunks)
    out = []
    for c in np.flatnonzero(np.diff(edges)):
        s = order[edges[c] : edges[c + 1]]
        out.append((int(c), PROFILE, len(s), 0, lo[s].tobytes(), key[s].tobytes(), n[s].astype(np.int64).tobytes(), hi[s].tobytes(), ids[s].tobytes()))
    return out


def _pieces(k: int, buckets: int, chunks: int):
    shift = tokens.U64(64 - (buckets.bit_length() - 1)) if buckets > 1 else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, "text", BLOCK_BYTES):
                h, doc, docs = shingles(part.column("text"), k)
                key = part.column("key").to_numpy(zero_copy_only=False).astype(np.int64)
                ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                order = np.argsort(h, kind="stable")
                hs, ds = h[order], doc[order]
                first = np.r_[np.ones(min(1, len(hs)), bool), (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])]
                kept = np.zeros(len(h), bool)
                kept[order[first]] = True
                n = np.bincount(doc[kept], minlength=docs)
                edge = np.concatenate([[0], np.cumsum(n)])
                sums = []
                for salt in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F):
                    total = np.concatenate([np.zeros(1, tokens.U64), np.cumsum(tokens.mix(h[kept] ^ tokens.U64(salt)), dtype=tokens.U64)])
                    sums.append(total[edge[1:]] - total[edge[:-1]])
                rows = _profiles(key, ids, n, *sums, chunks)
                by_set = np.lexsort((key, n, *sums))
                a, b = by_set[1:], by_set[:-1]
                copy = np.zeros(docs, bool)
                copy[a] = (sums[0][a] == sums[0][b]) & (sums[1][a] == sums[1][b]) & (n[a] == n[b])
                first &= ~copy[ds]
                hs, ks = hs[first], key[ds[first]]
                if len(hs):
                    start = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]])
                    size = np.diff(np.r_[start, len(hs)])
                    hot = np.repeat(size >= HOT_DOCS, size)
                    told = hs[start[size >= HOT_DOCS]]
                    rows += _replies(ks[hot], hs[hot], np.full(int(hot.sum()), 255), chunks)
                    hs, ks = hs[~hot], ks[~hot]
                    for kind, part_h, part_k in ((ENTRY, hs, ks), (HOT, told, None)):
                        if not len(part_h):
                            continue
                        edges = np.array([0, len(part_h)]) if shift is None else np.searchsorted(part_h >> shift, np.arange(buckets + 1, dtype=tokens.U64))
                        base = int(part_k.min()) if part_k is not None else 0
                        for c in np.flatnonzero(np.diff(edges)):
                            s = slice(edges[c], edges[c + 1])
                            packed = tokens.pack((part_k[s] - base).view(tokens.U64)) if part_k is not None else b""
                            rows.append((int(c), kind, edges[c + 1] - edges[c], base, tokens.pack_sorted(part_h[s]), packed, b"", b"", b""))
                yield _rows(rows)

    return cut


def _count(chunks: int):
    def count(group: pa.Table) -> pa.Table:
        pieces = group.to_pylist()
        out = [tuple(p[c] for c in _ARROW.names) for p in pieces if p["kind"] in (REPLY, PROFILE)]
        entries = [p for p in pieces if p["kind"] == ENTRY]
        if entries:
            h = np.concatenate([tokens.unpack_sorted(p["h"], p["n"]) for p in entries])
            key = np.concatenate([tokens.unpack(p["key"], p["n"]).view(np.int64) + p["base"] for p in entries])
            hot = [tokens.unpack_sorted(p["h"], p["n"]) for p in pieces if p["kind"] == HOT]
            order = np.argsort(h, kind="stable")
            h, key = h[order], key[order]
            start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            size = np.diff(np.r_[start, len(h)])
            level = np.minimum(254, 1 + (4 * np.log2(size)).astype(np.int64))
            shared = size > 1
            if hot:
                known = np.isin(h[start], np.concatenate(hot))
                level[known], shared[known] = 255, True
            some = np.repeat(shared, size)
            out += _replies(key[some], h[some], np.repeat(level, size)[some], chunks)
        return pa.Table.from_batches([_rows(out)])

    return count


def _read_profile(p: dict) -> list[np.ndarray]:
    return [np.frombuffer(p[c], np.int64) for c in ("ids", "key", "x", "y", "h")]


def _profile_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for p in batch.to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in _read_profile(p)], ["doc_id", "key", "n", "hi", "lo"])


def least_overlap(n: np.ndarray) -> np.ndarray:
    """Shingles that a set of n shares with any set it links to, at least."""
    return (75 * n + 99) // 100


def _sets(group: pa.Table) -> pa.Table:
    """Of one chunk of documents: the sets that may link, with their shared shingles, rare ones first."""
    pieces = group.to_pylist()
    profiles = [_read_profile(p) for p in pieces if p["kind"] == PROFILE]
    replies = [p for p in pieces if p["kind"] == REPLY]
    out = {"key": [], "n": [], "m": [], "toks": [], "prefix": []}
    if replies and profiles:
        keys, sizes = (np.concatenate([p[i] for p in profiles]) for i in (1, 2))
        order = np.argsort(keys, kind="stable")
        keys, sizes = keys[order], sizes[order]
        key = np.concatenate([tokens.unpack(p["key"], p["n"]).view(np.int64) + p["base"] for p in replies])
        h = np.concatenate([tokens.unpack(p["h"], p["n"]) for p in replies])
        level = np.concatenate([tokens.unpack(p["x"], p["n"]) for p in replies]).astype(np.uint8)
        order = np.argsort(key, kind="stable")
        key, h, level = key[order], h[order], level[order]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        stop = np.r_[start[1:], len(key)]
        n = sizes[np.searchsorted(keys, key[start])]
        for i in np.flatnonzero((stop - start >= least_overlap(n)) & (n > 1)):
            s = slice(start[i], stop[i])
            own = h[s][np.lexsort((h[s], level[s]))]
            m = len(own)
            out["key"].append(int(key[start[i]]))
            out["n"].append(int(n[i]))
            out["m"].append(m)
            out["toks"].append(own.tobytes())
            out["prefix"].append(own[: m - int(least_overlap(n[i])) + 2].view(np.int64))
    types = {"key": pa.int64(), "n": pa.int32(), "m": pa.int32(), "toks": pa.binary(), "prefix": pa.list_(pa.int64())}
    return pa.table({c: pa.array(v, types[c]) for c, v in out.items()})


def _overlaps(toks: list[np.ndarray]) -> np.ndarray:
    """Numbers of shared shingles of all pairs of sets, by products of incidence matrices."""
    who = np.repeat(np.arange(len(toks)), [len(t) for t in toks])
    _, what, times = np.unique(np.concatenate(toks), return_inverse=True, return_counts=True)
    some = times[what] > 1
    number = np.cumsum(times > 1) - 1
    who, what = who[some], number[what[some]]
    out = np.zeros((len(toks), len(toks)), np.float32)
    step = 8192
    order = np.argsort(what, kind="stable")
    who, what = who[order], what[order]
    for low in range(0, int(what[-1]) + 1 if len(what) else 0, step):
        a, b = np.searchsorted(what, [low, low + step])
        m = np.zeros((len(toks), step), np.float32)
        m[who[a:b], what[a:b] - low] = 1
        out += m @ m.T
    return out.astype(np.int64)


def _verify(group: pa.Table) -> pa.Table:
    """Of each pair of blocks: (key, root, links), where root is the least key it is joined with here."""
    group = group.sort_by([("a", "ascending"), ("b", "ascending"), ("key", "ascending")])
    a, b, side = (group.column(c).to_numpy() for c in ("a", "b", "side"))
    key, n, weight = (group.column(c).to_numpy().astype(np.int64) for c in ("key", "n", "weight"))
    toks = group.column("toks")
    start = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    out = []
    for low, high in zip(start, np.r_[start[1:], len(a)], strict=True):
        own, ks, sizes, w, sd = [np.frombuffer(toks[i].as_py(), np.uint64) for i in range(low, high)], key[low:high], n[low:high], weight[low:high], side[low:high]
        shared = _overlaps(own)
        linked = 100 * shared >= 75 * (sizes[:, None] + sizes[None, :] - shared)
        np.fill_diagonal(linked, False)
        if a[low] != b[low]:
            linked &= sd[:, None] != sd[None, :]
        root = ks.copy()
        some = np.flatnonzero(linked.any(1))
        while len(some):
            nearest = np.minimum(root[some], np.where(linked[some], root[None, :], np.iinfo(np.int64).max).min(1))
            if (nearest == root[some]).all():
                break
            root[some] = nearest
        out.append((ks[some], root[some], (linked[some] * w[None, :]).sum(1)))
    return pa.table({c: pa.array(np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64), pa.int64()) for i, c in enumerate(("key", "root", "links"))})


def boundary(sets: DataFrame) -> int:
    """The largest light size: the one of least estimated cost.

    A light set costs a row for each 2-subset. A set that heavy ones may link
    to costs a row for each shingle of its prefix and its part in scanning that
    list, whose d sets lie in about d / BLOCK_SETS blocks that are paired. Sizes
    are summed in classes a quarter of a power of two wide, so that a few
    hundred rows at most reach the driver.
    """
    one = F.size("prefix") - 1
    by_size = sets.groupBy(F.floor(4 * F.log2("n")).alias("c")).agg(F.sum(one).alias("postings"), F.sum(one * (one + 1) / 2).alias("subsets"), F.max("n").alias("top")).orderBy("c").collect()
    lists = sets.select(F.explode(F.slice("prefix", 1, one)).alias("t")).groupBy("t").agg(F.count("*").alias("d")).agg((F.sum(F.col("d") * F.col("d")) / F.sum("d")).alias("scan")).first()
    scan, best = float(lists["scan"] or 1) / (2 * BLOCK_SETS**2), (float("inf"), 0)
    for limit in [0, *[r["top"] for r in by_size]]:
        light = sum(r["subsets"] for r in by_size if r["top"] <= limit)
        heavy = sum(r["postings"] for r in by_size if 4 * r["top"] >= 3 * limit) * (1 + scan) if limit < max((r["top"] for r in by_size), default=0) else 0
        best = min(best, (light + heavy, limit))
    return int(best[1])


def _links(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """sets: key, n, m, toks, prefix, weight. Returns (key, root, links) from all verified block pairs."""
    limit = boundary(sets)
    one = F.slice("prefix", 1, F.size("prefix") - 1)
    pairs_of = F.flatten(F.transform(F.col("prefix"), lambda x, i: F.transform(F.slice(F.col("prefix"), i + 2, F.size("prefix")), lambda y: F.xxhash64(F.least(x, y), F.greatest(x, y)))))
    light = sets.filter(F.col("n") <= limit).select("key", F.lit(True).alias("heavy"), F.explode(pairs_of).alias("sig")).withColumn("space", F.lit(2))
    heavy = sets.filter(F.col("n") * 4 >= 3 * limit).select("key", (F.col("n") > limit).alias("heavy"), F.explode(one).alias("sig")).withColumn("space", F.lit(1))
    postings = scratch.write(light.union(heavy.select("key", "heavy", "sig", "space")), "postings")
    shared = postings.groupBy("space", "sig").agg(F.min("key").alias("leader"), F.count("*").alias("d")).filter("d > 1").select("space", "sig", "leader")
    postings = scratch.write(postings.join(shared, ["space", "sig"]), "shared")
    votes = postings.groupBy("key", "leader").count().groupBy("key").agg(F.max(F.struct("count", -F.col("leader"))).getField("col2").alias("l")).select("key", (-F.col("l")).alias("leader"))
    votes = scratch.write(votes, "votes")
    around = votes.groupBy("leader").agg(F.count("*").alias("n"))
    met = postings.select("space", "sig", "key").join(votes, "key").select("space", "sig", "leader").distinct().join(around, "leader")
    largest = met.groupBy("space", "sig").agg(F.max(F.struct("n", "leader")).alias("large"))
    drawn = met.join(largest, ["space", "sig"]).groupBy("leader", "n").agg(F.max("large").alias("large")).filter(F.col("large.n") >= ABSORBS * F.col("n"))
    votes = votes.join(drawn.select("leader", F.col("large.leader").alias("other")), "leader", "left").select("key", F.coalesce("other", "leader").alias("leader"))
    sizes = votes.groupBy("leader").agg(F.ceil(F.count("*") / BLOCK_SETS).alias("parts"))
    block = F.xxhash64("leader", F.pmod(F.xxhash64("key"), F.col("parts")))
    blocks = scratch.write(votes.join(sizes, "leader").select("key", block.alias("block")), "blocks")
    spread = postings.join(blocks, "key").groupBy("space", "sig", "block").agg(F.max("heavy").alias("heavy"))
    a, b = spread.select("space", "sig", F.col("block").alias("a"), F.col("heavy").alias("p")), spread.select("space", "sig", F.col("block").alias("b"), F.col("heavy").alias("q"))
    pairs = a.join(b, ["space", "sig"]).filter("a < b AND (p OR q)").select("a", "b").distinct()
    pairs = scratch.write(pairs.union(blocks.select(F.col("block").alias("a"), F.col("block").alias("b")).distinct()), "pairs")
    own = sets.join(blocks, "key").select("block", "key", "n", "weight", "toks")
    sides = pairs.select("a", "b", F.col("a").alias("block"), F.lit(0).alias("side")).union(pairs.filter("a <> b").select("a", "b", F.col("b").alias("block"), F.lit(1).alias("side")))
    bundles = max(1, sides.join(blocks, "block").count() // 4000)
    shipped = sides.join(own, "block").withColumn("bundle", F.pmod(F.xxhash64("a", "b"), F.lit(bundles)))
    return shipped.groupBy("bundle").applyInArrow(_verify, "key long, root long, links long")


def row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What tells rows apart: the id where no rows share one, else a hash of id and text; null where the id is."""
    i = F.col(id_col).cast("long")
    if docs.select(i.alias("i")).filter("i IS NOT NULL").groupBy("i").count().filter("count > 1").isEmpty():
        return i
    return F.when(i.isNotNull(), F.xxhash64(i, F.col(text_col)))


def join(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None) -> DataFrame:
    """One row (doc_id, n_shingles, component_id, n_links) for each document.

    component_id is the smallest id reachable by links; n_links the number of
    other documents that the document links to, copies included. key: row_key
    of docs, if the result is to have it as a column key, and in is_first
    whether it is the one key of the component to keep: the least of those with
    the smallest id.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "join")
    with_key = key is not None
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (key if with_key else row_key(docs, id_col, text_col)).alias("key"))
    keyed = docs.filter("doc_id IS NOT NULL")
    bytes_ = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 << max(0, (bytes_ // BUCKET_BYTES).bit_length())
    chunks = max(1, buckets // 2)
    pieces = keyed.mapInArrow(_pieces(k, buckets, chunks), PIECE).groupBy("bucket").applyInArrow(_count(chunks), PIECE)
    pieces = scratch.write(pieces, "pieces")
    profiles = scratch.write(pieces.filter(F.col("kind") == PROFILE).mapInArrow(_profile_rows, "doc_id long, key long, n long, hi long, lo long"), "profiles")
    found = scratch.write(pieces.groupBy("bucket").applyInArrow(_sets, SET), "found")
    scratch.drop("pieces")
    classes = scratch.write(profiles.filter("n > 0").groupBy("n", "hi", "lo").agg(F.min("key").alias("key"), F.min(F.struct("doc_id", F.col("key").alias("row"))).alias("first"), F.count("*").alias("weight")), "classes")
    sets = scratch.write(found.join(classes.select("key", "weight"), "key"), "sets")
    scratch.drop("found")
    stars = scratch.write(_links(sets, scratch), "stars")
    roots = components(stars.select(F.col("key").alias("a"), F.col("root").alias("b"))).select(F.col("a").alias("key"), F.col("b").alias("root"))
    links = stars.groupBy("key").agg(F.sum("links").alias("links"))
    classes = classes.join(roots, "key", "left").join(links, "key", "left").withColumn("root", F.coalesce("root", "key"))
    classes = scratch.write(classes, "rooted")
    least = scratch.write(classes.groupBy("root").agg(F.min("first").alias("least")), "least")  # written, so that a join can split a large component
    classes = scratch.write(classes.join(least, "root").select("n", "hi", "lo", "least", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "labelled")
    scratch.drop("sets", "classes", "postings", "shared", "votes", "blocks", "pairs", "stars", "rooted", "least")
    out = profiles.join(classes, ["n", "hi", "lo"], "left")
    result = ["doc_id", F.col("n").alias("n_shingles"), F.coalesce("least.doc_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")]
    if with_key:
        return out.select(*result, "key", F.coalesce(F.col("least.row") == F.col("key"), F.lit(True)).alias("is_first"))
    out = out.select(*result)
    nameless = docs.filter("doc_id IS NULL")
    if nameless.isEmpty():
        return out
    sized = nameless.withColumn("key", F.lit(0).cast("long")).withColumn("doc_id", F.lit(0).cast("long")).mapInArrow(_pieces(k, 1, 1), PIECE).filter(F.col("kind") == PROFILE).mapInArrow(_profile_rows, "doc_id long, key long, n long, hi long, lo long")
    return out.union(sized.select(F.lit(None).cast("long"), "n", F.lit(None).cast("long"), F.lit(0).cast("long")))
