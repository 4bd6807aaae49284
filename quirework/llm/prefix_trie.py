"""Conversation prefix trie by prefix-doubling naming.

Every distinct sequence of first turns is a node; conversations that start with
it are its members. Nodes are found without walking a trie:

* Turns get dense names (0, 1, 2, ...), equal for equal (role, text).
* Blocks of 2, 4, 8, ... turns at multiples of their length are named from the
  names of their two halves, one round a length; each round has half the rows
  of the one before.
* The first d turns are the blocks of d's binary digits, longest first. Their
  names, one column a digit, are the prefix's name, and one grouping by it gives
  the nodes.

The smallest member stands for a node, so (conv_id, depth) is its key. Sums over
subtrees need no rounds: each node counts for the conversation that stands for
it, and a subtree is what its members stand for at its depth or below. So a
running sum up each conversation, then one sum over the members, gives them.

Turns are told apart by the SHA-256 of role and text; only that digest and the
text's length are shuffled. Turns are numbered by ranges of the sorted table,
and running sums within a conversation go by segments of 4096 turns, so one
conversation may hold any share of the rows. The members of a node that end
there are hashed in ascending order: lists of up to a batch are written out by
many tasks, and of one node these pieces pass through one task, one at a time.

Defined results: rows of a null conversation take no part. A null turn comes
first; turns that share a number are ordered by their digest. A null role or
text is the empty one. A conversation without turns is a member of the root
alone, if it is named in ``convs``. An empty table gives no nodes. Columns other
than the named ones are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch

#: Turns of a conversation that are summed together.
SEGMENT = 4096
_NODE = ["rep", "depth"]
_PART = 33  # bits of a row's number within its partition, in monotonically_increasing_id
_PIECE = "rep long, depth long, first long, piece string"
_HASHED = "rep long, depth long, ends_sha256 string"


def _part(at: str) -> Column:
    return F.shiftright(F.col(at), _PART)


def ordered(messages: DataFrame, scratch: Scratch, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(turns, convs): turns with conv, pos (from 0), digest and bytes; convs with conv and n, its turns."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = messages.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    order = ["conv", F.asc_nulls_first("turn"), "digest"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = scratch.write(rows.select("conv", "digest", "bytes", F.monotonically_increasing_id().alias("at")), "sorted")
    rows = rows.withColumn("part", _part("at"))
    runs = rows.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = scratch.write(runs.withColumn("shift", before - F.col("first")), "runs")
    turns = rows.join(runs.select("conv", "part", "shift"), ["conv", "part"]).select("conv", (F.col("at") + F.col("shift")).alias("pos"), "digest", "bytes")
    return turns, runs.groupBy("conv").agg(F.sum("n").alias("n"))


def with_openings(turns: DataFrame, convs: DataFrame, scratch: Scratch, base: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt from shared openings, as ordered() returns them.

    base and head, of the column conv, name the conversation whose first head
    turns (all, if it has fewer; none, if it is absent) come before the
    conversation's own turns after its first head. head is at most most.
    """
    convs = convs.withColumns({"base": base, "head": head})
    of_base = convs.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(of_base, "base", "left").withColumn("got", F.least("head", F.coalesce("n_base", F.lit(0))))
    convs = scratch.write(convs.select("conv", "base", "head", "got", (F.col("got") + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("n")), "convs")
    own = turns.filter(F.col("pos") >= head).join(convs.select("conv", "head", "got"), "conv")
    own = own.select("conv", (F.col("pos") - F.col("head") + F.col("got")).alias("pos"), "digest", "bytes")
    opening = turns.filter(F.col("pos") < most).withColumnRenamed("conv", "base").join(convs.select("conv", "base", "got"), "base").filter(F.col("pos") < F.col("got"))
    return own.unionByName(opening.select("conv", "pos", "digest", "bytes")), convs.select("conv", "n")


def dense_names(keys: DataFrame, scratch: Scratch, table: str) -> DataFrame:
    """keys, distinct rows, with name: 0, 1, 2, ... over all of them."""
    found = scratch.write(keys.withColumn("at", F.monotonically_increasing_id()), table)
    sizes = found.groupBy(_part("at").alias("part")).agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    named = found.withColumn("part", _part("at")).join(F.broadcast(before), "part")  # one row a partition
    return named.select(*keys.columns, (F.col("before") + F.col("at").bitwiseAND((1 << _PART) - 1)).alias("name"))


def _from_to(first: Column, last: Column) -> list[Column]:
    """Two columns to explode one after the other: runs of at most SEGMENT numbers, and the numbers of a run."""
    return [F.sequence(first, last, F.lit(SEGMENT).cast("long")), F.sequence(F.col("run"), F.least(F.col("run") + SEGMENT - 1, last))]


def _prefixes(turns: DataFrame, scratch: Scratch, longest: int) -> tuple[DataFrame, list[str]]:
    """Each conversation's first depth turns, by their name's columns; with the last one's bytes."""
    named = turns.join(dense_names(turns.select("digest").distinct(), scratch, "names0"), "digest")
    level = scratch.write(named.select("conv", F.col("pos").alias("block"), "name", "bytes"), "blocks0")
    even = F.col("block") % 2 == 0
    parts = [level.select("conv", (F.col("block") + 1).alias("depth"), F.when(even, F.lit(0)).alias("digit"), F.when(even, F.col("name")).alias("name"), "bytes")]
    digits = max(1, longest.bit_length())
    for k in range(1, digits):
        halves = level.groupBy("conv", F.shiftright("block", 1).alias("block")).agg(F.max(F.when(even, F.col("name"))).alias("left"), F.max(F.when(~even, F.col("name"))).alias("right"))
        halves = scratch.write(halves.filter("right IS NOT NULL"), f"halves{k}")
        names = dense_names(halves.select("left", "right").distinct(), scratch, f"names{k}")
        level = scratch.write(halves.join(names, ["left", "right"]).select("conv", "block", "name"), f"blocks{k}")
        first = F.shiftleft(F.col("block"), k) + (1 << k)
        runs, each = _from_to(first, first + ((1 << k) - 1))
        spread = level.filter(even).select("conv", "block", "name", F.explode(runs).alias("run")).select("conv", F.explode(each).alias("depth"), "name")
        parts.append(spread.select("conv", "depth", F.lit(k).alias("digit"), "name", F.lit(None).cast("long").alias("bytes")))
        scratch.drop(f"halves{k}")
    pieces = parts[0]
    for p in parts[1:]:
        pieces = pieces.unionByName(p)
    columns = [f"n{k}" for k in range(digits)]
    named = [F.coalesce(F.max(F.when(F.col("digit") == k, F.col("name"))), F.lit(-1)).alias(c) for k, c in enumerate(columns)]
    met = pieces.groupBy("conv", "depth").agg(*named, F.max("bytes").alias("bytes"))
    return met.filter("bytes IS NOT NULL"), columns


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (rep, depth, conv) to the decimal ids of each node's rows in a batch, comma-joined."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rep, depth, conv = (batch.column(c).to_numpy() for c in (*_NODE, "conv"))
        start = np.flatnonzero(np.r_[True, (rep[1:] != rep[:-1]) | (depth[1:] != depth[:-1])])
        ids, edges = list(map(str, conv.tolist())), [*start.tolist(), len(conv)]
        joined = [",".join(ids[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(rep[start]), pa.array(depth[start]), pa.array(conv[start]), pa.array(joined, pa.string())], ["rep", "depth", "first", "piece"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (rep, depth, first) to each node's hash; one piece is held at a time."""
    now, state = None, None
    for batch in batches:
        done = []
        for key, piece in zip(zip(*(batch.column(c).to_pylist() for c in _NODE), strict=True), batch.column("piece"), strict=True):
            if key == now:
                state.update(b"," + piece.as_py().encode())
            else:
                if now:
                    done.append((*now, state.hexdigest()))
                now, state = key, hashlib.sha256(piece.as_py().encode())
        yield _hashes(done)
    if now:
        yield _hashes([(*now, state.hexdigest())])


def _hashes(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], ["rep", "depth", "ends_sha256"])


def _ends(members: DataFrame) -> DataFrame:
    rows = members.select(*_NODE, "conv")
    rows = rows.repartitionByRange(*_NODE, "conv").sortWithinPartitions(*_NODE, "conv")
    pieces = rows.mapInArrow(_pieces, _PIECE)
    return pieces.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(_hashed, _HASHED)


def trie(turns: DataFrame, convs: DataFrame, scratch: Scratch) -> DataFrame:
    """turns: conv, pos, digest, bytes. convs: conv and n for every conversation. One row a node."""
    about = convs.agg(F.count("*").alias("n"), F.min("conv").alias("least"), F.max("n").alias("longest"), F.max(F.when(F.col("n") > 0, 1)).alias("deep")).first()
    spark = turns.sparkSession
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    if not about["n"]:
        return spark.createDataFrame([], ", ".join(f"{c} long" for c in names) + ", ends_sha256 string")
    prefixes, key = _prefixes(turns, scratch, about["longest"])
    prefixes = scratch.write(prefixes.join(convs, "conv").withColumn("last", F.col("depth") == F.col("n")).drop("n"), "prefixes")
    nodes = prefixes.groupBy("depth", *key).agg(F.min("conv").alias("rep"), F.count("*").alias("n"), F.max("bytes").alias("bytes"), F.max(~F.col("last")).alias("inner"))
    own = F.col("conv") == F.col("rep")
    found = prefixes.drop("bytes").join(nodes, ["depth", *key])
    found = found.select("conv", "depth", "rep", "last", F.when(own, F.col("n")).alias("n"), F.when(own, (F.col("n") - 1) * F.col("bytes")).alias("saved"), F.when(own & ~F.col("inner"), 1).alias("leaf"))
    # The root holds every conversation, so it is counted, not grouped and joined.
    first = F.col("conv") == about["least"]
    root = convs.select(
        "conv", F.lit(0).cast("long").alias("depth"), F.lit(about["least"]).cast("long").alias("rep"), (F.col("n") == 0).alias("last"), F.when(first, F.lit(about["n"])).cast("long").alias("n"),
        F.when(first, 0).cast("long").alias("saved"), F.when(first & F.lit(not about["deep"]), 1).alias("leaf"),
    )
    members = scratch.write(found.unionByName(root).withColumn("segment", F.floor(F.col("depth") / SEGMENT)), "members")

    up = Window.partitionBy("conv", "segment").orderBy(F.desc("depth"))
    so_far = up.rowsBetween(Window.unboundedPreceding, 0)
    sums = members.select("conv", *_NODE, "n", "segment", own.alias("own"), F.sum("saved").over(so_far).alias("saved"), F.sum("leaf").over(so_far).alias("leaves"), F.lead("rep").over(up).alias("parent"))
    # Of a conversation with more than one segment: sums of the later ones, and who stands for the node before a segment.
    later = members.filter("segment > 0").groupBy("conv", (F.col("segment") - 1).alias("segment")).agg(F.sum("saved").alias("s"), F.sum("leaf").alias("l"))
    onward = Window.partitionBy("conv").orderBy(F.desc("segment"))
    later = later.select("conv", "segment", F.sum("s").over(onward).alias("later_saved"), F.sum("l").over(onward).alias("later_leaves"))
    before = members.filter(F.col("depth") % SEGMENT == SEGMENT - 1).select("conv", (F.col("segment") + 1).alias("segment"), F.col("rep").alias("before"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    sums = sums.join(later, ["conv", "segment"], "left").join(before, ["conv", "segment"], "left")
    sums = sums.select(*_NODE, "n", "own", (zero("saved") + zero("later_saved")).alias("saved"), (zero("leaves") + zero("later_leaves")).alias("leaves"), F.coalesce("parent", "before").alias("parent"))
    # Each node reports itself and, to its parent, that it is a child.
    none = F.lit(None).cast("long")
    itself = F.struct(*_NODE, "n", "saved", "leaves", F.when(F.col("own"), F.col("parent")).alias("parent"), F.lit(0).cast("long").alias("child"))
    to_parent = F.struct(F.col("parent").alias("rep"), (F.col("depth") - 1).alias("depth"), none.alias("n"), F.lit(0).cast("long").alias("saved"), F.lit(0).cast("long").alias("leaves"), none.alias("parent"), F.lit(1).cast("long").alias("child"))
    reports = sums.select(F.inline(F.when(F.col("own") & (F.col("depth") > 0), F.array(itself, to_parent)).otherwise(F.array(itself))))
    ends = _ends(members.filter("last")).select(*_NODE, none.alias("n"), none.alias("saved"), none.alias("leaves"), none.alias("parent"), none.alias("child"), "ends_sha256")
    reports = reports.withColumn("ends_sha256", F.lit(None).cast("string")).unionByName(ends)
    out = reports.groupBy(*_NODE).agg(
        F.max("parent").alias("parent_conv_id"), F.max("n").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
        F.coalesce(F.max("ends_sha256"), F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
    return out.withColumnRenamed("rep", "conv_id").select(*names, "ends_sha256")


def build(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of a table of turns: one row (conv_id, depth, ...) a node.

    conv_id is the smallest member, parent_conv_id the parent's (null at the
    root); n_convs counts members, n_children and n_leaves children and childless
    nodes of the subtree; saved_tokens is what a cache of prefixes would save, in
    bytes: of each node of the subtree its last text, once for each member but
    one. ends_sha256 digests the ids of members that end at the node.
    """
    scratch = Scratch(messages.sparkSession, "trie")
    turns, convs = ordered(messages, scratch, conv_col, turn_col, role_col, text_col)
    return trie(turns, scratch.write(convs, "convs"), scratch)


def build_with_openings(messages: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) rebuilt by with_openings()."""
    scratch = Scratch(messages.sparkSession, "trie")
    turns, convs = ordered(messages, scratch)
    return trie(*with_openings(turns, convs, scratch, base, head, most), scratch)
