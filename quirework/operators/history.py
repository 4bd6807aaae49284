"""Edit history: coalescing, what is live after undo and redo, and the elements that follow from it.

The undo stack is a fold over one document's log in order of seq: a pointer into
the list of commands, which undo and redo move and a new command cuts off behind
itself. Logs are cut into segments of SEGMENT commands, whatever the documents,
so one document's log may be spread over many tasks:

* Of a document that begins and ends within a segment, the stack is found there.
* Of others, each segment is summed up: undos and redos before its first new
  command as runs; then, by the pointer's place at that command, where pointer
  and stack end. That is one difference for all places from which no undo meets
  the bottom, and a table for the places below, as many as the segment's undos.
* A document's summaries, one row a segment, are chained from its begin.
* Each segment is then replayed from what it begins with, and says at which
  depth its new commands stand. A command is still on the stack in the end if
  no later one stands at its depth or below: a running minimum over segments.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import new_folder

#: Commands of a segment, a power of two.
SEGMENT = 8192
PUSH, UNDO, REDO = 0, 1, 2
_KEPT = "doc_id long, segment long, seq long, done boolean"
_SUMMARY = "doc_id long, segment long, lead array<int>, pushes boolean, need int, pointer int, top int, pointers array<int>, tops array<int>"
_STATE = "doc_id long, segment long, pointer long, top long, final long"
_PLACED = "doc_id long, segment long, seq long, depth long"


def coalesced(log: DataFrame) -> DataFrame:
    """Runs of consecutive moves of one element as one command: the oldest start, the newest end."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    same = (F.col("op") == "move") & (F.lag("op").over(w) == "move") & (F.lag("element_id").over(w) == F.col("element_id"))
    run = F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(w)
    return (
        log.withColumn("run", run)
        .groupBy("doc_id", "run", "op", "element_id")
        .agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.min_by("x", "seq").alias("old_x"), F.max_by("x", "seq").alias("new_x"), F.count("*").alias("commands"))
    )


def _documents(group: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray, bool]]:
    """The documents of a segment: id, seqs and codes in order, and whether the segment's edge cuts them off."""
    order = np.argsort(group.column("at").to_numpy(), kind="stable")
    doc, seq, code = (group.column(c).to_numpy()[order] for c in ("doc_id", "seq", "code"))
    edges = np.r_[np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]), len(doc)].tolist()
    return [(int(doc[a]), seq[a:b], code[a:b], a == 0 or b == len(doc)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _played(codes: list[int], pointer: int, top: int) -> tuple[int, int, list[int]]:
    """Pointer and top after some commands, and the depth at which each new command stands."""
    depths = []
    for code in codes:
        if code == PUSH:
            depths.append(pointer)
            pointer += 1
            top = pointer
        elif code == UNDO:
            pointer = max(0, pointer - 1)
        else:
            pointer = min(top, pointer + 1)
    return pointer, top, depths


def _surviving(seqs: np.ndarray, codes: np.ndarray, depths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """New commands that no later one of the same rows stands at or below, with their depths."""
    depth = np.array(depths, np.int64)
    later = np.r_[np.minimum.accumulate(depth[::-1])[::-1][1:], np.iinfo(np.int64).max] if len(depth) else depth
    return seqs[codes == PUSH][depth < later], depth[depth < later]


def _inner(group: pa.Table) -> pa.Table:
    """Commands on the stacks of documents that are whole in a segment."""
    out = []
    for doc, seqs, codes, cut in _documents(group):
        if not cut:
            pointer, _, depths = _played(codes.tolist(), 0, 0)
            seq, depth = _surviving(seqs, codes, depths)
            out += [(doc, 0, s, d < pointer) for s, d in zip(seq.tolist(), depth.tolist(), strict=True)]
    columns = list(zip(*out, strict=True)) or [(), (), (), ()]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("doc_id", "segment", "seq", "done"), columns, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)})


def _summed(group: pa.Table) -> pa.Table:
    """What a segment does to the stacks of documents that its edges cut."""
    segment, out = group.column("segment")[0].as_py(), []
    for doc, _, codes, cut in _documents(group):
        if cut:
            pushes = np.flatnonzero(codes == PUSH)
            first = int(pushes[0]) if len(pushes) else len(codes)
            lead = codes[:first]
            turns = np.r_[np.flatnonzero(np.r_[True, lead[1:] != lead[:-1]]), first] if first else np.zeros(1, np.int64)
            runs = [int(b - a) if lead[a] == REDO else -int(b - a) for a, b in zip(turns[:-1], turns[1:], strict=True)]
            rest, far = codes[first:].tolist(), len(codes) + 1
            pointer, top, _ = _played(rest, far, far)
            lowest = now = 0
            for code in rest:
                # Redos are taken as nothing here, so this is at most what is needed.
                now += (code == PUSH) - (code == UNDO)
                lowest = min(lowest, now)
            pointers = np.arange(-lowest)
            tops = pointers.copy()
            if lowest:
                for code in rest:
                    if code == PUSH:
                        pointers = pointers + 1
                        tops = pointers
                    elif code == UNDO:
                        pointers = np.maximum(0, pointers - 1)
                    else:
                        pointers = np.minimum(tops, pointers + 1)
            out.append((doc, segment, runs, first < len(codes), -lowest, pointer - far, top - far, pointers.tolist(), tops.tolist()))
    columns = list(zip(*out, strict=True)) or [()] * 9
    ints = pa.list_(pa.int32())
    kinds = (pa.int64(), pa.int64(), ints, pa.bool_(), pa.int32(), pa.int32(), pa.int32(), ints, ints)
    return pa.table({f.split()[0]: pa.array(c, t) for f, c, t in zip(_SUMMARY.split(", "), columns, kinds, strict=True)})


def _chained(group: pa.Table) -> pa.Table:
    """With which pointer and top each segment of a document begins, and the pointer in the end."""
    pointer = top = 0
    out = []
    for r in sorted(group.to_pylist(), key=lambda r: r["segment"]):
        out.append((r["doc_id"], r["segment"], pointer, top))
        for run in r["lead"]:
            pointer = min(top, pointer + run) if run > 0 else max(0, pointer + run)
        if r["pushes"]:
            known = pointer < r["need"]
            pointer, top = (r["pointers"][pointer], r["tops"][pointer]) if known else (pointer + r["pointer"], pointer + r["top"])
    columns = [*zip(*out, strict=True), [pointer] * len(out)]
    return pa.table({f.split()[0]: pa.array(c, pa.int64()) for f, c in zip(_STATE.split(", "), columns, strict=True)})


def _replayed(group: pa.Table) -> pa.Table:
    """Depths of the new commands of cut documents that their own segment leaves on the stack."""
    begin = {r["doc_id"]: (r["pointer"], r["top"]) for r in group.select(["doc_id", "pointer", "top"]).group_by(["doc_id", "pointer", "top"]).aggregate([]).to_pylist()}
    segment, out = group.column("segment")[0].as_py(), []
    for doc, seqs, codes, _ in _documents(group):
        seq, depth = _surviving(seqs, codes, _played(codes.tolist(), *begin[doc])[2])
        out += [(doc, segment, s, d) for s, d in zip(seq.tolist(), depth.tolist(), strict=True)]
    columns = list(zip(*out, strict=True)) or [(), (), (), ()]
    return pa.table({f.split()[0]: pa.array(c, pa.int64()) for f, c in zip(_PLACED.split(", "), columns, strict=True)})


def on_stack(log: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(doc_id, seq, done) of each command that is on its document's stack after the whole log: done, or undone and to be redone.

    A command after undos discards what could be redone; undo and redo without
    anything to act on do nothing. Rows with a null document or seq are left out.
    """
    spark = log.sparkSession
    code = F.when(F.col("op") == "undo", UNDO).when(F.col("op") == "redo", REDO).otherwise(PUSH).cast("byte")
    rows = log.filter("doc_id IS NOT NULL AND seq IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("seq").cast("long").alias("seq"), code.alias("code"))
    at = new_folder(spark, "history")
    rows.repartitionByRange("doc_id", "seq").sortWithinPartitions("doc_id", "seq").withColumn("at", F.monotonically_increasing_id()).write.parquet(f"{at}/log")
    rows = spark.read.parquet(f"{at}/log").withColumn("segment", F.shiftright("at", segment.bit_length() - 1))
    inner = rows.groupBy("segment").applyInArrow(_inner, _KEPT)
    rows.groupBy("segment").applyInArrow(_summed, _SUMMARY).groupBy("doc_id").applyInArrow(_chained, _STATE).write.parquet(f"{at}/states")
    states = spark.read.parquet(f"{at}/states")
    placed = rows.join(states, ["doc_id", "segment"]).groupBy("segment").applyInArrow(_replayed, _PLACED)
    placed.write.parquet(f"{at}/placed")
    placed = spark.read.parquet(f"{at}/placed")
    onward = Window.partitionBy("doc_id").orderBy(F.desc("segment")).rowsBetween(Window.unboundedPreceding, -1)
    least = states.join(placed.groupBy("doc_id", "segment").agg(F.min("depth").alias("depth")), ["doc_id", "segment"], "left")
    least = least.select("doc_id", "segment", "final", F.min("depth").over(onward).alias("later"))
    cut = placed.join(least, ["doc_id", "segment"]).filter("later IS NULL OR depth < later")
    return inner.select("doc_id", "seq", "done").unionByName(cut.select("doc_id", "seq", (F.col("depth") < F.col("final")).alias("done")))


def live(log: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Of each document, the seqs still done, those that can be redone (the next one last), after its whole log."""
    seqs = lambda keep: F.sort_array(F.collect_list(F.when(keep, F.col("seq"))))
    stacks = on_stack(log, segment).groupBy("doc_id").agg(seqs(F.col("done")).alias("done"), F.reverse(seqs(~F.col("done"))).alias("undone"))
    none = F.array().cast("array<long>")
    documents = log.filter("doc_id IS NOT NULL AND seq IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return documents.join(stacks, "doc_id", "left").select("doc_id", F.coalesce("done", none).alias("done"), F.coalesce("undone", none).alias("undone"))


def replayed(elements: DataFrame, log: DataFrame) -> DataFrame:
    """The elements after a log with its undos and redos: each command that is live in the end takes effect, in order.

    elements: doc_id, element_id, bounds, text (null unless a text element). log:
    doc_id, seq, op, element_id and, as the op asks, x and y (move), bounds
    (resize), text; insert and delete of an element. Undone commands leave what
    was there before; whatever was ever done to an element marks it as modified.
    Commands on elements that aren't there do nothing; an inserted one without
    bounds and text of its own gets those of its commands.
    """
    done = on_stack(log).filter("done").select("doc_id", "seq")
    act = log.filter(~F.col("op").isin("undo", "redo"))
    kept = act.join(done.withColumn("live", F.lit(True)), ["doc_id", "seq"], "left").withColumn("live", F.coalesce("live", F.lit(False)))

    def last(value: str | Column, *ops: str) -> Column:
        return F.max_by(F.when(F.col("op").isin(*ops), F.struct(F.lit(1).alias("set"), (F.col(value) if isinstance(value, str) else value).alias("v"))), F.when(F.col("op").isin(*ops) & F.col("live"), F.col("seq")))["v"]

    moved = lambda c: F.when(F.col("op") == "resize", F.col(f"bounds.{c}")).otherwise(F.col(c))
    state = kept.groupBy("doc_id", "element_id").agg(
        last(moved("x"), "move", "resize").alias("nx"), last(moved("y"), "move", "resize").alias("ny"),
        last("bounds.width", "resize").alias("nw"), last("bounds.height", "resize").alias("nh"), last("text", "text").alias("nt"),
        last(F.col("op") == "insert", "insert", "delete").alias("inserted"),
    )
    both = elements.withColumn("was", F.lit(True)).join(state.withColumn("touched", F.lit(True)), ["doc_id", "element_id"], "full")
    there = F.coalesce("inserted", "was", F.lit(False))
    b = F.struct(F.coalesce("nx", "bounds.x").alias("x"), F.coalesce("ny", "bounds.y").alias("y"), F.coalesce("nw", "bounds.width").alias("width"), F.coalesce("nh", "bounds.height").alias("height"))
    text = F.when(F.col("text").isNotNull() | F.col("was").isNull(), F.coalesce("nt", "text"))
    return both.filter(there).select("doc_id", "element_id", b.alias("bounds"), text.alias("text"), F.coalesce("touched", F.lit(False)).alias("modified"))


def drags(events: DataFrame) -> DataFrame:
    """events: doc_id, seq, kind (press, move, release; others are passed over), element_id (of a press: what it hit, or null), x, y. One move command for each release that ends a drag.

    The last element pressed since the release before is dragged, by the steps
    of all moves after that press; a press beside it sets a new start but doesn't
    let go. A release pushes its command even where nothing moved.
    """
    w = Window.partitionBy("doc_id").orderBy("seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = events.filter(F.col("kind").isin("press", "move", "release"))
    rows = rows.withColumn("stretch", F.coalesce(F.count(F.when(F.col("kind") == "release", 1)).over(before), F.lit(0)))
    inside = Window.partitionBy("doc_id", "stretch")
    held = F.max(F.when((F.col("kind") == "press") & F.col("element_id").isNotNull(), F.struct("seq", "element_id"))).over(inside)
    rows = rows.withColumn("held", held).filter(F.col("held").isNotNull() & (F.col("seq") >= F.col("held.seq")))
    steps = Window.partitionBy("doc_id", "stretch").orderBy("seq")
    step = lambda c: F.sum(F.when(F.col("kind") == "move", F.col(c) - F.col(f"last_{c}")).otherwise(0.0))
    rows = rows.withColumns({f"last_{c}": F.lag(c).over(steps) for c in "xy"})
    ended = rows.groupBy("doc_id", "stretch").agg(F.first("held.element_id").alias("element_id"), F.min("seq").alias("press_seq"), F.max(F.when(F.col("kind") == "release", F.col("seq"))).alias("release_seq"), step("x").alias("dx"), step("y").alias("dy"))
    return ended.filter("release_seq IS NOT NULL").drop("stretch")
