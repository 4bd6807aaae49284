"""Edits of ordered pages and elements.

Order is a column (page_idx or ord, from 0 without gaps within its owner), and
inserting, removing and moving renumber it by a CASE over the places involved;
no sort and no window over the list. Each takes a table of edits with one row
for each owner at most; owners without an edit stay as they are. Undo of a
move, insert or delete restores what was there before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from . import layout


def insert_place(index: Column, count: Column) -> Column:
    """An index that is null or at the end or beyond appends."""
    return F.when(index.isNull() | (index >= count) | (index < 0), count).otherwise(index)


def moved_place(place: Column, start: Column, end: Column, count: Column) -> Column:
    """Where place is after the item at start has moved to end; out-of-range moves do nothing."""
    inside = start.between(0, count - 1) & end.between(0, count - 1)
    shifted = (
        F.when(place == start, end)
        .when((start < end) & (place > start) & (place <= end), place - 1)
        .when((end < start) & (place >= end) & (place < start), place + 1)
        .otherwise(place)
    )
    return F.when(F.coalesce(inside, F.lit(False)), shifted).otherwise(place)


def insert(items: DataFrame, edits: DataFrame, owner: str, order: str, id_col: str) -> DataFrame:
    """edits: owner, new_id, at. Inserts an item at a place, moving later ones on; other columns of it are null."""
    counts = items.groupBy(owner).agg(F.count("*").alias("__n"))
    placed = edits.join(counts, owner, "left").select(owner, "new_id", insert_place(F.col("at"), F.coalesce("__n", F.lit(0))).alias("__at"))
    kept = items.join(placed, owner, "left").withColumn(order, F.when(F.col(order) >= F.col("__at"), F.col(order) + 1).otherwise(F.col(order))).drop("new_id", "__at")
    new = placed.select(owner, F.col("new_id").alias(id_col), F.col("__at").alias(order))
    return kept.unionByName(new, allowMissingColumns=True)


def remove(items: DataFrame, edits: DataFrame, owner: str, order: str) -> DataFrame:
    """edits: owner, at. Removes the item at a place, moving later ones up; places that don't exist do nothing."""
    met = items.join(edits.select(owner, F.col("at").alias("__at")), owner, "left")
    kept = met.filter(F.col("__at").isNull() | (F.col(order) != F.col("__at")))
    return kept.withColumn(order, F.when(F.col("__at").between(0, F.col(order)), F.col(order) - 1).otherwise(F.col(order))).drop("__at")


def move(items: DataFrame, edits: DataFrame, owner: str, order: str) -> DataFrame:
    """edits: owner, from_idx, to_idx. Moves an item to a place."""
    counts = items.groupBy(owner).agg(F.count("*").alias("__n"))
    met = items.join(edits.select(owner, F.col("from_idx").alias("__from"), F.col("to_idx").alias("__to")), owner, "left").join(counts, owner)
    return met.withColumn(order, moved_place(F.col(order), F.col("__from"), F.col("__to"), F.col("__n"))).drop("__from", "__to", "__n")


def move_to(bounds: Column, x: Column, y: Column) -> Column:
    """bounds at another place; null x or y keep them."""
    return F.struct(F.coalesce(x, bounds["x"]).alias("x"), F.coalesce(y, bounds["y"]).alias("y"), bounds["width"].alias("width"), bounds["height"].alias("height"))


def resize_to(bounds: Column, new: Column) -> Column:
    """The new bounds in place of the old, place and size alike; null keeps these."""
    return F.coalesce(new, bounds)


def new_tables(wanted: DataFrame) -> DataFrame:
    """wanted: table_id, rows, cols (clamped to 1..100). The table elements: their size and bounds, which hold all cells."""
    size = lambda c: F.least(F.greatest(F.col(c), F.lit(1)), F.lit(layout.MOST_CELLS)).cast("int")
    sized = wanted.withColumns({"rows": size("rows"), "cols": size("cols")})
    return sized.withColumn("bounds", geometry.rect(F.lit(layout.TABLE_X), F.lit(layout.TABLE_Y), layout.COL_WIDTH * F.col("cols"), layout.ROW_HEIGHT * F.col("rows")))


def modify_text(kind: Column, text: Column, new: Column) -> Column:
    """Only text elements take a new text."""
    return F.when((kind == "text") & new.isNotNull(), new).otherwise(text)


def select(elements: DataFrame, target: Column) -> DataFrame:
    """At most one element is selected; none if target is null."""
    return elements.withColumn("selected", F.coalesce(F.col("element_id") == target, F.lit(False)))


def latest_positions(log: DataFrame) -> DataFrame:
    """Of each element, where its last move left it, and how many moves there were."""
    moves = log.filter("op = 'move'")
    return moves.groupBy("doc_id", "element_id").agg(F.max_by("x", "seq").alias("x"), F.max_by("y", "seq").alias("y"), F.count("*").alias("moves"))


def mark_modified(rows: DataFrame, changed: Column, now: Column | None = None) -> DataFrame:
    """Sets modified, and modification_date to now (the time of the query, unless given), where changed; the rest keep theirs (none: not modified, no date)."""
    old = F.col("modified") if "modified" in rows.columns else F.lit(False)
    date = F.col("modification_date") if "modification_date" in rows.columns else F.lit(None).cast("timestamp")
    return rows.withColumns({"modified": old | changed, "modification_date": F.when(changed, F.current_timestamp() if now is None else now).otherwise(date)})


def add_tabs(tabs: DataFrame, new: DataFrame) -> DataFrame:
    """new: doc_id, id, name. Tabs start without pages; documents aren't marked as modified."""
    return tabs.unionByName(new.withColumn("page_indices", F.array().cast("array<bigint>")), allowMissingColumns=True)


def remove_tabs(tabs: DataFrame, gone: DataFrame) -> DataFrame:
    """gone: id. Ids that aren't there do nothing."""
    return tabs.join(gone.select("id"), "id", "left_anti")
