"""Placement: what is visible, in which order it is drawn, and where table cells stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry

#: Pages that a viewport meets together, and what rounding may cost, in pages.
BIN, SLACK = 16, 1e-6
# Fixed values.
#: Largest difference of zoom for which a rendered page is used again.
ZOOM_TOLERANCE = 0.001
TABLE_X, TABLE_Y, ROW_HEIGHT, COL_WIDTH = 100.0, 100.0, 30.0, 100.0
MOST_CELLS = 100


def near_pages(pages: DataFrame, viewports: DataFrame) -> DataFrame:
    """Pages that a document's viewport may show: those of the bins that it reaches.

    An equi-join on the document and a bin of BIN pages. Where pages can be
    visible at all follows from the least and greatest height of the document's
    pages, so a viewport meets the bins that it shows and those at their edges,
    not the whole document.
    """
    sizes = pages.groupBy("doc_id").agg(F.max("page_idx").alias("__last"), F.min("height").alias("__low"), F.max("height").alias("__high"))
    v = {c: F.col(c) for c in ("scroll_x", "scroll_y", "zoom")}
    low, high = geometry.screen_to_doc(v, F.lit(0), F.lit(0)), geometry.screen_to_doc(v, F.col("screen_width"), F.col("screen_height"))
    views = viewports.join(sizes, "doc_id").withColumns({"__from": low["y"], "__to": high["y"], "__step": F.try_divide(F.col("page_spacing"), F.col("zoom"))})
    regular = F.col("__low") + F.col("__step") > 0
    at = lambda top, h: F.try_divide(top, F.col(h) + F.col("__step"))
    first = F.least(*[at(F.col("__from") - F.col(h), h) for h in ("__low", "__high")])
    last = F.greatest(*[at(F.col("__to"), h) for h in ("__low", "__high")])
    bins = [F.greatest(F.when(regular, F.floor((first - SLACK) / BIN)).otherwise(0), F.lit(0)), F.least(F.when(regular, F.floor((last + SLACK) / BIN)).otherwise(F.col("__last")), F.floor(F.col("__last") / BIN))]
    views = views.withColumns({"__a": bins[0].cast("long"), "__b": bins[1].cast("long")}).filter("__a <= __b").withColumn("__bin", F.explode(F.sequence("__a", "__b")))
    met = pages.withColumn("__bin", F.floor(F.col("page_idx") / BIN)).join(views, ["doc_id", "__bin"])
    return met.drop("__last", "__low", "__high", "__step", "__a", "__b", "__bin")


def visible_pages(pages: DataFrame, viewports: DataFrame) -> DataFrame:
    """Pages that a document's viewport shows, with page_top; the test is vertical and touching counts."""
    top = geometry.page_top(F.col("page_idx"), F.col("height"), F.col("page_spacing"), F.col("zoom"))
    shown = near_pages(pages, viewports).withColumn("page_top", top)
    return shown.filter((F.col("page_top") + F.col("height") >= F.col("__from")) & (F.col("page_top") <= F.col("__to"))).drop("__from", "__to")


def rendered(pages: DataFrame) -> DataFrame:
    """pages: width, height, zoom. Adds pixels, the size of the picture; pages of which a side has no pixel are left out."""
    sized = pages.withColumn("pixels", geometry.pixel_size(F.col("width"), F.col("height"), F.col("zoom")))
    return sized.filter("pixels.width > 0 AND pixels.height > 0")


def needs_render(valid: Column, cached_zoom: Column, zoom: Column) -> Column:
    return ~valid | (F.abs(cached_zoom - zoom) > ZOOM_TOLERANCE)


def draw_order(elements: DataFrame) -> DataFrame:
    """Visible elements with their place in the page's drawing order: by z_index, then order."""
    w = Window.partitionBy("page_id").orderBy("z_index", "ord")
    return elements.filter("visible").withColumn("draw", F.row_number().over(w) - 1)


def screen_offsets(pages: DataFrame, viewports: DataFrame) -> DataFrame:
    """Running sum of page heights in whole pixels, and spacing, before each page."""
    w = Window.partitionBy("doc_id").orderBy("page_idx").rowsBetween(Window.unboundedPreceding, -1)
    pixels = (F.col("height") * F.col("zoom")).try_cast("long") + F.col("page_spacing")
    return pages.join(viewports, "doc_id").withColumn("y_offset", F.coalesce(F.sum(pixels).over(w), F.lit(0)))


def table_cells(tables: DataFrame) -> DataFrame:
    """tables: table_id, rows, cols (clamped to 1..100). One row for each cell with its bounds.

    Offsets are running sums of the widths and heights before; these are all
    equal in a new table, so the sums are products and no window is needed.
    """
    size = lambda c: F.least(F.greatest(F.col(c), F.lit(1)), F.lit(MOST_CELLS)).cast("int")
    cells = tables.select("table_id", size("rows").alias("rows"), size("cols").alias("cols"))
    cells = cells.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)))
    return cells.withColumn("bounds", geometry.rect(TABLE_X + F.col("col") * COL_WIDTH, TABLE_Y + F.col("row") * ROW_HEIGHT, F.lit(COL_WIDTH), F.lit(ROW_HEIGHT)))


def column_offsets(columns: DataFrame, table: str, order: list[str], width: str, start: float = TABLE_X) -> DataFrame:
    """Adds col, the place of each column in its table, and x, its offset: the widths of those before it."""
    w = Window.partitionBy(table).orderBy(*order)
    before = F.sum(width).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return columns.withColumns({"col": (F.row_number().over(w) - 1).cast("long"), "x": F.coalesce(before, F.lit(0.0)) + F.lit(start)})


def numbered(rows: DataFrame, by: str, start: int = 0, parts: int | None = None) -> DataFrame:
    """Adds number, the place of each row in the order of by (a number), from start, over the whole table.

    Rows are dealt out to parts by quantiles and numbered in each; only the
    parts' counts are summed in one task. Ties are numbered in any order.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(rows.approxQuantile(by, [i / parts for i in range(1, parts)], 0.25 / parts))) if parts > 1 else []
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c < F.col(by)))
    rows = rows.withColumn("__part", part)
    sizes = rows.groupBy("__part").agg(F.count("*").alias("n"))
    before = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(by))
    return rows.withColumn("__place", place).join(before, "__part").withColumn("number", F.lit(start) + F.col("__before") + F.col("__place")).drop("__part", "__place", "__before")
