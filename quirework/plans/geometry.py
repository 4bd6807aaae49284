"""Queries of geometry, viewports and hit tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colour, geometry, paths
from ..operators import hit, layout, spatial
from ..sources import adapters
from ..sources.scratch import new_folder
from .registry import query


@query("SELECT element_id, x + w AS right_edge, y + h AS top_edge FROM doc_element")
def doc_rect_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("bounds")
    return adapters.elements(spark, sf_dir).select("element_id", geometry.right(b).alias("right_edge"), geometry.top(b).alias("top_edge"))


@query("SELECT element_id, a * x + c * y + e AS px, b * x + d * y + f AS py FROM doc_element")
def doc_map_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = geometry.map_point(F.col("transform"), F.col("bounds.x"), F.col("bounds.y"))
    return adapters.elements(spark, sf_dir).select("element_id", p["x"].alias("px"), p["y"].alias("py"))


_BOX = """
WITH corners AS (
  SELECT element_id, page_id, a * x + c * y + e AS x1, a * (x + w) + c * y + e AS x2, a * x + c * (y + h) + e AS x3, a * (x + w) + c * (y + h) + e AS x4,
    b * x + d * y + f AS y1, b * (x + w) + d * y + f AS y2, b * x + d * (y + h) + f AS y3, b * (x + w) + d * (y + h) + f AS y4 FROM doc_element
)"""


@query(_BOX + " SELECT element_id, least(x1, x2, x3, x4) AS x, least(y1, y2, y3, y4) AS y, greatest(x1, x2, x3, x4) - least(x1, x2, x3, x4) AS width, greatest(y1, y2, y3, y4) - least(y1, y2, y3, y4) AS height FROM corners")
def doc_transformed_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = geometry.map_rect(F.col("transform"), F.col("bounds"))
    return adapters.elements(spark, sf_dir).select("element_id", r["x"].alias("x"), r["y"].alias("y"), r["width"].alias("width"), r["height"].alias("height"))


@query("""
WITH inv AS (SELECT *, a * d - b * c AS det FROM doc_element)
SELECT element_id, CASE WHEN abs(det) >= 1e-10 THEN (d * (100 - e) - c * (200 - f)) / det END AS lx, CASE WHEN abs(det) >= 1e-10 THEN (a * (200 - f) - b * (100 - e)) / det END AS ly FROM inv
""")
def doc_inverse_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = geometry.unmap_point(F.col("transform"), F.lit(100.0), F.lit(200.0))
    return adapters.elements(spark, sf_dir).select("element_id", p["x"].alias("lx"), p["y"].alias("ly"))


@query("""
SELECT el.element_id, (el.x + v.scroll_x) / v.zoom AS doc_x, (el.y + v.scroll_y) / v.zoom AS doc_y, CAST(trunc(el.x * v.zoom - v.scroll_x) AS INTEGER) AS screen_x, CAST(trunc(el.y * v.zoom - v.scroll_y) AS INTEGER) AS screen_y,
  CAST(trunc((el.y + v.scroll_y) / v.zoom / 792.0) AS BIGINT) AS page_idx
FROM doc_element el JOIN doc_page p USING (page_id) JOIN viewport v ON v.doc_id = p.doc_id
""")
def doc_screen_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.elements(spark, sf_dir).join(adapters.pages(spark, sf_dir).select("page_id", "doc_id"), "page_id").join(adapters.viewports(spark, sf_dir), "doc_id")
    v, x, y = {c: F.col(c) for c in ("scroll_x", "scroll_y", "zoom")}, F.col("bounds.x"), F.col("bounds.y")
    doc, screen = geometry.screen_to_doc(v, x, y), geometry.doc_to_screen(v, x, y)
    return rows.select("element_id", doc["x"].alias("doc_x"), doc["y"].alias("doc_y"), screen["x"].alias("screen_x"), screen["y"].alias("screen_y"), geometry.page_at(doc["y"]).alias("page_idx"))


@query("SELECT page_id, page_idx * (height + 20 / zoom) AS page_top, page_idx * (height + 20 / zoom) + height AS page_bottom, 1590 - page_idx * (height + 20 / zoom) AS local_y FROM doc_page JOIN viewport USING (doc_id)")
def doc_page_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.pages(spark, sf_dir).join(adapters.viewports(spark, sf_dir), "doc_id")
    top = geometry.page_top(F.col("page_idx"), F.col("height"), F.col("page_spacing"), F.col("zoom"))
    return rows.select("page_id", top.alias("page_top"), (top + F.col("height")).alias("page_bottom"), (1590 - top).alias("local_y"))


@query("SELECT page_id, margin_left AS x, margin_bottom AS y, width - margin_left - margin_right AS w, height - margin_top - margin_bottom AS h, 600.0 BETWEEN 0 AND width AND 810.0 BETWEEN 0 AND height AS holds_point FROM doc_page")
def doc_page_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = {s: F.col(f"margin_{s}") for s in ("left", "right", "bottom", "top")}
    r = geometry.content_rect(F.col("width"), F.col("height"), m["left"], m["right"], m["bottom"], m["top"])
    page = geometry.rect(F.lit(0), F.lit(0), F.col("width"), F.col("height"))
    return adapters.pages(spark, sf_dir).select("page_id", r["x"].alias("x"), r["y"].alias("y"), r["width"].alias("w"), r["height"].alias("h"), geometry.contains(page, F.lit(600.0), F.lit(810.0)).alias("holds_point"))


@query("""
SELECT doc_id, least(greatest((screen_width - 40) / width, 0.1), 10.0) AS fit_width, least(greatest(least((screen_width - 40) / width, (screen_height - 40) / height), 0.1), 10.0) AS fit_page,
  least(greatest(zoom * 1.25, 0.1), 10.0) AS zoom_in, least(greatest(zoom / 1.25, 0.1), 10.0) AS zoom_out, least(greatest(zoom * 20, 0.1), 10.0) AS clamped_high, least(greatest(zoom / 20, 0.1), 10.0) AS clamped_low
FROM viewport JOIN doc_page USING (doc_id) WHERE page_idx = 0
""")
def doc_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.viewports(spark, sf_dir).join(adapters.pages(spark, sf_dir).filter("page_idx = 0"), "doc_id")
    zoom, vw, vh = F.col("zoom"), F.col("screen_width"), F.col("screen_height")
    return rows.select(
        "doc_id", geometry.fit_width_zoom(vw, F.col("width")).alias("fit_width"), geometry.fit_page_zoom(vw, vh, F.col("width"), F.col("height")).alias("fit_page"),
        geometry.clamp_zoom(zoom * geometry.ZOOM_STEP).alias("zoom_in"), geometry.clamp_zoom(zoom / geometry.ZOOM_STEP).alias("zoom_out"),
        geometry.clamp_zoom(zoom * 20).alias("clamped_high"), geometry.clamp_zoom(zoom / 20).alias("clamped_low"),
    )


@query("""
SELECT page_id, (width * zoom - screen_width) / 2 AS scroll_x, page_idx * (height + 20 / zoom) * zoom - screen_height // 2 + (height * zoom) / 2 AS scroll_y,
  CAST(trunc(width * zoom) AS INTEGER) AS pixel_width, CAST(trunc(height * zoom) AS INTEGER) AS pixel_height
FROM doc_page JOIN viewport USING (doc_id)
""")
def doc_centre_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.pages(spark, sf_dir).join(adapters.viewports(spark, sf_dir), "doc_id")
    s = geometry.centre_scroll(F.col("page_idx"), F.col("width"), F.col("height"), F.col("page_spacing"), F.col("zoom"), F.col("screen_width"), F.col("screen_height"))
    px = geometry.pixel_size(F.col("width"), F.col("height"), F.col("zoom"))
    return rows.select("page_id", s["x"].alias("scroll_x"), s["y"].alias("scroll_y"), px["width"].alias("pixel_width"), px["height"].alias("pixel_height"))


@query(_BOX + """, box AS (SELECT element_id, page_id, least(x1, x2, x3, x4) AS bx, least(y1, y2, y3, y4) AS by_ FROM corners)
SELECT element_id, page_idx, by_ * zoom - screen_height // 2 AS scroll_y, bx * zoom - screen_width // 2 AS scroll_x
FROM box JOIN doc_page USING (page_id) JOIN viewport USING (doc_id)
""")
def doc_scroll_to_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.elements(spark, sf_dir).join(adapters.pages(spark, sf_dir), "page_id").join(adapters.viewports(spark, sf_dir), "doc_id")
    r = geometry.map_rect(F.col("transform"), F.col("bounds"))
    half = lambda c: F.floor(F.col(c) / 2).cast("double")
    return rows.select("element_id", "page_idx", (r["y"] * F.col("zoom") - half("screen_height")).alias("scroll_y"), (r["x"] * F.col("zoom") - half("screen_width")).alias("scroll_x"))


@query("""
SELECT p_partkey, r / 255.0::DOUBLE AS red, g / 255.0::DOUBLE AS green, b / 255.0::DOUBLE AS blue, r AS r_byte, g AS g_byte, b AS b_byte
FROM (SELECT p_partkey, CAST(p_partkey % 256 AS INTEGER) AS r, CAST(p_partkey * 7 % 256 AS INTEGER) AS g, CAST(p_size AS INTEGER) AS b FROM part)
""")
def doc_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    c = colour.from_bytes(k % 256, k * 7 % 256, F.col("p_size"), F.lit(255))
    rows = adapters.table(spark, sf_dir, "part").select("p_partkey", c.alias("c"))
    back = colour.to_bytes(F.col("c"))
    return rows.select("p_partkey", F.col("c.r").alias("red"), F.col("c.g").alias("green"), F.col("c.b").alias("blue"), back["r"].alias("r_byte"), back["g"].alias("g_byte"), back["b"].alias("b_byte"))


@query("""
SELECT * FROM (SELECT doc_id, seq, least(x, 300.0) AS rx, least(y, 200.0) AS ry, abs(300.0 - x) AS rw, abs(200.0 - y) AS rh FROM command_log) WHERE rw > 5 AND rh > 5
""")
def doc_drag_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = geometry.drag_rect(F.col("x"), F.col("y"), F.lit(300.0), F.lit(200.0))
    rows = adapters.commands(spark, sf_dir).select("doc_id", "seq", r["x"].alias("rx"), r["y"].alias("ry"), r["width"].alias("rw"), r["height"].alias("rh"))
    return rows.filter("rw > 5 AND rh > 5")


@query("SELECT p_partkey, least(300.0, CAST(p_partkey % 700 AS DOUBLE)) AS width, CASE WHEN p_partkey % 700 > 0 THEN least(300.0, CAST(p_partkey % 700 AS DOUBLE)) * (p_size * 10) / (p_partkey % 700) END AS height FROM part")
def doc_image_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = geometry.image_size(F.col("p_partkey") % 700, F.col("p_size") * 10)
    return adapters.table(spark, sf_dir, "part").select("p_partkey", s["width"].alias("width"), s["height"].alias("height"))


_LOCAL = "abs(a * d - b * c) >= 1e-10 AND (d * (px - e) - c * (py - f)) / (a * d - b * c) BETWEEN {x0} AND {x1} AND (a * (py - f) - b * (px - e)) / (a * d - b * c) BETWEEN {y0} AND {y1}"
_TOPMOST = """
WITH probe AS (SELECT page_id * 5 + k AS probe_id, page_id, CAST(k * 60 + 20 AS DOUBLE) AS px, CAST(k * 45 + 10 AS DOUBLE) AS py FROM doc_page, range(5) t(k)),
hit AS (SELECT probe_id, arg_max(element_id, ord) AS element_id FROM probe JOIN doc_element USING (page_id) WHERE visible AND CASE WHEN abs(a * d - b * c) < 1e-10 THEN false ELSE {local} END GROUP BY probe_id)
SELECT probe_id, page_id, px AS x, py AS y, element_id FROM probe LEFT JOIN hit USING (probe_id)
"""


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.pages(spark, sf_dir).select("page_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    return rows.select((F.col("page_id") * 5 + F.col("k")).alias("probe_id"), "page_id", (F.col("k") * 60 + 20).cast("double").alias("x"), (F.col("k") * 45 + 10).cast("double").alias("y"))


@query(_TOPMOST.format(local=_LOCAL.format(x0="0", x1="w", y0="0", y1="h")))
def doc_topmost_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hit.topmost(_probes(spark, sf_dir), adapters.elements(spark, sf_dir))


@query(_TOPMOST.format(local=_LOCAL.format(x0="x", x1="x + w", y0="y", y1="y + h")))
def doc_topmost_hit_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hit.topmost(_probes(spark, sf_dir), adapters.elements(spark, sf_dir), anchor="bounds")


@query(_TOPMOST.format(local=_LOCAL.format(x0="0", x1="w", y0="0", y1="h")))
def doc_indexed_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The element under each probe, by a spatial index that is written first."""
    index = new_folder(spark, "spatial")
    spatial.write(adapters.elements(spark, sf_dir), index)
    return spatial.topmost(spark, index, _probes(spark, sf_dir))


@query("""
WITH point AS (SELECT doc_id * 40 + k AS probe_id, doc_id, zoom, CAST(k * 16 AS DOUBLE) AS px, CAST(k * 137 AS DOUBLE) AS py0, CAST(trunc(k * 137 / 792.0) AS BIGINT) AS page_idx FROM viewport, range(40) t(k)),
placed AS (SELECT point.*, page_id, py0 - page_idx * (height + 20 / zoom) AS py FROM point LEFT JOIN doc_page USING (doc_id, page_idx)),
hit AS (SELECT probe_id, arg_max(element_id, ord) AS element_id FROM placed JOIN doc_element USING (page_id) WHERE visible AND CASE WHEN abs(a * d - b * c) < 1e-10 THEN false ELSE """ + _LOCAL.format(x0="0", x1="w", y0="0", y1="h") + """ END GROUP BY probe_id)
SELECT probe_id, doc_id, page_idx, py AS local_y, element_id FROM placed LEFT JOIN hit USING (probe_id)
""")
def doc_element_at_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    rows = adapters.viewports(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(39))))
    points = rows.select((F.col("doc_id") * 40 + k).alias("probe_id"), "doc_id", "zoom", "page_spacing", (k * 16).cast("double").alias("x"), (k * 137).cast("double").alias("y"))
    return hit.element_at(points, adapters.pages(spark, sf_dir), adapters.elements(spark, sf_dir))


@query("SELECT p.page_id, p.element_id AS a, q.element_id AS b FROM doc_element p JOIN doc_element q ON p.page_id = q.page_id AND p.element_id < q.element_id AND p.x <= q.x + q.w AND q.x <= p.x + p.w AND p.y <= q.y + q.h AND q.y <= p.y + p.h")
def doc_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hit.overlaps(adapters.elements(spark, sf_dir))


_CLIPPED = "CASE WHEN element_id % 4 = 0 THEN {x} >= 10 AND {x} < 10 + w / 2 AND {y} >= 5 AND {y} < 5 + h / 2 ELSE true END".format(x="(d * (px - e) - c * (py - f)) / (a * d - b * c)", y="(a * (py - f) - b * (px - e)) / (a * d - b * c)")


@query(_TOPMOST.format(local=_LOCAL.format(x0="0", x1="w", y0="0", y1="h") + " AND " + _CLIPPED))
def doc_topmost_hit_clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth element has a clip path, a quarter of its size; points outside it don't hit."""
    own = F.col("bounds")
    clip = F.when(F.col("element_id") % 4 == 0, paths.rectangle(geometry.rect(F.lit(10.0), F.lit(5.0), own["width"] / 2, own["height"] / 2)))
    return hit.topmost(_probes(spark, sf_dir), adapters.elements(spark, sf_dir).withColumn("clip_path", clip))


@query("""
SELECT page_id, page_idx * (height + 20 / zoom) AS page_top FROM doc_page JOIN viewport USING (doc_id)
WHERE page_idx * (height + 20 / zoom) + height >= (0 + scroll_y) / zoom AND page_idx * (height + 20 / zoom) <= (screen_height + scroll_y) / zoom
""")
def doc_visible_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.visible_pages(adapters.pages(spark, sf_dir), adapters.viewports(spark, sf_dir)).select("page_id", "page_top")


@query("SELECT page_id, NOT (page_id % 3 <> 0) OR abs(1 + (page_id % 4) * 0.0005 - zoom) > 0.001 AS stale FROM doc_page JOIN viewport USING (doc_id)")
def doc_needs_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.pages(spark, sf_dir).join(adapters.viewports(spark, sf_dir), "doc_id")
    k = F.col("page_id")
    return rows.select("page_id", layout.needs_render(k % 3 != 0, 1 + (k % 4) * 0.0005, F.col("zoom")).alias("stale"))
