"""Geometry as column expressions.

Rectangles are structs (x, y, width, height), points (x, y), matrices
(a, b, c, d, e, f) for x' = a x + c y + e, y' = b x + d y + f. Everything stays
in whole-stage codegen; nulls give nulls.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
#: Determinants below this count as singular.
SINGULAR = 1e-10
#: The page height that point-to-page assumes, in points.
PAGE_HEIGHT = 792.0
ZOOM_LEAST, ZOOM_MOST, ZOOM_STEP = 0.1, 10.0, 1.25
FIT_MARGIN = 40


def rect(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), width.cast("double").alias("width"), height.cast("double").alias("height"))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def right(r: Column) -> Column:
    return r["x"] + r["width"]


def top(r: Column) -> Column:
    """y grows upward: the far edge."""
    return r["y"] + r["height"]


def contains(r: Column, x: Column, y: Column) -> Column:
    """All edges belong to the rectangle."""
    return x.between(r["x"], right(r)) & y.between(r["y"], top(r))


def intersects(r: Column, s: Column) -> Column:
    """Touching counts."""
    return (r["x"] <= right(s)) & (s["x"] <= right(r)) & (r["y"] <= top(s)) & (s["y"] <= top(r))


def map_point(m: Column, x: Column, y: Column) -> Column:
    return point(m["a"] * x + m["c"] * y + m["e"], m["b"] * x + m["d"] * y + m["f"])


def map_rect(m: Column, r: Column) -> Column:
    """The box around the four mapped corners."""
    corners = [map_point(m, x, y) for x in (r["x"], right(r)) for y in (r["y"], top(r))]
    low = [F.least(*[c[k] for c in corners]) for k in ("x", "y")]
    high = [F.greatest(*[c[k] for c in corners]) for k in ("x", "y")]
    return rect(low[0], low[1], high[0] - low[0], high[1] - low[1])


def determinant(m: Column) -> Column:
    return m["a"] * m["d"] - m["b"] * m["c"]


def unmap_point(m: Column, x: Column, y: Column) -> Column:
    """The point that m maps to (x, y); null if m is singular."""
    det = determinant(m)
    dx, dy = x - m["e"], y - m["f"]
    return F.when(F.abs(det) >= SINGULAR, point(F.try_divide(m["d"] * dx - m["c"] * dy, det), F.try_divide(m["a"] * dy - m["b"] * dx, det)))


def screen_to_doc(v: dict[str, Column], x: Column, y: Column) -> Column:
    return point(F.try_divide(x + v["scroll_x"], v["zoom"]), F.try_divide(y + v["scroll_y"], v["zoom"]))


def doc_to_screen(v: dict[str, Column], x: Column, y: Column) -> Column:
    """Truncated toward zero."""
    return F.struct((x * v["zoom"] - v["scroll_x"]).try_cast("int").alias("x"), (y * v["zoom"] - v["scroll_y"]).try_cast("int").alias("y"))


def page_at(y: Column) -> Column:
    """Index of the page a document y falls on, by truncation; null at one page height above the first or higher."""
    return F.when(y > -PAGE_HEIGHT, (y / F.lit(PAGE_HEIGHT)).try_cast("long"))


def page_top(index: Column, height: Column, spacing: Column, zoom: Column) -> Column:
    """Each page is placed by its own height."""
    return index * (height + F.try_divide(spacing, zoom))


def clamp_zoom(zoom: Column) -> Column:
    return F.least(F.greatest(zoom, F.lit(ZOOM_LEAST)), F.lit(ZOOM_MOST))


def fit_width_zoom(view_width: Column, page_width: Column) -> Column:
    return clamp_zoom(F.try_divide(view_width - FIT_MARGIN, page_width))


def fit_page_zoom(view_width: Column, view_height: Column, page_width: Column, page_height: Column) -> Column:
    return clamp_zoom(F.least(F.try_divide(view_width - FIT_MARGIN, page_width), F.try_divide(view_height - FIT_MARGIN, page_height)))


def centre_scroll(index: Column, width: Column, height: Column, spacing: Column, zoom: Column, view_width: Column, view_height: Column) -> Column:
    """Scroll offsets that centre a page; half the view height is a whole number of pixels."""
    half = F.floor(view_height / 2).cast("double")
    return point((width * zoom - view_width) / 2, page_top(index, height, spacing, zoom) * zoom - half + (height * zoom) / 2)


def drag_rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return rect(F.least(x0, x1), F.least(y0, y1), F.abs(x1 - x0), F.abs(y1 - y0))


def image_size(width: Column, height: Column, most: float = 300.0) -> Column:
    """Display width at most 300, height in proportion; null without a width."""
    shown = F.least(F.lit(most), width.cast("double"))
    return F.struct(shown.alias("width"), F.try_divide(shown * height, width).alias("height"))


def pixel_size(width: Column, height: Column, zoom: Column) -> Column:
    return F.struct((width * zoom).try_cast("int").alias("width"), (height * zoom).try_cast("int").alias("height"))


def content_rect(width: Column, height: Column, left: Column, right_: Column, bottom: Column, top_: Column) -> Column:
    return rect(left, bottom, width - left - right_, height - top_ - bottom)
