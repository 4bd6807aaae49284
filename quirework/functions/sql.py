"""The library's rules as functions of Spark SQL.

``register(spark)`` makes them temporary functions of a session. Scalar ones are
SQL expressions that Catalyst inlines, so a query that calls them is planned and
compiled like one that spells them out; the table function lays out texts in
Python. Each equals the column function of the same name without its prefix.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators import lines
from . import geometry, text

_D = "DOUBLE"
_POINT = "STRUCT<x: DOUBLE, y: DOUBLE>"
_RECT = "STRUCT<x: DOUBLE, y: DOUBLE, width: DOUBLE, height: DOUBLE>"
_MATRIX = "STRUCT<a: DOUBLE, b: DOUBLE, c: DOUBLE, d: DOUBLE, e: DOUBLE, f: DOUBLE>"


def _corners(what: str, k: str) -> str:
    return what + "(" + ", ".join(f"qw_map_point(m, {x}, {y}).{k}" for x in ("r.x", "r.x + r.width") for y in ("r.y", "r.y + r.height")) + ")"


#: Name, parameters, result and body; later ones may call earlier ones.
SCALAR = {
    "qw_rect": (f"x {_D}, y {_D}, w {_D}, h {_D}", _RECT, "named_struct('x', x, 'y', y, 'width', w, 'height', h)"),
    "qw_contains": (f"r {_RECT}, x {_D}, y {_D}", "BOOLEAN", "x BETWEEN r.x AND r.x + r.width AND y BETWEEN r.y AND r.y + r.height"),
    "qw_intersects": (f"r {_RECT}, s {_RECT}", "BOOLEAN", "r.x <= s.x + s.width AND s.x <= r.x + r.width AND r.y <= s.y + s.height AND s.y <= r.y + r.height"),
    "qw_map_point": (f"m {_MATRIX}, x {_D}, y {_D}", _POINT, "named_struct('x', m.a * x + m.c * y + m.e, 'y', m.b * x + m.d * y + m.f)"),
    "qw_map_rect": (
        f"m {_MATRIX}, r {_RECT}", _RECT,
        f"qw_rect({_corners('least', 'x')}, {_corners('least', 'y')}, {_corners('greatest', 'x')} - {_corners('least', 'x')}, {_corners('greatest', 'y')} - {_corners('least', 'y')})",
    ),
    "qw_determinant": (f"m {_MATRIX}", _D, "m.a * m.d - m.b * m.c"),
    "qw_unmap_point": (
        f"m {_MATRIX}, x {_D}, y {_D}", _POINT,
        f"CASE WHEN abs(qw_determinant(m)) >= {geometry.SINGULAR!r} THEN named_struct('x', try_divide(m.d * (x - m.e) - m.c * (y - m.f), qw_determinant(m)), 'y', try_divide(m.a * (y - m.f) - m.b * (x - m.e), qw_determinant(m))) END",
    ),
    "qw_hit": (f"bounds {_RECT}, m {_MATRIX}, x {_D}, y {_D}", "BOOLEAN", "coalesce(qw_contains(qw_rect(0, 0, bounds.width, bounds.height), qw_unmap_point(m, x, y).x, qw_unmap_point(m, x, y).y), false)"),
    "qw_page_at": (f"y {_D}", "BIGINT", f"CASE WHEN y > -{geometry.PAGE_HEIGHT} THEN try_cast(y / {geometry.PAGE_HEIGHT}D AS BIGINT) END"),
    "qw_page_top": (f"place BIGINT, height {_D}, spacing {_D}, zoom {_D}", _D, "place * (height + try_divide(spacing, zoom))"),
    "qw_clamp_zoom": (f"zoom {_D}", _D, f"least(greatest(zoom, {geometry.ZOOM_LEAST}D), {geometry.ZOOM_MOST}D)"),
    "qw_insert_place": ("place BIGINT, n BIGINT", "BIGINT", "CASE WHEN place IS NULL OR place >= n OR place < 0 THEN n ELSE place END"),
    "qw_moved_place": (
        "place BIGINT, start BIGINT, target BIGINT, n BIGINT", "BIGINT",
        "CASE WHEN NOT coalesce(start BETWEEN 0 AND n - 1 AND target BETWEEN 0 AND n - 1, false) THEN place WHEN place = start THEN target"
        " WHEN start < target AND place > start AND place <= target THEN place - 1 WHEN target < start AND place >= target AND place < start THEN place + 1 ELSE place END",
    ),
    "qw_shown": ("t STRING", "STRING", f"CASE WHEN length(t) > {text.SHOWN_CHARS} THEN concat(left(t, {text.SHOWN_CHARS}), '...') ELSE t END"),
}


class TextLines:
    """qw_text_lines(TABLE(t), width, size): t's other columns and those of a line, for each line of its column text."""

    def __init__(self):
        self.widths: dict[tuple[float, float], int] = {}

    @staticmethod
    def analyze(t: AnalyzeArgument, width: AnalyzeArgument, size: AnalyzeArgument) -> AnalyzeResult:
        if not t.isTable or "text" not in t.dataType.fieldNames():
            raise ValueError("qw_text_lines asks for a table with a column text")
        taken = [c.split()[0] for c in lines.LINES.split(", ")]
        out = StructType([f for f in t.dataType.fields if f.name != "text" and f.name not in taken])
        for c in lines.LINES.split(", "):
            out = out.add(*c.split())
        return AnalyzeResult(schema=out)

    def eval(self, row, width: float, size: float):
        own = [v for c, v in row.asDict().items() if c != "text" and c not in [x.split()[0] for x in lines.LINES.split(", ")]]
        for line in lines.of_text(row["text"], float(width), float(size)):
            yield (*own, *line)


def register(spark: SparkSession) -> None:
    """Makes all functions temporary functions of the session, in place of any of the same name."""
    for name, (parameters, result, body) in SCALAR.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.udtf.register("qw_text_lines", udtf(TextLines))
