"""Queries of paths with curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..sources import adapters
from .registry import query


def _outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each element with an outline of a cubic, a quadratic and two straight edges, and a second one of a quadratic that is left open."""
    x, y, w, h = (F.col(f"bounds.{c}") for c in ("x", "y", "width", "height"))
    c, none = paths.curve, F.lit(None).cast("double")
    path = F.array(
        c("LineTo", x, y, none, none), c("CubicTo", x + w, y, x + w / 2, y - h, x + w + 20, y + h / 4), c("QuadTo", x + w, y + h, x + w * 1.25, y + h / 2), c("LineTo", x, y + h, none, none), c("ClosePath", none, none, none, none),
        c("MoveTo", x + w / 4, y + h / 4, none, none), c("QuadTo", x + w * 0.75, y + h / 4, x + w / 2, y + h),
    )
    return adapters.elements(spark, sf_dir).withColumn("path", paths.replay(path))


_PIECES = """
WITH RECURSIVE ends AS (
  SELECT element_id, x, y, w, h, unnest([
    {'kind': 'CubicTo', 'x0': x, 'y0': y, 'x1': x + w / 2, 'y1': y - h, 'x2': x + w + 20, 'y2': y + h / 4, 'x3': x + w, 'y3': y},
    {'kind': 'QuadTo', 'x0': x + w, 'y0': y, 'x1': x + w * 1.25::DOUBLE, 'y1': y + h / 2, 'x2': NULL, 'y2': NULL, 'x3': x + w, 'y3': y + h},
    {'kind': 'LineTo', 'x0': x + w, 'y0': y + h, 'x1': NULL, 'y1': NULL, 'x2': NULL, 'y2': NULL, 'x3': x, 'y3': y + h},
    {'kind': 'LineTo', 'x0': x, 'y0': y + h, 'x1': NULL, 'y1': NULL, 'x2': NULL, 'y2': NULL, 'x3': x, 'y3': y},
    {'kind': 'QuadTo', 'x0': x + w / 4, 'y0': y + h / 4, 'x1': x + w / 2, 'y1': y + h, 'x2': NULL, 'y2': NULL, 'x3': x + w * 0.75::DOUBLE, 'y3': y + h / 4},
    {'kind': 'LineTo', 'x0': x + w * 0.75::DOUBLE, 'y0': y + h / 4, 'x1': NULL, 'y1': NULL, 'x2': NULL, 'y2': NULL, 'x3': x + w / 4, 'y3': y + h / 4}]) AS e FROM doc_element
), pieces AS (
  SELECT element_id, x + w / 2 + element_id % 9 AS px, y + h / 3 AS py, row_number() OVER () AS piece, e.kind AS kind, e.x0, e.y0, e.x3, e.y3,
    CASE e.kind WHEN 'QuadTo' THEN (e.x0 + 2 * e.x1) / 3 WHEN 'CubicTo' THEN e.x1 ELSE e.x0 END AS x1, CASE e.kind WHEN 'QuadTo' THEN (e.y0 + 2 * e.y1) / 3 WHEN 'CubicTo' THEN e.y1 ELSE e.y0 END AS y1,
    CASE e.kind WHEN 'QuadTo' THEN (e.x3 + 2 * e.x1) / 3 WHEN 'CubicTo' THEN e.x2 ELSE e.x3 END AS x2, CASE e.kind WHEN 'QuadTo' THEN (e.y3 + 2 * e.y1) / 3 WHEN 'CubicTo' THEN e.y2 ELSE e.y3 END AS y2 FROM ends
), slopes AS (
  SELECT element_id, piece, k, kind, p0, p1, p2, p3, p3 - 3 * p2 + 3 * p1 - p0 AS a, 2 * (p0 - 2 * p1 + p2) AS b, p1 - p0 AS c
  FROM (SELECT element_id, piece, kind, 'x' AS k, x0 AS p0, x1 AS p1, x2 AS p2, x3 AS p3 FROM pieces UNION ALL SELECT element_id, piece, kind, 'y', y0, y1, y2, y3 FROM pieces)
), roots AS (
  SELECT element_id, piece, k, p0, p1, p2, p3, unnest(CASE WHEN kind = 'LineTo' THEN [] WHEN abs(a) < 1e-12 THEN CASE WHEN b <> 0 THEN [-c / b] ELSE [] END WHEN b * b - 4 * a * c >= 0 THEN [(-b - sqrt(b * b - 4 * a * c)) / (2 * a), (-b + sqrt(b * b - 4 * a * c)) / (2 * a)] ELSE [] END) AS t FROM slopes
), turns AS (
  SELECT *, (1 - t) * (1 - t) * (1 - t) * p0 + 3 * (1 - t) * (1 - t) * t * p1 + 3 * (1 - t) * t * t * p2 + t * t * t * p3 AS v FROM roots WHERE t > 0 AND t < 1
)"""


@query(_PIECES + """
, seen AS (
  SELECT element_id, 'x' AS k, x0 AS v FROM pieces UNION ALL SELECT element_id, 'x', x3 FROM pieces UNION ALL SELECT element_id, 'y', y0 FROM pieces UNION ALL SELECT element_id, 'y', y3 FROM pieces UNION ALL SELECT element_id, k, v FROM turns
)
SELECT element_id, min(v) FILTER (WHERE k = 'x') AS x0, min(v) FILTER (WHERE k = 'y') AS y0, max(v) FILTER (WHERE k = 'x') AS x1, max(v) FILTER (WHERE k = 'y') AS y1 FROM seen GROUP BY element_id
""")
def doc_curve_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact box of each outline."""
    return _outlines(spark, sf_dir).withColumn("b", paths.curve_bounds(F.col("path"))).select("element_id", "b.*")


@query(_PIECES + """
, cuts AS (
  SELECT piece, 0.0::DOUBLE AS t, NULL::DOUBLE AS v FROM pieces UNION ALL SELECT piece, t, v FROM turns WHERE k = 'y' UNION ALL SELECT piece, 1.0::DOUBLE, NULL FROM pieces
), parts AS (
  SELECT c.piece, c.t AS low, lead(c.t) OVER w AS high, CASE WHEN c.t = 0 THEN p.y0 ELSE c.v END AS v0, CASE WHEN lead(c.t) OVER w = 1 THEN p.y3 ELSE lead(c.v) OVER w END AS v1
  FROM cuts c JOIN pieces p USING (piece) WINDOW w AS (PARTITION BY c.piece ORDER BY c.t)
), met AS (
  SELECT row_number() OVER () AS part, p.*, low, high, v1 > v0 AS up FROM parts JOIN pieces p USING (piece) WHERE high IS NOT NULL AND (v0 <= py) <> (v1 <= py)
), halved AS (
  SELECT part, low AS l, high AS h, 0 AS step FROM met
  UNION ALL
  SELECT part, CASE WHEN (v <= py) = up THEN t ELSE l END, CASE WHEN (v <= py) = up THEN h ELSE t END, step + 1 FROM (
    SELECT b.part, b.l, b.h, b.step, m.py, m.up, (l + h) / 2 AS t,
      (1 - (l + h) / 2) * (1 - (l + h) / 2) * (1 - (l + h) / 2) * y0 + 3 * (1 - (l + h) / 2) * (1 - (l + h) / 2) * ((l + h) / 2) * y1 + 3 * (1 - (l + h) / 2) * ((l + h) / 2) * ((l + h) / 2) * y2 + ((l + h) / 2) * ((l + h) / 2) * ((l + h) / 2) * y3 AS v
    FROM halved b JOIN met m USING (part) WHERE step < 48)
), crossed AS (
  SELECT m.element_id, CASE WHEN up THEN 1 ELSE -1 END AS n FROM met m JOIN (SELECT part, (l + h) / 2 AS t FROM halved WHERE step = 48) USING (part)
  WHERE CASE WHEN kind = 'LineTo' THEN px < x0 + (py - y0) * (x3 - x0) / (y3 - y0) ELSE px < (1 - t) * (1 - t) * (1 - t) * x0 + 3 * (1 - t) * (1 - t) * t * x1 + 3 * (1 - t) * t * t * x2 + t * t * t * x3 END
)
SELECT element_id, CAST(coalesce(sum(n), 0) AS INTEGER) AS winding, coalesce(sum(n), 0) <> 0 AS non_zero, count(n) % 2 = 1 AS even_odd FROM (SELECT DISTINCT element_id FROM pieces) LEFT JOIN crossed USING (element_id) GROUP BY element_id
""")
def doc_winding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each outline goes around a point within its element, and whether that is filled by either rule."""
    rows = _outlines(spark, sf_dir)
    x, y = F.col("bounds.x") + F.col("bounds.width") / 2 + F.col("element_id") % 9, F.col("bounds.y") + F.col("bounds.height") / 3
    crossed = F.col("crossed")
    rows = rows.select("element_id", paths.crossings(F.col("path"), x, y).alias("crossed"))
    return rows.select("element_id", paths.winding_of(crossed).alias("winding"), paths.filled_of(crossed, F.lit("NonZero")).alias("non_zero"), paths.filled_of(crossed, F.lit("EvenOdd")).alias("even_odd"))
