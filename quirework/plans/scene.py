"""Queries of scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scene
from ..sources import adapters
from .registry import query


@query("""
WITH RECURSIVE placed AS (
  SELECT element_id, page_id, element_id AS root_id, 0::BIGINT AS depth, a, b, c, d, e + cell_x AS e, f + cell_y AS f, opacity, visible, x, y FROM nested_el WHERE parent_id IS NULL
  UNION ALL
  SELECT s.element_id, s.page_id, p.root_id, p.depth + 1, p.a * s.a + p.c * s.b, p.b * s.a + p.d * s.b, p.a * s.c + p.c * s.d, p.b * s.c + p.d * s.d,
    p.a * (s.e + s.cell_x) + p.c * (s.f + s.cell_y) + p.e, p.b * (s.e + s.cell_x) + p.d * (s.f + s.cell_y) + p.f, p.opacity * s.opacity, p.visible AND s.visible, s.x, s.y
  FROM placed p JOIN nested_el s ON s.parent_id = p.element_id
)
SELECT element_id, page_id, doc_id, root_id, depth, a + 0.0::DOUBLE AS a, b + 0.0::DOUBLE AS b, c + 0.0::DOUBLE AS c, d + 0.0::DOUBLE AS d, e + 0.0::DOUBLE AS e, f + 0.0::DOUBLE AS f, opacity, visible, a * x + c * y + e AS page_x, b * x + d * y + f AS page_y
FROM placed JOIN doc_page USING (page_id)
""")
def doc_scene_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each element's place, opacity and visibility on its page, by all the groups and cells that it is in; and its document."""
    elements = adapters.nested_elements(spark, sf_dir)
    where = elements.select("element_id", "page_id", "bounds").join(adapters.pages(spark, sf_dir).select("page_id", "doc_id"), "page_id")
    rows = scene.placed(elements).filter("attached").join(where, "element_id")
    at = scene.on_page(F.col("transform"), F.col("bounds"))
    return rows.select("element_id", "page_id", "doc_id", "root_id", "depth", "transform.*", "opacity", "visible", at["x"].alias("page_x"), at["y"].alias("page_y"))
