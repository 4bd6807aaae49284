"""Scenes: elements in groups and table cells, placed by all that holds them.

A child stands in the space of its parent, in a table's cell from that cell's
corner on. Its place on the page is the product of the matrices down its chain,
its opacity the product of theirs, and it is visible where all of them are. The
chains are followed by a recursive query from the outside in, one equi-join of
the elements a level, so that each element is placed once from its parent's
place. The elements are written once, in buckets by parent; a level reads them
where they are and shuffles only what the level before placed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import map_point
from ..sources.scratch import new_folder

#: Levels below an outermost element, at most, unless told otherwise. Beyond it Spark raises.
MOST_LEVELS = 100

_PLACED = """
WITH RECURSIVE placed(element_id, root_id, depth, attached, a, b, c, d, e, f, opacity, visible) MAX RECURSION LEVEL {levels} AS (
  SELECT element_id, element_id, 0L, parent_id IS NULL, a, b, c, d, e, f, opacity, visible FROM {scene} WHERE outermost
  UNION ALL
  SELECT s.element_id, p.root_id, p.depth + 1, p.attached,
    p.a * s.a + p.c * s.b, p.b * s.a + p.d * s.b, p.a * s.c + p.c * s.d, p.b * s.c + p.d * s.d, p.a * s.e + p.c * s.f + p.e, p.b * s.e + p.d * s.f + p.f,
    p.opacity * s.opacity, p.visible AND s.visible
  FROM placed p JOIN {scene} s ON s.parent_id = p.element_id WHERE NOT s.outermost
)
SELECT * FROM placed
"""


def placed(elements: DataFrame, levels: int = MOST_LEVELS) -> DataFrame:
    """elements: element_id, parent_id (null if outermost), transform, opacity, visible and, in a cell, cell (a point: its corner in the table's space).

    One row an element: root_id, depth (0 if outermost), attached, transform,
    opacity and visible on the page. An element whose parent isn't there is
    placed as if it were outermost, but is neither attached nor visible, and so
    are those that it holds. Elements that hold one another raise when they are
    read. Ids are taken to be unique. Null matrices and opacities give nulls.
    """
    spark = elements.sparkSession
    # The recursion counts its rows against a limit of Spark's; here these are the elements, however many.
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    corner = F.col("cell") if "cell" in elements.columns else F.lit(None).cast("struct<x:double,y:double>")
    shifted = {c: F.col(f"transform.{c}") + F.coalesce(corner[k], F.lit(0.0)) for c, k in (("e", "x"), ("f", "y"))}
    own = elements.select("element_id", "parent_id", *[F.col(f"transform.{c}").alias(c) for c in "abcd"], *[v.alias(c) for c, v in shifted.items()], "opacity", "visible")
    parents = elements.select(F.col("element_id").alias("parent_id"), F.lit(True).alias("held"))
    inner = own.filter("parent_id IS NOT NULL").join(parents, "parent_id", "left").withColumn("outermost", F.col("held").isNull()).drop("held")
    scene = _by_parent(own.filter("parent_id IS NULL").withColumn("outermost", F.lit(True)).unionByName(inner))
    found = spark.sql(_PLACED.replace("{levels}", str(int(levels))), scene=scene)
    matrix = F.struct(*[(F.col(c) + F.lit(0.0)).alias(c) for c in "abcdef"])  # no negative zeros
    out = elements.select("element_id").join(found, "element_id", "left")
    loop = F.raise_error(F.concat(F.lit("elements hold one another; one of them is "), F.col("element_id").cast("string")))
    return out.select(
        "element_id", F.when(F.col("root_id").isNull(), loop.cast("long")).otherwise(F.col("root_id")).alias("root_id"), "depth", "attached",
        matrix.alias("transform"), "opacity", (F.col("visible") & F.col("attached")).alias("visible"),
    )


def _by_parent(scene: DataFrame) -> DataFrame:
    """scene, written in buckets by parent_id, as many as a shuffle has partitions, and read back. The files go when the program ends."""
    spark, path = scene.sparkSession, new_folder(scene.sparkSession, "scene")
    name = f"quirework_scene_{path[-12:]}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scene.write.format("parquet").option("path", path).bucketBy(buckets, "parent_id").sortBy("parent_id").saveAsTable(name)
    written = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # of the catalog; the files stay
    return written


def on_page(place: Column, bounds: Column) -> Column:
    """Where an element's own corner comes to stand."""
    return map_point(place, bounds["x"], bounds["y"])
