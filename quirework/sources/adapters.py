"""Document tables derived from a star schema, so that every operator has data to run on.

The mappings are invented. Geometry comes from integers modulo small numbers and
matrices from quarters, so doubles are exact. DuckDB SQL for the same tables is
beside each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import rect

KINDS = ("text", "image", "vector", "table", "media", "group")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each customer; its document is the nation."""
    k = F.col("c_custkey")
    place = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("page_id"), F.col("c_nationkey").cast("long").alias("doc_id"), (F.row_number().over(place) - 1).cast("long").alias("page_idx"),
        (612 + 12 * (k % 5)).cast("double").alias("width"), (792 + 18 * (k % 4)).cast("double").alias("height"),
        *[F.lit(72.0).alias(f"margin_{s}") for s in ("top", "bottom", "left", "right")],
    )


PAGES_SQL = """doc_page AS (
  SELECT c_custkey AS page_id, CAST(c_nationkey AS BIGINT) AS doc_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS page_idx,
    CAST(612 + 12 * (c_custkey % 5) AS DOUBLE) AS width, CAST(792 + 18 * (c_custkey % 4) AS DOUBLE) AS height,
    72.0::DOUBLE AS margin_top, 72.0::DOUBLE AS margin_bottom, 72.0::DOUBLE AS margin_left, 72.0::DOUBLE AS margin_right
  FROM customer
)"""


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An element for each order, on its customer's page; every 97th has a singular matrix."""
    k = F.col("o_orderkey")
    place = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    live = F.when(k % 97 == 0, 0).otherwise(1)
    matrix = F.struct(
        (live * (1 + (k % 3) * 0.5)).alias("a"), (live * (k % 4) * 0.25).alias("b"), (live * (k % 2) * -0.5).alias("c"),
        (live * (1 + (k % 5) * 0.25)).alias("d"), (k % 40).cast("double").alias("e"), (k % 60).cast("double").alias("f"),
    )
    kinds = F.array(*[F.lit(x) for x in KINDS])
    return table(spark, sf_dir, "orders").select(
        k.alias("element_id"), F.col("o_custkey").alias("page_id"), (F.row_number().over(place) - 1).cast("long").alias("ord"), (k % 5).cast("int").alias("z_index"),
        (k % 11 != 0).alias("visible"), (1 - (k % 4) * 0.25).alias("opacity"), F.element_at(kinds, (k % 6 + 1).cast("int")).alias("kind"),
        rect(k * 7 % 500, k * 13 % 700, 20 + k * 3 % 150, 10 + k * 5 % 90).alias("bounds"), matrix.alias("transform"),
    )


ELEMENTS_SQL = """doc_element AS (
  SELECT o_orderkey AS element_id, o_custkey AS page_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ord, CAST(o_orderkey % 5 AS INTEGER) AS z_index,
    o_orderkey % 11 <> 0 AS visible, 1 - (o_orderkey % 4) * 0.25::DOUBLE AS opacity, ['text', 'image', 'vector', 'table', 'media', 'group'][o_orderkey % 6 + 1] AS kind,
    CAST(o_orderkey * 7 % 500 AS DOUBLE) AS x, CAST(o_orderkey * 13 % 700 AS DOUBLE) AS y, CAST(20 + o_orderkey * 3 % 150 AS DOUBLE) AS w, CAST(10 + o_orderkey * 5 % 90 AS DOUBLE) AS h,
    CASE WHEN o_orderkey % 97 = 0 THEN 0.0::DOUBLE ELSE 1 + (o_orderkey % 3) * 0.5::DOUBLE END AS a, CASE WHEN o_orderkey % 97 = 0 THEN 0.0::DOUBLE ELSE (o_orderkey % 4) * 0.25::DOUBLE END AS b,
    CASE WHEN o_orderkey % 97 = 0 THEN 0.0::DOUBLE ELSE (o_orderkey % 2) * -0.5::DOUBLE END AS c, CASE WHEN o_orderkey % 97 = 0 THEN 0.0::DOUBLE ELSE 1 + (o_orderkey % 5) * 0.25::DOUBLE END AS d,
    CAST(o_orderkey % 40 AS DOUBLE) AS e, CAST(o_orderkey % 60 AS DOUBLE) AS f
  FROM orders
)"""


def nested_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements in one another: each but every 16th of a page is held by one of the three before it, in a cell of it if that is a table."""
    place = Window.partitionBy("page_id").orderBy("ord")
    held = lambda c: F.when(F.col("ord") % 16 != 0, F.coalesce(*[F.when(F.col("element_id") % 3 == i, F.lag(c, i + 1).over(place)) for i in range(3)]))
    k = F.col("element_id")
    rows = elements(spark, sf_dir).withColumns({"parent_id": held("element_id"), "parent_kind": held("kind")})
    cell = F.when(F.col("parent_kind") == "table", F.struct((100.0 + k % 3 * 100).alias("x"), (100.0 + k % 4 * 30).alias("y")))
    return rows.withColumn("cell", cell).drop("parent_kind")


NESTED_SQL = """nested_el AS (
  SELECT *, CASE WHEN parent_kind = 'table' THEN 100.0 + element_id % 3 * 100 ELSE 0 END::DOUBLE AS cell_x, CASE WHEN parent_kind = 'table' THEN 100.0 + element_id % 4 * 30 ELSE 0 END::DOUBLE AS cell_y FROM (
    SELECT *, CASE WHEN ord % 16 <> 0 THEN CASE element_id % 3 WHEN 0 THEN lag(element_id, 1) OVER w WHEN 1 THEN lag(element_id, 2) OVER w ELSE lag(element_id, 3) OVER w END END AS parent_id,
      CASE WHEN ord % 16 <> 0 THEN CASE element_id % 3 WHEN 0 THEN lag(kind, 1) OVER w WHEN 1 THEN lag(kind, 2) OVER w ELSE lag(kind, 3) OVER w END END AS parent_kind
    FROM doc_element WINDOW w AS (PARTITION BY page_id ORDER BY ord)
  )
)"""

#: What an event does to its user's document.
OPS = {"view": "move", "click": "move", "signup": "insert", "purchase": "text", "error": "undo"}


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edit for each event; every 15th is a redo."""
    place = Window.partitionBy("user_id").orderBy("ts", "event_id")
    op = F.create_map(*[F.lit(x) for kv in OPS.items() for x in kv])[F.col("event_type")]
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"), F.row_number().over(place).cast("long").alias("seq"), F.when(F.col("event_id") % 15 == 0, "redo").otherwise(op).alias("op"),
        (F.col("event_id") % 7).alias("element_id"), (F.col("event_id") % 640).cast("double").alias("x"), (F.col("event_id") % 480).cast("double").alias("y"),
    )


COMMANDS_SQL = """command_log AS (
  SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
    CASE WHEN event_id % 15 = 0 THEN 'redo' WHEN event_type IN ('view', 'click') THEN 'move' WHEN event_type = 'signup' THEN 'insert' WHEN event_type = 'purchase' THEN 'text' WHEN event_type = 'error' THEN 'undo' END AS op,
    event_id % 7 AS element_id, CAST(event_id % 640 AS DOUBLE) AS x, CAST(event_id % 480 AS DOUBLE) AS y
  FROM events
)"""


def viewports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A viewport for each nation, on its document."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        k.cast("long").alias("doc_id"), (k * 3 % 50).cast("double").alias("scroll_x"), (k * 997 % 20000).cast("double").alias("scroll_y"), (0.5 + (k % 4) * 0.5).alias("zoom"),
        F.lit(20).alias("page_spacing"), (800 + k * 8).cast("int").alias("screen_width"), (600 + k * 5).cast("int").alias("screen_height"),
    )


VIEWPORTS_SQL = """viewport AS (
  SELECT CAST(n_nationkey AS BIGINT) AS doc_id, CAST(n_nationkey * 3 % 50 AS DOUBLE) AS scroll_x, CAST(n_nationkey * 997 % 20000 AS DOUBLE) AS scroll_y, 0.5 + (n_nationkey % 4) * 0.5::DOUBLE AS zoom,
    20 AS page_spacing, CAST(800 + n_nationkey * 8 AS INTEGER) AS screen_width, CAST(600 + n_nationkey * 5 AS INTEGER) AS screen_height
  FROM nation
)"""
