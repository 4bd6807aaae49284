"""Queries of drawing tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tools
from ..sources import adapters
from .registry import query


@query("""
WITH RECURSIVE log AS (
  SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place, event_id AS seq, CAST(event_id % 640 AS DOUBLE) AS x, CAST(event_id % 480 AS DOUBLE) AS y,
    CASE event_type WHEN 'click' THEN 'press' WHEN 'view' THEN 'move' WHEN 'purchase' THEN 'release' WHEN 'error' THEN CASE WHEN event_id % 5 = 0 THEN 'cancel' ELSE 'tool' END ELSE 'tool' END AS kind,
    ['DrawRect', 'TextEdit', 'InsertImage'][event_id % 3 + 1] AS tool FROM events
), fold AS (
  SELECT doc_id, 0::BIGINT AS place, NULL::BIGINT AS seq, NULL::VARCHAR AS kind, NULL::VARCHAR AS was, NULL::VARCHAR AS active, 0.0::DOUBLE AS sx, 0.0::DOUBLE AS sy, 0.0::DOUBLE AS cx, 0.0::DOUBLE AS cy FROM (SELECT DISTINCT doc_id FROM log)
  UNION ALL
  SELECT f.doc_id, l.place, l.seq, l.kind, f.active, CASE l.kind WHEN 'tool' THEN l.tool WHEN 'cancel' THEN NULL WHEN 'release' THEN NULL ELSE f.active END,
    CASE WHEN f.active IS NOT NULL AND l.kind = 'press' THEN l.x ELSE f.sx END, CASE WHEN f.active IS NOT NULL AND l.kind = 'press' THEN l.y ELSE f.sy END,
    CASE WHEN f.active IS NOT NULL AND l.kind IN ('press', 'move') THEN l.x ELSE f.cx END, CASE WHEN f.active IS NOT NULL AND l.kind IN ('press', 'move') THEN l.y ELSE f.cy END
  FROM fold f JOIN log l ON l.doc_id = f.doc_id AND l.place = f.place + 1
)
SELECT doc_id, seq, was AS tool, CASE WHEN was = 'DrawRect' THEN least(sx, cx) ELSE sx END AS x, CASE WHEN was = 'DrawRect' THEN least(sy, cy) ELSE sy END AS y,
  CASE was WHEN 'DrawRect' THEN abs(cx - sx) WHEN 'TextEdit' THEN 200 END AS width, CASE was WHEN 'DrawRect' THEN abs(cy - sy) WHEN 'TextEdit' THEN 30 END AS height,
  was <> 'DrawRect' OR abs(cx - sx) > 5 AND abs(cy - sy) > 5 AS created
FROM fold WHERE kind = 'release' AND was IS NOT NULL
""")
def doc_tools_finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each use of a tool makes, from presses (clicks), moves (views), releases (purchases), starts (signups and most errors) and cancels."""
    k, event = F.col("event_id"), F.col("event_type")
    kind = F.when(event == "click", "press").when(event == "view", "move").when(event == "purchase", "release").when((event == "error") & (k % 5 == 0), "cancel").otherwise("tool")
    tool = F.element_at(F.array(*[F.lit(t) for t in ("DrawRect", "TextEdit", "InsertImage")]), (k % 3 + 1).cast("int"))
    rows = adapters.table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), k.alias("seq"), kind.alias("kind"), tool.alias("tool"), (k % 640).cast("double").alias("x"), (k % 480).cast("double").alias("y"))
    return tools.finished(rows).select("doc_id", "seq", "tool", "bounds.x", "bounds.y", "bounds.width", "bounds.height", "created")
