"""Queries of page renders and of what makes them stale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import asof, layout
from ..sources import adapters
from ..streaming import queue
from .registry import query


@query("""
WITH ev AS (
  SELECT event_id, user_id AS doc_id, event_id % 4 AS page, ts, 1 + (event_id % 3) * 0.5::DOUBLE AS zoom, CASE event_type WHEN 'view' THEN 'request' WHEN 'click' THEN 'render' WHEN 'signup' THEN 'whole' ELSE 'part' END AS kind FROM events
), changed AS (
  SELECT doc_id, page, ts, event_id AS changed_id FROM ev WHERE kind = 'part'
), reset AS (
  SELECT doc_id, ts, event_id AS reset_id, row_number() OVER (PARTITION BY doc_id ORDER BY ts) AS generation FROM ev WHERE kind = 'whole'
), rendered AS (
  SELECT r.doc_id, r.page, r.ts, r.event_id AS render_id, r.zoom AS rendered_zoom, coalesce(g.generation, 0) AS rendered_generation FROM ev r ASOF LEFT JOIN reset g ON g.doc_id = r.doc_id AND g.ts <= r.ts WHERE r.kind = 'render'
), met AS (
  SELECT q.*, r.render_id, r.rendered_zoom, r.rendered_generation, r.ts AS rendered_ts, c.changed_id, c.ts AS changed_ts, coalesce(g.generation, 0) AS generation
  FROM ev q ASOF LEFT JOIN rendered r ON r.doc_id = q.doc_id AND r.page = q.page AND r.ts <= q.ts ASOF LEFT JOIN changed c ON c.doc_id = q.doc_id AND c.page = q.page AND c.ts <= q.ts ASOF LEFT JOIN reset g ON g.doc_id = q.doc_id AND g.ts <= q.ts
  WHERE q.kind = 'request'
)
SELECT event_id, doc_id, page, render_id, changed_id, generation,
  render_id IS NULL OR coalesce(changed_ts > rendered_ts, false) OR generation > rendered_generation OR abs(rendered_zoom - zoom) > 0.001 AS stale FROM met
""")
def doc_stale_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views ask for a page, clicks render it, signups invalidate a whole document and count its generation up, all else invalidates one page. Each request with the last render and the last invalidation before it."""
    event = F.col("event_type")
    kind = F.when(event == "view", "request").when(event == "click", "render").when(event == "signup", "whole").otherwise("part")
    rows = adapters.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("doc_id"), (F.col("event_id") % 4).alias("page"), "ts", (1 + (F.col("event_id") % 3) * 0.5).alias("zoom"), kind.alias("kind"))
    of = lambda k: rows.filter(F.col("kind") == k).drop("kind")
    week = F.floor(F.datediff(F.col("ts"), F.lit("1970-01-01").cast("date")) / 7)
    reset = asof.counted(of("whole").select("doc_id", "ts"), ["doc_id"], "ts", week, "generation")
    generation = F.coalesce(F.col("reset.generation"), F.lit(0))
    since = lambda df: asof.latest(df, {"reset": reset}, ["doc_id"], "ts", week).withColumn("generation", generation).drop("reset")
    renders = since(of("render")).select("doc_id", "page", "ts", F.col("event_id").alias("render_id"), "zoom", "generation")
    changes = of("part").select("doc_id", "page", "ts", F.col("event_id").alias("changed_id"))
    met = asof.latest(since(of("request")), {"render": renders, "change": changes}, ["doc_id", "page"], "ts", week)
    valid = F.col("render").isNotNull() & ~F.coalesce(F.col("change.ts") > F.col("render.ts"), F.lit(False)) & (F.col("generation") <= F.col("render.generation"))
    stale = F.coalesce(layout.needs_render(valid, F.col("render.zoom"), F.col("zoom")), F.lit(True))
    return met.select("event_id", "doc_id", "page", "render.render_id", "change.changed_id", "generation", stale.alias("stale"))


@query("""
WITH RECURSIVE log AS (
  SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type IN ('purchase', 'error') AS pop, event_id % 40 AS page FROM events
), fold AS (
  SELECT doc_id, 0::BIGINT AS seq, CAST([] AS BIGINT[]) AS pending, NULL::BIGINT AS page_idx FROM (SELECT DISTINCT doc_id FROM log)
  UNION ALL
  SELECT f.doc_id, l.seq, CASE WHEN l.pop THEN f.pending[2:] WHEN list_contains(f.pending, l.page) THEN f.pending ELSE list_append(f.pending, l.page) END, CASE WHEN l.pop AND len(f.pending) > 0 THEN f.pending[1] END
  FROM fold f JOIN log l ON l.doc_id = f.doc_id AND l.seq = f.seq + 1
)
SELECT doc_id, seq, page_idx, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS place FROM fold WHERE page_idx IS NOT NULL
""")
def doc_pages_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in the order in which they are taken from the queue: views, clicks and signups ask for a page, purchases and errors take one."""
    rows = adapters.table(spark, sf_dir, "events")
    place = Window.partitionBy("user_id").orderBy("ts", "event_id")
    op = F.when(F.col("event_type").isin("purchase", "error"), "pop").otherwise("ask")
    log = rows.select(F.col("user_id").alias("doc_id"), F.row_number().over(place).cast("long").alias("seq"), op.alias("op"), (F.col("event_id") % 40).alias("page_idx"))
    return queue.taken(log)
