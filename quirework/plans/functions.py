"""Queries in Spark SQL that call the library's functions by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sql
from ..operators import hit
from ..sources import adapters
from .document import _MOVE
from .geometry import _LOCAL, _TOPMOST, _probes
from .registry import query


@query(_TOPMOST.format(local=_LOCAL.format(x0="0", x1="w", y0="0", y1="h")))
def doc_sql_topmost_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The element under each probe, in SQL; elements are dealt to the cells of a grid that they touch."""
    sql.register(spark)
    shown = adapters.elements(spark, sf_dir).filter("visible").selectExpr("*", "qw_map_rect(transform, qw_rect(0, 0, bounds.width, bounds.height)) AS box")
    return spark.sql(
        """
        WITH asked AS (
          SELECT *, inline(array(named_struct('cx', floor(x / {cell}), 'cy', floor(y / {cell})), named_struct('cx', {everywhere}, 'cy', {everywhere}))) FROM {probes}
        ), met AS (
          SELECT /*+ MERGE(d) */ probe_id, element_id, ord FROM asked JOIN {dealt} d USING (page_id, cx, cy) WHERE qw_hit(d.bounds, d.transform, asked.x, asked.y)
        ), best AS (
          SELECT probe_id, max_by(element_id, ord) AS element_id FROM met GROUP BY probe_id
        )
        SELECT /*+ MERGE(best) */ probe_id, page_id, x, y, element_id FROM {probes} LEFT JOIN best USING (probe_id)
        """,
        probes=_probes(spark, sf_dir), dealt=hit.in_cells(shown, F.col("box")), cell=hit.CELL, everywhere=hit.EVERYWHERE,
    )


@query(_MOVE.format(owner="doc_id", a="doc_id % 7", b="doc_id * 3 % 11", table="doc_page", id="page_id", order="page_idx"))
def doc_sql_move_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages renumbered after a move in each document, in SQL."""
    sql.register(spark)
    return spark.sql(
        """
        WITH counted AS (SELECT doc_id AS owner, count(*) AS n FROM {pages} GROUP BY doc_id)
        SELECT page_id, doc_id, qw_moved_place(page_idx, doc_id % 7, doc_id * 3 % 11, n) AS page_idx FROM {pages} JOIN counted ON owner = doc_id
        """,
        pages=adapters.pages(spark, sf_dir),
    )
