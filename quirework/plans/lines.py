"""Queries of text layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import lines
from ..sources import adapters
from .registry import query


#: Characters of each text with their widths; where a line from each would end, by windows; then the chain of lines.
_LINES = r"""
WITH RECURSIVE said AS (
  SELECT doc_id, regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n$', '') || chr(10) AS t FROM documents WHERE text <> ''
), chars AS (
  SELECT doc_id, unnest(string_split(t, '')) AS ch, unnest(range(len(string_split(t, '')))) AS i FROM said
), sized AS (
  SELECT doc_id, i, ch, CASE WHEN ch = chr(10) THEN 0 WHEN contains(' !''(),./:;I[]fijlt|', ch) THEN 278 WHEN contains('GMOQW@%mw', ch) THEN 833 WHEN ch BETWEEN 'A' AND 'Z' THEN 667
    WHEN unicode(ch) BETWEEN 768 AND 879 THEN 0 WHEN unicode(ch) BETWEEN 4352 AND 4447 OR unicode(ch) BETWEEN 11904 AND 42191 OR unicode(ch) BETWEEN 44032 AND 55203 OR unicode(ch) BETWEEN 63744 AND 64255
      OR unicode(ch) BETWEEN 65072 AND 65135 OR unicode(ch) BETWEEN 65280 AND 65376 THEN 1000 ELSE 556 END AS w FROM chars
), spread AS (
  SELECT doc_id, i, ch, coalesce(lag(ch) OVER d, chr(10)) = chr(10) AS begins, coalesce(sum(w) OVER (d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS wide,
    min(CASE WHEN ch = chr(10) THEN i END) OVER (d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fin, count(*) FILTER (WHERE ch = chr(10)) OVER (d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS paragraph,
    max(CASE WHEN ch NOT IN (' ', chr(10)) THEN i END) OVER d AS last_filled, min(CASE WHEN ch <> ' ' THEN i END) OVER (d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_filled, max(CASE WHEN ch = ' ' THEN i END) OVER d AS last_space
  FROM sized WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), fitted AS (
  SELECT *, greatest(i, least(fin, max(i) OVER (PARTITION BY doc_id ORDER BY wide RANGE BETWEEN CURRENT ROW AND CASE WHEN begins THEN 37000 ELSE 39000 END FOLLOWING))) AS fits FROM spread
), seen AS (
  SELECT a.doc_id, a.i, a.ch, a.begins, a.wide, a.fin, a.paragraph, a.fits, b.next_filled AS rest, b.ch AS at_fits, coalesce(c.last_filled, -1) AS before, coalesce(c.last_space, -1) AS cut
  FROM fitted a JOIN spread b ON b.doc_id = a.doc_id AND b.i = a.fits LEFT JOIN spread c ON c.doc_id = a.doc_id AND c.i = a.fits - 1
), jumps AS (
  SELECT s.*, CASE WHEN s.ch = chr(10) THEN s.i + 1 WHEN rest = s.fin THEN s.fin + 1 WHEN at_fits = ' ' THEN rest WHEN cut > s.i AND e.last_filled >= s.i AND fits > s.i THEN cut + 1 ELSE greatest(fits, s.i + 1) END AS following,
    greatest(s.i, CASE WHEN s.ch = chr(10) THEN s.i WHEN rest = s.fin OR at_fits = ' ' THEN before + 1 WHEN cut > s.i AND e.last_filled >= s.i AND fits > s.i THEN e.last_filled + 1 ELSE greatest(fits, s.i + 1) END) AS stop
  FROM seen s LEFT JOIN spread e ON e.doc_id = s.doc_id AND e.i = s.cut
), chain AS (
  SELECT doc_id, 0::BIGINT AS line, 0::BIGINT AS i FROM said
  UNION ALL SELECT c.doc_id, c.line + 1, j.following FROM chain c JOIN jumps j ON j.doc_id = c.doc_id AND j.i = c.i WHERE j.following <= (SELECT max(i) FROM spread x WHERE x.doc_id = c.doc_id)
)
SELECT c.doc_id, c.line, j.paragraph, j.i AS first_char, stop - j.i AS n_chars, z.wide - j.wide AS width, CASE WHEN j.begins THEN 2000 ELSE 0 END * 12.0::DOUBLE / 1000 AS x, c.line * (1.2::DOUBLE * 12) AS y
FROM chain c JOIN jumps j ON j.doc_id = c.doc_id AND j.i = c.i JOIN spread z ON z.doc_id = j.doc_id AND z.i = stop
"""


@query(_LINES)
def doc_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts set in 12 points on a page of 612 less margins of 72, the first line of a paragraph indented by 24."""
    return lines.laid_out(adapters.table(spark, sf_dir, "documents").select("doc_id", "text"), width=612 - 2 * 72, first_line_indent=24)
