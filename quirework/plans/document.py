"""Queries of text, order, editing and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths, payloads, text
from ..functions.geometry import image_size, page_at, rect
from ..operators import edits, history, layout
from ..sources import adapters, datasource, images, store
from ..sources.scratch import new_folder
from .registry import query

APPLICATION = "Editor"


@query("SELECT doc_id, CASE WHEN length(text) > 1000 THEN substr(text, 1, 1000) || '...' ELSE text END AS shown, length(text) AS chars FROM documents WHERE text <> ''")
def doc_text_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.table(spark, sf_dir, "documents").filter("text <> ''")
    return rows.select("doc_id", text.shown(F.col("text")).alias("shown"), F.length("text").cast("long").alias("chars"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'Arial' ELSE p_brand END AS font, CASE WHEN p_size % 3 <> 0 THEN CAST(p_size AS DOUBLE) END AS size, CASE WHEN p_size % 3 = 0 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS red, CASE p_partkey % 4 WHEN 1 THEN 'center' WHEN 2 THEN 'right' ELSE 'left' END AS alignment FROM part")
def doc_text_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    colour = F.struct(*[F.lit(0.5).alias(c) for c in "rgba"])
    run = F.struct(F.col("p_brand").alias("font_family"), F.col("p_size").cast("double").alias("font_size"), colour.alias("color"))
    later = F.struct(F.lit("unused").alias("font_family"), F.lit(1.0).alias("font_size"), colour.alias("color"))
    runs = F.when(F.col("p_size") % 3 == 0, F.slice(F.array(run), 1, 0)).otherwise(F.array(run, later))
    s = text.style(runs)
    return adapters.table(spark, sf_dir, "part").select("p_partkey", s["font_family"].alias("font"), s["font_size"].alias("size"), s["color"]["r"].alias("red"), text.alignment(F.col("p_partkey") % 4).alias("alignment"))


@query(rf"""
SELECT page_id, lower(regexp_extract(url, '\.([^./\\]*)$', 1)) AS suffix,
  CASE WHEN page_id % 5 = 0 THEN 'Untitled' ELSE regexp_extract(url, '([^/]*)$', 1) END || CASE WHEN page_id % 2 = 0 THEN ' *' ELSE '' END || ' - {APPLICATION}' AS title,
  'Page ' || (page_id + 1) || ' of ' || (page_id + 3) AS page_label, CAST(CAST(trunc(page_id * 0.125 * 100) AS INTEGER) AS VARCHAR) || '%' AS zoom_label,
  CASE WHEN page_id % 4 = 0 THEN 'Ready' ELSE 'Selected element ' || page_id END AS selection_label,
  CASE page_id % 3 WHEN 0 THEN 'IBeam' WHEN 1 THEN 'Cross' ELSE 'Arrow' END AS cursor
FROM pages
""")
def doc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    mode = F.element_at(F.array(F.lit("TextEdit"), F.lit("DrawRect"), F.lit("Select")), (k % 3 + 1).cast("int"))
    return adapters.table(spark, sf_dir, "pages").select(
        "page_id", text.suffix(F.col("url")).alias("suffix"), text.title(F.when(k % 5 != 0, F.col("url")), k % 2 == 0, APPLICATION).alias("title"), text.page_label(k, k + 3).alias("page_label"),
        text.zoom_label(k * 0.125).alias("zoom_label"), text.selection_label(F.when(k % 4 != 0, k)).alias("selection_label"), text.cursor(mode).alias("cursor"),
    )


@query("SELECT element_id, 5 AS commands, x AS x0, y AS y0, x + w AS x1, y + h AS y1, 4 AS edges FROM doc_element WHERE kind = 'vector'")
def doc_rectangle_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.elements(spark, sf_dir).filter("kind = 'vector'").withColumn("path", paths.replay(paths.rectangle(F.col("bounds"))))
    b = paths.bounds(F.col("path"))
    return rows.select("element_id", F.size("path").alias("commands"), b["x0"].alias("x0"), b["y0"].alias("y0"), b["x1"].alias("x1"), b["y1"].alias("y1"), F.size(paths.segments(F.col("path"))).alias("edges"))


@query("SELECT element_id, 250.0 >= x AND 250.0 < x + w AND 300.0 >= y AND 300.0 < y + h AS inside FROM doc_element")
def doc_clip_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of lower and left edges are inside an outline, those of upper and right ones aren't."""
    rows = adapters.elements(spark, sf_dir).withColumn("path", paths.rectangle(F.col("bounds")))
    return rows.select("element_id", paths.inside(F.col("path"), F.lit(250.0), F.lit(300.0)).alias("inside"))


@query("SELECT doc_id, seq, 'Double-click to edit' AS text, 'Arial' AS font, 26 AS run_length, x, y, 200.0::DOUBLE AS width, 30.0::DOUBLE AS height, CAST(trunc(y / 792.0) AS BIGINT) AS page_idx FROM command_log WHERE op = 'insert'")
def doc_new_text_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = rect(F.col("x"), F.col("y"), F.lit(200), F.lit(30))
    rows = adapters.commands(spark, sf_dir).filter("op = 'insert'").withColumn("b", b)
    return rows.select("doc_id", "seq", F.lit(text.DEFAULT_TEXT).alias("text"), F.lit(text.DEFAULT_FONT).alias("font"), F.lit(26).alias("run_length"), F.col("b.x").alias("x"), F.col("b.y").alias("y"), F.col("b.width").alias("width"), F.col("b.height").alias("height"), page_at(F.col("y")).alias("page_idx"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type = 'view' AS is_view, CASE WHEN event_type = 'view' THEN value END AS view_value FROM events")
def doc_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.table(spark, sf_dir, "events").withColumn("metadata", F.parse_json("props"))
    return rows.select("event_id", F.variant_get("metadata", "$.k", "bigint").alias("k"), (F.col("event_type") == "view").alias("is_view"), F.when(F.col("event_type") == "view", F.col("value")).alias("view_value"))


@query("SELECT o_custkey AS page_id, o_orderkey AS element_id, 100000000 + row_number() OVER (ORDER BY o_orderkey) AS new_id FROM orders")
def doc_generated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids go on from a counter in the order of the requests; one number for each new element."""
    rows = adapters.elements(spark, sf_dir).select("page_id", "element_id")
    return layout.numbered(rows, "element_id", 100_000_000).withColumnRenamed("number", "new_id")


@query("SELECT page_id, element_id, row_number() OVER (PARTITION BY page_id ORDER BY z_index, ord) - 1 AS draw FROM doc_element WHERE visible")
def doc_draw_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.draw_order(adapters.elements(spark, sf_dir)).select("page_id", "element_id", F.col("draw").cast("long").alias("draw"))


@query("SELECT element_id, kind, page_id, page_idx, doc_id FROM doc_element JOIN doc_page USING (page_id)")
def doc_find_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids are unique, so the first match is the only one; the chain of owners is one join long."""
    return adapters.elements(spark, sf_dir).join(adapters.pages(spark, sf_dir), "page_id").select("element_id", "kind", "page_id", "page_idx", "doc_id")


@query("""
SELECT wanted.id, objects.kind FROM (SELECT DISTINCT l_orderkey + 1000000 * k AS id FROM lineitem, range(3) t(k)) wanted LEFT JOIN (
  SELECT 0 AS id, 'document' AS kind UNION ALL SELECT page_id, 'page' FROM doc_page UNION ALL SELECT 1000000 + element_id, 'element' FROM doc_element
) objects ON objects.id = wanted.id
""")
def doc_find_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, pages and elements share one space of ids; unknown ids are null. Elements are set apart here, as the adapter's ids overlap."""
    document = spark.range(1).select(F.col("id"), F.lit("document").alias("kind"))
    pages = adapters.pages(spark, sf_dir).select(F.col("page_id").alias("id"), F.lit("page").alias("kind"))
    found = document.union(pages).union(adapters.elements(spark, sf_dir).select((1_000_000 + F.col("element_id")).alias("id"), F.lit("element").alias("kind")))
    wanted = adapters.table(spark, sf_dir, "lineitem").select(F.explode(F.array(*[F.col("l_orderkey") + 1_000_000 * i for i in range(3)])).alias("id")).distinct()
    return wanted.join(found, "id", "left").select("id", "kind")


@query("SELECT w.doc_id, w.page_idx, p.page_id FROM (SELECT doc_id, page_idx FROM doc_page UNION SELECT doc_id, page_idx + 1 FROM doc_page UNION SELECT doc_id, -1 FROM viewport) w LEFT JOIN doc_page p ON p.doc_id = w.doc_id AND p.page_idx = w.page_idx")
def doc_page_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All indexes, one before the first and one behind the last; those out of range find nothing."""
    pages = adapters.pages(spark, sf_dir)
    wanted = pages.select("doc_id", F.explode(F.array("page_idx", F.col("page_idx") + 1)).alias("page_idx")).union(adapters.viewports(spark, sf_dir).select("doc_id", F.lit(-1).cast("long"))).distinct()
    return wanted.join(adapters.pages(spark, sf_dir).select("doc_id", "page_idx", "page_id"), ["doc_id", "page_idx"], "left")


@query("SELECT doc_id, count(*) AS pages, CAST(sum(n) AS BIGINT) AS elements FROM (SELECT doc_id, p.page_id, count(e.element_id) AS n FROM doc_page p LEFT JOIN doc_element e ON e.page_id = p.page_id GROUP BY ALL) GROUP BY doc_id")
def doc_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_page = adapters.elements(spark, sf_dir).groupBy("page_id").agg(F.count("*").alias("n"))
    rows = adapters.pages(spark, sf_dir).join(per_page, "page_id", "left")
    return rows.groupBy("doc_id").agg(F.count("*").alias("pages"), F.coalesce(F.sum("n"), F.lit(0)).alias("elements"))


@query("SELECT page_id, CAST(coalesce(sum(CAST(trunc(height * zoom) AS BIGINT) + 20) OVER (PARTITION BY doc_id ORDER BY page_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS y_offset FROM doc_page JOIN viewport USING (doc_id)")
def doc_screen_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.screen_offsets(adapters.pages(spark, sf_dir), adapters.viewports(spark, sf_dir)).select("page_id", "y_offset")


@query("""
WITH size AS (SELECT n_nationkey AS table_id, greatest(least(n_nationkey * 6, 100), 1) AS n_rows, greatest(least(n_nationkey - 2, 100), 1) AS n_cols FROM nation)
SELECT table_id, r AS "row", c AS col, CAST(100 + 100 * c AS DOUBLE) AS x, CAST(100 + 30 * r AS DOUBLE) AS y FROM (SELECT *, unnest(range(CAST(n_rows AS BIGINT))) AS r FROM size) s, range(100) t(c) WHERE c < n_cols
""")
def doc_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    tables = adapters.table(spark, sf_dir, "nation").select(k.alias("table_id"), (k * 6).alias("rows"), (k - 2).alias("cols"))
    return layout.table_cells(tables).select("table_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("bounds.x").alias("x"), F.col("bounds.y").alias("y"))


@query("""
WITH cols AS (SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_partkey) AS col FROM lineitem)
SELECT l_orderkey, col - 1 AS col, CAST(coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 100 AS DOUBLE) AS x FROM cols
""")
def doc_column_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running offsets of columns of any width."""
    rows = adapters.table(spark, sf_dir, "lineitem")
    return layout.column_offsets(rows, "l_orderkey", ["l_linenumber", "l_quantity", "l_partkey"], "l_quantity").select("l_orderkey", "col", "x")


@query("""
SELECT t.element_id AS table_id, k AS position, c.element_id AS child_id, c.kind FROM (SELECT element_id, page_id, ord, unnest([1, 2, 3]) AS k FROM doc_element WHERE kind = 'table') t JOIN doc_element c ON c.page_id = t.page_id AND c.ord = t.ord + k
""")
def doc_table_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children by position: the three elements that follow a table on its page."""
    rows = adapters.elements(spark, sf_dir)
    tables = rows.filter("kind = 'table'").select(F.col("element_id").alias("table_id"), "page_id", F.col("ord").alias("at"), F.posexplode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("i", "k"))
    tables = tables.select("table_id", "page_id", F.col("k").alias("position"), (F.col("at") + F.col("k")).alias("ord"))
    return tables.join(rows, ["page_id", "ord"]).select("table_id", "position", F.col("element_id").alias("child_id"), "kind")


@query("""
SELECT t.tab_id, t.page_idx, p.page_id FROM (SELECT n_nationkey AS tab_id, CAST(n_nationkey AS BIGINT) AS doc_id, unnest([0, 2, 4, n_nationkey]) AS page_idx FROM nation) t JOIN doc_page p ON p.doc_id = t.doc_id AND p.page_idx = t.page_idx
""")
def doc_tab_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    tabs = adapters.table(spark, sf_dir, "nation").select(k.alias("tab_id"), k.cast("long").alias("doc_id"), F.array(F.lit(0), F.lit(2), F.lit(4), k).alias("page_indices"))
    return tabs.select("tab_id", "doc_id", F.explode("page_indices").alias("page_idx")).join(adapters.pages(spark, sf_dir).withColumn("page_idx", F.col("page_idx").cast("int")), ["doc_id", "page_idx"]).select("tab_id", "page_idx", "page_id")


@query("SELECT doc_id, page_idx, row_number() OVER (PARTITION BY doc_id ORDER BY asked) AS place FROM (SELECT user_id AS doc_id, event_id % 40 AS page_idx, min(event_id) AS asked FROM events GROUP BY ALL)")
def doc_render_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for pages, each pending once, in the order of their first arrival."""
    rows = adapters.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id"), (F.col("event_id") % 40).alias("page_idx")).agg(F.min("event_id").alias("asked"))
    return rows.select("doc_id", "page_idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("asked")).cast("long").alias("place"))


@query("""
WITH spot AS (SELECT doc_id, count(*) AS n, CASE WHEN doc_id % 3 = 0 OR doc_id * 2 >= count(*) THEN count(*) ELSE doc_id * 2 END AS p FROM doc_page GROUP BY doc_id)
SELECT page_id, doc_id, page_idx + CASE WHEN page_idx >= p THEN 1 ELSE 0 END AS page_idx FROM doc_page JOIN spot USING (doc_id) UNION ALL SELECT 1000000 + doc_id, doc_id, p FROM spot
""")
def doc_insert_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is inserted in every document; without a place, or with one beyond the end, it is appended."""
    pages = adapters.pages(spark, sf_dir).select("page_id", "doc_id", "page_idx")
    wanted = pages.select("doc_id").distinct().select("doc_id", (1_000_000 + F.col("doc_id")).alias("new_id"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") * 2).alias("at"))
    return edits.insert(pages, wanted, "doc_id", "page_idx", "page_id").select("page_id", "doc_id", "page_idx")


@query("SELECT page_id, doc_id, page_idx - CASE WHEN doc_id % 5 < page_idx THEN 1 ELSE 0 END AS page_idx FROM doc_page WHERE page_idx <> doc_id % 5")
def doc_remove_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = adapters.pages(spark, sf_dir).select("page_id", "doc_id", "page_idx")
    wanted = pages.select("doc_id").distinct().select("doc_id", (F.col("doc_id") % 5).alias("at"))
    return edits.remove(pages, wanted, "doc_id", "page_idx")


_MOVE = """
WITH m AS (SELECT {owner} AS o, count(*) AS n, {a} AS src, {b} AS dst FROM {table} GROUP BY ALL)
SELECT {id}, {owner}, CASE WHEN NOT (src < n AND dst < n) THEN {order} WHEN {order} = src THEN dst WHEN src < dst AND {order} > src AND {order} <= dst THEN {order} - 1 WHEN dst < src AND {order} >= dst AND {order} < src THEN {order} + 1 ELSE {order} END AS {order}
FROM {table} JOIN m ON o = {owner}
"""


@query(_MOVE.format(owner="doc_id", a="doc_id % 7", b="doc_id * 3 % 11", table="doc_page", id="page_id", order="page_idx"))
def doc_move_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = adapters.pages(spark, sf_dir).select("page_id", "doc_id", "page_idx")
    wanted = pages.select("doc_id").distinct().select("doc_id", (F.col("doc_id") % 7).alias("from_idx"), (F.col("doc_id") * 3 % 11).alias("to_idx"))
    return edits.move(pages, wanted, "doc_id", "page_idx")


@query(_MOVE.format(owner="page_id", a="page_id % 4", b="page_id * 5 % 6", table="doc_element", id="element_id", order="ord"))
def doc_restack_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = adapters.elements(spark, sf_dir).select("element_id", "page_id", "ord")
    wanted = items.select("page_id").distinct().select("page_id", (F.col("page_id") % 4).alias("from_idx"), (F.col("page_id") * 5 % 6).alias("to_idx"))
    return edits.move(items, wanted, "page_id", "ord").select("element_id", "page_id", "ord")


@query("""
SELECT element_id, page_id, ord - CASE WHEN page_id % 3 < ord THEN 1 ELSE 0 END AS ord FROM doc_element WHERE ord <> page_id % 3
UNION ALL SELECT 10000000 + page_id, page_id, count(*) - CASE WHEN count(*) > page_id % 3 THEN 1 ELSE 0 END FROM doc_element GROUP BY page_id
""")
def doc_replace_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On every page, one element is deleted and a new one appended."""
    items = adapters.elements(spark, sf_dir).select("element_id", "page_id", "ord")
    owners = items.select("page_id").distinct()
    left = edits.remove(items, owners.select("page_id", (F.col("page_id") % 3).alias("at")), "page_id", "ord")
    new = owners.select("page_id", (10_000_000 + F.col("page_id")).alias("new_id"), F.lit(None).cast("long").alias("at"))
    return edits.insert(left, new, "page_id", "ord", "element_id").select("element_id", "page_id", "ord")


@query("""
WITH last AS (SELECT doc_id, element_id, arg_max(x, seq) AS nx, arg_max(y, seq) AS ny, count(*) AS moves FROM command_log WHERE op = 'move' GROUP BY ALL)
SELECT doc_id, element_id, nx AS x, ny AS y, moves FROM last
""")
def doc_move_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.latest_positions(adapters.commands(spark, sf_dir))


@query("""
SELECT element_id, CASE WHEN element_id % 3 = 0 THEN CAST(element_id % 50 AS DOUBLE) ELSE x END AS x, CASE WHEN element_id % 3 = 0 THEN 5.0::DOUBLE ELSE y END AS y, CASE WHEN kind = 'text' AND element_id % 2 = 0 THEN 'new' ELSE kind END AS text, element_id = page_id % 100 AS selected FROM doc_element
""")
def doc_edit_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves, text changes (of text elements only) and a selection, as expressions on the rows."""
    k = F.col("element_id")
    changed = k % 3 == 0
    b = edits.move_to(F.col("bounds"), F.when(changed, (k % 50).cast("double")), F.when(changed, F.lit(5.0)))
    rows = edits.select(adapters.elements(spark, sf_dir), F.col("page_id") % 100)
    return rows.select("element_id", b["x"].alias("x"), b["y"].alias("y"), edits.modify_text(F.col("kind"), F.col("kind"), F.when(k % 2 == 0, F.lit("new"))).alias("text"), "selected")


@query("""
WITH marked AS (
  SELECT *, CASE WHEN op = 'move' AND lag(op) OVER w = 'move' AND lag(element_id) OVER w = element_id THEN 0 ELSE 1 END AS start FROM command_log WINDOW w AS (PARTITION BY doc_id ORDER BY seq)
), runs AS (SELECT *, sum(start) OVER (PARTITION BY doc_id ORDER BY seq) AS run FROM marked)
SELECT doc_id, op, element_id, min(seq) AS first_seq, max(seq) AS last_seq, arg_min(x, seq) AS old_x, arg_max(x, seq) AS new_x, count(*) AS commands FROM runs GROUP BY doc_id, run, op, element_id
""")
def doc_coalesced_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.coalesced(adapters.commands(spark, sf_dir)).drop("run")


_FOLD = """
WITH RECURSIVE fold AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS seq, CAST([] AS BIGINT[]) AS done, CAST([] AS BIGINT[]) AS undone FROM (SELECT DISTINCT doc_id FROM command_log)
  UNION ALL
  SELECT f.doc_id, c.seq,
    CASE WHEN c.op = 'undo' THEN f.done[1:len(f.done) - 1] WHEN c.op = 'redo' THEN CASE WHEN len(f.undone) > 0 THEN list_append(f.done, f.undone[len(f.undone)]) ELSE f.done END ELSE list_append(f.done, c.seq) END,
    CASE WHEN c.op = 'undo' THEN CASE WHEN len(f.done) > 0 THEN list_append(f.undone, f.done[len(f.done)]) ELSE f.undone END WHEN c.op = 'redo' THEN f.undone[1:len(f.undone) - 1] ELSE [] END
  FROM fold f JOIN command_log c ON c.doc_id = f.doc_id AND c.seq = f.seq + 1
), stacks AS (SELECT doc_id, arg_max(done, seq) AS done, arg_max(undone, seq) AS undone FROM fold GROUP BY doc_id)"""


@query(_FOLD + "SELECT doc_id, len(done) AS n_done, len(undone) AS n_undone, CAST(list_sum(done) AS BIGINT) AS done_sum FROM stacks")
def doc_undo_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = adapters.commands(spark, sf_dir)
    stack = history.on_stack(log).groupBy("doc_id").agg(F.count_if("done").alias("n_done"), F.count_if(~F.col("done")).alias("n_undone"), F.sum(F.when(F.col("done"), F.col("seq"))).alias("done_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return log.select("doc_id").distinct().join(stack, "doc_id", "left").select("doc_id", zero("n_done"), zero("n_undone"), "done_sum")


@query(_FOLD + """
, alive AS (SELECT doc_id, unnest(done) AS seq FROM stacks), acts AS (SELECT c.*, a.seq IS NOT NULL AS live FROM command_log c LEFT JOIN alive a ON a.doc_id = c.doc_id AND a.seq = c.seq WHERE op NOT IN ('undo', 'redo')),
ends AS (SELECT doc_id, element_id, arg_max(x, seq) FILTER (WHERE live AND op IN ('move', 'insert')) AS nx, arg_max(y, seq) FILTER (WHERE live AND op IN ('move', 'insert')) AS ny,
  arg_max(x / 4 + 1, seq) FILTER (WHERE live AND op = 'insert') AS nw, arg_max(y / 4 + 1, seq) FILTER (WHERE live AND op = 'insert') AS nh, max(seq) FILTER (WHERE live AND op = 'text') AS nt FROM acts GROUP BY ALL),
first AS (SELECT doc_id, k AS element_id FROM (SELECT DISTINCT doc_id FROM command_log), range(9) t(k))
SELECT first.doc_id, first.element_id, coalesce(nx, first.element_id * 10.0::DOUBLE) AS x, coalesce(ny, first.element_id * 20.0::DOUBLE) AS y, coalesce(nw, 30.0::DOUBLE) AS width, coalesce(nh, 40.0::DOUBLE) AS height,
  CASE WHEN first.element_id % 2 = 0 THEN coalesce('edit ' || nt, 'as it was') END AS text, ends.doc_id IS NOT NULL AS modified
FROM first LEFT JOIN ends ON ends.doc_id = first.doc_id AND ends.element_id = first.element_id
""")
def doc_replayed_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine elements of each document after its log of moves, resizes and text edits, with undos and redos."""
    log = adapters.commands(spark, sf_dir)
    k = F.col("element_id")
    first = log.select("doc_id").distinct().withColumn("element_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))))
    first = first.withColumns({"bounds": rect(k * 10, k * 20, F.lit(30), F.lit(40)), "text": F.when(k % 2 == 0, F.lit("as it was"))})
    log = log.withColumns({"op": F.when(F.col("op") == "insert", "resize").otherwise(F.col("op")), "bounds": rect(F.col("x"), F.col("y"), F.col("x") / 4 + 1, F.col("y") / 4 + 1), "text": F.concat(F.lit("edit "), F.col("seq").cast("string"))})
    return history.replayed(first, log).select("doc_id", "element_id", "bounds.x", "bounds.y", "bounds.width", "bounds.height", "text", "modified")


@query("SELECT element_id, CASE WHEN element_id % 3 = 0 THEN y ELSE x END AS x, CASE WHEN element_id % 3 = 0 THEN x ELSE y END AS y, CASE WHEN element_id % 3 = 0 THEN h * 2 ELSE w END AS width, CASE WHEN element_id % 3 = 0 THEN w / 2 ELSE h END AS height FROM doc_element")
def doc_resize_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third element gets new bounds: place and size turned about."""
    old = F.col("bounds")
    new = F.when(F.col("element_id") % 3 == 0, rect(old["y"], old["x"], old["height"] * 2, old["width"] / 2))
    return adapters.elements(spark, sf_dir).select("element_id", edits.resize_to(old, new).alias("b")).select("element_id", "b.x", "b.y", "b.width", "b.height")


@query("SELECT n_nationkey AS table_id, 100.0::DOUBLE AS x, 100.0::DOUBLE AS y, CAST(100 * greatest(least(n_nationkey - 2, 100), 1) AS DOUBLE) AS width, CAST(30 * greatest(least(n_nationkey * 6, 100), 1) AS DOUBLE) AS height FROM nation")
def doc_new_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    wanted = adapters.table(spark, sf_dir, "nation").select(k.alias("table_id"), (k * 6).alias("rows"), (k - 2).alias("cols"))
    return edits.new_tables(wanted).select("table_id", "bounds.x", "bounds.y", "bounds.width", "bounds.height")


@query("SELECT CAST(1 AS BIGINT) AS page_id, c_custkey AS doc_id, CAST(0 AS BIGINT) AS page_idx, 612.0::DOUBLE AS width, 792.0::DOUBLE AS height, 72.0::DOUBLE AS margin_top, 1.0::DOUBLE AS red, false AS modified FROM customer")
def doc_new_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new document for each customer; it has one default page."""
    page = store.new_pages(adapters.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id")))
    return page.select("page_id", "doc_id", "page_idx", "width", "height", "margin_top", F.col("background.r").alias("red"), "modified")


@query("SELECT element_id, page_id, ord, z_index, visible, opacity, kind, x, y, w AS width, h AS height FROM doc_element WHERE page_id % 3 = 0 OR page_id < 40")
def doc_saved_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements saved as a document table and opened again. Of the rows, those of every third page and of the first ones; the latter are opened by their range of pages, which reads few files."""
    folder = new_folder(spark, "saved")
    back = datasource.saved(adapters.elements(spark, sf_dir), folder)
    rows = datasource.opened(spark, folder, high=39).unionByName(back.filter("page_id >= 40 AND page_id % 3 = 0"))
    return rows.select("element_id", "page_id", "ord", "z_index", "visible", "opacity", "kind", "bounds.x", "bounds.y", "bounds.width", "bounds.height")


@query("""
WITH step AS (SELECT doc_id, seq, op, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, lag(op) OVER w AS before FROM command_log WINDOW w AS (PARTITION BY doc_id ORDER BY seq))
SELECT doc_id, count(*) AS moves, CAST(sum(dx) AS DOUBLE) AS dx, CAST(sum(dy) AS DOUBLE) AS dy FROM step WHERE op = 'move' AND before = 'move' GROUP BY doc_id
""")
def doc_drag_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live drags: the sum of the steps between consecutive moves."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    rows = adapters.commands(spark, sf_dir).withColumns({"dx": F.col("x") - F.lag("x").over(w), "dy": F.col("y") - F.lag("y").over(w), "before": F.lag("op").over(w)})
    return rows.filter("op = 'move' AND before = 'move'").groupBy("doc_id").agg(F.count("*").alias("moves"), F.sum("dx").alias("dx"), F.sum("dy").alias("dy"))


@query("""
WITH e AS (SELECT user_id AS doc_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'press' WHEN 'view' THEN 'move' WHEN 'signup' THEN 'move' WHEN 'purchase' THEN 'release' END AS kind,
  CASE WHEN event_type = 'click' AND event_id % 3 <> 0 THEN event_id % 7 END AS element_id, CAST(event_id % 640 AS DOUBLE) AS x, CAST(event_id % 480 AS DOUBLE) AS y FROM events WHERE event_type <> 'error'),
s AS (SELECT *, coalesce(count(*) FILTER (WHERE kind = 'release') OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stretch FROM e),
h AS (SELECT doc_id, stretch, max(seq) AS pressed, arg_max(element_id, seq) AS element_id FROM s WHERE kind = 'press' AND element_id IS NOT NULL GROUP BY ALL),
d AS (SELECT s.doc_id, s.stretch, s.seq, s.kind, h.element_id, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM s JOIN h ON h.doc_id = s.doc_id AND h.stretch = s.stretch AND s.seq >= h.pressed WINDOW w AS (PARTITION BY s.doc_id, s.stretch ORDER BY s.seq))
SELECT doc_id, element_id, min(seq) AS press_seq, max(seq) FILTER (WHERE kind = 'release') AS release_seq, CAST(sum(CASE WHEN kind = 'move' THEN dx ELSE 0 END) AS DOUBLE) AS dx, CAST(sum(CASE WHEN kind = 'move' THEN dy ELSE 0 END) AS DOUBLE) AS dy
FROM d GROUP BY doc_id, stretch, element_id HAVING max(seq) FILTER (WHERE kind = 'release') IS NOT NULL
""")
def doc_drags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presses, moves and releases of the pointer become one move command for each drag."""
    k = F.col("event_id")
    kind = F.create_map(*[F.lit(x) for kv in {"click": "press", "view": "move", "signup": "move", "purchase": "release", "error": "key"}.items() for x in kv])[F.col("event_type")]
    hit = F.when((F.col("event_type") == "click") & (k % 3 != 0), k % 7)
    rows = adapters.table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), k.alias("seq"), kind.alias("kind"), hit.alias("element_id"), (k % 640).cast("double").alias("x"), (k % 480).cast("double").alias("y"))
    return history.drags(rows)


@query("""
WITH s AS (SELECT doc_id, seq, op, CASE WHEN op IN ('insert', 'text') THEN seq END AS started FROM command_log),
t AS (SELECT *, max(started) OVER (PARTITION BY doc_id ORDER BY seq) AS since, lag(op) OVER (PARTITION BY doc_id ORDER BY seq) AS before FROM s)
SELECT doc_id, seq, CASE WHEN op = 'insert' THEN 'DrawRect' WHEN op = 'text' THEN 'TextEdit' WHEN since IS NULL THEN 'View' ELSE 'Select' END AS mode, op IN ('insert', 'text') AS active, CASE WHEN op NOT IN ('insert', 'text') AND since IS NOT NULL AND before IN ('insert', 'text') THEN 'finished' END AS event FROM t
""")
def doc_tool_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tool starts with an insert or text command and ends with the next other one, which leaves Select; View until then."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    starts = F.col("op").isin("insert", "text")
    rows = adapters.commands(spark, sf_dir).withColumns({"since": F.max(F.when(starts, F.col("seq"))).over(w), "before": F.lag("op").over(w)})
    mode = F.when(F.col("op") == "insert", "DrawRect").when(F.col("op") == "text", "TextEdit").when(F.col("since").isNull(), "View").otherwise("Select")
    done = F.when(~starts & F.col("since").isNotNull() & F.col("before").isin("insert", "text"), "finished")
    return rows.select("doc_id", "seq", mode.alias("mode"), starts.alias("active"), done.alias("event"))


@query("""
SELECT doc_id, seq, least(sel + 1, n) AS next_page, CASE WHEN sel + 1 < n THEN sel + 1 END AS went_next, CASE WHEN sel > 0 THEN sel - 1 ELSE 0 END AS previous_page, 0 AS first_page, n - 1 AS last_page
FROM (SELECT c.doc_id, c.seq, c.element_id * 9 AS sel, n FROM command_log c JOIN (SELECT doc_id, count(*) AS n FROM doc_page GROUP BY doc_id) p ON p.doc_id = c.doc_id)
""")
def doc_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps start from the selection's page; going beyond the last page does nothing."""
    n = adapters.pages(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"))
    rows = adapters.commands(spark, sf_dir).withColumn("sel", F.col("element_id") * 9).join(n, "doc_id")
    sel = F.col("sel")
    return rows.select("doc_id", "seq", F.least(sel + 1, F.col("n")).alias("next_page"), F.when(sel + 1 < F.col("n"), sel + 1).alias("went_next"), F.when(sel > 0, sel - 1).otherwise(0).alias("previous_page"), F.lit(0).alias("first_page"), (F.col("n") - 1).alias("last_page"))


@query("""
SELECT event_id, CASE event_type WHEN 'click' THEN 'press' WHEN 'view' THEN 'wheel' WHEN 'signup' THEN 'double_click' WHEN 'purchase' THEN 'release' ELSE 'key' END AS kind,
  CASE WHEN event_type = 'view' AND event_id % 2 = 0 THEN CASE WHEN value > 10 THEN 'zoom_in' ELSE 'zoom_out' END WHEN event_type = 'view' THEN 'scroll' WHEN event_type = 'click' THEN 'select' WHEN event_type = 'purchase' THEN 'push_move' WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'clear_selection' WHEN event_type = 'error' THEN 'next_page' ELSE 'notify' END AS effect
FROM events
""")
def doc_event_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What input events do: with the control key, the wheel zooms; a release pushes a move even without movement."""
    kind = F.create_map(*[F.lit(x) for kv in {"click": "press", "view": "wheel", "signup": "double_click", "purchase": "release", "error": "key"}.items() for x in kv])
    e, k = F.col("kind"), F.col("event_id")
    rows = adapters.table(spark, sf_dir, "events").withColumn("kind", kind[F.col("event_type")])
    effect = (
        F.when((e == "wheel") & (k % 2 == 0), F.when(F.col("value") > 10, "zoom_in").otherwise("zoom_out")).when(e == "wheel", "scroll").when(e == "press", "select")
        .when(e == "release", "push_move").when((e == "key") & (k % 3 == 0), "clear_selection").when(e == "key", "next_page").otherwise("notify")
    )
    return rows.select("event_id", "kind", effect.alias("effect"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_partkey % 7 + 1 AS INTEGER) END AS width, CASE WHEN p_partkey % 5 <> 0 THEN 2 END AS height, CASE WHEN p_partkey % 5 <> 0 THEN '89504E470D0A1A0A0000000D49484452' || printf('%08X', p_partkey % 7 + 1) || '00000002' END AS png_head FROM part")
def doc_image_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitmaps built from parts (every fifth is broken) are decoded and written as PNG."""
    return images.decode(_bitmaps(spark, sf_dir)).select("p_partkey", "width", "height", F.hex(F.substring("png", 1, 24)).alias("png_head"))


def _bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    size = (k % 7 + 1).cast("int")
    word = lambda n: F.unhex(F.concat(*[F.substring(F.lpad(F.hex(n), 8, "0"), i, 2) for i in (7, 5, 3, 1)]))
    zero = F.lit(0)
    head = F.concat(F.unhex(F.lit("424D")), word(zero), word(zero), word(F.lit(54)), word(F.lit(40)), word(size), word(F.lit(2)), F.unhex(F.lit("01001800")), *[word(zero)] * 6)
    pixels = F.expr("substring(unhex(repeat('80C0FF', 32)), 1, cast(ceil((p_partkey % 7 + 1) * 3 / 4) * 8 as int))")
    return adapters.table(spark, sf_dir, "part").select("p_partkey", F.when(k % 5 != 0, F.concat(head, pixels)).otherwise(F.unhex(F.lit("00FF"))).alias("content"))


@query("SELECT p_partkey, CAST(p_partkey % 7 + 1 AS INTEGER) AS width, 2 AS height, 'bmp' AS format FROM part WHERE p_partkey % 5 <> 0")
def doc_image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same bitmaps as files of a folder, which is scanned; broken ones are left out."""
    folder = new_folder(spark, "images")
    files = _bitmaps(spark, sf_dir).select(F.concat(F.col("p_partkey").cast("string"), F.lit(".bmp")).alias("name"), "content")
    parts = images.parts_for(files)
    images.write(files, folder, parts)
    return images.scan(spark, folder, parts).select(F.regexp_extract("path", r"(\d+)\.bmp$", 1).cast("long").alias("p_partkey"), "width", "height", "format")


@query("""
SELECT element_id, kind = 'text' AS is_text, kind = 'image' AS is_image, kind = 'vector' AS is_vector, kind = 'table' AS is_table, kind = 'media' AS is_media, kind = 'group' AS is_group, 'element' AS object_type,
  CASE WHEN element_id % 9 = 0 THEN 'None' ELSE 'SingleElement' END = 'None' AS selection_empty FROM doc_element
""")
def doc_kind_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    selection = F.when(F.col("element_id") % 9 == 0, "None").otherwise("SingleElement")
    return adapters.elements(spark, sf_dir).select("element_id", *[(F.col("kind") == k).alias(f"is_{k}") for k in adapters.KINDS], F.lit("element").alias("object_type"), (selection == "None").alias("selection_empty"))


@query("SELECT doc_id, count(*) FILTER (WHERE op IN ('move', 'insert', 'text')) AS edits, count(*) FILTER (WHERE op IN ('move', 'insert', 'text')) > 50 AS modified FROM command_log GROUP BY doc_id")
def doc_modified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with over fifty edits are marked; the date of the mark is left out here, as it is now."""
    edited = adapters.commands(spark, sf_dir).groupBy("doc_id").agg(F.count(F.when(F.col("op").isin("move", "insert", "text"), 1)).alias("edits"))
    return edits.mark_modified(edited, F.col("edits") > 50).select("doc_id", "edits", "modified")


@query("""
SELECT * FROM (SELECT n_nationkey AS id, CAST(n_regionkey AS BIGINT) AS doc_id, n_name AS name, 3 AS pages FROM nation UNION ALL SELECT 1000 + r_regionkey, CAST(r_regionkey AS BIGINT), r_name, 0 FROM region) WHERE id % 4 <> 1
""")
def doc_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document gets a new empty tab; then every fourth tab is removed."""
    nation = adapters.table(spark, sf_dir, "nation")
    tabs = nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("doc_id"), F.col("n_name").alias("name"), F.array(*[F.lit(i).cast("long") for i in range(3)]).alias("page_indices"))
    region = adapters.table(spark, sf_dir, "region")
    tabs = edits.add_tabs(tabs, region.select((1000 + F.col("r_regionkey")).cast("long").alias("id"), F.col("r_regionkey").cast("long").alias("doc_id"), F.col("r_name").alias("name")))
    gone = tabs.filter("id % 4 = 1")
    return edits.remove_tabs(tabs, gone).select(F.col("id").cast("int").alias("id"), "doc_id", "name", F.size("page_indices").alias("pages"))


@query("""
SELECT doc_id, seq, x, y, x + 50 AS x1, y + 40 AS y1, CAST(trunc(y / 792.0) AS BIGINT) AS page_idx, 5 AS commands, 0.8::DOUBLE AS fill_red, 0.9::DOUBLE AS fill_blue, 0.2::DOUBLE AS stroke_red, 1.0::DOUBLE AS stroke_width
FROM command_log WHERE op = 'insert'
""")
def doc_new_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new rectangle's path is in absolute coordinates; its page is the one its corner falls on."""
    rows = adapters.commands(spark, sf_dir).filter("op = 'insert'").withColumn("v", paths.new_rectangle(rect(F.col("x"), F.col("y"), F.lit(50), F.lit(40))))
    b = paths.bounds(F.col("v.commands"))
    return rows.select(
        "doc_id", "seq", b["x0"].alias("x"), b["y0"].alias("y"), b["x1"].alias("x1"), b["y1"].alias("y1"), page_at(F.col("y")).alias("page_idx"), F.size("v.commands").alias("commands"),
        F.col("v.fill.color.r").alias("fill_red"), F.col("v.fill.color.b").alias("fill_blue"), F.col("v.stroke.color.r").alias("stroke_red"), F.col("v.stroke.width").alias("stroke_width"),
    )


@query("""
WITH size AS (SELECT p_partkey, CAST(p_size * 20 AS DOUBLE) AS w, CAST(p_partkey % 400 AS DOUBLE) AS h, p_partkey % 900 AS py FROM part WHERE p_size > 0)
SELECT p_partkey, least(300.0::DOUBLE, w) AS width, least(300.0::DOUBLE, w) * h / w AS height, CAST(trunc(py / 792.0) AS BIGINT) AS page_idx FROM size
""")
def doc_new_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    s = image_size((F.col("p_size") * 20).cast("double"), (k % 400).cast("double"))
    return adapters.table(spark, sf_dir, "part").filter("p_size > 0").select("p_partkey", s["width"].alias("width"), s["height"].alias("height"), page_at((k % 900).cast("double")).alias("page_idx"))


@query("""
WITH touched AS (SELECT DISTINCT doc_id FROM command_log WHERE op NOT IN ('undo', 'redo'))
SELECT p.page_id, p.doc_id, p.page_idx % 5 = 0 OR t.doc_id IS NOT NULL AS modified, CASE WHEN t.doc_id IS NOT NULL THEN TIMESTAMP '2024-05-06 07:08:09' WHEN p.page_idx % 5 = 0 THEN TIMESTAMP '2020-01-01 00:00:00' END AS modification_date
FROM doc_page p LEFT JOIN touched t ON t.doc_id = p.doc_id
""")
def doc_modified_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of documents with edits are marked as modified, at a given time; others keep their mark and date."""
    touched = adapters.commands(spark, sf_dir).filter("op NOT IN ('undo', 'redo')").select("doc_id").distinct().withColumn("touched", F.lit(True))
    fifth = F.col("page_idx") % 5 == 0
    when = lambda t: F.lit(t).cast("timestamp_ntz")
    pages = adapters.pages(spark, sf_dir).withColumns({"modified": fifth, "modification_date": F.when(fifth, when("2020-01-01 00:00:00"))}).join(touched, "doc_id", "left")
    return edits.mark_modified(pages, F.col("touched").isNotNull(), when("2024-05-06 07:08:09")).select("page_id", "doc_id", "modified", "modification_date")


@query("""
SELECT element_id, CASE WHEN kind = 'text' THEN element_id % 3 END AS alignment, CASE WHEN kind = 'image' THEN least(300.0, w * 4) END AS display_width, CASE WHEN kind = 'vector' THEN 5 END AS commands,
  CASE WHEN kind = 'table' THEN (element_id % 4 + 1) * (element_id % 3 + 1) END AS cells, CASE WHEN kind = 'media' THEN CASE WHEN element_id % 2 = 0 THEN 'Video' ELSE 'Audio' END END AS media_type, CASE WHEN kind = 'group' THEN element_id % 5 END AS children FROM doc_element
""")
def doc_typed_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each element's content is one of six structs; asked for as another kind it is null."""
    k, b = F.col("element_id"), F.col("bounds")
    size = image_size(b["width"] * 4, b["height"] * 4)
    content = {
        "text": F.struct(F.lit(text.DEFAULT_TEXT).alias("text"), (k % 3).alias("alignment")), "image": F.struct(size["width"].alias("display_width"), size["height"].alias("display_height")), "vector": paths.new_rectangle(b),
        "table": F.struct((k % 4 + 1).alias("rows"), (k % 3 + 1).alias("cols")), "media": F.struct(F.when(k % 2 == 0, "Video").otherwise("Audio").alias("type")), "group": F.struct(F.slice(F.sequence(F.lit(0).cast("long"), k % 5), 1, (k % 5).cast("int")).alias("child_element_indices")),
    }
    rows = adapters.elements(spark, sf_dir).withColumn("content", payloads.stored(F.col("kind"), content))
    of = lambda kind: payloads.accessor(F.col("content"), kind)
    return rows.select(
        "element_id", of("text")["alignment"].alias("alignment"), of("image")["display_width"].alias("display_width"), F.when(of("vector").isNotNull(), F.size(of("vector")["commands"])).alias("commands"),
        (of("table")["rows"] * of("table")["cols"]).alias("cells"), of("media")["type"].alias("media_type"), F.when(of("group").isNotNull(), F.size(of("group")["child_element_indices"]).cast("long")).alias("children"),
    )


@query("""
SELECT p_partkey, CAST(trunc((p_partkey % 9) * 7.5::DOUBLE * (0.05::DOUBLE * (p_size % 4))) AS INTEGER) AS width, CAST(trunc((p_size % 11) * 20.0::DOUBLE * (0.05::DOUBLE * (p_size % 4))) AS INTEGER) AS height FROM part
WHERE trunc((p_partkey % 9) * 7.5::DOUBLE * (0.05::DOUBLE * (p_size % 4))) > 0 AND trunc((p_size % 11) * 20.0::DOUBLE * (0.05::DOUBLE * (p_size % 4))) > 0
""")
def doc_rendered_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the sizes of parts, in pixels; those without a pixel aren't rendered."""
    rows = adapters.table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_partkey") % 9) * 7.5).alias("width"), ((F.col("p_size") % 11) * 20.0).alias("height"), (0.05 * (F.col("p_size") % 4)).alias("zoom"))
    return layout.rendered(rows).select("p_partkey", "pixels.width", "pixels.height")
