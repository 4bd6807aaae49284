"""SQL functions against the column functions, and their plans."""

import inspect

import pytest
from pyspark.sql import functions as F

from quirework.functions import geometry, sql, text
from quirework.operators import edits, hit, lines
from quirework.plans.functions import doc_sql_move_page, doc_sql_topmost_hit
from quirework.sources import adapters


@pytest.fixture(scope="module")
def rows(spark, data):
    sql.register(spark)
    return adapters.elements(spark, data).withColumns({"px": (F.col("element_id") * 17 % 600).cast("double"), "py": (F.col("element_id") * 29 % 800 - 900).cast("double"), "z": F.col("ord") * 3.0 - 1})


def test_every_scalar_function_equals_its_column_function(rows):
    b, m, x, y, k = F.col("bounds"), F.col("transform"), F.col("px"), F.col("py"), F.col("element_id")
    other = geometry.rect(y, x, F.lit(90), F.lit(70))
    n = F.lit(9).cast("long")
    pairs = {
        "qw_rect(px, py, 3, 4)": geometry.rect(x, y, F.lit(3), F.lit(4)), "qw_contains(bounds, px, py)": geometry.contains(b, x, y), "qw_intersects(bounds, qw_rect(py, px, 90, 70))": geometry.intersects(b, other),
        "qw_map_point(transform, px, py)": geometry.map_point(m, x, y), "qw_map_rect(transform, bounds)": geometry.map_rect(m, b), "qw_determinant(transform)": geometry.determinant(m),
        "qw_unmap_point(transform, px, py)": geometry.unmap_point(m, x, y), "qw_hit(bounds, transform, px, py)": hit.hits(x, y, b, m), "qw_page_at(py * 3)": geometry.page_at(y * 3),
        "qw_page_top(ord, bounds.height, 20, z)": geometry.page_top(F.col("ord"), b["height"], F.lit(20), F.col("z")), "qw_clamp_zoom(z)": geometry.clamp_zoom(F.col("z")),
        "qw_insert_place(nullif(ord, 3) - 1, 9)": edits.insert_place(F.nullif(F.col("ord"), F.lit(3)) - 1, n), "qw_moved_place(ord, element_id % 10, element_id % 7, 9)": edits.moved_place(F.col("ord"), k % 10, k % 7, n),
        "qw_shown(repeat('é', int(element_id % 2000)))": text.shown(F.repeat(F.lit("é"), (k % 2000).cast("int"))),
    }
    assert {p.split("(")[0] for p in pairs} == set(sql.SCALAR)
    for call, column in pairs.items():
        assert rows.select(F.expr(call).alias("a"), column.alias("b")).filter("NOT a <=> b").count() == 0, call


def test_scalar_functions_are_inlined(spark, data):
    for query in (doc_sql_topmost_hit, doc_sql_move_page):
        plan = query(spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "qw_" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_text_lines_of_a_table(spark):
    sql.register(spark)
    texts = [(1, "a b " * 300 + "\n\nlast", "kept"), (2, None, "kept"), (3, "x" * 200, "kept"), (4, "one\r\ntwo\n", "kept")]
    df = spark.createDataFrame(texts, "id long, text string, line string")
    got = spark.sql("SELECT * FROM qw_text_lines(TABLE({df}), 200, 10)", df=df)
    assert got.columns == ["id", *[c.split()[0] for c in lines.LINES.split(", ")]]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, lines.laid_out(df, width=200.0, size=10.0).collect()))
    with pytest.raises(Exception, match="column text"):
        spark.sql("SELECT * FROM qw_text_lines(TABLE({df}), 200, 10)", df=df.drop("text"))
    assert "analyze" in dict(inspect.getmembers(sql.TextLines))
