"""Plans that must not depend on Spark's guess of a table's size, which misses rows that expressions make."""

import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quirework.functions import paths
from quirework.plans import curves, functions, geometry
from quirework.sources import datasource


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hit_tests_broadcast_neither_probes_nor_elements(spark, data):
    for query in (geometry.doc_topmost_hit, geometry.doc_topmost_hit_anchored, geometry.doc_topmost_hit_clipped, geometry.doc_indexed_hit, functions.doc_sql_topmost_hit):
        found = plan(query(spark, data))
        assert "Broadcast" not in found and found.count("SortMergeJoin") == 2, query.__name__


def test_boxes_of_curves_are_found_for_whole_batches(spark, data):
    """Higher-order functions evaluated them row by row, at some 0.5 ms each."""
    assert "ArrowEvalPython" in plan(curves.doc_curve_bounds(spark, data))


def test_boxes_with_missing_places(spark):
    """Missing coordinates are passed over, NaN is the greatest; unknown and missing commands draw nothing."""
    nan, none = float("nan"), None
    move, line = lambda x, y: ("MoveTo", x, y, none, none, none, none), lambda x, y: ("LineTo", x, y, none, none, none, none)
    paths_ = [
        ([move(1.0, none), line(3.0, 5.0)], (1.0, 5.0, 3.0, 5.0)), ([move(1.0, 2.0), line(nan, 4.0)], (1.0, 2.0, nan, 4.0)),
        ([none, ("Other", 9.0, 9.0, none, none, none, none)], (none,) * 4), ([], (none,) * 4), (none, (none,) * 4),
        ([move(0.0, 0.0), ("QuadTo", 4.0, 0.0, 2.0, none, none, none)], (0.0, 0.0, 4.0, 0.0)), ([move(0.0, 0.0), ("QuadTo", 4.0, 0.0, 2.0, 4.0, none, none)], (0.0, 0.0, 4.0, 2.0)),
        ([line(2.0, 3.0), ("ClosePath", none, none, none, none, none, none)], (0.0, 0.0, 2.0, 3.0)),
    ]
    kind = "array<struct<type:string,x:double,y:double,cx1:double,cy1:double,cx2:double,cy2:double>>"
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(paths_)], f"id int, path {kind}").coalesce(1)
    found = {r["id"]: tuple(r["b"]) for r in df.select("id", paths.curve_bounds(F.col("path")).alias("b")).collect()}
    assert [str(found[i]) for i in range(len(paths_))] == [str(want) for _, want in paths_]


def test_reading_a_saved_file_holds_a_few_row_groups(tmp_path):
    rows = 60 * datasource.GROUP
    table = pa.table({"page_id": np.arange(rows), **{c: np.random.default_rng(1).random(rows) for c in "abc"}})
    pq.write_table(table, tmp_path / "one.parquet", row_group_size=datasource.GROUP)
    schema = StructType.fromJson({"type": "struct", "fields": [{"name": c, "type": "long" if c == "page_id" else "double", "nullable": True, "metadata": {}} for c in ("page_id", *"abc")]})
    size, before, most, seen = table.nbytes, None, 0, 0
    del table
    before = pa.total_allocated_bytes()
    for batch in datasource._Reader(str(tmp_path), "page_id", [], schema).read(datasource.Files("one.parquet")):
        time.sleep(0.01)
        most, seen = max(most, pa.total_allocated_bytes() - before), seen + batch.num_rows
    assert seen == rows and most < size / 4
