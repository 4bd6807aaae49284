"""Every document query against its SQL."""

import pytest
from compare import duck_rows, spark_rows

from quirework.plans import curves, document, functions, geometry, lines, render, scene, tools  # noqa: F401
from quirework.plans.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, data, name):
    assert spark_rows(QUERIES[name](spark, data)) == duck_rows(SQL[name], data)


def test_entry(spark, data):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_hits_join_on_the_page(spark, data):
    plan = QUERIES["doc_topmost_hit"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
