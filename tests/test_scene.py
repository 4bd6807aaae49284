"""Elements in groups and cells."""

import random

import pytest
from pyspark.sql import functions as F

from quirework.operators import scene
from quirework.sources import adapters

ELEMENT = "element_id long, parent_id long, transform struct<a:double,b:double,c:double,d:double,e:double,f:double>, opacity double, visible boolean, cell struct<x:double,y:double>"
ONE = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def product(p, m):
    a, b, c, d, e, f = p
    return (a * m[0] + c * m[1], b * m[0] + d * m[1], a * m[2] + c * m[3], b * m[2] + d * m[3], a * m[4] + c * m[5] + e, b * m[4] + d * m[5] + f)


def test_random_forest_equals_a_walk_up(spark):
    rng = random.Random(1)
    rows = {}
    for i in range(300):
        parent = rng.choice([None, *range(max(0, i - 4), i)]) if i else None
        rows[i] = (i, parent, tuple(rng.choice([0.0, 0.5, -1.0, 1.0, 2.0]) for _ in range(6)), rng.choice([1.0, 0.5]), rng.random() < 0.9, rng.choice([None, (3.0, 4.0)]))
    got = {r["element_id"]: r for r in scene.placed(spark.createDataFrame(list(rows.values()), ELEMENT)).collect()}
    assert len(got) == 300 and max(r["depth"] for r in got.values()) > 5
    for i in rows:
        chain = [i]
        while rows[chain[-1]][1] is not None:
            chain.append(rows[chain[-1]][1])
        matrix, opacity = ONE, 1.0
        for j in reversed(chain):
            m, cell = rows[j][2], rows[j][5] or (0.0, 0.0)
            matrix, opacity = product(matrix, (*m[:4], m[4] + cell[0], m[5] + cell[1])), opacity * rows[j][3]
        r = got[i]
        assert (r["root_id"], r["depth"], tuple(r["transform"]), r["opacity"], r["visible"]) == (chain[-1], len(chain) - 1, matrix, opacity, all(rows[j][4] for j in chain))


def test_lost_parents_and_loops(spark):
    lost = [(1, 9, ONE, 1.0, True, None), (2, 1, ONE, 1.0, True, None), (3, None, ONE, None, True, None)]
    got = {r["element_id"]: (r["root_id"], r["depth"], r["attached"], r["visible"], r["opacity"]) for r in scene.placed(spark.createDataFrame(lost, ELEMENT)).collect()}
    assert got == {1: (1, 0, False, False, 1.0), 2: (1, 1, False, False, 1.0), 3: (3, 0, True, True, None)}
    loop = [(1, None, ONE, 1.0, True, None), (2, 3, ONE, 1.0, True, None), (3, 2, ONE, 1.0, True, None), (4, 4, ONE, 1.0, True, None)]
    with pytest.raises(Exception, match="hold one another"):
        scene.placed(spark.createDataFrame(loop, ELEMENT)).collect()
    assert scene.placed(spark.createDataFrame([], ELEMENT)).count() == 0


def test_too_deep_raises(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None, ONE, 1.0, True, None) for i in range(9)], ELEMENT)
    assert scene.placed(chain, levels=20).filter("depth = 8").count() == 1
    with pytest.raises(Exception, match="RECURSION_LEVEL_LIMIT_EXCEEDED"):
        scene.placed(chain, levels=4).collect()


def test_nested_elements_are_deep(spark, data):
    assert scene.placed(adapters.nested_elements(spark, data)).agg({"depth": "max"}).first()[0] > 5


def test_levels_read_the_elements_where_they_are(spark, data):
    """Each level computed the elements' windows anew and shuffled all elements."""
    left, right = (scene._by_parent(adapters.nested_elements(spark, data).select("element_id", "parent_id")) for _ in range(2))
    with_parents = left.withColumnRenamed("parent_id", "held_by").hint("merge").join(right.select("parent_id"), F.col("element_id") == F.col("parent_id"))
    found = with_parents._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in found and found.count("Exchange hashpartitioning") == 1
    whole = scene.placed(adapters.nested_elements(spark, data))._jdf.queryExecution()
    assert "Window" not in whole.optimizedPlan().toString()
