"""Vectors worked out by hand, one row each."""

import random

import pytest
from pyspark.sql import functions as F

from quirework.functions import colour, geometry, paths, text
from quirework.operators import hit, layout
from quirework.sources import schema


def one(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


def rect(*v):
    return geometry.rect(*[F.lit(float(x)) for x in v])


def matrix(*v):
    return F.struct(*[F.lit(float(x)).alias(k) for k, x in zip("abcdef", v, strict=True)])


@pytest.mark.parametrize("m, r, want", [
    ((0, 1, -1, 0, 0, 0), (10, 20, 30, 40), (-60, 10, 40, 30)),
    ((2, 0, 0, 3, 5, 7), (1, 1, 2, 2), (7, 10, 4, 6)),
    ((1, 0, 0, 1, 0, 0), (5, 5, -2, 4), (3, 5, 2, 4)),
])
def test_map_rect(spark, m, r, want):
    assert tuple(one(spark, geometry.map_rect(matrix(*m), rect(*r)))) == want


def test_edges_belong_to_rectangles(spark):
    assert one(spark, geometry.intersects(rect(0, 0, 10, 10), rect(10, 0, 5, 5)))
    assert one(spark, geometry.contains(rect(0, 0, 10, 10), F.lit(10.0), F.lit(10.0)))


@pytest.mark.parametrize("x, y, local, anchored", [(50, 10, True, False), (250, 110, False, True)])
def test_hit_ignores_the_place_of_bounds(spark, x, y, local, anchored):
    at = F.lit(float(x)), F.lit(float(y)), rect(100, 100, 200, 30), matrix(1, 0, 0, 1, 0, 0)
    assert one(spark, hit.hits(*at)) is local
    assert one(spark, hit.hits(*at, anchor="bounds")) is anchored


def test_nothing_is_hit_through_a_singular_matrix_or_outside_a_clip(spark):
    box = rect(0, 0, 10, 10)
    assert one(spark, hit.hits(F.lit(1.0), F.lit(1.0), box, matrix(0, 0, 0, 0, 0, 0))) is False
    clip = paths.rectangle(rect(0, 0, 5, 5))
    same = matrix(1, 0, 0, 1, 0, 0)
    assert one(spark, hit.hits(F.lit(1.0), F.lit(1.0), box, same, clip)) is True
    assert one(spark, hit.hits(F.lit(7.0), F.lit(7.0), box, same, clip)) is False


def test_clip_of_two_subpaths_is_odd_even(spark):
    both = F.concat(paths.rectangle(rect(0, 0, 10, 10)), paths.rectangle(rect(2, 2, 4, 4)))
    assert one(spark, paths.inside(both, F.lit(1.0), F.lit(1.0))) is True
    assert one(spark, paths.inside(both, F.lit(3.0), F.lit(3.0))) is False


def test_first_line_is_a_move(spark):
    path = F.array(paths.command("LineTo", F.lit(1), F.lit(2)), paths.command("LineTo", F.lit(3), F.lit(4)))
    assert [c["type"] for c in one(spark, paths.replay(path))] == ["MoveTo", "LineTo"]


@pytest.mark.parametrize("y, page", [(1590, 2), (-1, 0), (-791.9, 0), (-792, None), (0, 0), (792, 1)])
def test_page_at(spark, y, page):
    assert one(spark, geometry.page_at(F.lit(float(y)))) == page


def test_page_top_uses_spacing(spark):
    assert one(spark, geometry.page_top(F.lit(2), F.lit(792.0), F.lit(20), F.lit(1.0))) == 1624


def test_zoom(spark):
    assert one(spark, geometry.clamp_zoom(F.lit(0.01))) == 0.1
    assert one(spark, geometry.clamp_zoom(F.lit(50.0))) == 10
    assert one(spark, layout.needs_render(F.lit(True), F.lit(1.0), F.lit(1.0005))) is False
    assert one(spark, layout.needs_render(F.lit(True), F.lit(1.0), F.lit(1.01))) is True


def test_screen_coordinates_truncate(spark):
    v = {"zoom": F.lit(1.0), "scroll_x": F.lit(0.0), "scroll_y": F.lit(0.0)}
    assert tuple(one(spark, geometry.doc_to_screen(v, F.lit(2.7), F.lit(-2.7)))) == (2, -2)


def test_text_cap(spark):
    assert one(spark, F.length(text.shown(F.lit("x" * 1001)))) == 1003
    assert one(spark, F.length(text.shown(F.lit("x" * 1000)))) == 1000


def test_colour_round_trip(spark):
    for v in (0, 1, 127, 255):
        c = colour.from_bytes(*[F.lit(v)] * 4)
        assert tuple(one(spark, colour.to_bytes(c))) == (v,) * 4


def test_column_offsets(spark):
    rows = spark.createDataFrame([(1, i, 100.0) for i in range(3)] + [(2, 0, 5.0)], "t long, i long, w double")
    assert sorted((r["t"], r["col"], r["x"]) for r in layout.column_offsets(rows, "t", ["i"], "w").collect()) == [(1, 0, 100), (1, 1, 200), (1, 2, 300), (2, 0, 100)]


def test_numbers_over_parts(spark):
    rows = spark.createDataFrame([(i * 7919 % 5003 - 2000,) for i in range(5003)], "k long")
    got = sorted((r["number"], r["k"]) for r in layout.numbered(rows, "k", 10, parts=7).collect())
    assert got == [(11 + i, i - 2000) for i in range(5003)]
    assert layout.numbered(rows.limit(0), "k").count() == 0 and layout.numbered(spark.createDataFrame([(5,)] * 9, "k long"), "k", parts=3).agg(F.max("number"), F.min("number")).first() == (9, 1)


def test_grids_lose_nothing(spark, monkeypatch):
    rng = random.Random(3)
    matrices = [tuple(map(float, m)) for m in [(1, 0, 0, 1, 0, 0), (0, 1, -1, 0, 50, 50), (2, 0.5, -0.25, 1, 10, -700), (0, 0, 0, 0, 0, 0)]]
    boxes = [tuple(float(rng.choice([rng.randint(-900, 900), rng.randint(-3, 3) * 256])) for _ in range(2)) + (float(rng.choice([0, 1, 256, 40, 9000, 1e9])), float(rng.randint(0, 600))) for _ in range(60)]
    rows = [(i % 2, i, i, i % 9 != 0, b, rng.choice(matrices), [("MoveTo", 0.0, 0.0, *[0.0] * 4), ("LineTo", 30.0, 0.0, *[0.0] * 4), ("LineTo", 0.0, 500.0, *[0.0] * 4)] if i % 7 == 0 else None) for i, b in enumerate(boxes)] + [(0, 99, 99, True, None, matrices[0], None), (0, 98, 98, True, (None, 1.0, 1.0, 1.0), matrices[0], None)]
    elements = spark.createDataFrame(rows, f"page_id long, element_id long, ord long, visible boolean, bounds {schema.RECT}, transform {schema.MATRIX}, clip_path {schema.COMMANDS}")
    touch = lambda p, q: p[0] <= q[0] + q[2] and q[0] <= p[0] + p[2] and p[1] <= q[1] + q[3] and q[1] <= p[1] + p[3]
    want = sorted((a % 2, a, b) for a in range(60) for b in range(a + 1, 60) if a % 2 == b % 2 and touch(boxes[a], boxes[b]))
    assert sorted(tuple(r) for r in hit.overlaps(elements).collect()) == want
    probes = spark.createDataFrame([(i, i % 3, float(rng.randint(-4, 4) * 256 // rng.choice([1, 2])), float(rng.randint(-600, 900))) for i in range(200)], "probe_id long, page_id long, x double, y double")
    for anchor in ("local", "bounds"):
        near = hit.hits(F.col("x"), F.col("y"), F.col("bounds"), F.col("transform"), paths.stored(F.col("clip_path")), anchor)
        plain = probes.join(elements.filter("visible"), "page_id").filter(near).groupBy("probe_id").agg(F.max_by("element_id", "ord").alias("e"))
        want = {r["probe_id"]: r["e"] for r in plain.collect()}
        got = {r["probe_id"]: r["element_id"] for r in hit.topmost(probes, elements, anchor).collect()}
        assert len(got) == 200 and {k: v for k, v in got.items() if v is not None} == want and len(want) > 20
