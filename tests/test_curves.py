"""Curves against dense polylines, and the spatial index's reads."""

import glob
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quirework.functions import paths
from quirework.operators import hit, spatial
from quirework.plans.geometry import _probes
from quirework.sources import adapters

COMMAND = "array<struct<type:string,x:double,y:double,cx1:double,cy1:double,cx2:double,cy2:double>>"


def polyline(path, n=400):
    """Closed runs of points, each command after the other."""
    runs, run, start, now, first = [], [], (0.0, 0.0), (0.0, 0.0), True
    for kind, x, y, cx1, cy1, cx2, cy2 in path:
        if kind == "LineTo" and first:
            kind = "MoveTo"
        first = first and kind not in ("MoveTo", "LineTo")
        if kind == "MoveTo":
            runs.append(run)
            run, start, now = [(x, y)], (x, y), (x, y)
        elif kind == "ClosePath":
            runs.append(run or [start])
            run, now = [start], start
        else:
            run = run or [now]
            for i in range(1, n + 1) if kind != "LineTo" else [n]:
                t = i / n
                u = 1 - t
                if kind == "LineTo":
                    run.append((x, y))
                elif kind == "QuadTo":
                    run.append(tuple(u * u * p + 2 * u * t * c + t * t * q for p, c, q in zip(now, (cx1, cy1), (x, y), strict=True)))
                else:
                    run.append(tuple(u**3 * p + 3 * u * u * t * c + 3 * u * t * t * d + t**3 * q for p, c, d, q in zip(now, (cx1, cy1), (cx2, cy2), (x, y), strict=True)))
            now = (x, y)
    return [r for r in [*runs, run] if r]


def crossings(runs, x, y):
    out = []
    for run in runs:
        for (x0, y0), (x1, y1) in zip(run, [*run[1:], run[0]], strict=True):
            if (y0 <= y) != (y1 <= y) and x < x0 + (y - y0) * (x1 - x0) / (y1 - y0):
                out.append(1 if y1 > y0 else -1)
    return out


def made(rng):
    out = []
    for _ in range(rng.randrange(1, 9)):
        kind = rng.choice(["MoveTo", "LineTo", "QuadTo", "CubicTo", "CubicTo", "ClosePath"])
        n = {"MoveTo": 2, "LineTo": 2, "QuadTo": 4, "CubicTo": 6, "ClosePath": 0}[kind]
        out.append((kind, *[rng.uniform(0, 100) for _ in range(n)], *[None] * (6 - n)))
    return out


def test_curves_equal_dense_polylines(spark):
    rng = random.Random(8)
    rows = [(i, made(rng), rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(250)]
    df = spark.createDataFrame(rows, f"id long, path {COMMAND}, px double, py double").withColumn("path", paths.replay(F.col("path")))
    x, y = F.col("px"), F.col("py")
    got = df.select("id", paths.curve_bounds(F.col("path")).alias("b"), paths.winding(F.col("path"), x, y).alias("w"), paths.filled(F.col("path"), x, y, F.lit("EvenOdd")).alias("odd"), paths.inside(F.col("path"), x, y, True).alias("inside"))
    wrong = 0
    for r in got.collect():
        _, path, px, py = rows[r["id"]]
        runs = polyline(path)
        points = [p for run in runs if len(run) > 1 or path[-1][0] == "MoveTo" for p in run]
        if any(c[0] in ("LineTo", "QuadTo", "CubicTo") for c in path[1:]) and all(len(run) > 1 for run in runs):
            want = [f(p[k] for p in points) for f in (min, max) for k in (0, 1)]
            assert list(r["b"]) == pytest.approx(want, abs=0.05), path
            assert all(b <= w + 1e-9 for b, w in zip(r["b"][:2], want[:2], strict=True)) and all(b >= w - 1e-9 for b, w in zip(r["b"][2:], want[2:], strict=True))
        met = crossings(runs, px, py)
        wrong += (r["w"], r["odd"], r["inside"]) != (sum(met), len(met) % 2 == 1, len(met) % 2 == 1)
    assert wrong <= 1  # a point may fall between a curve and its polyline


def test_the_first_line_is_a_move_until_there_was_one(spark):
    line, close = lambda x: ("LineTo", float(x), 0.0, *[None] * 4), ("ClosePath", *[None] * 6)
    curve = ("QuadTo", 5.0, 5.0, 1.0, 1.0, None, None)
    for path, want in (
        ([close, line(1), line(2)], ["ClosePath", "MoveTo", "LineTo"]), ([curve, line(1), line(2)], ["QuadTo", "MoveTo", "LineTo"]), ([line(1), close, line(2)], ["MoveTo", "ClosePath", "LineTo"]),
        ([("MoveTo", 0.0, 0.0, *[None] * 4), line(1)], ["MoveTo", "LineTo"]), ([], []),
    ):
        (r,) = spark.createDataFrame([(path,)], f"path {COMMAND}").select(paths.replay(F.col("path")).alias("p"), paths.curve_bounds(F.col("path")).alias("b")).collect()
        assert [c["type"] for c in r["p"]] == want and (path or tuple(r["b"]) == (None,) * 4)


def test_nonzero_and_even_odd_differ_where_an_outline_goes_round_twice(spark):
    square = [("MoveTo", 0.0, 0.0), ("LineTo", 9.0, 0.0), ("LineTo", 9.0, 9.0), ("LineTo", 0.0, 9.0), ("ClosePath", None, None)]
    path = [(*c, *[None] * 4) for c in square * 2]
    p, at = F.col("path"), (F.lit(4.0), F.lit(4.0))
    (r,) = spark.createDataFrame([(path,)], f"path {COMMAND}").select(paths.winding(p, *at).alias("w"), paths.filled(p, *at, F.lit("NonZero")).alias("n"), paths.filled(p, *at, F.lit("EvenOdd")).alias("e"), F.size(paths.segments(p)).alias("s")).collect()
    assert tuple(r) == (2, True, False, 8)


def test_probes_of_a_page_read_few_row_groups(spark, tmp_path):
    data = "/root/testdata/sf0.01"
    elements, path = adapters.elements(spark, data), str(tmp_path / "index")
    spatial.GROUP_BYTES, kept = 4 << 10, spatial.GROUP_BYTES
    try:
        spatial.write(elements, path)
    finally:
        spatial.GROUP_BYTES = kept
    probes = _probes(spark, data)
    same = lambda df: sorted(map(repr, df.collect()))
    for anchor, at in (("local", path), ("bounds", str(tmp_path / "other"))):
        if anchor == "bounds":
            spatial.write(elements, at, anchor)
        assert same(spatial.topmost(spark, at, probes, anchor)) == same(hit.topmost(probes, elements, anchor))
    page = probes.filter("page_id = 700")
    wanted = spatial.ranges(spatial.asked(page))
    groups = [g for name in glob.glob(f"{path}/*.parquet") for g in (lambda m: [m.row_group(i) for i in range(m.num_row_groups)])(pq.read_metadata(name))]
    column = [c for c in range(groups[0].num_columns) if groups[0].column(c).path_in_schema == "place"][0]
    read = [g for g in groups if any(g.column(column).statistics.min <= high and g.column(column).statistics.max >= low for low, high in wanted)]
    assert len(groups) > 40 and len(read) * 10 < len(groups)
    plan = spatial.scan(spark, path, wanted)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(place" in plan
    assert same(spatial.topmost(spark, path, page)) == same(hit.topmost(page, elements))
    assert spatial.topmost(spark, path, probes.filter("false")).count() == 0


def test_places_are_those_of_interleaved_bits(spark):
    rows = [(p, x, y) for p in (0, 3) for x in (-700, -512, 0, 5, 511, 900) for y in (-512, 1, 511)]
    got = spark.createDataFrame(rows, "p long, x long, y long").select("p", "x", "y", spatial.place(F.col("p"), F.col("x"), F.col("y")).alias("z")).collect()
    for r in got:
        x, y = (min(max(v, -512), 511) + 512 for v in (r["x"], r["y"]))
        assert r["z"] == (r["p"] << 21) + sum(((x >> b) & 1) << (2 * b) | ((y >> b) & 1) << (2 * b + 1) for b in range(10))
