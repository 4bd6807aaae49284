"""Vector paths: arrays of commands (type, x, y, and with curves their control points cx1, cy1, cx2, cy2), taken apart inside each row.

A path is cut into runs at its moves; within a run, each command's edge starts
where the command before it ends, so edges need no fold and cost what the path
is long. After ClosePath the run goes on from its start. Commands before the
first move start at the origin.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import right, top

# Fill and line of a new rectangle.
FILL, LINE, LINE_WIDTH = (0.8, 0.8, 0.9, 1), (0.2, 0.2, 0.6, 1), 1.0

#: Curves whose cubic part is below this turn where their quadratic part does; halvings of a crossing's place.
FLAT, HALVINGS = 1e-12, 48
_KINDS = ("MoveTo", "LineTo", "ClosePath", "QuadTo", "CubicTo")


def command(kind: str, x: Column, y: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), x.cast("double").alias("x"), y.cast("double").alias("y"))


def stored(path: Column) -> Column:
    """A path as the tables of documents have it, with its curves."""
    return F.transform(path, lambda c: F.struct(c["type"].alias("type"), c["x1"].alias("x"), c["y1"].alias("y"), *[c[k].alias(k) for k in ("cx1", "cy1", "cx2", "cy2")]))


def curve(kind: str, x: Column, y: Column, cx1: Column, cy1: Column, cx2: Column | None = None, cy2: Column | None = None) -> Column:
    """A command with control points: MoveTo, LineTo and ClosePath have none, QuadTo the first, CubicTo both."""
    none = F.lit(None).cast("double")
    points = [none if c is None else c.cast("double") for c in (cx1, cy1, cx2, cy2)]
    return F.struct(F.lit(kind).alias("type"), x.cast("double").alias("x"), y.cast("double").alias("y"), *[c.alias(k) for c, k in zip(points, ("cx1", "cy1", "cx2", "cy2"), strict=True)])


def rectangle(r: Column) -> Column:
    """A rectangle's outline in absolute coordinates."""
    zero = F.lit(0.0)
    return F.array(command("MoveTo", r["x"], r["y"]), command("LineTo", right(r), r["y"]), command("LineTo", right(r), top(r)), command("LineTo", r["x"], top(r)), command("ClosePath", zero, zero))


def new_rectangle(r: Column) -> Column:
    """A new rectangle element's content: its outline, a light blue fill and a dark blue line of width 1."""
    colour = lambda v: F.struct(*[F.lit(float(x)).alias(k) for k, x in zip("rgba", v, strict=True)])
    fill, stroke = F.struct(colour(FILL).alias("color")), F.struct(colour(LINE).alias("color"), F.lit(LINE_WIDTH).alias("width"))
    return F.struct(rectangle(r).alias("commands"), F.lit("NonZero").alias("fill_rule"), fill.alias("fill"), stroke.alias("stroke"))


def replay(path: Column) -> Column:
    """The path as drawn: a line is a move if neither a line nor a move came before it."""
    first = F.array_position(F.transform(path, lambda c: c["type"].isin("MoveTo", "LineTo")), True)
    return F.transform(path, lambda c, i: F.when((i + 1 == first) & (c["type"] == "LineTo"), c.withField("type", F.lit("MoveTo"))).otherwise(c))


def points(path: Column) -> Column:
    return F.filter(path, lambda c: c["type"].isin("MoveTo", "LineTo"))


def bounds(path: Column) -> Column:
    """(x0, y0, x1, y1) of all points; nulls for a path without any."""
    p = points(path)
    xs, ys = F.transform(p, lambda c: c["x"]), F.transform(p, lambda c: c["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def named(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _runs(path: Column) -> Column:
    """The path cut before each move."""
    starts = F.filter(F.transform(path, lambda c, i: F.when((i == 0) | (c["type"] == "MoveTo"), i + 1)), lambda i: i.isNotNull())
    return named(starts, lambda s: F.transform(s, lambda a, k: F.slice(path, a, F.coalesce(F.get(s, k + 1), F.size(path) + 1) - a)))


def edges(path: Column, curves: bool = True) -> Column:
    """Edges of the filled outline as cubic pieces (kind, x0, y0 .. x3, y3), a line's control points being its ends; every run is closed to its start. kind: LineTo, QuadTo or CubicTo.

    curves: whether commands have control points; without, curves are passed over.
    """
    kinds = ("MoveTo", "LineTo", "ClosePath", *(("QuadTo", "CubicTo") if curves else ()))
    known = F.filter(path, lambda c: c["type"].isin(*kinds))

    ended = lambda c, origin: F.when(c["type"] == "ClosePath", origin).otherwise(F.struct(c["x"].alias("x"), c["y"].alias("y")))

    def of_run(run: Column) -> Column:
        first = F.get(run, F.lit(0))
        moved = first["type"] == "MoveTo"
        return named(F.struct(*[F.when(moved, first[k]).otherwise(F.lit(0.0)).alias(k) for k in "xy"]), lambda origin: from_origin(run, origin))

    def from_origin(run: Column, origin: Column) -> Column:
        ends = F.concat(F.array(origin), F.transform(run, lambda c: ended(c, origin)))
        return named(ends, lambda at: F.filter(F.concat(F.transform(run, lambda c, i: _edge(c, F.get(at, i), F.get(at, i + 1), curves)), closing(run, at, origin)), lambda e: e["kind"] != "MoveTo"))

    def closing(run: Column, at: Column, origin: Column) -> Column:
        last = F.filter(F.slice(run, -1, 1), lambda c: c["type"] != "ClosePath")
        return F.transform(last, lambda c: _edge(c.withField("type", F.lit("LineTo")), F.get(at, F.size(at) - 1), origin, False))

    return F.flatten(named(known, lambda p: F.transform(_runs(p), of_run)))


def _edge(c: Column, p: Column, q: Column, curves: bool) -> Column:
    """The edge of a command from p to q. A quadratic one is raised to a cubic."""
    kind = F.when(c["type"] == "ClosePath", F.lit("LineTo")).otherwise(c["type"])
    out = [kind.alias("kind")]
    control = {}
    for k in "xy":
        one, two = p[k], q[k]
        if curves:
            quad = c["type"] == "QuadTo"
            one = F.when(quad, (p[k] + 2 * c[f"c{k}1"]) / 3).when(c["type"] == "CubicTo", c[f"c{k}1"]).otherwise(one)
            two = F.when(quad, (q[k] + 2 * c[f"c{k}1"]) / 3).when(c["type"] == "CubicTo", c[f"c{k}2"]).otherwise(two)
        control |= {f"{k}0": p[k], f"{k}1": one, f"{k}2": two, f"{k}3": q[k]}
    return F.struct(*out, *[control[f"{k}{i}"].alias(f"{k}{i}") for i in range(4) for k in "xy"])


def at(e: Column, k: str, t: Column) -> Column:
    """A coordinate of a cubic piece."""
    u = 1 - t
    return u * u * u * e[f"{k}0"] + 3 * u * u * t * e[f"{k}1"] + 3 * u * t * t * e[f"{k}2"] + t * t * t * e[f"{k}3"]


def turns(e: Column, k: str) -> Column:
    """Where within (0, 1) a coordinate of a piece turns: the roots of its derivative, ascending."""
    a, b, c = e[f"{k}3"] - 3 * e[f"{k}2"] + 3 * e[f"{k}1"] - e[f"{k}0"], 2 * (e[f"{k}0"] - 2 * e[f"{k}1"] + e[f"{k}2"]), e[f"{k}1"] - e[f"{k}0"]

    def roots(s: Column) -> Column:
        flat, root = F.abs(s["a"]) < FLAT, F.sqrt(F.greatest(s["d"], F.lit(0.0)))
        first = F.when(flat, F.try_divide(-s["c"], s["b"])).when(s["d"] >= 0, F.try_divide(-s["b"] - root, 2 * s["a"]))
        second = F.when(~flat & (s["d"] >= 0), F.try_divide(-s["b"] + root, 2 * s["a"]))
        return F.array_sort(F.filter(F.array(first, second), lambda t: t.isNotNull() & (t > 0) & (t < 1)))

    found = named(F.struct(a.alias("a"), b.alias("b"), c.alias("c"), (b * b - 4 * a * c).alias("d")), roots)
    return F.when(e["kind"] == "LineTo", F.array().cast("array<double>")).otherwise(found)


def _drawn(path: pa.Array) -> tuple:
    """edges() of all paths of a batch as arrays: row and whether curved of each edge, for x and y whether its start, end and control points are there, and its four places in x and in y."""
    row = np.repeat(np.arange(len(path)), pc.fill_null(pc.list_value_length(path), 0).to_numpy(zero_copy_only=False))
    commands = path.flatten()
    kind = pc.index_in(pc.struct_field(commands, "type"), value_set=pa.array(_KINDS))
    known = pc.is_valid(kind)
    commands, row = commands.filter(known), row[known.to_numpy(zero_copy_only=False)]
    kind = kind.filter(known).to_numpy(zero_copy_only=False).astype(np.int8)
    move, close, quad, cubic = (kind == _KINDS.index(k) for k in ("MoveTo", "ClosePath", "QuadTo", "CubicTo"))
    n = len(row)
    first = np.r_[True, row[1:] != row[:-1]][:n] | move
    at_first = np.flatnonzero(first)
    run = np.cumsum(first) - 1
    last = np.r_[first[1:], True][:n]
    closing = np.flatnonzero(last & ~close)
    edge = np.flatnonzero(~move)
    there, places = [], []
    for k in "xy":
        columns = [pc.struct_field(commands, c) for c in (k, f"c{k}1", f"c{k}2")]
        own, one, two = (pc.fill_null(c, np.nan).to_numpy(zero_copy_only=False) for c in columns)
        has, has_one, has_two = (c.is_valid().to_numpy(zero_copy_only=False) for c in columns)
        origin, has_origin = np.where(move[at_first], own[at_first], 0.0)[run], np.where(move[at_first], has[at_first], True)[run]
        q, has_q = np.where(close, origin, own), np.where(close, has_origin, has)
        p, has_p = np.where(first, origin, np.r_[0.0, q[:-1]][:n]), np.where(first, has_origin, np.r_[True, has_q[:-1]][:n])
        c1 = np.where(quad, (p + 2 * one) / 3, np.where(cubic, one, p))
        c2 = np.where(quad, (q + 2 * one) / 3, np.where(cubic, two, q))
        bent = np.where(quad, has_one, np.where(cubic, has_one & has_two, True))
        cut = lambda a, b: np.concatenate([a[edge], b[closing]])
        places.append([cut(p, q), cut(c1, q), cut(c2, origin), cut(q, origin)])
        there.append((cut(has_p, has_q), cut(has_q, has_origin), cut(bent, np.ones(n, bool))))
    return np.concatenate([row[edge], row[closing]]), np.concatenate([(quad | cubic)[edge], np.zeros(len(closing), bool)]), there, *places


def _boxes(path: pa.Array) -> pa.Array:
    """(x0, y0, x1, y1) of each path of a batch."""
    n, found = len(path), {}
    row, curved, there, *places = _drawn(path)
    with np.errstate(all="ignore"):
        for k, (p0, p1, p2, p3), (has_p, has_q, bent) in zip("xy", places, there, strict=True):
            rows, values = [row[has_p], row[has_q]], [p0[has_p], p3[has_q]]
            some = curved & has_p & has_q & bent
            p0, p1, p2, p3 = p0[some], p1[some], p2[some], p3[some]
            a, b, c = p3 - 3 * p2 + 3 * p1 - p0, 2 * (p0 - 2 * p1 + p2), p1 - p0
            d, flat = b * b - 4 * a * c, np.abs(a) < FLAT
            root = np.sqrt(np.maximum(d, 0.0))
            for t in (np.where(flat, -c / b, np.where(d >= 0, (-b - root) / (2 * a), np.nan)), np.where(~flat & (d >= 0), (-b + root) / (2 * a), np.nan)):
                inner = (t > 0) & (t < 1)
                t, u = t[inner], 1 - t[inner]
                rows.append(row[some][inner])
                values.append(u * u * u * p0[inner] + 3 * u * u * t * p1[inner] + 3 * u * t * t * p2[inner] + t * t * t * p3[inner])
            rows, values = np.concatenate(rows), np.concatenate(values)
            none = np.bincount(rows, minlength=n) == 0
            low, high = np.full(n, np.nan), np.full(n, -np.inf)  # NaN is the greatest, as in Spark
            np.fmin.at(low, rows, values)
            np.maximum.at(high, rows, values)
            found |= {f"{k}0": pa.array(low, mask=none), f"{k}1": pa.array(high, mask=none)}
    names = ["x0", "y0", "x1", "y1"]
    return pa.StructArray.from_arrays([found[name] for name in names], names)


def curve_bounds(path: Column) -> Column:
    """(x0, y0, x1, y1) of the drawn path: of all ends, and of curves where they turn. Nulls for a path that draws nothing. All paths of an Arrow batch are done at once."""

    def boxes(paths: pa.Array) -> pa.Array:
        return _boxes(paths)

    return F.arrow_udf(boxes, "struct<x0:double,y0:double,x1:double,y1:double>")(path)


def _crossed(pieces: Column, x: Column, y: Column) -> Column:
    """+1 for each upward and -1 for each downward crossing of the ray to the right of a point. Curves are cut where they turn in y, and each part's crossing is found by halving."""

    def of(e: Column) -> Column:
        return named(F.concat(F.array(F.lit(0.0)), turns(e, "y"), F.array(F.lit(1.0))), lambda cuts: F.transform(F.slice(cuts, 1, F.size(cuts) - 1), lambda low, i: part(e, low, F.get(cuts, i + 1))))

    def part(e: Column, low: Column, high: Column) -> Column:
        value = lambda t: F.when(t == 0, e["y0"]).when(t == 1, e["y3"]).otherwise(at(e, "y", t))
        bounds = F.struct(low.alias("l"), high.alias("h"), value(low).alias("y0"), value(high).alias("y1"))
        return named(bounds, lambda b: F.when(((b["y0"] <= y) != (b["y1"] <= y)) & right_of(e, b), F.when(b["y1"] > b["y0"], 1).otherwise(-1)).otherwise(0))

    def right_of(e: Column, b: Column) -> Column:
        straight = x < e["x0"] + F.try_divide((y - e["y0"]) * (e["x3"] - e["x0"]), e["y3"] - e["y0"])
        half = lambda s: (s["l"] + s["h"]) / 2
        start = F.struct(b["l"].alias("l"), b["h"].alias("h"))

        def halvings(p: Column) -> Column:
            def step(s: Column, _: Column) -> Column:
                below = lambda t: (((p["a"] * t + p["b"]) * t + p["c"]) * t + p["d"] <= y) == p["up"]
                return named(half(s), lambda t: F.when(below(t), F.struct(t.alias("l"), s["h"].alias("h"))).otherwise(F.struct(s["l"].alias("l"), t.alias("h"))))

            return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, step, half)

        y0, y1, y2, y3 = (e[f"y{i}"] for i in range(4))
        powers = {"a": y3 - 3 * y2 + 3 * y1 - y0, "b": 3 * (y0 - 2 * y1 + y2), "c": 3 * (y1 - y0), "d": y0, "up": b["y1"] > b["y0"]}
        halved = named(F.struct(*[v.alias(k) for k, v in powers.items()]), halvings)
        # A curve stays between its control points, so only points among these ask where it is.
        ends = [e[f"x{i}"] for i in range(4)]
        return F.when(e["kind"] == "LineTo", straight).when(x < F.least(*ends), True).when(x >= F.greatest(*ends), False).otherwise(named(halved, lambda t: x < at(e, "x", t)))

    return F.filter(F.flatten(F.transform(pieces, of)), lambda n: n != 0)


def crossings(path: Column, x: Column, y: Column) -> Column:
    """+1 for each upward and -1 for each downward crossing of the ray to the right of a point. From these follow winding_of() and filled_of(); name them where both are asked for."""
    return _crossed(edges(path), x, y)


def winding_of(crossed: Column) -> Column:
    return F.aggregate(crossed, F.lit(0), lambda s, n: s + n)


def filled_of(crossed: Column, rule: Column) -> Column:
    return F.when(rule == "EvenOdd", F.size(crossed) % 2 == 1).otherwise(winding_of(crossed) != 0)


def winding(path: Column, x: Column, y: Column) -> Column:
    """How often the outline goes around a point; 0 outside."""
    return winding_of(crossings(path, x, y))


def filled(path: Column, x: Column, y: Column, rule: Column) -> Column:
    """Whether a point is inside by a path's rule, EvenOdd or NonZero. A point on a lower or left edge is inside, on an upper or right one outside."""
    return named(crossings(path, x, y), lambda crossed: filled_of(crossed, rule))


def segments(path: Column) -> Column:
    """Straight edges (x0, y0, x1, y1) of the filled outline of a path without curves."""
    return F.transform(edges(path, curves=False), lambda e: F.struct(e["x0"].alias("x0"), e["y0"].alias("y0"), e["x3"].alias("x1"), e["y3"].alias("y1")))


def inside(path: Column, x: Column, y: Column, curves: bool = False) -> Column:
    """Odd-even rule: edges crossed by the ray to the right. A point on a lower or left edge is inside, on an upper or right one outside. curves: whether commands have control points; without, curves are passed over."""
    return F.size(_crossed(edges(path), x, y) if curves else _straight(segments(path), x, y)) % 2 == 1


def _straight(lines: Column, x: Column, y: Column) -> Column:
    crossed = lambda e: ((e["y0"] <= y) != (e["y1"] <= y)) & (x < e["x0"] + F.try_divide((y - e["y0"]) * (e["x1"] - e["x0"]), e["y1"] - e["y0"]))
    return F.filter(lines, lambda e: F.coalesce(crossed(e), F.lit(False)))
