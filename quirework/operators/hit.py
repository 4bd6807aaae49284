"""Point queries: which element is under a point.

By default an element's own space is tested from (0, 0) to its width and
height, without the place of its bounds; ``anchor="bounds"`` tests the bounds
themselves. Probes and elements always join on the page and a cell of a grid on
it, so the plan is an equi-join with the geometry as its condition, and a page
that holds very many elements is spread over its cells. An element is dealt to
each cell that its box touches; one that touches more than MOST_CELLS stands
in all cells and joins on the page alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, paths


#: Side of a cell, and cells of an element, at most.
CELL, MOST_CELLS = 256.0, 64
#: Boxes are this much larger on each side, relative to their place, as mapping there and back is rounded.
SLACK = 1e-9


#: The cell of elements that stand in all cells.
EVERYWHERE = -(1 << 40)


def in_cells(rows: DataFrame, box: Column) -> DataFrame:
    """rows with cx and cy for each cell that their box touches, or EVERYWHERE for too large a box. Rows without a box are left out."""
    first = lambda c: F.floor((F.col(c) - (F.abs(F.col(c)) * SLACK + SLACK)) / CELL)
    last = lambda c: F.floor((F.col(c) + (F.abs(F.col(c)) * SLACK + SLACK)) / CELL)
    # Step by step: each step names what the next one uses several times, so that no expression is repeated.
    b = rows.withColumn("__box", box).select(*rows.columns, *[F.col(f"__box.{c}").alias(f"__{c}") for c in ("x", "y", "width", "height")])
    b = b.withColumns({"__right": F.col("__x") + F.col("__width"), "__top": F.col("__y") + F.col("__height")})
    b = b.select(*rows.columns, *[f(x, y).alias(n) for n, f, x, y in (("__lx", F.least, "__x", "__right"), ("__hx", F.greatest, "__x", "__right"), ("__ly", F.least, "__y", "__top"), ("__hy", F.greatest, "__y", "__top"))])
    b = b.select(*rows.columns, first("__lx").alias("__x0"), last("__hx").alias("__x1"), first("__ly").alias("__y0"), last("__hy").alias("__y1"))
    small = (F.col("__x1") - F.col("__x0") + 1.0) * (F.col("__y1") - F.col("__y0") + 1.0) <= MOST_CELLS
    all_ = F.array(F.lit(EVERYWHERE).cast("long"))
    b = b.withColumn("cx", F.explode(F.when(small, F.sequence("__x0", "__x1")).when(~small, all_)))
    b = b.withColumn("cy", F.explode(F.when(F.col("cx") == EVERYWHERE, all_).otherwise(F.sequence("__y0", "__y1"))))
    return b.drop("__x0", "__x1", "__y0", "__y1")


def hits(x: Column, y: Column, bounds: Column, transform: Column, clip: Column | None = None, anchor: str = "local", curves: bool = False) -> Column:
    """Whether an element is hit; never through a singular matrix, nor outside a clip path. curves: whether the clip's commands have control points."""
    local = geometry.unmap_point(transform, x, y)
    box = bounds if anchor == "bounds" else geometry.rect(F.lit(0), F.lit(0), bounds["width"], bounds["height"])
    hit = geometry.contains(box, local["x"], local["y"])
    if clip is not None:
        hit = hit & (clip.isNull() | paths.inside(clip, local["x"], local["y"], curves))
    return F.coalesce(hit, F.lit(False))


def topmost(probes: DataFrame, elements: DataFrame, anchor: str = "local") -> DataFrame:
    """probes: probe_id, page_id, x, y. Adds the visible element hit that stands last in its page's order, or null.

    Where elements have a clip_path, points outside it don't hit. One maximum
    per probe; only its key and the element's order are shuffled.
    """
    clip = [c for c in ("clip_path",) if c in elements.columns]
    candidates = elements.filter("visible").select("page_id", "element_id", "ord", "bounds", "transform", *clip)
    own = F.col("bounds") if anchor == "bounds" else geometry.rect(F.lit(0), F.lit(0), F.col("bounds.width"), F.col("bounds.height"))
    dealt = in_cells(candidates, geometry.map_rect(F.col("transform"), own))
    cell = lambda c: F.floor(F.col(c) / CELL).alias(f"c{c}")
    cells = F.array(F.struct(cell("x"), cell("y")), F.struct(*[F.lit(EVERYWHERE).cast("long").alias(c) for c in ("cx", "cy")]))
    asked = probes.select("probe_id", "page_id", "x", "y", F.inline(cells))
    path, curves = None, False
    if clip:
        curves = "x1" in elements.schema["clip_path"].dataType.elementType.names
        path = paths.stored(F.col("clip_path")) if curves else F.col("clip_path")
    near = hits(F.col("x"), F.col("y"), F.col("bounds"), F.col("transform"), path, anchor, curves)
    # Spark takes probes for as small as what they are made of; a sorted join needs no side in the driver's memory or a task's.
    met = asked.join(dealt.hint("merge"), ["page_id", "cx", "cy"]).filter(near)
    best = met.groupBy("probe_id").agg(F.max_by("element_id", "ord").alias("element_id"))
    return probes.join(best.hint("merge"), "probe_id", "left").select("probe_id", "page_id", "x", "y", "element_id")


def element_at(points: DataFrame, pages: DataFrame, elements: DataFrame) -> DataFrame:
    """points: probe_id, doc_id, x, y in document space, zoom and page_spacing. Adds page_idx and the topmost element.

    The page is set even where nothing is hit.
    """
    found = points.withColumn("page_idx", geometry.page_at(F.col("y"))).join(pages.select("doc_id", "page_idx", "page_id", "height"), ["doc_id", "page_idx"], "left")
    top = geometry.page_top(F.col("page_idx"), F.col("height"), F.col("page_spacing"), F.col("zoom"))
    local = found.withColumn("local_y", F.col("y") - top)
    hit = topmost(local.filter("page_id IS NOT NULL").select("probe_id", "page_id", "x", F.col("local_y").alias("y")), elements)
    return local.join(hit.select("probe_id", "element_id"), "probe_id", "left").select("probe_id", "doc_id", "page_idx", "local_y", "element_id")


def overlaps(elements: DataFrame) -> DataFrame:
    """Pairs of elements of one page whose bounds touch, the smaller id first.

    Two that touch share a cell; the one that holds the low corner of what they
    share reports the pair, so each comes once.
    """
    rows = elements.select("page_id", "element_id", "bounds")
    cells = in_cells(rows, F.col("bounds"))
    dealt, large = cells.filter(F.col("cx") != EVERYWHERE), cells.filter(F.col("cx") == EVERYWHERE).select(*rows.columns)
    named = lambda df, i, r, *more: df.select("page_id", F.col("element_id").alias(i), F.col("bounds").alias(r), *more)
    touch = geometry.intersects(F.col("p"), F.col("q"))
    corner = lambda c: F.floor(F.greatest(F.col(f"p.{c}"), F.col(f"q.{c}")) / CELL)
    near = named(dealt, "a", "p", "cx", "cy").join(named(dealt, "b", "q", "cx", "cy"), ["page_id", "cx", "cy"])
    near = near.filter((F.col("a") < F.col("b")) & touch & (F.col("cx") == corner("x")) & (F.col("cy") == corner("y"))).select("page_id", "a", "b")
    sized = rows.join(large.select("page_id", "element_id", F.lit(True).alias("large")), ["page_id", "element_id"], "left").withColumn("large", F.coalesce("large", F.lit(False)))
    far = named(large, "i", "p").join(named(sized, "j", "q", "large"), "page_id").filter((F.col("i") != F.col("j")) & touch & (~F.col("large") | (F.col("i") < F.col("j"))))
    return near.union(far.select("page_id", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")))
