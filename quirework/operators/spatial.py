"""A spatial index: elements in files that are laid out along a Z-order curve.

Each element is dealt to the cells of its page's grid that it touches, and the
rows are sorted by ``place``: the page, and within it the cell's place on the
Z-order (Morton) curve, so that neighbouring cells are near one another in the
files. Row groups are small and Parquet keeps the least and greatest place of
each. Probes are turned into at most RANGES ranges of places, which go down to
the scan as filters, so row groups between them are not read; the rest is an
equi-join on the place and the exact test.

Cells beyond 511 in either direction share the outermost ones; an element that
touches very many cells stands once a page, at a place of its own that every
probe of the page asks, too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from . import hit

#: Ranges of places that are sent to the scan, at most.
RANGES = 64
#: Bits of a cell's place within its page; the bit above them is that of elements that stand in all cells.
BITS, MOST = 20, 511
#: Bytes of a row group.
GROUP_BYTES = 64 << 10


def _spread(n: Column) -> Column:
    """The ten low bits of a number, each followed by a zero."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        n = n.bitwiseOR(F.shiftleft(n, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return n


def place(page: Column, cx: Column, cy: Column) -> Column:
    """Where a cell stands in the order of the index."""
    axis = lambda c: F.least(F.greatest(c, F.lit(-MOST - 1)), F.lit(MOST)).cast("long") + (MOST + 1)
    morton = _spread(axis(cx)).bitwiseOR(F.shiftleft(_spread(axis(cy)), 1))
    return F.shiftleft(page.cast("long"), BITS + 1) + F.when(cx == hit.EVERYWHERE, F.lit(1 << BITS)).otherwise(morton)


def write(elements: DataFrame, path: str, anchor: str = "local") -> None:
    """Writes the index of visible elements into a folder. Page ids below 2**42."""
    own = F.col("bounds") if anchor == "bounds" else geometry.rect(F.lit(0), F.lit(0), F.col("bounds.width"), F.col("bounds.height"))
    shown = elements.filter("visible").select("page_id", "element_id", "ord", "bounds", "transform")
    dealt = hit.in_cells(shown, geometry.map_rect(F.col("transform"), own)).select(*shown.columns, place(F.col("page_id"), F.col("cx"), F.col("cy")).alias("place")).distinct()
    dealt.repartitionByRange("place").sortWithinPartitions("place").write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).parquet(path)


def asked(probes: DataFrame) -> DataFrame:
    """Probes (probe_id, page_id, x, y) with the two places that they ask."""
    cell = lambda c: F.floor(F.col(c) / hit.CELL)
    own, all_ = place(F.col("page_id"), cell("x"), cell("y")), place(F.col("page_id"), F.lit(hit.EVERYWHERE), F.lit(hit.EVERYWHERE))
    return probes.select("probe_id", "page_id", "x", "y", F.explode(F.array(own, all_)).alias("place"))


def ranges(places: DataFrame, most: int = RANGES) -> list[tuple[int, int]]:
    """At most most ranges that hold every place, cut at its quantiles. One row a range reaches the driver."""
    cuts = sorted(set(places.approxQuantile("place", [i / most for i in range(1, most)], 0.25 / most)))
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c < F.col("place")))
    found = places.filter("place IS NOT NULL").groupBy(part.alias("part")).agg(F.min("place").alias("low"), F.max("place").alias("high")).collect()
    return sorted((r["low"], r["high"]) for r in found)


def scan(spark: SparkSession, path: str, wanted: list[tuple[int, int]]) -> DataFrame:
    """The index's rows in some ranges of places."""
    rows = spark.read.parquet(path)
    if not wanted:
        return rows.filter("false")
    return rows.filter(reduce(Column.__or__, [F.col("place").between(low, high) for low, high in wanted]))


def topmost(spark: SparkSession, path: str, probes: DataFrame, anchor: str = "local") -> DataFrame:
    """As hit.topmost(), by the index in a folder."""
    places = asked(probes)
    near = hit.hits(F.col("x"), F.col("y"), F.col("bounds"), F.col("transform"), anchor=anchor)
    met = places.join(scan(spark, path, ranges(places)).drop("page_id").hint("merge"), "place").filter(near)
    best = met.groupBy("probe_id").agg(F.max_by("element_id", "ord").alias("element_id"))
    return probes.join(best.hint("merge"), "probe_id", "left").select("probe_id", "page_id", "x", "y", "element_id")
