"""Connected components of an edge table by alternating large-star and small-star rounds.

Each half round is one minimum per node and one join; nothing is gathered per
node, so a hub with very many neighbours is only pre-aggregated. The rounds end
when one changes nothing, which is when the edges are stars; there is no other
bound, as each round that changes an edge brings it to a smaller node. Nulls take
no part; an empty edge table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b): large-star joins every larger neighbour, small-star every smaller one, to the least of all."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = both if large else both.filter("b < a")
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    moved = both.filter("b > a") if large else around
    moved = moved.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.union(least.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: two long columns (a, b). Returns (a, b): each node but the least of its component, and that least node."""
    scratch = Scratch(edges.sparkSession, "components")
    now = scratch.write(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "round0")
    seen, i = None, 0
    while True:
        stat = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if not stat["n"] or stat == seen:
            return now
        seen, i = stat, i + 1
        now = scratch.write(_star(_star(now, True), False), f"round{i}")
        if i > 1:
            scratch.drop(f"round{i - 2}")
