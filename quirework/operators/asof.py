"""As-of joins: each request with the latest fact at or before it.

Requests and facts are sorted together by key and time, and each request takes
what came last before it: one sort a key and no product of ranges. A key that
holds a large share of the rows is cut into segments of time; within a segment
rows are sorted, and what earlier segments end with is carried in from a table
with one row for each key and segment that has facts or requests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(requests: DataFrame, facts: dict[str, DataFrame], keys: list[str], time: str, segment: Column) -> DataFrame:
    """requests with a struct column for each of facts: the columns of its latest row with the same keys, at or before the request, or null.

    Every table has keys and time; segment is a whole number that doesn't fall
    as time grows. Of facts of one key and time any may be taken, so give them
    times of their own. Facts with a null key or time are passed over, requests
    with one have no facts. Several facts are looked up in one pass.
    """
    shared = [*keys, time]
    own = {name: [c for c in df.columns if c not in keys] for name, df in facts.items()}
    absent = {name: F.lit(None).cast(df.select(F.struct(*own[name]).alias("s")).schema["s"].dataType) for name, df in facts.items()}
    known = lambda df: df.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in shared))
    rest = F.struct(*requests.columns)
    parts = [requests.select(*shared, F.lit(1).alias("__side"), rest.alias("__row"), *[a.alias(f"__{n}") for n, a in absent.items()])]
    no_row = F.lit(None).cast(parts[0].schema["__row"].dataType)
    for name, df in facts.items():
        found = [F.struct(*own[n]).alias(f"__{n}") if n == name else a.alias(f"__{n}") for n, a in absent.items()]
        parts.append(known(df).select(*shared, F.lit(0).alias("__side"), no_row.alias("__row"), *found))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    rows = rows.withColumn("__segment", segment)
    names = [f"__{n}" for n in facts]
    inside = Window.partitionBy(*keys, "__segment").orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumns({n: F.last(n, ignorenulls=True).over(inside) for n in names}).filter("__side = 1")
    ends = rows.groupBy(*keys, "__segment").agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.col(time))).alias(n) for n in names])
    earlier = Window.partitionBy(*keys).orderBy("__segment").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*[F.col(k).alias(f"__key_{k}") for k in keys], F.col("__segment").alias("__at"), *[F.last(n, ignorenulls=True).over(earlier).alias(f"{n}_before") for n in names])
    carried = carried.filter(" OR ".join(f"{n}_before IS NOT NULL" for n in names))
    same = F.col("__segment") == F.col("__at")
    for k in keys:
        same = same & (F.col(k) == F.col(f"__key_{k}"))
    out = seen.join(carried, same, "left")
    return out.select("__row.*", *[F.coalesce(n, f"{n}_before").alias(n[2:]) for n in names])


def counted(rows: DataFrame, keys: list[str], time: str, segment: Column, name: str) -> DataFrame:
    """Adds name, how many rows of the keys there are up to this one in order of time, by segments as in latest()."""
    rows = rows.withColumn("__segment", segment)
    inside = Window.partitionBy(*keys, "__segment").orderBy(time)
    sizes = rows.groupBy(*keys, "__segment").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__segment").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*keys, "__segment", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    placed = rows.withColumn("__place", F.row_number().over(inside)).join(before, [*keys, "__segment"])
    return placed.withColumn(name, F.col("__before") + F.col("__place")).drop("__segment", "__before", "__place")
