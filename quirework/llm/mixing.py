"""Mixing sources to target weights by capped water-filling.

Every source has a weight and the mix a budget of words. A source takes its
share of the budget by weight, but no more than ``max_epochs`` times its own
words; what a clamped source leaves is shared again by weight among the rest,
until no source is above its cap. That fixed point has a closed form: with the
sources sorted by cap / weight, a prefix of them is clamped, so two running
sums over the table of sources find it without rounds.

A source's target is met by whole repetitions of all its documents and one
seeded fractional repetition: documents in the order of the MD5 of seed and id
are taken again while the middle of the document still lies below what is
missing. The order is cut into 4096 bins of the hash, so the running sum within
a source is that of its bins, then that within one bin.

Native DataFrame operations only. One row of counts per source and per source
and bin is all that is ever grouped; documents of a hot source are dealt out by
bin.

Defined results: a null or blank text has size 0 and takes nothing. A null
source is a source of its own, after all others. Rows that share an id are
separate documents. An empty table gives an empty result. Columns other than
the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch

WORD = r"[^\x20\x09-\x0D]+"
BIN_DIGITS = 3  # hex digits of the hash: 4096 bins for each source


def word_count(text: Column) -> Column:
    """Number of words of a text; of a null, 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """sizes: one row (source, source_size) for each source. Adds its target.

    weights repeat over the sources in the order of their code points, null
    last. budget is a multiple of all words. A table of one row per source goes
    through a single task here; nothing else does.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    summed = ranked.select(
        "source", "source_size", "weight", "cap",
        F.row_number().over(by_ratio).alias("place"),
        (F.sum("source_size").over(everything) * F.lit(float(budget)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("left"),
        F.sum("weight").over(onward).alias("open_weight"),
    )
    fits = F.col("weight") * F.col("left") / F.col("open_weight") <= F.col("cap")
    first = F.min(F.when(fits, F.struct("place", "left", "open_weight"))).over(everything)
    share = F.col("weight") * F.col("first.left") / F.col("first.open_weight")
    target = F.when(F.col("place") >= F.col("first.place"), share).otherwise(F.col("cap"))
    return summed.withColumn("first", first).select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    budget: float = 1.5,
    max_epochs: float = 2.0,
    seed: str = "",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row (doc_id, source, size, source_size, target, copies, taken) for each document.

    copies is how often the mix repeats the document, taken its words times
    that. Whole texts are read once, for their sizes; those are written to the
    shared folder and all else works on them.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    sized = scratch.write(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key")), "sized")
    sized = sized.withColumn("bin", F.substring("key", 1, BIN_DIGITS))
    bins = scratch.write(sized.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")), "bins")
    targets = source_targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, budget, max_epochs)
    targets = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    targets = targets.withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size"))
    earlier = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("bin_from", F.coalesce(F.sum("bin_size").over(earlier), F.lit(0)))
    placed = bins.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.source", "b.bin", "b.bin_from", "t.source_size", "t.target", "t.whole", "t.missing")
    both = sized.alias("d").join(placed.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.bin") == F.col("p.bin")))
    in_bin = Window.partitionBy("d.source", "d.bin").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("bin_from") + F.coalesce(F.sum("size").over(in_bin), F.lit(0))
    again = (2 * start + F.col("size") <= 2 * F.col("missing")).cast("long")
    out = both.select("doc_id", "d.source", "size", "source_size", "target", (F.col("whole") + again).alias("copies"))
    return out.withColumn("taken", F.col("size") * F.col("copies"))
