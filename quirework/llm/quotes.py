"""Quotation linking: from messages that quote one another to reply-ordered conversations without quotes.

Leading ``>`` marks give each line its quote level. Consecutive lines of one
level form a passage. Passages are normalised (lower case, single spaces) and
hashed; a quoted passage is joined, within its conversation, to the earliest
message whose own words contain it: as its whole text, as a passage or as a
single line. Where a quoted passage as a whole isn't found, its lines are
looked up one by one. A message replies to the latest message that its
least-nested linked quotes come from; following these links up by pointer
doubling gives the root of its thread and its depth below it.

Native DataFrame operations only; passages are cut inside each row. The
originals are reduced to one row for each conversation and hash before the
join, so repeated messages and very common first turns don't multiply, and a
hot conversation is dealt out by hash.

Defined results: a null text is empty and has no passages. A null conversation
or turn links with nothing; such a message is its own root. Rows that share
conversation and turn share links; a passage that they quote in the same place
counts once. A quote found nowhere earlier is counted but
not linked. An empty table gives an empty result. Columns other than the named
ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scratch

_MARKS = r"^((?:[ \t]{0,3}>)*+)[ \t]?"  # possessive: matched by a loop, however long
_SAID = r"(?i)^.{0,200}\b(?:wrote|writes|schrieb|a écrit|escribió)\s?:\s*$"


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 1), "[^>]", ""))


def normalised(text: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _hash(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def parse(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Adds to each message its passages (level, lines) and its own text without quotes.

    A line such as "... wrote:" directly before a quote counts as part of it.
    """
    raw = F.split(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"\r\n?", "\n"), "\n", -1)
    lines = F.transform(raw, lambda x: F.struct(_level(x).alias("level"), F.regexp_replace(x, _MARKS, "").alias("body")))
    named = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), lines.alias("lines"))
    following = F.transform("lines", lambda x, i: F.struct(x["level"].alias("level"), x["body"].alias("body"), F.coalesce(F.get(F.col("lines"), i + 1)["level"], F.lit(0)).alias("next")))
    kept = F.filter(following, lambda x: ~((x["level"] == 0) & (x["next"] > 0) & F.coalesce(x["body"].rlike(_SAID), F.lit(False))))
    named = named.withColumn("lines", kept)
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size("lines"), F.lit(1))), lambda i: (F.size("lines") > 0) & ((i == 1) | (F.get(F.col("lines"), i - 1)["level"] != F.get(F.col("lines"), F.greatest(i - 2, F.lit(0)))["level"])))
    named = named.withColumn("starts", starts)

    def passage(i: Column, k: Column) -> Column:
        end = F.coalesce(F.get(F.col("starts"), k + 1), F.size("lines") + 1)
        part = F.slice("lines", i, end - i)
        return F.struct(part[0]["level"].alias("level"), F.transform(part, lambda x: x["body"]).alias("lines"))

    own = F.filter("lines", lambda x: x["level"] == 0)
    text = F.btrim(F.array_join(F.transform(own, lambda x: x["body"]), "\n"), F.lit(" \t\n\r\x0b\x0c"))
    return named.select("conv_id", "turn", "role", F.transform("starts", passage).alias("passages"), text.alias("text"))


def _hashes(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Quoted passages with the hashes of their whole and their lines; originals with one hash a row."""
    joined = lambda p: normalised(F.array_join(p["lines"], " "))
    each = lambda p: F.filter(F.transform(p["lines"], normalised), lambda x: x != "")
    quoted = F.filter("passages", lambda p: (p["level"] > 0) & (joined(p) != ""))
    quotes = parsed.select("conv_id", "turn", F.posexplode(F.transform(quoted, lambda p: F.struct(p["level"].alias("level"), _hash(joined(p)).alias("whole"), F.transform(each(p), _hash).alias("lines")))).alias("passage", "q"))
    own = F.filter("passages", lambda p: p["level"] == 0)
    found = F.concat(F.array(normalised(F.col("text"))), F.transform(own, joined), F.flatten(F.transform(own, each)))
    originals = parsed.select("conv_id", "turn", F.explode(F.array_distinct(F.filter(found, lambda x: x != ""))).alias("said")).select("conv_id", "turn", _hash(F.col("said")).alias("hash"))
    return quotes.select("conv_id", "turn", "passage", "q.level", "q.whole", "q.lines"), originals.groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))


def link(parsed: DataFrame) -> DataFrame:
    """One row (conv_id, turn, passage, level, whole, origin) for each quoted passage, whole being its hash; origin is null where it isn't found in an earlier turn."""
    quotes, originals = _hashes(parsed)
    tried = quotes.select("conv_id", "turn", "passage", "level", "whole", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("by"), F.col("whole").alias("hash"))), F.transform("lines", lambda x: F.struct(F.lit(1).alias("by"), x.alias("hash"))))).alias("t"))
    tried = tried.select("conv_id", "turn", "passage", "level", "whole", "t.by", "t.hash")
    met = tried.join(originals, ["conv_id", "hash"], "left").withColumn("origin", F.when(F.col("origin") < F.col("turn"), F.col("origin")))
    best = F.coalesce(F.max(F.when(F.col("by") == 0, F.col("origin"))), F.max(F.when(F.col("by") == 1, F.col("origin"))))
    return met.groupBy("conv_id", "turn", "passage", "level", "whole").agg(best.alias("origin"))


def conversations(
    messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", max_rounds: int = 40
) -> DataFrame:
    """One row for each message, in reply order: by conversation, thread root, depth and turn.

    Columns: conv_id, root_turn, depth, turn, parent_turn (null for a root),
    role, text (its own words), n_quotes, n_linked.
    max_rounds of pointer doubling reach a depth of 2 ** max_rounds.
    """
    scratch = Scratch(messages.sparkSession, "quotes")
    parsed = scratch.write(parse(messages, conv_col, turn_col, role_col, text_col), "parsed")
    links = link(parsed).groupBy("conv_id", "turn")
    least = F.min(F.when(F.col("origin").isNotNull(), F.struct(F.col("level"), -F.col("origin")))).getField("col2")
    links = scratch.write(links.agg(F.count("*").alias("n_quotes"), F.count("origin").alias("n_linked"), (-least).alias("parent_turn")), "links")
    up = links.filter("parent_turn IS NOT NULL").select("conv_id", "turn", F.col("parent_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth"))
    up = scratch.write(up, "up0")
    for i in range(max_rounds):
        above = up.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("higher"), F.col("depth").alias("more"))
        if up.join(above, ["conv_id", "root_turn"], "left_semi").isEmpty():
            break
        met = up.join(above, ["conv_id", "root_turn"], "left")
        met = met.select("conv_id", "turn", F.coalesce("higher", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        up = scratch.write(met, f"up{i + 1}")
    links = links.join(up, ["conv_id", "turn"], "left").withColumnsRenamed({"conv_id": "c", "turn": "t"})
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t"))
    out = parsed.select("conv_id", "turn", "role", "text").join(links, same, "left")
    out = out.select(
        "conv_id", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "turn", "parent_turn", "role", "text",
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
    )
    return out.orderBy("conv_id", "root_turn", "depth", "turn")
