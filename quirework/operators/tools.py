"""Drawing tools: what presses, moves, releases and cancels of the pointer make.

A tool is active from its start to the next release, which finishes it, or
cancel. While one is active, a press sets its start and current point, a move its
current one; points stay from one use to the next, as no start resets them. So
every part of the state is the last of some earlier events, and as-of joins find
it: first the tool that is active at each event, then the points at each finish.
They go by segments of a document's events, so one document may hold any share of
them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import drag_rect, rect
from . import asof

# The smallest rectangle that is drawn, and the size of a new text.
LEAST_SIDE, TEXT_WIDTH, TEXT_HEIGHT = 5, 200, 30
#: Events of a document that are sorted together.
SEGMENT = 4096


def _segment():
    return F.floor(F.col("seq") / SEGMENT)


def active(events: DataFrame) -> DataFrame:
    """events: doc_id, seq (whole numbers), kind (tool, cancel, press, move, release; others change nothing), tool (of a tool's start), x, y. Adds active, the tool that is active when the event comes, or null."""
    control = events.filter("kind IN ('tool', 'cancel', 'release')").select("doc_id", (F.col("seq") + 1).alias("seq"), F.when(F.col("kind") == "tool", F.col("tool")).alias("started"))
    return asof.latest(events, {"control": control}, ["doc_id"], "seq", _segment()).withColumn("active", F.col("control.started")).drop("control")


def finished(events: DataFrame) -> DataFrame:
    """One row (doc_id, seq, tool, bounds, created) for each release that finishes a tool.

    A rectangle spans the two points and is made if both sides are longer than
    LEAST_SIDE; a text or an image stands at the start point, an image's size
    being its own (null here). Points that were never set are the origin.
    """
    seen = active(events).filter("active IS NOT NULL")
    at = lambda *kinds: seen.filter(F.col("kind").isin(*kinds)).select("doc_id", "seq", "x", "y")
    ends = seen.filter("kind = 'release'").select("doc_id", "seq", F.col("active").alias("tool"))
    met = asof.latest(ends, {"start": at("press"), "current": at("press", "move")}, ["doc_id"], "seq", _segment())
    x, y, cx, cy = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("start.x", "start.y", "current.x", "current.y"))
    none = F.lit(None).cast("double")
    drawn = drag_rect(x, y, cx, cy)
    bounds = F.when(F.col("tool") == "DrawRect", drawn).when(F.col("tool") == "TextEdit", rect(x, y, F.lit(TEXT_WIDTH), F.lit(TEXT_HEIGHT))).when(F.col("tool") == "InsertImage", rect(x, y, none, none))
    created = F.when(F.col("tool") == "DrawRect", (drawn["width"] > LEAST_SIDE) & (drawn["height"] > LEAST_SIDE)).otherwise(F.col("tool").isin("TextEdit", "InsertImage"))
    return met.select("doc_id", "seq", "tool", bounds.alias("bounds"), created.alias("created"))
