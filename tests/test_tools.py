"""Tools against an automaton that is walked event by event."""

import random

from quirework.operators import tools

EVENT = "doc_id long, seq long, kind string, tool string, x double, y double"


def walk(rows):
    out = []
    for doc in {r[0] for r in rows}:
        active, start, now = None, (0.0, 0.0), (0.0, 0.0)
        for _, seq, kind, tool, x, y in sorted(r for r in rows if r[0] == doc):
            if kind == "tool":
                active = tool
            elif kind == "cancel":
                active = None
            elif kind == "press" and active:
                start = now = (x, y)
            elif kind == "move" and active:
                now = (x, y)
            elif kind == "release" and active:
                if active == "DrawRect":
                    w, h = abs(now[0] - start[0]), abs(now[1] - start[1])
                    out.append((doc, seq, active, (min(start[0], now[0]), min(start[1], now[1]), w, h), w > 5 and h > 5))
                elif active == "TextEdit":
                    out.append((doc, seq, active, (*start, 200.0, 30.0), True))
                else:
                    out.append((doc, seq, active, (*start, None, None), True))
                active = None
    return sorted(out, key=str)


def test_finished_tools_equal_a_walk(spark, monkeypatch):
    monkeypatch.setattr(tools, "SEGMENT", 16)
    rng = random.Random(11)
    rows = []
    for doc in range(15):
        seq = 0
        for _ in range(rng.randrange(120)):
            seq += rng.choice([1, 1, 2, 9])
            kind = rng.choice(["tool", "press", "move", "move", "release", "cancel", "wheel"])
            rows.append((doc, seq, kind, rng.choice(["DrawRect", "DrawRect", "TextEdit", "InsertImage"]) if kind == "tool" else None, float(rng.randrange(20)), float(rng.randrange(20))))
    got = [(r["doc_id"], r["seq"], r["tool"], tuple(r["bounds"]), r["created"]) for r in tools.finished(spark.createDataFrame(rows, EVENT)).collect()]
    assert sorted(got, key=str) == walk(rows) and len(got) > 30
    assert tools.finished(spark.createDataFrame([], EVENT)).count() == 0
