"""Ordered edits and history against plain lists."""

import random
from collections import defaultdict

import pandas as pd
import pytest

from quirework.operators import edits, history
from quirework.streaming import history as stream


def lists(df, owner, order, name):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: r[order]):
        assert r[order] == len(out[r[owner]])
        out[r[owner]].append(r[name])
    return dict(out)


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(1)
    rows = [(p, i, p * 100 + i) for p in range(60) for i in range(rng.randint(1, 6))]
    want = defaultdict(list)
    for p, _, k in rows:
        want[p].append(k)
    return spark.createDataFrame(rows, "page long, ord long, id long"), dict(want)


def test_move(spark, items):
    df, want = items
    rng = random.Random(2)
    moves = [(p, rng.randint(0, 6), rng.randint(0, 6)) for p in want if p % 5]
    for p, a, b in moves:
        if a < len(want[p]) and b < len(want[p]):
            x = list(want[p])
            x.insert(b, x.pop(a))
            want = want | {p: x}
    assert lists(edits.move(df, spark.createDataFrame(moves, "page long, from_idx long, to_idx long"), "page", "ord"), "page", "ord", "id") == want


def test_insert_then_remove_is_nothing(spark, items):
    df, want = items
    new = spark.createDataFrame([(p, 9000 + p, p % 8 if p % 3 else None) for p in want if p % 4], "page long, new_id long, at long")
    more = edits.insert(df, new, "page", "ord", "id")
    full = lists(more, "page", "ord", "id")
    for p in want:
        x = list(want[p])
        if p % 4:
            at = p % 8 if p % 3 else len(x)
            x.insert(min(at, len(x)), 9000 + p)
        assert full[p] == x
    gone = spark.createDataFrame([(p, full[p].index(9000 + p)) for p in want if p % 4], "page long, at long")
    assert lists(edits.remove(more, gone, "page", "ord"), "page", "ord", "id") == want


def test_moving_the_first_page_behind_the_third(spark):
    df = spark.createDataFrame([(0, i, i) for i in range(4)], "doc long, idx long, id long")
    moved = edits.move(df, spark.createDataFrame([(0, 0, 2)], "doc long, from_idx long, to_idx long"), "doc", "idx")
    assert {r["id"]: r["idx"] for r in moved.collect()} == {1: 0, 2: 1, 0: 2, 3: 3}


@pytest.fixture(scope="module")
def log():
    rng = random.Random(3)
    ops = ["move", "text", "undo", "undo", "redo"]
    rows = [(d, s, rng.choice(ops)) for d in range(12) for s in range(1, rng.randint(2, 40))]
    return [*rows, *[(99, i + 1, op) for i, op in enumerate(["move", "move", "undo", "text", "undo", "redo"])]]


def folded(log):
    out = {}
    for d in {d for d, _, _ in log}:
        done, undone = stream.fold([], [], pd.DataFrame([(s, o) for k, s, o in log if k == d], columns=["seq", "op"]))
        out[d] = done, undone
    return out


def test_undo_stack(spark, log):
    live = history.live(spark.createDataFrame(log, "doc_id long, seq long, op string"))
    found = {r["doc_id"]: (r["done"], r["undone"]) for r in live.collect()}
    assert found == folded(log) and found[99] == ([1, 4], [])


def test_stream_equals_batch(spark, log, tmp_path):
    schema = "doc_id long, seq long, op string"
    for part, low in enumerate((0, 11, 22)):
        rows = [r for r in log if low < r[1] <= low + 11 or part == 2 and r[1] > 22]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    seen = {}

    def keep(df, _):
        seen.update({r["doc_id"]: (r["done"], r["undone"]) for r in df.collect()})

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    q = stream.live(source).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert seen == folded(log)


def test_coalescing(spark):
    rows = [(1, 1, "move", 5, 1.0, 0.0), (1, 2, "move", 5, 2.0, 0.0), (1, 3, "move", 6, 3.0, 0.0), (1, 4, "text", 6, 0.0, 0.0), (1, 5, "move", 6, 4.0, 0.0)]
    runs = history.coalesced(spark.createDataFrame(rows, "doc_id long, seq long, op string, element_id long, x double, y double")).orderBy("run").collect()
    assert [(r["first_seq"], r["last_seq"], r["old_x"], r["new_x"]) for r in runs] == [(1, 2, 1, 2), (3, 3, 3, 3), (4, 4, 0, 0), (5, 5, 4, 4)]


def test_replay_restores_what_was_undone(spark):
    rng = random.Random(7)
    docs, rows, want = 40, [], {}
    for d in range(docs):
        state = {i: ((float(i), 0.0, 10.0, 10.0), f"t{i}" if i % 2 == 0 else None) for i in range(4)}
        stack, done, touched = [dict(state)], 0, set()
        for seq in range(1, rng.randint(2, 60)):
            op = rng.choice(["move", "move", "resize", "text", "delete", "insert", "undo", "undo", "redo"])
            i, x = rng.randrange(6), float(seq)
            rows.append((d, seq, op, i, x, x + 1, (x, x, x + 2, x + 3), f"new{seq}"))
            if op == "undo":
                done = max(0, done - 1)
                continue
            if op == "redo":
                done = min(len(stack) - 1, done + 1)
                continue
            touched.add(i)
            now = dict(stack[done])
            if op == "delete":
                now.pop(i, None)
            elif op == "insert" and i not in now:
                now[i] = None
            stack[done + 1 :] = [now]
            done += 1
        alive = stack[done]
        want[d] = (set(alive), touched)
    log = spark.createDataFrame(rows, "doc_id long, seq long, op string, element_id long, x double, y double, bounds struct<x:double,y:double,width:double,height:double>, text string")
    first = spark.createDataFrame([(d, i, (float(i), 0.0, 10.0, 10.0), f"t{i}" if i % 2 == 0 else None) for d in range(docs) for i in range(4)], "doc_id long, element_id long, bounds struct<x:double,y:double,width:double,height:double>, text string")
    out = history.replayed(first, log).collect()
    live = {r["doc_id"]: set(r["done"]) for r in history.live(log).collect()}
    got = defaultdict(set)
    for r in out:
        d, i = r["doc_id"], r["element_id"]
        got[d].add(i)
        own = [x for x in rows if x[0] == d and x[3] == i and x[1] in live[d]]
        placed = [x for x in own if x[2] in ("move", "resize")]
        sized = [x for x in own if x[2] == "resize"]
        start = (float(i), 0.0) if i < 4 else (None, None)
        assert (r["bounds"]["x"], r["bounds"]["y"]) == ((placed[-1][6][:2] if placed[-1][2] == "resize" else placed[-1][4:6]) if placed else start)
        assert r["bounds"]["width"] == (sized[-1][6][2] if sized else 10.0 if i < 4 else None)
        said = [x[7] for x in own if x[2] == "text"]
        assert r["text"] == ((said[-1] if said else f"t{i}" if i < 4 else None) if i % 2 == 0 or i > 3 else None)
        assert r["modified"] == (i in want[d][1])
    assert {d: got[d] for d in want} == {d: w[0] for d, w in want.items()}
