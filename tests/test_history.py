"""Undo stacks by segments against a plain fold."""

import random

import numpy as np
import pandas as pd
import pytest

from quirework.operators import history
from quirework.streaming.history import fold

LOG = "doc_id long, seq long, op string"


def stacks(rows):
    frame = pd.DataFrame(rows, columns=["doc_id", "seq", "op"])
    return {int(d): fold([], [], g) for d, g in frame.groupby("doc_id")}


@pytest.mark.parametrize("weights", [(5, 3, 2), (1, 3, 1), (1, 5, 5), (8, 1, 1)])
@pytest.mark.parametrize("segment", [4, 64])
def test_segments_equal_a_fold(spark, weights, segment):
    rng = random.Random(f"{weights}{segment}")
    rows = []
    for doc in range(40):
        n = rng.choice([1, 2, 3, 5, 8, 30, 150])
        rows += [(doc, s * 3 + doc, op) for s, op in enumerate(rng.choices(["move", "undo", "redo"], weights, k=n))]
    rng.shuffle(rows)
    got = {r["doc_id"]: (list(r["done"]), list(r["undone"])) for r in history.live(spark.createDataFrame(rows, LOG), segment).collect()}
    assert got == stacks(rows)


def test_one_document_in_many_tasks(spark):
    """A document holds nearly all commands; no task gets more than a segment of them."""
    rng = np.random.default_rng(3)
    n = 120_000
    ops = np.array(["text", "undo", "redo"])[rng.choice(3, n, p=[0.4, 0.35, 0.25])]
    frame = pd.DataFrame({"doc_id": np.where(np.arange(n) % 1000 == 7, 2, 1), "seq": np.arange(n), "op": ops})
    log = spark.createDataFrame(frame, LOG)
    (row,) = history.live(log).filter("doc_id = 1").collect()
    assert (list(row["done"]), list(row["undone"])) == stacks(frame)[1] and len(row["done"]) > 100
    seen = []
    summed = history._summed
    group = __import__("pyarrow").table({"at": np.arange(9), "doc_id": np.ones(9, np.int64), "seq": np.arange(9), "code": np.array([1, 2, 2, 0, 1, 1, 2, 0, 1], np.int8), "segment": np.zeros(9, np.int64)})
    seen = summed(group).to_pylist()
    assert seen == [{"doc_id": 1, "segment": 0, "lead": [-1, 2], "pushes": True, "need": 1, "pointer": 0, "top": 1, "pointers": [1], "tops": [2]}]


def test_nothing_and_nulls(spark):
    assert history.live(spark.createDataFrame([], LOG)).count() == 0
    got = history.live(spark.createDataFrame([(None, 1, "move"), (3, None, "move"), (4, 1, "undo"), (5, 1, None)], LOG)).collect()
    assert sorted((r["doc_id"], r["done"], r["undone"]) for r in got) == [(4, [], []), (5, [1], [])]
