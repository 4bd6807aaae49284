"""The render queue: rule, batch, stream and timer."""

import random
from types import SimpleNamespace

import pytest

from quirework.streaming import queue

LOG = "doc_id long, seq long, op string, page_idx long"


class State:
    """A state of a test, in place of Spark's."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def put(self, v):
        self.value = v

    update = put

    def clear(self):
        self.value = None


@pytest.fixture
def rows():
    rng = random.Random(9)
    return [(d, s, rng.choice(["ask", "ask", "ask", "pop"]), rng.randrange(6)) for d in range(12) for s in range(rng.randrange(80))]


def walk(rows):
    out = []
    for doc in {r[0] for r in rows}:
        pending, n = [], 0
        for _, seq, op, page in sorted(r for r in rows if r[0] == doc):
            if op == "ask":
                pending += [page] if page not in pending else []
            elif pending:
                n += 1
                out.append((doc, seq, pending.pop(0), n))
    return sorted(out)


def test_batch_equals_a_walk(spark, rows):
    got = sorted(map(tuple, queue.taken(spark.createDataFrame(random.Random(1).sample(rows, len(rows)), LOG)).collect()))
    assert got == walk(rows) and got
    assert queue.taken(spark.createDataFrame([(None, 1, "ask", 2), (1, None, "pop", 1), (1, 2, "pop", None), (2, 1, "ask", None)], LOG)).count() == 0


def test_a_page_taken_may_be_asked_for_again(spark):
    log = [(1, 1, "ask", 5), (1, 2, "ask", 5), (1, 3, "pop", None), (1, 4, "ask", 5), (1, 5, "pop", None), (1, 6, "pop", None)]
    assert sorted(map(tuple, queue.taken(spark.createDataFrame(log, LOG)).collect())) == [(1, 3, 5, 1), (1, 5, 5, 2)]


def test_stream_equals_batch(spark, rows, tmp_path):
    for i in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 27 == i], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        run = queue.live(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination(120)
        assert run.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(map(tuple, spark.read.schema(queue.TAKEN).parquet(str(tmp_path / "out")).collect())) == walk(rows)


def test_a_timer_takes_pages_while_any_is_pending():
    import pandas as pd

    timers, states = [], {}
    handle = SimpleNamespace(getListState=lambda n, _: states.setdefault(n, State()), getValueState=lambda n, _: states.setdefault(n, State()), registerTimer=timers.append)
    one = queue.Pending(poll_ms=10)
    one.init(handle)
    log = pd.DataFrame([(1, "ask", 3), (2, "ask", 4), (3, "ask", 3)], columns=["seq", "op", "page_idx"])
    (first,) = one.handleInputRows((7,), iter([log]), SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 100))
    assert not len(first) and timers == [110]
    taken = []
    while timers:
        at = timers.pop(0)
        (out,) = one.handleExpiredTimer((7,), None, SimpleNamespace(getExpiryTimeInMs=lambda at=at: at))
        taken += out[["page_idx", "place"]].values.tolist()
    assert taken == [[3, 1], [4, 2]] and states["pages"].get() is None
