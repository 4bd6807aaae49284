"""The queue of pages to render: a page is pending once; one that was taken may be asked for again.

``transition`` is the one rule; a stateful stream and a batch fold both go by it.
In the stream, a document's pending pages are a list state, and, if poll_ms is
given, a timer takes a page each time it expires, as long as any is pending; else
only the log's pops take pages. A document's log is folded in order of seq by one
task, as whether a page is pending depends on all before; what is held is the
pending pages, each once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TAKEN = "doc_id bigint, seq bigint, page_idx bigint, place bigint"


def transition(pending: list[int], op: str, page: int | None) -> int | None:
    """Changes pending; returns the page that is taken, if one is. ask: of a pending page, and pop of nothing, do nothing."""
    if op == "pop":
        return pending.pop(0) if pending else None
    if page is not None and page not in pending:
        pending.append(page)
    return None


def _folded(group: pa.Table) -> pa.Table:
    rows = sorted(zip(group.column("seq").to_pylist(), group.column("op").to_pylist(), group.column("page_idx").to_pylist(), strict=True), key=lambda r: r[0])
    pending, out = [], []
    for seq, op, page in rows:
        if (page := transition(pending, op, page)) is not None:
            out.append((seq, page))
    n = len(out)
    columns = [[group.column("doc_id")[0].as_py()] * n, [s for s, _ in out], [p for _, p in out], list(range(1, n + 1))]
    return pa.table({c.split()[0]: pa.array(v, pa.int64()) for c, v in zip(TAKEN.split(", "), columns, strict=True)})


def taken(log: DataFrame) -> DataFrame:
    """log: doc_id, seq, op (ask or pop), page_idx. One row for each page taken: by which pop, and the how manieth of its document."""
    rows = log.select("doc_id", "seq", "op", "page_idx").filter("doc_id IS NOT NULL AND seq IS NOT NULL AND op IN ('ask', 'pop')")
    return rows.groupBy("doc_id").applyInArrow(_folded, TAKEN)


class Pending(StatefulProcessor):
    """Of one document: its pending pages, in order, and how many were taken."""

    def __init__(self, poll_ms: int | None = None):
        self.poll_ms = poll_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getListState("pages", "page bigint")
        self.count = handle.getValueState("count", "n bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        log = pd.concat(list(rows)).sort_values("seq")
        pending, n = self._state()
        out, idle = [], not pending
        for seq, op, page in zip(log["seq"], log["op"], log["page_idx"], strict=True):
            if (page := transition(pending, op, None if pd.isna(page) else int(page))) is not None:
                n += 1
                out.append((key[0], int(seq), page, n))
        self._keep(pending, n)
        if self.poll_ms is not None and pending and idle:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.poll_ms)
        yield self._rows(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A page is taken at no one's request; seq is null."""
        pending, n = self._state()
        page = transition(pending, "pop", None)
        self._keep(pending, n + (page is not None))
        if pending:
            self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + self.poll_ms)
        yield self._rows([] if page is None else [(key[0], None, page, n + 1)])

    def _state(self) -> tuple[list[int], int]:
        pending = [int(r[0]) for r in self.pages.get()] if self.pages.exists() else []
        return pending, int(self.count.get()[0]) if self.count.exists() else 0

    def _keep(self, pending: list[int], n: int) -> None:
        self.pages.put([(p,) for p in pending]) if pending else self.pages.clear()
        self.count.update((n,))

    @staticmethod
    def _rows(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[c.split()[0] for c in TAKEN.split(", ")]).astype({"doc_id": "int64", "seq": "Int64", "page_idx": "int64", "place": "int64"})

    def close(self) -> None:
        pass


def live(log: DataFrame, poll_ms: int | None = None) -> DataFrame:
    """The same of a stream, in append mode. Rows of a document must arrive in order of seq across triggers. Asks for Spark's RocksDB state store."""
    rows = log.select("doc_id", "seq", "op", "page_idx")
    return rows.groupBy("doc_id").transformWithStateInPandas(Pending(poll_ms), TAKEN, "Append", "None" if poll_ms is None else "ProcessingTime")
