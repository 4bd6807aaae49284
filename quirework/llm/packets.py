"""Supersteps: work in bundles that send one another packed arrays.

A table has rows of one shape: each goes to a bundle, is of a kind, says which
bundle sent it, and holds up to six packed arrays. In a superstep the table is
grouped by bundle, which is one exchange; the work of a bundle gets all its rows
and returns rows for any bundles, its own state among them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch

PARTS = ("a", "b", "c", "d", "e", "f")
ROW = "bundle int, kind int, source int, n int, " + ", ".join(f"{p} binary" for p in PARTS) + ", count long"
ARROW = pa.schema([(c, pa.int32()) for c in ("bundle", "kind", "source", "n")] + [(p, pa.binary()) for p in PARTS] + [("count", pa.int64())])


def row(bundle: int, kind: int, n: int, *parts: bytes | np.ndarray, source: int = 0, count: int = 0) -> tuple:
    packed = [p if isinstance(p, bytes) else np.ascontiguousarray(p).tobytes() for p in parts]
    return int(bundle), kind, int(source), int(n), *packed, *[b""] * (len(PARTS) - len(parts)), int(count)


def send(kind: int, dest: np.ndarray, *parts: np.ndarray, source: int = 0) -> list[tuple]:
    """One message for each destination, of the rows of parts that go there."""
    if not len(dest):
        return []
    order = np.argsort(dest, kind="stable")
    dest, parts = dest[order], [p[order] for p in parts]
    start = np.flatnonzero(np.r_[True, dest[1:] != dest[:-1]])
    return [row(dest[low], kind, high - low, *(p[low:high] for p in parts), source=source) for low, high in zip(start, np.r_[start[1:], len(dest)], strict=True)]


def table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * len(ARROW)
    return pa.table({f.name: pa.array(c, f.type) for f, c in zip(ARROW, columns, strict=True)}, schema=ARROW)


class Inbox:
    """The rows of one bundle, by kind, and of each kind by their source."""

    def __init__(self, rows: pa.Table):
        found = rows.to_pylist()
        self.bundle = found[0]["bundle"] if found else None
        self.rows: dict[int, list[dict]] = {}
        for r in sorted(found, key=lambda r: (r["kind"], r["source"])):
            self.rows.setdefault(r["kind"], []).append(r)

    def of(self, kind: int, part: str, dtype: type, width: int = 0) -> np.ndarray:
        out = np.frombuffer(b"".join(r[part] for r in self.rows.get(kind, ())), dtype)
        return out.reshape(-1, width) if width else out

    def kept(self, *kinds: int) -> list[tuple]:
        return [tuple(r[f] for f in ARROW.names) for k in kinds for r in self.rows.get(k, ())]


def superstep(rows: DataFrame, work: Callable[[Inbox], list[tuple]]) -> DataFrame:
    return rows.groupBy("bundle").applyInArrow(lambda group: table(work(Inbox(group))), ROW)


def write(scratch: Scratch, rows: DataFrame, name: str) -> Callable[..., DataFrame]:
    """Writes the table, each kind by itself. Returns what reads some kinds of it."""
    scratch.write(rows, name, ["kind"])
    back = scratch.spark.read.schema(ROW).parquet(scratch.path(name)).select(*ARROW.names)
    return lambda *kinds: back.filter(F.col("kind").isin(*kinds))
