"""The undo stack as a stateful stream: one state for each document, fed by the command log.

Commands of a document must arrive in order of seq across triggers, as a log
keyed by document delivers them; within a trigger they are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "done array<bigint>, undone array<bigint>"
OUTPUT = "doc_id bigint, done array<bigint>, undone array<bigint>"


def fold(done: list[int], undone: list[int], log: pd.DataFrame) -> tuple[list[int], list[int]]:
    """The stack after some more commands (seq, op)."""
    done, undone = list(done), list(undone)
    for seq, op in log.sort_values("seq")[["seq", "op"]].itertuples(index=False):
        if op == "undo":
            if done:
                undone.append(done.pop())
        elif op == "redo":
            if undone:
                done.append(undone.pop())
        else:
            done.append(int(seq))
            undone = []
    return done, undone


def live(log: DataFrame) -> DataFrame:
    """log: a stream of (doc_id, seq, op). In update mode, each document's stack after a trigger that touched it."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, undone = state.get if state.exists else ([], [])
        done, undone = fold(done, undone, pd.concat(list(batches)))
        state.update((done, undone))
        yield pd.DataFrame({"doc_id": [key[0]], "done": [done], "undone": [undone]})

    return log.select("doc_id", "seq", "op").groupBy("doc_id").applyInPandasWithState(step, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)
