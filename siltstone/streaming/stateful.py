"""Stateful streams: debouncing and retries per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def debounce_stream(events: DataFrame, seconds: float) -> DataFrame:
    """As ``operators.chunks.debounce``: the state of a (user, type) is the time of its last kept event.

    Within a micro-batch a key's events are taken in time order; an event older than the last kept one
    counts as too close and goes.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        last = state.get[0] if state.exists else None
        kept = []
        for i, t in zip(rows["event_id"], rows["ts"].astype("int64") // 1000):
            if last is None or t - last >= seconds * 1_000_000:
                kept.append(i)
                last = t
        state.update((last,))
        yield pd.DataFrame({"event_id": kept})

    rows = events.selectExpr("user_id", "event_type", "event_id", "CAST(ts AS TIMESTAMP) AS ts")
    return rows.groupBy("user_id", "event_type").applyInPandasWithState(fold, "event_id long", "last long", "append", GroupStateTimeout.NoTimeout)


def retry_stream(attempts: DataFrame, most: int = 5) -> DataFrame:
    """(task_id, failures, status) after each batch of attempts (task_id, ok): Done, Retrying or, after ``most`` failures, DeadLetter."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, status = state.get if state.exists else (0, "Pending")
        for ok in (x for b in batches for x in b["ok"]):
            if status not in ("Done", "DeadLetter"):
                failures += not ok
                status = "Done" if ok else "DeadLetter" if failures >= most else "Retrying"
        state.update((failures, status))
        yield pd.DataFrame({"task_id": [key[0]], "failures": [failures], "status": [status]})

    return attempts.groupBy("task_id").applyInPandasWithState(fold, "task_id long, failures long, status string", "failures long, status string", "update", GroupStateTimeout.NoTimeout)
