"""Token buckets and circuit breakers over events, in batch and as streams, by one fold each.

A key's state is a few numbers; a stream keeps it in Spark's state store and forgets keys that are idle. In batch a key's events
are folded in order of time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BUCKET_STATE = "tokens double, at double"
BREAKER_STATE = "failures int, paused_until double"


def take(state: tuple[float, float] | None, at: float, capacity: float, per_second: float) -> tuple[tuple[float, float], bool]:
    """A bucket after one request at a time in seconds, and whether it let the request pass."""
    tokens, last = state or (capacity, at)
    tokens = min(capacity, tokens + max(0.0, at - last) * per_second)
    return ((tokens - 1, at), True) if tokens >= 1 else ((tokens, at), False)


def record(state: tuple[int, float] | None, at: float, failed: bool, gone: bool, most: int = 5, pause: float = 7 * 86_400) -> tuple[int, float]:
    """A source's consecutive failures and until when it is paused, after one outcome; a success clears both."""
    failures, until = state or (0, 0.0)
    if not failed:
        return 0, 0.0
    failures += 1
    return failures, at + pause if gone or failures >= most else until


def limited(events: DataFrame, key: str, at: str, id: str, capacity: float, per_second: float) -> DataFrame:
    """id, key and `ok` of every event of a batch."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        state, out = None, []
        rows = rows.sort_values(["at", "id"], kind="stable")
        for t in rows["at"]:
            state, ok = take(state, t.timestamp(), capacity, per_second)
            out.append(ok)
        return pd.DataFrame({"id": rows["id"], "key": rows["key"], "ok": out})

    read = events.selectExpr(f"cast({id} as long) as id", f"cast({key} as string) as key", f"cast({at} as timestamp) as at")
    return read.groupBy("key").applyInPandas(fold, "id long, key string, ok boolean")


def limited_stream(events: DataFrame, key: str, at: str, id: str, capacity: float, per_second: float, idle: str = "1 hour") -> DataFrame:
    """The same for a stream. A key without events for `idle` of event time is forgotten; events that come later than that are dropped.

    Choose `idle` no shorter than a bucket takes to fill, so that forgetting a key changes nothing.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get if state.exists else None
        for rows in batches:
            rows, out = rows.sort_values(["at", "id"], kind="stable"), []
            for t in rows["at"]:
                now, ok = take(now, t.timestamp(), capacity, per_second)
                out.append(ok)
            yield pd.DataFrame({"id": rows["id"], "key": rows["key"], "ok": out})
        if now:
            state.update(now)
            state.setTimeoutTimestamp(int(now[1] * 1000) + idle_ms)

    read = events.selectExpr(f"cast({id} as long) as id", f"cast({key} as string) as key", f"cast({at} as timestamp) as at").withWatermark("at", idle)
    return read.groupBy("key").applyInPandasWithState(fold, "id long, key string, ok boolean", BUCKET_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def breaker_stream(outcomes: DataFrame, key: str, at: str, failed: str, gone: str = "false", most: int = 5) -> DataFrame:
    """The state of each source after every micro-batch: key, consecutive_failures, status."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, last = (state.get if state.exists else None), 0.0
        for rows in batches:
            for row in rows.sort_values("at", kind="stable").itertuples():
                last = row.at.timestamp()
                now = record(now, last, bool(row.failed), bool(row.gone), most)
        failures, until = now or (0, 0.0)
        state.update((failures, until))
        yield pd.DataFrame({"key": [key[0]], "consecutive_failures": [failures], "status": ["paused" if until > last else "error" if failures else "ok"]})

    read = outcomes.selectExpr(f"cast({key} as string) as key", f"cast({at} as timestamp) as at", f"{failed} as failed", f"{gone} as gone")
    return read.groupBy("key").applyInPandasWithState(fold, "key string, consecutive_failures int, status string", BREAKER_STATE, "update", GroupStateTimeout.NoTimeout)
