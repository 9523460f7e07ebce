"""Keyed state on streams: the last command of each session, and a cache's hits.

Both keep one small row for each key and forget it after its time to live,
counted in event time, so reruns give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _seconds(ts: pd.Series) -> list[int]:
    return (ts.astype("datetime64[us, UTC]").astype("int64") // 1_000_000).tolist() if getattr(ts.dtype, "tz", None) is not None else (ts.astype("datetime64[us]").astype("int64") // 1_000_000).tolist()


def session_commands(events: DataFrame, ttl_s: int, late: str = "1 hour") -> DataFrame:
    """(session_id, ts, pos, command, known) for events (session_id, ts, pos, command): known is the session's command before the event.

    An event with a command sets it; one without only asks.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        command, at = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "pos"], kind="stable")
        known = []
        for t, c in zip(_seconds(rows["ts"]), rows["command"], strict=True):
            known.append(command if command is not None and t - at <= ttl_s else None)
            if isinstance(c, str):
                command, at = c, t
        if command is not None:
            state.update((command, at))
            state.setTimeoutTimestamp(max((at + ttl_s + 1) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"session_id": key[0], "ts": rows["ts"], "pos": rows["pos"], "command": rows["command"], "known": pd.Series(known, dtype=object, index=rows.index)})

    kind = events.schema["session_id"].dataType.simpleString()
    grouped = events.select("session_id", "ts", "pos", "command").withWatermark("ts", late).groupBy("session_id")
    return grouped.applyInPandasWithState(step, f"session_id {kind}, ts timestamp, pos long, command string, known string", "command string, at long", "append", GroupStateTimeout.EventTimeTimeout)


def cache_hits(uses: DataFrame, ttl_s: int, late: str = "1 hour") -> DataFrame:
    """(key, ts, is_hit) for uses (key, ts): the key was used at most ttl_s before; each use renews it.

    The cache has no other limit: what a number of entries would push out
    depends on all keys together, which a keyed stream doesn't see.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        hits = []
        for t in _seconds(rows["ts"]):
            hits.append(last is not None and t - last <= ttl_s)
            last = t
        state.update((last,))
        state.setTimeoutTimestamp(max((last + ttl_s + 1) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": key[0], "ts": rows["ts"], "is_hit": hits})

    kind = uses.schema["key"].dataType.simpleString()
    grouped = uses.select("key", "ts").withWatermark("ts", late).groupBy("key")
    return grouped.applyInPandasWithState(step, f"key {kind}, ts timestamp, is_hit boolean", "last long", "append", GroupStateTimeout.EventTimeTimeout)
