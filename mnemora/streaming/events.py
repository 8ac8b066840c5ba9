"""Structured Streaming forms of the event operators.

Each takes and gives streaming DataFrames; state is bounded by the watermark.
``file_stream`` reads parquet or JSON files as they arrive, a few per trigger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from mnemora.operators.late_events import PaneStore
from mnemora.operators.sessions import SessionTable


def file_stream(spark: SparkSession, path: str, schema: StructType | str, *, kind: str = "parquet", files: int = 8) -> DataFrame:
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files).load(path)


def hourly_counts(events: DataFrame, *, at: str = "ts", by: str = "event_type", late: str = "1 hour") -> DataFrame:
    """Tumbling hours with a watermark; rows later than that are dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, "1 hour"), by).agg(F.count("*").alias("n"))


def user_sessions(events: DataFrame, *, at: str = "ts", by: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions by inactivity, given once the watermark has passed their end."""
    w = F.session_window(at, gap)
    return events.withWatermark(at, late).groupBy(w, by).agg(F.count("*").alias("events"))


def once(events: DataFrame, keys: list[str], *, at: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark: conversions once per session."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def rate_limit(events: DataFrame, *, key: str, at: str, most: int, seconds: int, late: str = "1 hour") -> DataFrame:
    """(key, at, allowed) by a sliding window of accepted requests.

    A key's state is at most ``most`` times, and goes once the watermark has
    passed the last of them by the window; rows later than ``late`` are dropped.
    """

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        taken = list(state.get[0]) if state.exists else []
        for p in parts:
            p = p.sort_values(at, kind="stable")
            allowed = []
            for t in p[at].astype("datetime64[us]").astype("int64"):
                taken = [x for x in taken if x > t - seconds * 1_000_000]
                allowed.append(len(taken) < most)
                if allowed[-1]:
                    taken.append(int(t))
            yield pd.DataFrame({key: [k[0]] * len(p), at: p[at].to_numpy(), "allowed": allowed})
        state.update((taken,))
        state.setTimeoutTimestamp(max(max(taken) // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    f = {x.name: x.dataType.simpleString() for x in events.schema}
    out = f"`{key}` {f[key]}, `{at}` {f[at]}, allowed boolean"
    return events.select(key, at).withWatermark(at, late).groupBy(key).applyInPandasWithState(step, out, "taken array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def circuit_breaker(calls: DataFrame, *, key: str, at: str, failed: str, failures: int = 5, cooldown: int = 30, latency: str | None = None, slow: float = 1e9, violations: int = 3, late: str = "1 hour") -> DataFrame:
    """(key, at, state): closed, open after so many failures in a row or, where ``latency`` is named, so many calls over ``slow`` in a row, half-open once the cool-down has passed.

    A key's state goes when the watermark has passed its last call by an hour and the cool-down.
    """

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, over, opened = state.get if state.exists else (0, 0, 0)
        last = 0
        for p in parts:
            p = p.sort_values(at, kind="stable")
            out = []
            times = p[at].astype("datetime64[us]").astype("int64")
            last = max(last, int(times.max())) if len(p) else last
            for t, bad, ms in zip(times, p[failed], p[latency] if latency else [0.0] * len(p)):
                now = "closed"
                if opened:
                    now = "half_open" if t - opened >= cooldown * 1_000_000 else "open"
                if now != "open":
                    n, over = n + 1 if bad else 0, over + 1 if ms > slow else 0
                    opened = int(t) if (bad and (now == "half_open" or n >= failures)) or over >= violations else 0
                out.append(now)
            yield pd.DataFrame({key: [k[0]] * len(p), at: p[at].to_numpy(), "state": out})
        state.update((n, over, opened))
        state.setTimeoutTimestamp(max(last // 1000 + (3600 + cooldown) * 1000, state.getCurrentWatermarkMs() + 1))

    f = {x.name: x.dataType.simpleString() for x in calls.schema}
    out = f"`{key}` {f[key]}, `{at}` {f[at]}, state string"
    columns = [key, at, failed, *([latency] if latency else [])]
    return calls.select(*columns).withWatermark(at, late).groupBy(key).applyInPandasWithState(step, out, "n int, over int, opened bigint", "append", GroupStateTimeout.EventTimeTimeout)


def into_panes(events: DataFrame, path: str, checkpoint: str, *, emit: Callable[[DataFrame, int], Any] | None = None, **rule):
    """Feed a stream of log rows to a ``PaneStore``; ``emit`` gets the windows each batch changed."""
    store = PaneStore(events.sparkSession, path, **rule)

    def apply(batch: DataFrame, number: int) -> None:
        windows = store.apply(batch, number)
        if emit:
            emit(windows, number)

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def into_sessions(events: DataFrame, path: str, checkpoint: str):
    """Feed a stream of log rows to a ``SessionTable``; ids seen before are not counted again, so a batch may be repeated."""
    table = SessionTable(events.sparkSession, path)
    return events.writeStream.foreachBatch(lambda batch, _: table.apply(batch) and None).option("checkpointLocation", checkpoint)
