"""Request metrics and idempotency over event streams; each works on a batch table as well."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def request_histogram(events: DataFrame, keys: Sequence[str], value: str, bounds: Sequence[float]) -> DataFrame:
    """Counts, sums and cumulative buckets by key; as a stream, in update mode."""
    buckets = [F.sum(F.when(F.col(value) <= b, 1).otherwise(0)).alias(f"le_{b}") for b in bounds]
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *buckets, F.round(F.sum(value), 4).alias("total"))


def tumbling(events: DataFrame, ts: str, width: str, keys: Sequence[str], value: str, late: str | None = None) -> DataFrame:
    """Counts and sums by window; with ``late``, windows close that long after their end."""
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, ts: str, gap: str, keys: Sequence[str], late: str | None = None) -> DataFrame:
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def once_per_key(requests: DataFrame, key: str, ts: str, ttl: str) -> DataFrame:
    """The first request of each key within its time to live."""
    return requests.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


_OUT = "key string, body string, replayed boolean, conflict boolean"


def idempotent(requests: DataFrame, ttl_ms: int = 3_600_000) -> DataFrame:
    """Requests (``key``, ``body``) answered from state: a repeat with the same body is replayed, with another one a conflict; keys live ``ttl_ms``."""

    def step(key: tuple[str], frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first = state.get[0] if state.exists else None
        for frame in frames:
            rows = []
            for body in frame["body"]:
                rows.append((key[0], body, first is not None and body == first, first is not None and body != first))
                first = body if first is None else first
            yield pd.DataFrame(rows, columns=["key", "body", "replayed", "conflict"])
        if not state.exists:
            state.update((first,))
            state.setTimeoutDuration(ttl_ms)

    from pyspark.sql.streaming.state import GroupStateTimeout

    return requests.groupBy("key").applyInPandasWithState(step, _OUT, "body string", "append", GroupStateTimeout.ProcessingTimeTimeout)
