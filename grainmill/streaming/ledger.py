"""Idempotent requests with a bounded ledger: as a stream with event-time state, and as a batch with the same answers.

Requests are dealt by key to shards. A shard answers its requests in the order of event
time (then id), whatever order they arrive in: a request waits in state until
the watermark has passed it, and timers wake the shard then. Answers are kept for a
retention period; a live key is never evicted, so a full ledger refuses new keys
instead. Both the number of live keys and their bytes are bounded for each shard.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched, count, groupby, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from grainmill.functions.hashing import bucket

#: What becomes of a request.
COMPUTED, REPLAYED, CONFLICT, FULL, MEMORY, INVALID = "computed", "replayed", "conflict", "full", "memory", "invalid"
ANSWERS = "id long, shard int, outcome string, n_bytes long"
_LIVE = "expires long, digest string, n_bytes long"
#: Requests that wait are kept by slices of event time of this length.
SLICE_MS = 6 * 3_600_000
#: Requests that a task sorts in memory as they arrive, and those of one value of the state.
HOLD_ROWS, PIECE_ROWS = 100_000, 5_000
_HELD = pa.schema([("micros", pa.int64()), ("id", pa.int64()), ("key", pa.string()), ("digest", pa.string()), ("size", pa.int64())])


@dataclass(frozen=True)
class Rules:
    """Retention, and bounds of one shard's ledger; an answer above ``answer_bytes`` is replaced by a short refusal."""

    retention_ms: int = 3_600_000
    capacity: int = 8_192
    max_bytes: int = 64 << 20
    answer_bytes: int = 2 << 20
    refusal_bytes: int = 55


class Ledger:
    """What one shard holds, in order of expiry: expiry, digest and bytes by key."""

    def __init__(self, rules: Rules, live: dict[str, tuple[int, str, int]] | None = None) -> None:
        self.rules = rules
        self.live = dict(sorted((live or {}).items(), key=lambda e: e[1][0]))
        self.used = sum(v[2] for v in self.live.values())

    def answer(self, now: int, key: str | None, digest: str, size: int) -> tuple[str, int]:
        """Outcome and bytes of the answer; requests come in the order of time, so the oldest entries expire first."""
        rules, live = self.rules, self.live
        if key is None or not 1 <= len(key) <= 128 or not all("!" <= c <= "~" for c in key):
            return INVALID, 0
        while live:
            oldest = next(iter(live))
            if now < live[oldest][0]:
                break
            self.used -= live.pop(oldest)[2]
        if key in live:
            _, before, kept = live[key]
            return (REPLAYED, kept) if before == digest else (CONFLICT, 0)
        if len(live) >= rules.capacity:
            return FULL, 0
        if self.used + max(rules.answer_bytes, 128) > rules.max_bytes:
            return MEMORY, 0
        kept = size if size <= rules.answer_bytes else rules.refusal_bytes
        live[key] = (now + rules.retention_ms, digest, kept)
        self.used += kept
        return COMPUTED, kept


def keyed_requests(requests: DataFrame, ts: str, id_: str, key: str | Column, body: str | Column, size: str | Column, shards: int) -> DataFrame:
    """``shard``, ``ts``, ``id``, ``key``, ``digest`` of the body and ``size`` of the answer that computing would give; null bodies are empty."""
    column = lambda c: F.col(c) if isinstance(c, str) else c
    rows = requests.select(F.col(ts).cast("timestamp").alias("ts"), F.col(id_).cast("long").alias("id"), column(key).cast("string").alias("key"), F.sha2(F.coalesce(column(body).cast("string"), F.lit("")), 256).alias("digest"), F.coalesce(column(size).cast("long"), F.lit(0)).alias("size"))
    return rows.withColumn("shard", bucket(F.coalesce("key", F.lit("")), shards))


def settle_batch(keyed: DataFrame, rules: Rules) -> DataFrame:
    """Answers of a table of requests; a shard's rows pass as a stream in order, and only its ledger is held."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, ledger = None, Ledger(rules)
        for frame in frames:
            out = []
            for s, now, i, key, digest, size in zip(frame["shard"], frame["at"], frame["id"], frame["key"], frame["digest"], frame["size"], strict=True):
                if s != shard:
                    shard, ledger = s, Ledger(rules)
                out.append((i, s, *ledger.answer(now, key, digest, size)))
            yield pd.DataFrame(out, columns=["id", "shard", "outcome", "n_bytes"])

    rows = keyed.where("ts IS NOT NULL").withColumn("at", F.unix_millis("ts"))
    return rows.repartition("shard").sortWithinPartitions("shard", "ts", "id").mapInPandas(run, ANSWERS)


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _HELD, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


class _Settler(StatefulProcessor):
    """Requests wait as sorted runs by slice of event time, in pieces; a slice's timer merges its runs piece by piece.

    So a task holds ``hold_rows`` requests as they arrive, and later one piece of each run of one slice, however many wait.
    """

    def __init__(self, rules: Rules, slice_ms: int = SLICE_MS, hold_rows: int = HOLD_ROWS, piece_rows: int = PIECE_ROWS) -> None:
        self.rules, self.slice_ms, self.hold_rows, self.piece_rows = rules, slice_ms, hold_rows, piece_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slice long, run long, piece long", "rows binary")
        # of each slice: its first request's time, for which there is a timer, and the range of its runs
        self.runs = handle.getMapState("runs", "slice long", "first long, low long, high long")
        self.live = handle.getMapState("live", "key string", _LIVE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for frame in rows:
            held.append(pa.Table.from_pandas(frame[_HELD.names], schema=_HELD, preserve_index=False))
            n += len(frame)
            if n >= self.hold_rows:
                self._hold(pa.concat_tables(held))
                held, n = [], 0
        if n:
            self._hold(pa.concat_tables(held))
        yield _answers([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        slice_ = expiredTimerInfo.getExpiryTimeInMs() // self.slice_ms
        known = self.runs.getValue((slice_,))
        if known is None or known[0] > passed:
            return
        _, low, high = known
        before = {k[0]: tuple(v) for k, v in self.live.iterator()}
        ledger, first = Ledger(self.rules, before), None
        merged = heapq.merge(*(self._taken(slice_, run) for run in range(low, high)), key=lambda r: (r[0], r[1] is not None, r[1]))
        for due, rows in groupby(merged, key=lambda r: r[0] // 1000 <= passed):
            for piece, part in enumerate(batched(rows, self.piece_rows)):
                if due:
                    yield _answers([(i, key[0], *ledger.answer(micros // 1000, name, digest, size)) for micros, i, name, digest, size in part])
                else:
                    first = part[0][0] // 1000 if first is None else first
                    columns = [pa.array(c, t) for c, t in zip(zip(*part, strict=True), _HELD.types, strict=True)]
                    self.waiting.updateValue((slice_, high, piece), (_packed(pa.table(columns, schema=_HELD)),))
        if first is None:
            self.runs.removeKey((slice_,))
        else:
            self.runs.updateValue((slice_,), (first, high, high + 1))
            self.handle.registerTimer(first)
        for name in before.keys() - ledger.live.keys():
            self.live.removeKey((name,))
        for name, entry in ledger.live.items():
            if before.get(name) != entry:
                self.live.updateValue((name,), entry)

    def _hold(self, rows: pa.Table) -> None:
        """Add a sorted run to each slice that the rows fall in, and see to its timer."""
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("micros", "ascending"), ("id", "ascending")], null_placement="at_start")).combine_chunks()
        micros = rows["micros"].to_numpy()
        slices = micros // (1000 * self.slice_ms)
        starts = [0, *(np.flatnonzero(np.diff(slices)) + 1).tolist(), len(rows)]
        for start, stop in pairwise(starts):
            slice_, first = int(slices[start]), int(micros[start]) // 1000
            known = self.runs.getValue((slice_,))
            least, low, high = known or (first, 0, 0)
            for piece, at in enumerate(range(start, stop, self.piece_rows)):
                self.waiting.updateValue((slice_, high, piece), (_packed(rows.slice(at, min(self.piece_rows, stop - at))),))
            if known is None or first < least:
                self.handle.registerTimer(first)
            self.runs.updateValue((slice_,), (min(first, least), low, high + 1))

    def _taken(self, slice_: int, run: int) -> Iterator[tuple]:
        """Requests of a run in order; each piece leaves the state as it is read."""
        for piece in count():
            found = self.waiting.getValue((slice_, run, piece))
            if found is None:
                return
            self.waiting.removeKey((slice_, run, piece))
            with pa.ipc.open_stream(bytes(found[0])) as stream:
                yield from zip(*(c.to_pylist() for c in stream.read_all().columns), strict=True)

    def close(self) -> None:
        pass


def _answers(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["id", "shard", "outcome", "n_bytes"]).astype({"id": "Int64", "shard": "int32", "outcome": "object", "n_bytes": "int64"})


def settle_stream(keyed: DataFrame, rules: Rules, late: str) -> DataFrame:
    """Answers of a stream of requests once the watermark, ``late`` behind the latest event time, has passed them.

    Requests that arrive later than that are dropped. Needs a state store that keeps lists and maps (RocksDB).
    """
    rows = keyed.where("ts IS NOT NULL").withWatermark("ts", late).withColumn("micros", F.unix_micros("ts"))
    return rows.groupBy("shard").transformWithStateInPandas(_Settler(rules), ANSWERS, "append", "EventTime")


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def replay(spark, stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over all that is there and append its rows to Parquet at ``path``."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)
