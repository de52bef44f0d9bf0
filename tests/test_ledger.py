"""The ledger as a stream, in any order of arrival, equals the batch and a plain walk."""

import hashlib
import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone
from types import SimpleNamespace

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grainmill.functions.hashing import bucket
from grainmill.streaming import ledger as L

RULES = L.Rules(retention_ms=60_000, capacity=5, max_bytes=450, answer_bytes=150)
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def requests():
    random.seed(13)
    rows = []
    for i in range(400):
        at = START + timedelta(milliseconds=random.choice([250, 1000]) * random.randrange(2000))
        rows.append((i, at, random.choice([None, "", "bad key", "é", "x" * 129, *[f"k{n}" for n in range(40)]]), random.choice([None, "a", "a", "b"]), random.choice([None, 10, 90, 150, 151, 900])))
    return rows


def walk(rows, shard_of):
    """Every request by time, without a ledger class: expiry, bodies and bounds checked from a plain list."""
    out, live = {}, defaultdict(list)
    for i, at, key, body, size in sorted(rows, key=lambda r: (r[1], r[0])):
        if key is None or not 1 <= len(key) <= 128 or any(not 33 <= ord(c) <= 126 for c in key):
            out[i] = ("invalid", 0)
            continue
        now, digest, size = at.timestamp(), hashlib.sha256((body or "").encode()).hexdigest(), size or 0
        held = live[shard_of[key]] = [e for e in live[shard_of[key]] if now < e[1]]
        mine = [e for e in held if e[0] == key]
        if mine:
            out[i] = ("replayed", mine[0][3]) if mine[0][2] == digest else ("conflict", 0)
        elif len(held) >= 5:
            out[i] = ("full", 0)
        elif sum(e[3] for e in held) + 150 > 450:
            out[i] = ("memory", 0)
        else:
            kept = size if size <= 150 else 55
            held.append((key, now + 60, digest, kept))
            out[i] = ("computed", kept)
    return out


@pytest.fixture(scope="module")
def case(spark):
    rows = requests()
    df = spark.createDataFrame(rows, "id long, ts timestamp, key string, body string, size long")
    keys = spark.createDataFrame([(k,) for k in {r[2] for r in rows if r[2]}], "key string")
    shards = {r["key"]: r["s"] for r in keys.select("key", bucket("key", 3).alias("s")).collect()}
    return rows, df, walk(rows, shards)


def keyed(df):
    return L.keyed_requests(df, "ts", "id", "key", "body", "size", 3)


def test_batch_equals_walk(case):
    rows, df, want = case
    got = {r["id"]: (r["outcome"], r["n_bytes"]) for r in L.settle_batch(keyed(df.repartition(5)), RULES).collect()}
    assert got == want and {o for o, _ in got.values()} == {"computed", "replayed", "conflict", "full", "memory", "invalid"}
    assert L.settle_batch(keyed(df.limit(0)), RULES).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_in_any_order_equals_batch(spark, tmp_path, case, seed):
    """Several files, one a micro-batch, in shuffled order; a last request far later lets the watermark pass all."""
    rows, df, want = case
    random.seed(seed)
    shuffled = random.sample(rows, len(rows))
    end = (10_000, START + timedelta(days=3), "last", "", 0)
    for n, part in enumerate([shuffled[:150], shuffled[150:160], shuffled[160:], [end]]):
        spark.createDataFrame(part, df.schema).coalesce(1).write.parquet(str(tmp_path / "staged" / f"{n}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        (file,) = (tmp_path / "staged" / f"{n}").glob("*.parquet")
        file.rename(tmp_path / "in" / f"{n}.parquet")
        import os

        os.utime(tmp_path / "in" / f"{n}.parquet", (1e9 + n, 1e9 + n))  # the source reads old files first
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    L.replay(spark, L.settle_stream(keyed(stream), RULES, "1 day"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = {r["id"]: (r["outcome"], r["n_bytes"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want


def test_null_times_are_left_out(spark):
    df = spark.createDataFrame([(1, None, "k", "a", 5)], "id long, ts timestamp, key string, body string, size long")
    assert L.settle_batch(keyed(df), RULES).count() == 0 and keyed(df).where(F.col("shard").isNull()).count() == 0


class Cells(dict):
    """A map state that notes the most rows of waiting requests that one value has held."""

    most = 0

    def updateValue(self, key, value):
        if isinstance(value[0], bytes):
            Cells.most = max(Cells.most, pa.ipc.open_stream(value[0]).read_all().num_rows)
        self[key] = value

    def getValue(self, key):
        return self.get(key)

    def removeKey(self, key):
        del self[key]

    def iterator(self):
        return iter(list(self.items()))


class Handle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def getMapState(self, name, key, value):
        return self.states.setdefault(name, Cells())

    def registerTimer(self, at):
        self.timers.add(at)


def test_state_keeps_small_sorted_pieces(case):
    """No value holds more than a piece of the requests that wait, a watermark inside a slice keeps the rest of it, all answers are the walk's."""
    rows, _, want = case
    random.seed(3)
    frame = pd.DataFrame([(int((at - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1)), i, k, hashlib.sha256((b or "").encode()).hexdigest(), z or 0) for i, at, k, b, z in random.sample(rows, len(rows))], columns=["micros", "id", "key", "digest", "size"])
    settler, handle, got = L._Settler(RULES, 700_000, 60, 7), Handle(), []
    settler.init(handle)
    list(settler.handleInputRows((0,), (frame.iloc[n : n + 20] for n in range(0, len(frame), 20)), None))
    assert 0 < Cells.most <= 7 and len(handle.states["waiting"]) >= len(rows) / 7
    for passed in [int(frame["micros"].median()) // 1000, 1 << 50]:
        while due := sorted(t for t in handle.timers if t <= passed):
            handle.timers.remove(due[0])
            for part in settler.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: passed), SimpleNamespace(getExpiryTimeInMs=lambda: due[0])):
                assert len(part) <= 7
                got += [(r.id, (r.outcome, r.n_bytes)) for r in part.itertuples()]
    assert not handle.states["waiting"] and not handle.states["runs"] and Cells.most <= 7
    one = walk(rows, defaultdict(int))
    assert len(got) == len(rows) and dict(got) == one and one.keys() == want.keys()
    order = [r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]))]
    assert [i for i, _ in got] == order
