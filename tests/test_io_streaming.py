import pytest
from pyspark.sql import functions as F

from grainmill.plans.tables import table
from grainmill.sources import io
from grainmill.streaming import requests as R


def test_sources_and_resume(spark, data, tmp_path):
    ok = io.Source("docs", f"{data}/documents.parquet", where={"lang": ["en"]}, limit=5)
    assert io.read_source(spark, ok, id_col="doc_id").count() == 5
    pools, manifest = io.load_all(spark, [ok, io.Source("gone", str(tmp_path / "none"))], {"docs": lambda d: d.select("doc_id"), "gone": lambda d: d})
    assert {r.dataset_id: r.status for r in manifest.collect()} == {"docs": "loaded", "gone": "failed"} and pools.count() == 5
    planned = spark.range(6).withColumn("bind", F.lit("x"))
    out = str(tmp_path / "out")
    io.append_missing(planned.where("id < 3"), out, "id", lambda d: d, "bind")
    io.append_missing(planned, out, "id", lambda d: d, "bind")
    assert spark.read.parquet(out).count() == 6
    assert io.file_hashes(spark, out + "/*.parquet").count() >= 1
    roles = io.write_splits(planned.withColumn("role", F.when(F.col("id") < 2, "a").otherwise("b")), str(tmp_path / "split"))
    assert {r.role: r.rows for r in roles.collect()} == {"a": 2, "b": 4}


def test_sinks_tell_repeats_and_broken_outputs(spark, tmp_path):
    rows = spark.range(2).select("id", F.lit("a").alias("role"))
    once = io.write_splits(rows, str(tmp_path / "once")).first()
    twice = io.write_splits(rows.union(rows), str(tmp_path / "twice")).first()
    none = io.write_splits(rows.where("id < 1").union(rows.where("id < 1")), str(tmp_path / "pair")).first()
    assert len({once.content, twice.content, none.content, "0"}) == 4 and int(twice.content) == 2 * int(once.content)
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception, match="(?i)parquet|footer|read"):
        io.append_missing(spark.range(1), str(broken), "id", lambda d: d)
    assert [p.name for p in broken.iterdir()] == ["part-0.parquet"]


def test_a_source_that_breaks_while_read_leaves_the_others(spark, data, tmp_path):
    bad = tmp_path / "bad"
    bad.mkdir()
    spark.range(3).selectExpr("id AS doc_id").write.parquet(str(bad / "ok"))
    for f in (bad / "ok").glob("part-*.parquet"):
        whole = f.read_bytes()
        f.write_bytes(whole[:4] + b"\xff" * (len(whole) // 2) + whole[4 + len(whole) // 2 :])
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    sources = [io.Source("bad", str(bad / "ok")), io.Source("docs", f"{data}/documents.parquet", limit=4, oversample=3)]
    pools, manifest = io.load_all(spark, sources, {"bad": lambda d: d, "docs": lambda d: d.select("doc_id")})
    assert {r.dataset_id: r.status for r in manifest.collect()} == {"bad": "failed", "docs": "loaded"} and pools.count() == 4


def test_stream_equals_batch(spark, data, tmp_path):
    events = table(spark, data, "events")
    events.limit(500).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = R.request_histogram(stream, ["event_type"], "value", (10, 50)).writeStream.outputMode("complete").format("memory").queryName("hist").trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = R.request_histogram(spark.read.parquet(str(tmp_path / "in")), ["event_type"], "value", (10, 50))
    assert sorted(map(tuple, spark.table("hist").collect())) == sorted(map(tuple, want.collect()))


def test_idempotent_state(spark, tmp_path):
    rows = spark.createDataFrame([("k", "a"), ("k", "a"), ("k", "b"), ("j", "z")], "key string, body string").coalesce(1)
    rows.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, body string").json(str(tmp_path / "in"))
    q = R.idempotent(stream).writeStream.outputMode("append").format("memory").queryName("idem").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = sorted((r.key, r.replayed, r.conflict) for r in spark.table("idem").collect())
    assert got == [("j", False, False), ("k", False, False), ("k", False, True), ("k", True, False)]
