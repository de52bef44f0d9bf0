"""Queries over event streams that need state, and over endless batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.functions.hashing import bucket
from grainmill.operators import epochs as E
from grainmill.plans.registry import register
from grainmill.plans.shipping import ship
from grainmill.plans.tables import table
from grainmill.plans.workspace import Workspace
from grainmill.streaming import ledger as L
from grainmill.streaming.endless import endless_batches

SHARDS, LATE = 8, "1 hour"
RULES = L.Rules(retention_ms=6 * 3_600_000, capacity=12, max_bytes=2_400, answer_bytes=400)
_SIZE = "CAST(floor(value * 5) AS BIGINT)"

#: One request after the other in each shard; ``live`` holds what its ledger holds.
_WALK = f"""requests AS MATERIALIZED (
  SELECT id, ts, ms, shard, key, digest, size, row_number() OVER (PARTITION BY shard ORDER BY ts, id) AS r FROM (
    SELECT event_id AS id, ts, epoch_ms(ts) AS ms, user_id || '-' || event_type AS key, sha256(substr(props, 1, 7)) AS digest, {_SIZE} AS size,
      CAST('0x' || substr(sha256(user_id || '-' || event_type), 1, 8) AS BIGINT) % {SHARDS} AS shard FROM events)
), walk AS (
  SELECT shard, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS id, '' AS outcome, CAST(0 AS BIGINT) AS n_bytes, CAST([] AS STRUCT(key VARCHAR, expires BIGINT, digest VARCHAR, n BIGINT)[]) AS live FROM requests GROUP BY shard
  UNION ALL
  SELECT shard, r, id, outcome, CASE outcome WHEN 'computed' THEN kept WHEN 'replayed' THEN same[1].n ELSE 0 END,
    CASE outcome WHEN 'computed' THEN list_append(alive, {{'key': key, 'expires': ms + {RULES.retention_ms}, 'digest': digest, 'n': kept}}) ELSE alive END
  FROM (
    SELECT *, CASE WHEN len(same) > 0 THEN CASE WHEN same[1].digest = digest THEN 'replayed' ELSE 'conflict' END WHEN len(alive) >= {RULES.capacity} THEN 'full'
      WHEN coalesce(list_sum(list_transform(alive, lambda x: x.n)), 0) + {max(RULES.answer_bytes, 128)} > {RULES.max_bytes} THEN 'memory' ELSE 'computed' END AS outcome
    FROM (
      SELECT *, list_filter(alive, lambda x: x.key = key) AS same, CASE WHEN size <= {RULES.answer_bytes} THEN size ELSE {RULES.refusal_bytes} END AS kept
      FROM (SELECT q.*, list_filter(w.live, lambda x: x.expires > q.ms) AS alive FROM walk w JOIN requests q ON q.shard = w.shard AND q.r = w.r + 1)
    )
  )
)"""


def _requests(events):
    return L.keyed_requests(events, "ts", "event_id", F.concat_ws("-", F.col("user_id").cast("string"), "event_type"), F.substring("props", 1, 7), F.expr(_SIZE), SHARDS)


@register("request_ledger", f"WITH RECURSIVE {_WALK} SELECT w.id, CAST(w.shard AS INTEGER) AS shard, outcome, n_bytes FROM walk w JOIN requests q ON q.id = w.id WHERE q.ts <= (SELECT max(ts) FROM events) - INTERVAL {LATE}")
def request_ledger(spark, sf_dir):
    """Events as requests of user and type, replayed as a stream: every request that the watermark passed, with its outcome."""
    ship(spark)
    space = Workspace(spark, "ledger")
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")  # a pattern: the source refuses the name of one file
    L.replay(spark, L.settle_stream(_requests(stream), RULES, LATE), space.path("answers"), space.path("checkpoint"))
    return spark.read.schema(L.ANSWERS).parquet(space.path("answers"))


@register("request_outcomes", f"WITH RECURSIVE {_WALK} SELECT CAST(shard AS INTEGER) AS shard, outcome, count(*) AS n, CAST(sum(n_bytes) AS BIGINT) AS n_bytes FROM walk WHERE r > 0 GROUP BY shard, outcome")
def request_outcomes(spark, sf_dir):
    """The same rule over the whole table as a batch: outcomes by shard."""
    ship(spark)
    return L.settle_batch(_requests(table(spark, sf_dir, "events")), RULES).groupBy("shard", "outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("n_bytes"))


BATCH_QUOTAS, EPOCH_SEED, EPOCHS = {"en": 12, "fr": 4, "de": 4, "es": 4}, 21, 2


def _numbered(spark, sf_dir):
    ship(spark)
    return E.number_cells(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", ["doc_id"], Workspace(spark, "cells"))


_QUOTA_VALUES = f"(VALUES {', '.join(map(str, BATCH_QUOTAS.items()))}) AS q (lang, quota)"


def _per_document(rows, epochs: int):
    """Visits of every document in the first epochs, with the least and most rows that a batch took of its language."""
    per_batch = rows.groupBy("lang", "batch").agg(F.count(F.lit(1)).alias("k")).groupBy("lang").agg(F.min("k").alias("least_a_batch"), F.max("k").alias("most_a_batch"))
    visits = rows.where(f"epoch < {epochs}").groupBy("doc_id", "lang").agg(F.count(F.lit(1)).alias("visits"), F.count_distinct("epoch").alias("epochs"))
    return visits.join(F.broadcast(per_batch), "lang").select("doc_id", "lang", "visits", "epochs", "least_a_batch", "most_a_batch")  # a row for each planned language


def _visited(epochs: int) -> str:
    return f"SELECT doc_id, lang, CAST({epochs} AS BIGINT) AS visits, CAST({epochs} AS BIGINT) AS epochs, CAST(quota AS BIGINT) AS least_a_batch, CAST(quota AS BIGINT) AS most_a_batch FROM documents JOIN {_QUOTA_VALUES} USING (lang)"


def _batches_for(sizes, epochs: int) -> int:
    return max(-(-epochs * sizes.get(c, 0) // q) for c, q in BATCH_QUOTAS.items())


@register("epoch_batches", _visited(EPOCHS))
def epoch_batches(spark, sf_dir):
    """Batches with exact quotas until every language has had two epochs: each takes every document once, each batch exactly its quota."""
    numbered, sizes = _numbered(spark, sf_dir)
    rows = E.drawn_rows(E.planned_places(spark, sizes, BATCH_QUOTAS, 0, _batches_for(sizes, EPOCHS), EPOCH_SEED), numbered, "lang")
    return _per_document(Workspace(spark, "batches").table("rows", rows), EPOCHS)


@register("epoch_stream", _visited(1))
def epoch_stream(spark, sf_dir):
    """The same batches as an endless stream, stopped after a third of an epoch and started again from its checkpoint."""
    numbered, sizes = _numbered(spark, sf_dir)
    space = Workspace(spark, "endless")
    last = _batches_for(sizes, 1)
    for until in (max(1, last // 3), last):
        stream = endless_batches(spark, numbered, "lang", sizes, BATCH_QUOTAS, seed=str(EPOCH_SEED), until=str(until), perTrigger=str(max(1, last // 3)))
        query = stream.writeStream.format("parquet").option("path", space.path("rows")).option("checkpointLocation", space.path("checkpoint")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    return _per_document(spark.read.parquet(space.path("rows")), 1)


def _visits(spark, sf_dir):
    ship(spark)
    inventory = table(spark, sf_dir, "conversations").selectExpr("conv_id AS sample", "turn AS row")
    return inventory, E.whole_epochs(inventory, ["sample", "row"], EPOCHS, 2, EPOCH_SEED)


@register("epoch_coverage", f"SELECT count(*) AS rows, {EPOCHS} * count(*) AS visits, true AS covered FROM conversations")
def epoch_coverage(spark, sf_dir):
    """Visits of every turn in two epochs, proved complete by sums."""
    inventory, visits = _visits(spark, sf_dir)
    return E.coverage_proof(inventory, visits, ["sample", "row"], EPOCHS)


_PLANT = "CAST('0x' || substr(sha256(conv_id || '/' || turn), 1, 8) AS BIGINT) % 50"


@register("epoch_differences", f"SELECT conv_id AS sample, turn AS row, {EPOCHS} AS due, {EPOCHS} + CASE {_PLANT} WHEN 0 THEN -1 ELSE 1 END AS visits FROM conversations WHERE {_PLANT} IN (0, 1)")
def epoch_differences(spark, sf_dir):
    """The same visits, some lost and some doubled by a hash: the differing rows by name."""
    inventory, visits = _visits(spark, sf_dir)
    plant = bucket(F.concat_ws("/", "sample", "row"), 50)
    damaged = visits.where((plant != 0) | (F.col("epoch") != 1)).withColumn("twice", F.explode(F.when((plant == 1) & (F.col("epoch") == 0), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return E.coverage_differences(inventory, damaged.drop("twice"), ["sample", "row"], EPOCHS)


@register("quota_differences", "WITH plan AS (SELECT lang, source, count(*) AS planned FROM documents GROUP BY ALL), kept AS (SELECT lang, source, count(*) AS found FROM documents JOIN labels USING (doc_id) GROUP BY ALL) SELECT lang, source, planned, coalesce(found, 0) AS found FROM plan LEFT JOIN kept USING (lang, source) WHERE planned <> coalesce(found, 0)")
def quota_differences(spark, sf_dir):
    """Labelled documents against a plan that wants all: the cells that fall short."""
    docs = table(spark, sf_dir, "documents")
    plan = docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("planned"))
    return E.quota_differences(docs.join(table(spark, sf_dir, "labels"), "doc_id"), plan, ["lang", "source"])
