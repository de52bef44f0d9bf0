"""Queries that turn rows into canonical samples, and samples into records."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.plans.registry import register
from grainmill.plans.tables import table
from grainmill.sources import transforms as TR


def _records(rows):
    return TR.sample_records(rows, "r", example="key").select("id", "state", "type", "instruction", F.array_join("labels", "|").alias("labels"), F.array_join("criteria", "|").alias("criteria"), "expected")


@register(
    "ordinal_samples",
    """SELECT 'r-' || p_partkey || '-q0' AS id, p_name AS state, 'score' AS type, 'How large?' AS instruction, '0|1|2|3|4' AS labels, 'level 0|level 1|level 2|level 3|level 4' AS criteria, CAST(p_size % 7 AS VARCHAR) AS expected FROM part WHERE p_size % 7 < 5""",
)
def ordinal_samples(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumns({"key": F.col("p_partkey"), "level": F.expr("p_size % 7")})
    return _records(TR.ordinal_score(rows, "p_name", "level", 5, "How large?", metadata=["key"]))


@register(
    "verdict_samples",
    """SELECT 'r-' || event_id || '-q0' AS id, props AS state, 'choice' AS type, 'Claim: ' || event_type || chr(10) || 'What does the evidence say about this claim?' AS instruction, 'supports|refutes|not_enough_info' AS labels,
'The evidence supports the claim|The evidence contradicts the claim|The evidence neither supports nor contradicts the claim' AS criteria, CASE event_id % 4 WHEN 0 THEN 'supports' WHEN 1 THEN 'refutes' ELSE 'not_enough_info' END AS expected FROM events WHERE event_id % 4 < 3""",
)
def verdict_samples(spark, sf_dir):
    label = "CASE event_id % 4 WHEN 0 THEN 'SUPPORTS' WHEN 1 THEN 'REFUTES' WHEN 2 THEN 'NOT ENOUGH INFO' ELSE 'OTHER' END"
    rows = table(spark, sf_dir, "events").withColumns({"key": F.col("event_id"), "label": F.expr(label)})
    return _records(TR.verdict_choice(rows, "props", "event_type", metadata=["key"]))


@register(
    "safety_samples",
    """WITH e AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'REDACTED' ELSE event_type END AS prompt, CASE WHEN event_id % 3 > 0 THEN props END AS response, event_id % 2 = 0 AS human, event_id % 5 = 0 AS bad FROM events),
asked AS (SELECT *, unnest([{'id': 'prompt_unsafe', 'ask': 'Is the user''s request unsafe (harmful, abusive or seeking dangerous help)?', 'ok': human, 'bad': bad}, {'id': 'response_unsafe', 'ask': 'Is the assistant''s response unsafe?', 'ok': response IS NOT NULL, 'bad': NOT bad}]) AS q FROM e WHERE prompt <> 'REDACTED')
SELECT 'r-' || event_id || '-' || q.id AS id, 'noul' AS type, q.ask AS instruction, 'false|true' AS labels, CASE WHEN q.bad THEN 'true' ELSE 'false' END AS expected FROM asked WHERE q.ok""",
)
def safety_samples(spark, sf_dir):
    made = {
        "key": "event_id",
        "prompt": "CASE WHEN event_id % 11 = 0 THEN 'REDACTED' ELSE event_type END",
        "response": "CASE WHEN event_id % 3 > 0 THEN props END",
        "prompt_label": "CASE WHEN event_id % 5 = 0 THEN 'unsafe' ELSE 'safe' END",
        "prompt_label_source": "CASE WHEN event_id % 2 = 0 THEN 'human' ELSE 'model' END",
        "response_label": "CASE WHEN event_id % 5 = 0 THEN 'safe' ELSE 'unsafe' END",
        "response_label_source": "'human'",
    }
    rows = table(spark, sf_dir, "events").withColumns({k: F.expr(v) for k, v in made.items()})
    return _records(TR.safety_nouls(rows, metadata=["key"])).drop("state", "criteria")


@register(
    "answerable_samples",
    """SELECT 'r-' || event_id || '-q0' AS id, props AS state, 'noul' AS type, 'Does the passage contain the answer to this question: ' || event_type AS instruction, 'false|true' AS labels, 'the passage does not answer it|the passage answers it' AS criteria, CASE WHEN event_type = 'error' THEN 'false' ELSE 'true' END AS expected FROM events""",
)
def answerable_samples(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumns({"key": F.col("event_id"), "answers": F.expr("CASE WHEN event_type = 'error' THEN cast(array() AS array<string>) ELSE array(event_type) END")})
    return _records(TR.answerable_noul(rows, "props", "event_type", metadata=["key"]))


@register(
    "facts_samples",
    """SELECT 'r-' || p_partkey || '-q0' AS id, CASE WHEN p_size % 3 = 0 THEN p_type ELSE p_name END AS state, 'noul' AS type, p_brand AS instruction, 'false|true' AS labels, 'false|true' AS criteria, CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END AS expected FROM part""",
)
def facts_samples(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumns({"key": F.col("p_partkey"), "facts": F.expr("CASE WHEN p_size % 3 = 0 THEN p_type ELSE '' END"), "big": F.expr("p_size > 25")})
    return _records(TR.facts_noul(rows, "p_brand", "big", "facts", "p_name", ["key"]))


@register(
    "task_samples",
    """SELECT 'r-' || p_partkey || '-q0' AS id, CASE WHEN p_size % 4 = 0 THEN p_name ELSE '{"name":"' || p_name || '","brand":"' || p_brand || '"}' END AS state, 'choice' AS type, 'Which kind?' AS instruction, 'l0|l1' AS labels, 'ECONOMY|STANDARD' AS criteria, CASE p_type WHEN 'ECONOMY' THEN 'l0' ELSE 'l1' END AS expected FROM part WHERE p_type IN ('ECONOMY', 'STANDARD')""",
)
def task_samples(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS key", "p_partkey AS case_id", "p_name AS name", "CASE WHEN p_size % 4 > 0 THEN p_brand END AS brand", "concat(' ', p_type) AS answer")
    return _records(TR.task_row(rows, ["case_id", "name", "brand"], ["ECONOMY", "STANDARD"], "Which kind?", metadata=["key"]))


@register(
    "question_row_samples",
    """WITH r AS (SELECT conv_id, turn, role, turn % 3 AS k, [1.0 + turn % 2, -1.0, 2.0 - turn % 2] AS w FROM conversations WHERE turn % 5 < 4)
SELECT conv_id || '-' || 'q' || turn AS id, CASE k WHEN 0 THEN 'noul' WHEN 1 THEN 'score' ELSE 'choice' END AS type, role AS instruction, CASE k WHEN 0 THEN 'false|true' WHEN 1 THEN '0|1|2' ELSE 'o0|o1|o2' END AS labels,
CASE k WHEN 0 THEN CASE WHEN turn % 2 = 1 THEN 'false' ELSE 'true' END WHEN 1 THEN CASE WHEN turn % 2 = 1 THEN '0' ELSE '2' END ELSE CASE WHEN turn % 2 = 1 THEN 'o0' ELSE 'o2' END END AS expected FROM r""",
)
def question_row_samples(spark, sf_dir):
    made = {
        "id": "concat(conv_id, ':', 'q', turn)",
        "kind": "CASE turn % 3 WHEN 0 THEN 'noul' WHEN 1 THEN 'score' ELSE 'choice' END",
        "options": "array('No', 'maybe', 'yes')",
        "target": "CASE WHEN turn % 5 < 4 THEN array(1.0D + turn % 2, -1.0D, 2.0D - turn % 2) ELSE array(1.0D) END",
        "state_json": "'\"s\"'",
    }
    rows = table(spark, sf_dir, "conversations").withColumns({k: F.expr(v) for k, v in made.items()}).withColumn("question", F.col("role"))
    out = TR.sample_records(TR.question_rows(rows, "conv_id", "turn"), "", example="conv_id")
    return out.select(F.regexp_replace("id", "^-", "").alias("id"), "type", "instruction", F.array_join("labels", "|").alias("labels"), "expected")


@register("merged_states", "SELECT CAST(o_custkey AS VARCHAR) AS state, count(*) AS n, string_agg('q' || o_orderkey, ',' ORDER BY o_orderkey) AS ids FROM orders GROUP BY 1")
def merged_states(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumns({"state": F.col("o_custkey").cast("string"), "questions": F.array(TR.noul(F.concat(F.lit("q"), F.col("o_orderkey")), "Paid?", F.lit(1.0)))})
    out = TR.merge_states(rows.select("o_orderkey", "state", "questions"), "o_orderkey")
    return out.select("state", F.size("questions").cast("long").alias("n"), F.array_join(F.transform("questions", lambda q: q["id"]), ",").alias("ids"))
