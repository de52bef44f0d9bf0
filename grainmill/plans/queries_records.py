"""Queries that turn recorded questions into items and back."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.plans.registry import register
from grainmill.plans.tables import table
from grainmill.sources import records as R

_NOUL_FAULT = "CASE WHEN doc_id % 31 = 5 THEN 'no false label' END"


def _records(spark, sf_dir):
    """Two benchmark records for each labelled document: a noul with labels of its own, and a choice; some have no label that means no."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    name = F.concat(F.when(F.col("quality") == 0, "judge-").otherwise("doc-"), F.col("doc_id").cast("string"))
    yes, no = F.lit("Yes"), F.when(F.col("doc_id") % 31 == 5, "Never").otherwise("No")
    shared = [F.col("text").alias("state"), F.col("source").alias("family"), F.when(F.col("lang") == "en", "easy").when(F.col("lang") == "fr", "public").otherwise(F.col("lang")).alias("split"), F.concat(F.lit("case-"), "source").alias("case_id")]
    noul = F.struct(F.lit("noul").alias("type"), F.lit("Does it insult?").alias("instructions"), F.create_map(F.lit("yes"), F.lit("it does")).alias("criteria"))
    choice = F.struct(F.lit("choice").alias("type"), F.lit("Is it of use?").alias("instructions"), F.create_map(F.lit("good"), F.lit("of use"), F.lit("bad"), F.lit("of none")).alias("criteria"))
    a = rows.select(F.to_json(F.struct(F.concat(name, F.lit("/t")).alias("id"), noul.alias("question"), F.array(yes, no).alias("labels"), F.when(F.col("toxic") == 1, yes).otherwise(no).alias("expected"), *shared)).alias("record"))
    b = rows.select(F.to_json(F.struct(F.concat(name, F.lit("/q")).alias("id"), choice.alias("question"), F.array(F.lit("good"), F.lit("bad")).alias("labels"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("expected"), *shared)).alias("record"))
    return a.unionByName(b)


_ITEMS = f"""items AS (
  SELECT CASE quality WHEN 0 THEN 'judge-' ELSE 'doc-' END || doc_id AS base, CASE WHEN lang = 'en' THEN 'easy' WHEN quality = 0 THEN 'judge' ELSE 'standard' END AS tier, lang = 'fr' AS public, source, doc_id, quality, toxic, coalesce(text, '') AS text
  FROM labels JOIN documents USING (doc_id)
), adapted AS (
  SELECT base || '/t' AS id, tier, 'noul' AS type, 'false,true' AS labels, CASE toxic WHEN 1 THEN 'true' ELSE 'false' END AS gold, public, source, {_NOUL_FAULT} AS fault, text, 'false|it does' AS descriptions FROM items
  UNION ALL SELECT base || '/q', tier, 'choice', 'good,bad', CASE quality WHEN 1 THEN 'good' ELSE 'bad' END, public, source, NULL, text, 'of use|of none' FROM items
)"""


@register("benchmark_items", f"WITH {_ITEMS} SELECT id, tier, type, labels, descriptions, CASE WHEN fault IS NULL THEN gold END AS gold, public, CASE WHEN public THEN id ELSE 'case-' || source END AS identity, fault, sha256(text) AS state FROM adapted")
def benchmark_items(spark, sf_dir):
    items = R.benchmark_items(_records(spark, sf_dir))
    gold = F.when(F.col("fault").isNull(), F.get(F.map_keys("gold"), F.lit(0)))
    return items.select("id", "tier", "type", F.array_join("labels", ",").alias("labels"), F.array_join("descriptions", "|").alias("descriptions"), gold.alias("gold"), "public", "identity", "fault", F.sha2("state", 256).alias("state"))


@register("record_round_trip", f"WITH {_ITEMS} SELECT type, tier, count(*) AS n, count(*) AS equal FROM adapted WHERE fault IS NULL GROUP BY type, tier")
def record_round_trip(spark, sf_dir):
    """Sound items written as records and read again: how many come back as they were."""
    items = R.benchmark_items(_records(spark, sf_dir)).where("fault IS NULL")
    back = R.benchmark_items(R.benchmark_records(items))
    same = [c for c in items.columns if c != "gold"]
    digest = lambda df: df.select("id", "type", "tier", F.sha2(F.to_json(F.struct(*same, F.array_sort(F.map_entries("gold")).alias("gold"))), 256).alias("h"))
    both = digest(items).join(digest(back).select(F.col("id").alias("of"), F.col("h").alias("again")), F.col("id") == F.col("of"), "left")
    return both.groupBy("type", "tier").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("h").eqNullSafe(F.col("again"))).alias("equal"))
