"""Stand-ins on the shared tables for the shapes that operators take, as DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.functions import probability as P

_TYPE = "CASE vec_id % 3 WHEN 0 THEN 'choice' WHEN 1 THEN 'noul' ELSE 'score' END"
_TIER = "CASE vec_id % 4 WHEN 0 THEN 'easy' WHEN 1 THEN 'standard' WHEN 2 THEN 'judge' ELSE 'hard' END"
_K = "CASE vec_id % 3 WHEN 0 THEN 10 WHEN 1 THEN 2 ELSE 5 END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with the probabilities of systems a and b, and targets, from slices of the embeddings."""
    base = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS id", "embedding", "label", f"{_TYPE} AS type", f"{_TIER} AS tier", f"{_K} AS k", "vec_id % 37 AS cluster")
    slice_ = lambda start: F.transform(F.slice("embedding", start, F.col("k")), lambda x: x.cast("double"))
    gold = F.expr("cast(label % k AS int)")
    y = F.when(F.expr("id % 5 = 0"), P.softmax(slice_(21))).otherwise(P.one_hot(F.col("k"), gold))
    return base.select("id", "type", "tier", "cluster", gold.alias("gold"), P.softmax(slice_(1)).alias("pa"), P.softmax(slice_(11)).alias("pb"), slice_(1).alias("logits"), y.alias("y"), (F.abs(F.element_at("embedding", 31).cast("double")) + 0.05).alias("latency"))


def system(reads_: DataFrame, name: str) -> DataFrame:
    return reads_.withColumn("p", F.col("p" + name))


def _softmax(start: int) -> str:
    cut = f"list_transform(embedding[{start}:{start - 1} + k], lambda x: CAST(x AS DOUBLE))"
    return f"list_transform({cut}, lambda x: exp(x - list_max({cut})) / list_sum(list_transform({cut}, lambda z: exp(z - list_max({cut})))))"


READS = f"""
base AS (SELECT vec_id AS id, embedding, label, {_TYPE} AS type, {_TIER} AS tier, {_K} AS k, vec_id % 37 AS cluster FROM embeddings),
reads AS (
  SELECT id, type, tier, cluster, k, CAST(label % k AS INTEGER) AS gold, {_softmax(1)} AS pa, {_softmax(11)} AS pb, list_transform(embedding[1:k], lambda x: CAST(x AS DOUBLE)) AS logits,
    CASE WHEN id % 5 = 0 THEN {_softmax(21)} ELSE list_transform(range(0, k), lambda i: CASE WHEN i = label % k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) END AS y,
    abs(CAST(embedding[31] AS DOUBLE)) + 0.05 AS latency
  FROM base
)"""


def typed(p: str = "pa") -> str:
    """CTEs ``reads`` and ``typed``: one row of each question of a system with its metrics."""
    zipped = f"list_zip({p}, y)"
    place = f"list_sum(list_transform({p}, lambda v, i: v * (i - 1)))"
    running = lambda x: f"list_transform(range(1, k), lambda j: list_sum({x}[1:j]))"
    return f"""{READS},
typed AS (
  SELECT *,
    -list_sum(list_transform({zipped}, lambda z: z[2] * ln(greatest(z[1], 1e-12)))) AS nll,
    CASE WHEN type = 'noul' THEN ({p}[2] - y[2]) * ({p}[2] - y[2]) ELSE list_sum(list_transform({zipped}, lambda z: (z[1] - z[2]) * (z[1] - z[2]))) END AS brier,
    CASE WHEN type = 'noul' THEN {p}[2] ELSE list_max({p}) END AS confidence,
    CASE WHEN type = 'noul' THEN CASE WHEN {p}[2] <= 0.2 THEN y[1] WHEN {p}[2] >= 0.8 THEN y[2] ELSE 0 END ELSE y[list_position({p}, list_max({p}))] END AS correct,
    CASE WHEN type = 'noul' THEN 0.5 ELSE 1.0 / k END AS chance,
    CASE WHEN type = 'noul' THEN y[2] ELSE y[list_position({p}, list_max({p}))] END AS calibration_target,
    CASE WHEN type = 'noul' THEN {p}[2] > 0.2 AND {p}[2] < 0.8 END AS abstained,
    CASE WHEN type = 'score' THEN list_sum(list_transform(y, lambda v, i: v * abs({place} - (i - 1)))) / (k - 1) END AS nmae,
    CASE WHEN type = 'score' THEN list_sum(list_transform(y, lambda v, i: v * list_sum(list_transform(range(0, k), lambda j: abs(j - (i - 1)))) / k)) / (k - 1) END AS nmae_chance,
    CASE WHEN type = 'score' THEN list_sum(list_transform(list_zip({running(p)}, {running("y")}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / (k - 1) END AS rps
  FROM reads
)"""
