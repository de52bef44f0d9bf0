"""From raw documents to training shards, in five stages.

Every stage takes what its predecessor kept and returns the columns of
``documents``; the last adds each row's shard. Between stages the rows are
written as Parquet in the session's shared folder and read again, so a lost
executor costs a stage's tasks and not the chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm.decontaminate import benchmark_overlap, contamination
from grainmill.llm.extendible_shards import assign_shards
from grainmill.llm.jaccard_join import jaccard_components
from grainmill.llm.quality_rules import judge_quality
from grainmill.llm.queries import SHARD_BYTES
from grainmill.llm.source_mixture import mix_sources, mixed_rows
from grainmill.operators.ordered import running_sums
from grainmill.operators.removal import without_keys
from grainmill.plans.shipping import ship
from grainmill.plans.workspace import Workspace

#: The result hangs on keyed hashes and on a graph closure; it is tested against a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; null and empty texts fail them. Ids are not looked at."""
    ship(spark)
    return judge_quality(docs).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least id.

    Where ids repeat or are null, rows of equal id and text are one document, and
    others are told apart by their place in the order of ids and texts.
    """
    ship(spark)
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty():
        later = jaccard_components(docs).where("id <> component").select(F.col("id").alias("doc_id"))
        return without_keys(docs, Workspace(spark, "later-of-group").table("ids", later), "doc_id")
    space = Workspace(spark, "ranked")
    each = docs.dropDuplicates(["doc_id", "text"])
    ranked = space.table("docs", running_sums(each, ["doc_id", F.sha2(F.coalesce("text", F.lit("")), 256), F.col("text").isNull()], {"_rank": F.lit(1)}))
    later = space.table("ids", jaccard_components(ranked, id_col="_rank").where("id <> component").select(F.col("id").alias("_rank")))
    return without_keys(ranked, later, "_rank").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in benchmark windows; null ids stay as they are, rows of one id go together."""
    ship(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = contamination(benchmark_overlap(docs, benchmark)).where("contaminated").select(F.col("id").alias("doc_id")).distinct()
    return without_keys(docs, Workspace(spark, "contaminated").table("ids", hit), "doc_id")


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time a document is taken; texts without words are not taken."""
    ship(spark)
    return mixed_rows(mix_sources(docs)).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, null ids and texts too, with its shard."""
    ship(spark)
    return assign_shards(docs, SHARD_BYTES)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("source_mixture", source_mixture),
    ("extendible_sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of a folder of tables."""
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = space.table(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
