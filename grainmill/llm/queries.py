"""Registered queries of this package's operators, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm import sql
from grainmill.llm.conversation_repair import damage_turns, repaired_conversations
from grainmill.llm.decontaminate import benchmark_overlap, contamination
from grainmill.llm.extendible_shards import assign_shards
from grainmill.llm.jaccard_join import jaccard_components
from grainmill.llm.line_dedup import dedup_lines
from grainmill.llm.packed_ids import packed_documents, read_packed, write_packed
from grainmill.llm.pii_pseudonyms import pseudonymise
from grainmill.llm.quality_rules import judge_quality
from grainmill.llm.source_mixture import mix_sources
from grainmill.llm.span_dedup import dedup_spans
from grainmill.llm.spelling_variants import FORM_RATIO, count_words, spelling_variants
from grainmill.llm.tool_calls import chat_lines, with_calls
from grainmill.llm.toxic_spans import score_toxicity, train_on
from grainmill.plans.shipping import ship
from grainmill.plans.workspace import Workspace

#: Bytes of text in a shard, at most.
SHARD_BYTES = 64 << 20
#: Stands in for a secret from the caller's key store.
PSEUDONYM_KEY = "query-key"
#: Words from which a single sentence that repeats is removed by itself.
SENTENCE_WORDS = 50
#: Code points of a line's key, and documents that hold it, from which a line is removed.
LINE_LENGTH, LINE_DOCUMENTS = 40, 5
#: Code points and occurrences of a word, at least, and how many of the words lose a letter.
WORD_LENGTH, WORD_COUNT, DELETE_ONE_IN = 7, 2, 31
#: What the arguments of calls must be, by tool.
TOOLS = {
    "measure": {"properties": {"turn": "integer", "unit": "string"}, "required": ["turn", "unit"]},
    "file": {"properties": {"measured": "object", "size": "integer", "title": "string"}, "required": ["measured", "title"]},
}
#: The vocabulary of token-id files.
VOCABULARY = "word_bpe_49k.json"

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(_read(spark, sf_dir, "documents"), PSEUDONYM_KEY).select("doc_id", "text", F.size("pii").cast("long").alias("n_pii"), "pii")


def op2_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    field = train_on(docs, _read(spark, sf_dir, "labels").where(~held_out))
    scored = score_toxicity(docs, field).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.expr("cast(score >= 0.7 AS int)").alias("predicted"), "spans")


def op3_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), F.col("_mix_taken").alias("taken"), F.col("_mix_shards").alias("shards"))


def op4_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(_read(spark, sf_dir, "documents"), SHARD_BYTES).select("doc_id", "n_bytes", "shard", "shard_depth", "shard_bytes", "shard_docs")


def op5_packed_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = Workspace(spark, "packed").path("ids")
    write_packed(_read(spark, sf_dir, "documents"), path, public_tokenizers.path(VOCABULARY))
    return packed_documents(read_packed(spark, path)).withColumnRenamed("id", "doc_id")


def op6_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the conversations, whose assistants' turns are given calls, answers and some faults: the table holds none."""
    return chat_lines(with_calls(_read(spark, sf_dir, "conversations")), TOOLS)


def op7_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_spans(_read(spark, sf_dir, "documents"), alone=SENTENCE_WORDS, whole=True)
    return found.select(F.col("id").alias("doc_id"), "text", F.col("n_sentences").cast("long").alias("n_sentences"), F.size("removed").cast("long").alias("n_removed_spans"), F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"]).alias("removed_bytes"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(benchmark_overlap(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")))
    digest = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_components(_read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(_read(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = dedup_lines(_read(spark, sf_dir, "documents"), least_length=LINE_LENGTH, least_documents=LINE_DOCUMENTS)
    return cut.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = count_words(_read(spark, sf_dir, "documents"), least_length=WORD_LENGTH, least_count=WORD_COUNT, delete_one_in=DELETE_ONE_IN)
    return spelling_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations")
    return repaired_conversations(turns, damage_turns(turns))


def queries() -> dict[str, Query]:
    return {
        "op1_pii_pseudonyms": op1_pii_pseudonyms,
        "op2_toxic_spans": op2_toxic_spans,
        "op3_source_mixture": op3_source_mixture,
        "op4_extendible_sharding": op4_extendible_sharding,
        "op5_packed_token_ids": op5_packed_token_ids,
        "op6_tool_call_linking": op6_tool_call_linking,
        "op7_sentence_span_dedup": op7_sentence_span_dedup,
        "op8_benchmark_decontamination": op8_benchmark_decontamination,
        "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
        "op10_quality_rules": op10_quality_rules,
        "op11_line_dedup": op11_line_dedup,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_conversation_repair": op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_extendible_sharding": sql.extendible_sharding(SHARD_BYTES),
        "op8_benchmark_decontamination": sql.BENCHMARK_DECONTAMINATION,
        "op9_ngram_jaccard_join": sql.NGRAM_JACCARD,
        "op10_quality_rules": sql.quality_rules(),
        "op11_line_dedup": sql.line_dedup(LINE_LENGTH, LINE_DOCUMENTS),
        "op12_spelling_variants": sql.spelling_variants(WORD_LENGTH, WORD_COUNT, DELETE_ONE_IN, FORM_RATIO),
    }
