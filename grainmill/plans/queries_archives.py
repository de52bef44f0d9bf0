"""Queries that write given tables into archives and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.plans.registry import register
from grainmill.plans.shipping import ship
from grainmill.plans.tables import table
from grainmill.plans.workspace import Workspace
from grainmill.sources import archives as A


@register("archive_pages", "SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n_bytes, sha256(coalesce(html, '')) AS content FROM pages")
def archive_pages(spark, sf_dir):
    """Every page as a member of an archive, read back by the directory."""
    ship(spark)
    path = Workspace(spark, "archive").path("pages")
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("member"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"))
    A.write_archives(pages, path)
    members = A.read_archive(spark, path, partitionBytes=str(1 << 20))
    return members.select(F.regexp_extract("member", r"(\d+)\.html$", 1).cast("long").alias("page_id"), "n_bytes", F.sha2("content", 256).alias("content"))


HYPOTHESES = {"quality": "The document is of use.", "toxic": "The document insults someone."}


@register(
    "archive_questions",
    "SELECT CAST(doc_id AS VARCHAR) AS document, question, hypothesis, CASE choice WHEN 1 THEN 'Entailment' ELSE 'Contradiction' END AS choice, sha256(coalesce(text, '')) AS text FROM ("
    + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS question, '{h}' AS hypothesis, {k} AS choice, text FROM labels JOIN documents USING (doc_id)" for k, h in HYPOTHESES.items())
    + ")",
)
def archive_questions(spark, sf_dir):
    """Labelled documents as nested JSON members, read back and taken apart into questions."""
    ship(spark)
    path = Workspace(spark, "archive").path("documents")
    choice = lambda k: F.struct(F.when(F.col(k) == 1, "Entailment").otherwise("Contradiction").alias("choice"))
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    sets = F.array(F.struct(F.create_map(*[x for k in HYPOTHESES for x in (F.lit(k), choice(k))]).alias("annotations")))
    nested = F.struct(F.array(F.struct(F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"), sets.alias("annotation_sets"))).alias("documents"), F.create_map(*[x for k, h in HYPOTHESES.items() for x in (F.lit(k), F.struct(F.lit(h).alias("hypothesis")))]).alias("labels"))
    A.write_archives(docs.select(F.concat(F.lit("train/"), F.col("doc_id").cast("string"), F.lit(".json")).alias("member"), F.to_json(nested).alias("content")), path)
    return A.document_questions(A.read_archive(spark, path)).select("document", "question", "hypothesis", "choice", F.sha2("text", 256).alias("text"))
