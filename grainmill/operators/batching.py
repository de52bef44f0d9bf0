"""Training batches under a token budget, and questions that share a prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.operators.ordered import greedy_batches
from grainmill.plans.workspace import Workspace

#: Tokens that sharing a prefix must save before it is worth a pass of its own.
LEAST_SAVING = 256
_NO_LIMIT = 1 << 40


def budget_batches(items: DataFrame, length: str, max_tokens: int, max_rows: int = 64, order: list[str] | None = None) -> DataFrame:
    """``items`` with ``batch``: length-sorted batches with rows times the longest within ``max_tokens``, of ``max_rows`` rows at most.

    Ties of length go by ``order`` (default ``id``). A longer item than the budget is a batch of its own.
    """
    return greedy_batches(items, length, max_tokens, order or ["id"], max_rows, name="budget")


def plan_chunks(items: DataFrame, sample: str, prefix: str, suffix: str, max_tokens: int, order: list[str], max_rows: int = 64, share: bool = True) -> DataFrame:
    """``items`` with ``kind`` and ``chunk``: questions of one sample in shared passes where that saves enough, else rows.

    A sample of two questions or more shares its prefix if that saves ``LEAST_SAVING`` tokens; its
    questions by ascending suffix are cut where prefix plus the longest suffix times the rows would exceed
    ``max_tokens``, and ``chunk`` counts within the sample. All others are ``rows``: prefix and suffix
    together in ``budget_batches``, and ``chunk`` counts over the table. Null samples are single questions.
    """
    space = Workspace(items.sparkSession, "chunks")
    counts = items.groupBy(F.col(sample).alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    known = space.table("items", items.join(counts, F.col(sample) == F.col("_of"), "left").drop("_of"))
    pays = (F.coalesce("_n", F.lit(1)) >= 2) & ((F.col("_n") - 1) * F.col(prefix) >= LEAST_SAVING) if share else F.lit(False)
    together = known.where(pays).drop("_n").withColumn("_left", F.lit(max_tokens) - F.col(prefix))
    shared = greedy_batches(together, suffix, "_left", order, _NO_LIMIT, group=sample, name="shared")
    alone = known.where(~F.coalesce(pays, F.lit(False))).drop("_n").withColumn("_left", F.col(prefix) + F.col(suffix))
    rows = greedy_batches(alone, "_left", max_tokens, order, max_rows, name="rows")
    tag = lambda df, kind: df.drop("_left").withColumnRenamed("batch", "chunk").withColumn("kind", F.lit(kind))
    return tag(shared, "shared").unionByName(tag(rows, "rows"))
