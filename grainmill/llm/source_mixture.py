"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents are hashed into blocks of their source. A source's target is a number
of draws from its keyed permutation of blocks: whole rounds over all blocks,
then the leading blocks of one more round, the last of them in part. The draws
of all sources are dealt among output shards by a tree: each node splits its
exact draw counts between its halves by a multivariate hypergeometric draw, so
shards hold what a uniform shuffle of all draws would give them, yet every
count is exact. Each shard then takes disjoint runs of the permuted blocks and
orders its documents by a keyed hash.

Only sums by source and by block reach the driver; their number is bounded.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainmill.plans.workspace import Workspace

#: Blocks of all sources together, at most (one for each source at least).
MAX_BLOCKS = 1 << 14
BLOCK_WORDS = 1 << 16
#: Passes over the block that is drawn in part; each leaves a smaller gap.
_FILLS = 4
_WORDS = r"[^\x20\x09-\x0D]+"


def waterfill(sizes: Sequence[int], weights: Sequence[float], total: float, cap: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``cap`` times its size; what is cut off is shared again by weight."""
    out = [0.0] * len(sizes)
    open_, rest = set(range(len(sizes))), float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        over = {i for i in open_ if rest * weights[i] / weight > cap * sizes[i]}
        if not over:
            for i in open_:
                out[i] = rest * weights[i] / weight
            break
        for i in sorted(over):
            out[i] = float(cap * sizes[i])
            rest -= out[i]
        open_ -= over
    return out


def split_draws(draws: Sequence[int], shards: int, seed: int) -> np.ndarray:
    """Deal each source's draws among shards: an array [shard, source] with exact sums."""
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(draws)), np.int64)

    def deal(low: int, high: int, have: np.ndarray) -> None:
        if high - low == 1:
            out[low] = have
            return
        middle = (low + high) // 2
        total = int(have.sum())
        take = total * (middle - low) // (high - low)
        left = rng.multivariate_hypergeometric(have, take, method="marginals") if take else np.zeros_like(have)
        deal(low, middle, left)
        deal(middle, high, have - left)

    deal(0, shards, np.array(draws, np.int64))
    return out


def _order(seed: int, source: str | None, blocks: Sequence[int]) -> list[int]:
    def key(b: int) -> bytes:
        return hashlib.blake2b(f"{seed}/{source is None}/{source}/{b}".encode("utf-8", "surrogatepass"), digest_size=16).digest()

    return sorted(blocks, key=key)


def _plan(sums: dict[str | None, dict[int, int]], weights: Sequence[float], cap: float, shards: int, seed: int) -> tuple[list[tuple], list[tuple]]:
    """Rows (source, source_size, target) and rows (source, block, shards of whole draws, shard of a part or None, its words)."""
    sources = sorted((s for s in sums if s is not None)) + [s for s in sums if s is None]
    sizes = [sum(sums[s].values()) for s in sources]
    targets = waterfill(sizes, [weights[i % len(weights)] for i in range(len(sources))], sum(sizes), cap)
    drawn: list[list[tuple[int, int | None]]] = []
    for source, size, target in zip(sources, sizes, targets, strict=True):
        order, own, rest, turn = _order(seed, source, list(sums[source])), [], target, 0
        while size and rest > 0.5 and turn < cap:
            over: list[tuple[int, int]] = []
            apart = rest < size <= BLOCK_WORDS
            for block in order:
                words = sums[source][block]
                if words <= rest and not apart:
                    own.append((block, None))
                    rest -= words
                else:
                    over.append((words, block))
            if over:
                # the last turn: what no whole block fits is drawn from the smallest block left, of a small source from all its documents
                if rest > 0.5:
                    own += [(block, round(rest)) for _, block in sorted(over)[: None if apart else 1]]
                rest = 0
            turn += 1
        drawn.append(own)
    dealt = split_draws([len(d) for d in drawn], shards, seed)
    rows = []
    for i, source in enumerate(sources):
        at, whole, part = 0, {b: [] for b in sums[source]}, {}
        for shard in range(shards):
            for block, words in drawn[i][at : at + dealt[shard, i]]:
                if words is None:
                    whole[block].append(shard)
                else:
                    part[block] = (shard, words)
            at += dealt[shard, i]
        rows += [(source, block, whole[block], *part.get(block, (None, None))) for block in whole]
    return list(zip(sources, sizes, targets, strict=True)), rows


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), cap: int = 3, shards: int = 64, seed: int = 11, block_words: int = BLOCK_WORDS) -> DataFrame:
    """How often the mix takes each document, and into which output shards.

    A document's size is its number of words (runs outside ASCII white space).
    Sources in code-point order, null last, have ``weights``, repeating; targets
    share the sum of all sizes by weight, at most ``cap`` times a source's size.

    Returns every input column (names starting with ``_mix_`` are reserved) and
    ``_mix_size``, ``_mix_source_size``, ``_mix_target``, ``_mix_taken`` (words
    taken, repeats counted) and ``_mix_shards`` (one shard for each time taken).
    Null and empty texts have size 0, follow their block and take no words. No
    document is taken more than ``cap`` times. Rows that repeat an id are separate
    documents that share a block. The result depends on the rows alone, not on
    their order or partitions. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "mixture")
    base = docs.select("*", F.coalesce(F.regexp_count(text_col, F.lit(_WORDS)), F.lit(0)).cast("long").alias("_mix_size"), F.xxhash64(F.lit(seed), F.col(id_col).cast("string")).alias("_mix_key"))
    narrow = space.table("sized", base.select(F.col(source_col).cast("string").alias("source"), F.col("_mix_size").alias("size"), F.col("_mix_key").alias("key")))
    totals = {r.source: r.n for r in narrow.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    step = max(block_words, sum(totals.values()) / MAX_BLOCKS)
    counts = [(s, max(1, math.ceil(n / step))) for s, n in totals.items()]
    blocks = spark.createDataFrame(counts, "source string, n long")
    small = len(counts) <= MAX_BLOCKS
    blocks = F.broadcast(blocks) if small else blocks
    sums: dict[str | None, dict[int, int]] = {}
    summed = narrow.join(blocks.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).groupBy("source", F.expr("pmod(key, n)").alias("block")).agg(F.sum("size").alias("words"))
    for r in summed.collect():
        sums.setdefault(r.source, {})[r.block] = r.words
    space.drop("sized")
    targets, draws = _plan(sums, weights, cap, shards, seed)

    plan = spark.createDataFrame([(s, size, target, dict(counts)[s]) for s, size, target in targets], "_mix_of string, _mix_source_size long, _mix_target double, _mix_n long")
    drawn = spark.createDataFrame(draws, "_mix_from string, _mix_at long, _mix_shards array<int>, _mix_part int, _mix_words long")
    if small:
        plan, drawn = F.broadcast(plan), F.broadcast(drawn)
    rows = base.join(plan, F.col(source_col).cast("string").eqNullSafe(F.col("_mix_of")))
    rows = rows.join(drawn, F.col("_mix_of").eqNullSafe(F.col("_mix_from")) & (F.expr("pmod(_mix_key, _mix_n)") == F.col("_mix_at")))
    whole = rows.where("_mix_part IS NULL")
    # a source's last block: a quarter of what is left in keyed order, then the largest documents that fit it
    own = Window.partitionBy("_mix_of")
    ties = ["_mix_key", F.col("_mix_size").desc(), F.xxhash64(text_col)]
    part = rows.where("_mix_part IS NOT NULL").withColumn("_mix_in", F.lit(False))
    for turn in range(_FILLS):
        order = own.orderBy(*ties) if turn == 0 else own.orderBy(F.col("_mix_size").desc(), *ties)
        left = "_mix_words / 4" if turn == 0 else "_mix_words"
        part = part.withColumn("_mix_fit", F.expr(f"CASE WHEN NOT _mix_in AND _mix_size <= {left} THEN _mix_size ELSE 0 END"))
        part = part.withColumn("_mix_run", F.sum("_mix_fit").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_mix_fit", F.expr(f"CASE WHEN _mix_run <= {left} THEN _mix_fit ELSE 0 END"))
        part = part.withColumn("_mix_in", F.expr("_mix_in OR _mix_fit > 0")).withColumn("_mix_words", F.col("_mix_words") - F.sum("_mix_fit").over(own))
    # the last gap: the unused document whose size leaves the least, over or under, if it leaves less than the gap
    miss = F.abs(F.col("_mix_size") - F.col("_mix_words"))
    nearest = F.row_number().over(own.orderBy("_mix_in", miss, "_mix_key", F.xxhash64(text_col)))
    part = part.withColumn("_mix_in", F.col("_mix_in") | ((nearest == 1) & (miss < F.col("_mix_words"))))
    part = part.withColumn("_mix_shards", F.expr("CASE WHEN _mix_in THEN concat(_mix_shards, array(_mix_part)) ELSE _mix_shards END")).drop("_mix_in", "_mix_fit", "_mix_run")
    out = whole.unionByName(part).withColumn("_mix_taken", F.col("_mix_size") * F.size("_mix_shards"))
    return out.select(*[F.col(c) for c in docs.columns], "_mix_size", "_mix_source_size", "_mix_target", "_mix_taken", "_mix_shards")


def mixed_rows(mixed: DataFrame, id_col: str = "doc_id", seed: int = 11) -> DataFrame:
    """One row for each time a document is taken, with ``_mix_shard`` and, for the order inside the shard, ``_mix_order``."""
    rows = mixed.select("*", F.posexplode("_mix_shards").alias("_mix_copy", "_mix_shard"))
    return rows.withColumn("_mix_order", F.xxhash64(F.lit(seed + 1), F.col(id_col).cast("string"), "_mix_copy", "_mix_shard"))


def write_mixture(mixed: DataFrame, path: str, columns: Sequence[str], id_col: str = "doc_id") -> None:
    """Write the mix as Parquet, a folder for each shard, in shuffled order inside it."""
    rows = mixed_rows(mixed, id_col).repartition("_mix_shard").sortWithinPartitions("_mix_shard", "_mix_order")
    rows.select(*columns, "_mix_shard").write.partitionBy("_mix_shard").parquet(path)
