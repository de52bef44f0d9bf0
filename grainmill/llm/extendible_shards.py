"""Sharding by extendible hashing, in DataFrame operations alone.

A document's key is hashed to 60 bits. The directory is indexed by leading
bits: the empty prefix is one bucket, and a bucket whose bytes exceed the limit,
and only such a one, splits on its next bit. Bytes by prefix are sums, so all
levels come from one aggregation of narrow rows to fine cells; cells that are
still too large are refined by further bits.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.plans.workspace import Workspace

HASH_BITS = 60
#: Levels whose buckets are broadcast: 2^13 rows at most.
_SHALLOW = 12


def _key_hash(key: str):
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def shard_directory(rows: DataFrame, limit: int, fine_bits: int = 6) -> tuple[DataFrame, list[tuple[DataFrame, int]]]:
    """Buckets of (h, n_bytes) rows, and for each round its cells with their bucket's depth.

    A bucket is final at the first depth at which it fits the limit or holds one
    hash value only, which no bit can split.
    """
    spark = rows.sparkSession
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    low, high = 0, min(HASH_BITS, max(1, math.ceil(math.log2(max(total, 1) / limit + 1)) + fine_bits))
    space = Workspace(spark, "shards")
    buckets, rounds, pending = [], [], rows
    while True:
        cells = pending.groupBy(F.expr(f"shiftright(h, {HASH_BITS - high})").alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n_docs"), F.min("h").alias("h0"), F.max("h").alias("h1"))
        cells = space.table(f"cells{high}", cells)
        up = cells.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {high} - depth)"))
        level = up.groupBy("depth", "prefix").agg(F.sum("n_bytes").alias("shard_bytes"), F.sum("n_docs").alias("shard_docs"), F.min("h0").alias("h0"), F.max("h1").alias("h1")).where(f"shard_bytes <= {limit} OR h0 = h1 OR depth = {HASH_BITS}").drop("h0", "h1")
        step = up.select("cell", "depth", "prefix")
        shallow = step.where(f"depth <= {_SHALLOW}").join(F.broadcast(level.where(f"depth <= {_SHALLOW}")), ["depth", "prefix"])
        deep = step.where(f"depth > {_SHALLOW}").join(level.where(f"depth > {_SHALLOW}"), ["depth", "prefix"])
        placed = shallow.unionByName(deep).groupBy("cell").agg(F.min(F.struct("depth", "prefix", "shard_bytes", "shard_docs")).alias("b")).select("cell", "b.*")
        placed = space.table(f"placed{high}", placed)
        rounds.append((placed, high))
        buckets.append(placed.drop("cell").distinct())
        left = cells.select("cell").join(placed, "cell", "left_anti")
        if high >= HASH_BITS or left.isEmpty():
            break
        pending = pending.withColumn("cell", F.expr(f"shiftright(h, {HASH_BITS - high})")).join(left, "cell", "left_semi").drop("cell")
        low, high = high + 1, min(HASH_BITS, high + 8)
    directory = buckets[0]
    for b in buckets[1:]:
        directory = directory.unionByName(b)
    return directory, rounds


def assign_shards(docs: DataFrame, limit: int, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every input column, and the shard of each row.

    Adds ``n_bytes`` (UTF-8 bytes of the text), ``shard`` (the directory prefix as
    bits; empty if all fits one shard), ``shard_depth``, ``shard_bytes`` and
    ``shard_docs``; input columns of these names are replaced, and
    ``_h``, ``_cell``, ``_depth`` and ``_prefix`` are reserved. Shards hold at most
    ``limit`` bytes, except one that holds a single key value whose rows alone are
    larger. Equal keys share a shard, as do repeated rows. Null and empty texts have
    0 bytes and are placed as others are; null keys hash as an empty string. An
    empty table gives an empty result.
    """
    own = ["n_bytes", "shard", "shard_depth", "shard_bytes", "shard_docs"]
    base = docs.drop(*[c for c in own if c != key and c != text_col]).withColumn("n_bytes", F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long")).withColumn("_h", _key_hash(key))
    narrow = Workspace(docs.sparkSession, "shard-keys").table("keys", base.select(F.col("_h").alias("h"), "n_bytes"))
    _, rounds = shard_directory(narrow, limit)
    out, rest = None, base
    for placed, high in rounds:
        cell = F.expr(f"shiftright(_h, {HASH_BITS - high})")
        found = rest.withColumn("_cell", cell).join(placed.select(F.col("cell").alias("_cell"), F.col("depth").alias("_depth"), F.col("prefix").alias("_prefix"), "shard_bytes", "shard_docs"), "_cell")
        out = found if out is None else out.unionByName(found)
        if placed is not rounds[-1][0]:
            rest = rest.withColumn("_cell", cell).join(placed.select(F.col("cell").alias("_cell")), "_cell", "left_anti").drop("_cell")
    name = F.expr("CASE WHEN _depth = 0 THEN '' ELSE lpad(bin(_prefix), _depth, '0') END")
    return out.withColumn("shard", name).withColumn("shard_depth", F.col("_depth").cast("int")).drop("_cell", "_h", "_depth", "_prefix")


def write_shards(docs: DataFrame, path: str, limit: int, key: str = "doc_id", text_col: str = "text") -> None:
    """Write rows as Parquet, a folder for each shard."""
    rows = assign_shards(docs, limit, key, text_col)
    rows.repartition("shard").sortWithinPartitions("shard", key).write.partitionBy("shard").parquet(path)
