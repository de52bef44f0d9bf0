"""Deduplication, splits, quotas and mixtures; every choice is a hash, never a random draw."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.functions.hashing import bucket, hashed_order, unit_fraction


def first_by(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """Of rows with equal keys the first by order. Aggregates before the shuffle, so a key that holds most rows costs no more."""
    rest = [c for c in df.columns if c not in keys]
    ranks = [F.expr(o) if isinstance(o, str) else o for o in order]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*[r.alias(f"o{i}") for i, r in enumerate(ranks)])).alias("_b"))
    return best.select(*keys, "_b.*").select(*df.columns)


def dedup_questions(questions: DataFrame, key: str = "dedup_key", scope: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """First occurrence of each question identity, over all rows or within the columns of ``scope``."""
    return first_by(questions, [*(scope or []), key], list(order or ["id"]))


def group_split(df: DataFrame, group: str | Column, val_fraction: float, seed: int = 0) -> DataFrame:
    """``split`` is val where the group's hashed fraction is below ``val_fraction``; whole groups move together."""
    g = F.col(group) if isinstance(group, str) else group
    return df.withColumn("split", F.when(unit_fraction(F.concat_ws(":", F.lit(str(seed)), g)) < val_fraction, "val").otherwise("train"))


def bucket_split(df: DataFrame, key: str, shares: Mapping[str, int]) -> DataFrame:
    """``split`` by hash bucket of 100, in consecutive ranges of the given sizes."""
    b, at, out = bucket(F.col(key).cast("string")), 0, F.lit(None).cast("string")
    for name, share in shares.items():
        out = F.when((b >= at) & (b < at + share), name).otherwise(out)
        at += share
    return df.withColumn("split", out)


def quota_fill(df: DataFrame, cell: list[str], order: list[str | Column], quota: int, eligible: str = "true") -> DataFrame:
    """Walk each cell in order and take eligible rows until its quota: ``taken``, and ``excluded`` for those passed over before that."""
    w = Window.partitionBy(*cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_ok", F.coalesce(F.expr(eligible), F.lit(False)).cast("int"))
    rows = rows.withColumn("_upto", F.sum("_ok").over(w))
    return rows.withColumn("taken", (F.col("_ok") == 1) & (F.col("_upto") <= quota)).withColumn("excluded", (F.col("_ok") == 0) & (F.col("_upto") < quota)).drop("_ok", "_upto")


def round_robin(df: DataFrame, component: str, target: int, seed: int = 0, id_col: str = "id") -> DataFrame:
    """One row of each component in turn, components and rows in hashed order, until the target."""
    inside = Window.partitionBy(component).orderBy(hashed_order(seed, id_col), id_col)
    return df.withColumn("_turn", F.row_number().over(inside)).orderBy("_turn", hashed_order(seed, component), component).limit(target).drop("_turn")


def apportion(shares: DataFrame, n: int | str, weight: str = "weight", by: list[str] | None = None, tie: str = "cell") -> DataFrame:
    """Largest remainders: ``quota`` sums to ``n`` (a number or a column) within each group of ``by``; ties by hashed cell."""
    keys = by or []
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    total = F.col(n) if isinstance(n, str) else F.lit(n)
    raw = F.col(weight) / F.sum(weight).over(w) * total
    rows = shares.withColumn("_raw", F.round(raw, 9)).withColumn("_floor", F.floor("_raw"))
    left = total - F.sum("_floor").over(w)
    rank = F.row_number().over(w.orderBy((F.col("_raw") - F.col("_floor")).desc(), hashed_order("tie", tie)))
    return rows.withColumn("quota", (F.col("_floor") + F.when(rank <= left, 1).otherwise(0)).cast("long")).drop("_raw", "_floor")


def language_weights(counts: Mapping[str, int], power: float = 0.5, bounds: Mapping[str, tuple[float, float]] | None = None) -> dict[str, float]:
    """Shares in proportion to a power of the counts, kept within bounds and normalised, for up to 20 rounds."""
    limits = {"en": (0.0, 0.6), "ko": (0.2, 1.0), "ja": (0.2, 1.0)} if bounds is None else bounds
    raw = {k: v**power for k, v in counts.items()}
    whole = sum(raw.values())
    out = {k: v / whole if whole else 1 / len(raw) for k, v in raw.items()}
    for _ in range(20):
        held = {k: min(max(v, limits.get(k, (0, 1))[0]), limits.get(k, (0, 1))[1]) for k, v in out.items()}
        whole = sum(held.values())
        settled, out = held == out, {k: v / whole for k, v in held.items()}
        if settled:
            break
    return out


def sample_cells(df: DataFrame, quotas: DataFrame, cell: list[str], seed: int = 0, id_col: str = "id") -> DataFrame:
    """Each cell's quota of rows without replacement, in hashed order."""
    w = Window.partitionBy(*cell).orderBy(hashed_order(seed, id_col), id_col)
    return df.withColumn("_rank", F.row_number().over(w)).join(quotas.select(*cell, "quota"), cell).where("_rank <= quota").drop("_rank", "quota")


def draw_with_replacement(df: DataFrame, n: int, seed: int = 0, id_col: str = "id") -> DataFrame:
    """n hashed draws: ``slot`` and the row drawn. Rows are numbered once; slots join by number."""
    ranked = df.withColumn("_at", F.row_number().over(Window.orderBy(hashed_order(seed, id_col), id_col)) - 1)
    count = df.count()
    slots = df.sparkSession.range(n).withColumnRenamed("id", "slot").withColumn("_at", F.pmod(F.xxhash64(F.lit(seed), "slot"), F.lit(max(count, 1))).cast("int"))
    return slots.join(ranked, "_at").drop("_at")


def leakage(df: DataFrame, keys: list[str], split: str = "split") -> DataFrame:
    """Key values that more than one split has: ``key``, ``value`` and the number of splits."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys]))
    rows = df.select(split, pairs.alias("p")).select(split, "p.*").where("value IS NOT NULL")
    return rows.groupBy("key", "value").agg(F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def batches_by_rows(df: DataFrame, order: list[str | Column], rows_per_batch: int, keys: list[str] | None = None) -> DataFrame:
    """``batch`` of consecutive rows of a fixed size, the last with what is left."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    return df.withColumn("batch", F.floor((F.row_number().over(w.orderBy(*order)) - 1) / rows_per_batch))


def near_equal_groups(df: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """``part`` from 1: each group's rows in ceil(n / size) parts, the first ones larger by a row."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    rows = rows.withColumn("_g", F.ceil(F.col("_n") / size)).withColumn("_base", F.floor(F.col("_n") / F.col("_g"))).withColumn("_extra", F.col("_n") % F.col("_g"))
    wide = F.col("_extra") * (F.col("_base") + 1)
    part = F.when(F.col("_i") < wide, F.floor(F.col("_i") / (F.col("_base") + 1))).otherwise(F.col("_extra") + F.floor((F.col("_i") - wide) / F.col("_base")))
    return rows.withColumn("part", (part + 1).cast("int")).drop("_i", "_n", "_g", "_base", "_extra")
