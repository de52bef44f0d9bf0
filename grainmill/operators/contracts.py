"""Checks that two tables, or several readings of one, hold what they must.

Each returns the violations as rows, so that an empty result is a pass and
nothing has to come to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.hashing import sha


def row_contract(rows: DataFrame, expected: DataFrame, key: Sequence[str], complete: bool = True) -> DataFrame:
    """Keys that ``rows`` repeats, has beyond ``expected``, or (``complete``) lacks: ``key`` columns and ``problem``.

    Both sides are counted by key before they meet: one shuffle, and no key is hot.
    """
    seen = rows.select(*key, F.lit(1).alias("_r"), F.lit(0).alias("_e")).unionByName(expected.select(*key, F.lit(0).alias("_r"), F.lit(1).alias("_e")))
    n = seen.groupBy(*key).agg(F.sum("_r").alias("_r"), F.sum("_e").alias("_e"))
    rules = [F.when(F.col("_e") == 0, "unknown"), F.when(F.col("_r") > 1, "duplicate")]
    if complete:
        rules.append(F.when(F.col("_r") == 0, "missing"))
    return n.select(*key, F.explode(F.array_compact(F.array(*rules))).alias("problem"))


def variant_alignment(rows: DataFrame, variant: str, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Keys that not every variant holds exactly once, or whose ``fields`` differ between variants."""
    variants = rows.agg(F.count_distinct(variant).alias("_all"))
    same = [F.max(F.struct(f)).eqNullSafe(F.min(F.struct(f))) & (F.count(f).isin(0) | (F.count(f) == F.count(F.lit(1)))) for f in fields]
    per = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(variant).alias("_v"), F.array_compact(F.array(*[F.when(~s, F.lit(f"{f} differs")) for f, s in zip(fields, same, strict=True)])).alias("_d"))
    held = per.crossJoin(F.broadcast(variants))  # one row
    problems = F.concat(F.array_compact(F.array(F.when(F.col("_n") > F.col("_v"), "duplicate"), F.when(F.col("_v") < F.col("_all"), "missing variant"))), F.col("_d"))
    return held.select(*key, F.explode(problems).alias("problem"))


def differences(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows, with repeats, that one side has more often: ``cols``, and the surplus of the left side (negative: of the right)."""
    both = left.select(*cols, F.lit(1).alias("_s")).unionByName(right.select(*cols, F.lit(-1).alias("_s")))
    return both.groupBy(*cols).agg(F.sum("_s").alias("surplus")).where("surplus <> 0")


def lineage_key(family: Column, example: Column, translation_of: Column, derived_from: Column) -> Column:
    """family:root, the root being what an example was translated or derived from, else itself; null without family or example."""
    given = lambda c: F.nullif(c.cast("string"), F.lit(""))
    root = F.coalesce(given(translation_of), given(derived_from), given(example))
    return F.when(given(family).isNotNull() & given(example).isNotNull(), F.concat_ws(":", family, root))


def group_key(template: Sequence[Column], lineage: Column, own: Column) -> Column:
    """Identity of what rows are split by: the hashed template fields if any is set, else the lineage, else the row's own key."""
    parts = [F.coalesce(t.cast("string"), F.lit("")) for t in template]
    return F.when(F.concat(*parts) != "", sha(*parts)).otherwise(F.coalesce(lineage, own))


def commitment(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Hashes alone of the named fields: ``field`` and ``hash``, distinct. Array fields give a hash for each entry; nulls none."""
    types = dict(rows.select(*[c.alias(n) for n, c in fields.items()]).dtypes)
    entry = lambda n: lambda v: F.struct(F.lit(n).alias("field"), v.cast("string").alias("value"))
    entries = [F.transform(c if types[n].startswith("array") else F.array(c), entry(n)) for n, c in fields.items()]
    flat = rows.select(F.explode(F.concat(*[F.coalesce(e, F.array().cast("array<struct<field:string,value:string>>")) for e in entries])).alias("e")).where("e.value IS NOT NULL")
    return flat.select("e.field", F.sha2("e.value", 256).alias("hash")).distinct()


def commitment_overlap(rows: DataFrame, fields: dict[str, Column], committed: DataFrame) -> DataFrame:
    """Hashes of ``rows`` that a published commitment holds too; any is a leak."""
    return commitment(rows, fields).join(committed.select("field", "hash"), ["field", "hash"], "left_semi")


def preferred(base: DataFrame, over: DataFrame, key: Sequence[str], cols: Sequence[str], needed: Column) -> DataFrame:
    """``base`` with ``cols`` taken from ``over`` where it has the key; ``gap`` marks rows that need ``over`` and lack it.

    Keys of ``over`` must be unique; see ``row_contract``.
    """
    right = over.select(*key, F.lit(True).alias("_has"), *[F.col(c).alias(f"_{c}") for c in cols])
    joined = base.join(right, list(key), "left")
    has = F.coalesce(F.col("_has"), F.lit(False))
    out = joined.withColumn("gap", F.coalesce(needed, F.lit(False)) & ~has)
    return out.withColumns({c: F.when(has, F.col(f"_{c}")).otherwise(F.col(c)) for c in cols}).drop("_has", *[f"_{c}" for c in cols])


def partition_audit(universe: Column, buckets: Column, parent: Column | None = None) -> Column:
    """How named buckets (array of struct<id, outcomes>) cover a small domain, or the ``parent`` subset of it.

    Struct of overlap_pairs, equivalent_pairs, outside_parent, residual, explicit_coverage and exhaustive. A
    domain has at most 256 outcomes and 8 buckets; ``valid`` is false beyond that, for repeats and for unknown outcomes.
    """
    allowed = universe if parent is None else F.coalesce(parent, universe)
    union = F.array_distinct(F.flatten(F.transform(buckets, lambda b: b["outcomes"])))
    pairs = F.flatten(F.transform(buckets, lambda a, i: F.transform(F.slice(buckets, i + 2, F.size(buckets)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    names = lambda ps: F.transform(ps, lambda p: F.concat_ws("|", p["a"]["id"], p["b"]["id"]))
    same = lambda p: (F.size(F.array_except(p["a"]["outcomes"], p["b"]["outcomes"])) == 0) & (F.size(F.array_except(p["b"]["outcomes"], p["a"]["outcomes"])) == 0)
    unique = lambda a: F.size(F.array_distinct(a)) == F.size(a)
    residual = F.array_except(allowed, union)
    valid = F.size(universe).between(1, 256) & unique(universe) & F.size(buckets).between(1, 8) & F.forall(buckets, lambda b: (F.size(b["outcomes"]) > 0) & unique(b["outcomes"])) & (F.size(F.array_except(union, universe)) == 0)
    return F.struct(
        names(F.filter(pairs, lambda p: F.arrays_overlap(p["a"]["outcomes"], p["b"]["outcomes"]))).alias("overlap_pairs"),
        names(F.filter(pairs, same)).alias("equivalent_pairs"),
        F.array_sort(F.array_except(union, allowed)).alias("outside_parent"),
        F.array_sort(residual).alias("residual"),
        (F.size(F.array_intersect(union, allowed)) / F.size(F.array_distinct(allowed))).alias("explicit_coverage"),
        (F.size(residual) == 0).alias("exhaustive"),
        valid.alias("valid"),
    )
