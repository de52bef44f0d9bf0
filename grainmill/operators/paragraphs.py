"""Closure of rows over shared paragraphs, and roles for whole components under quotas.

Rows and paragraphs form a hypergraph: a row holds titles (told apart by
namespace) and texts. Rows that share any of them, directly or through rows that
nobody selects, are one component; a component has one role, and one blocked
row blocks it all. Every alias points at its least row, so a paragraph that most
rows hold costs one edge a row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.functions.hashing import bucket, hashed_order, sha
from grainmill.functions.text import normalize_text
from grainmill.operators.components import connected_components
from grainmill.plans.workspace import Workspace

Cell = tuple[str, str, str]


def paragraph_aliases(rows: DataFrame, id_col: str, paragraphs: str, namespace: str | Column) -> DataFrame:
    """``id`` and ``alias``, each once, of rows whose ``paragraphs`` are an array of (title, text).

    A title counts within its namespace, a text anywhere; both in their compatibility form, case folded,
    white space collapsed. Null and blank ones give no alias.
    """
    space_ = F.col(namespace) if isinstance(namespace, str) else namespace
    each = rows.select(F.col(id_col).alias("id"), space_.cast("string").alias("space"), F.explode(paragraphs).alias("p")).select("id", "space", "p.title", "p.text")
    kinds = F.explode(F.array(F.struct(F.lit("title").alias("kind"), F.col("space"), F.col("title").alias("value")), F.struct(F.lit("text").alias("kind"), F.lit("").alias("space"), F.col("text").alias("value"))))
    values = each.select("id", kinds.alias("k")).select("id", "k.*").where("value IS NOT NULL")
    folded = values.withColumn("value", normalize_text("value")).where("value <> ''")
    return folded.select("id", F.concat(F.col("kind"), F.lit("/"), sha(F.coalesce("space", F.lit("")), "value")).alias("alias")).distinct()


def close_paragraphs(rows: DataFrame, aliases: DataFrame, id_col: str = "id") -> DataFrame:
    """``id`` and ``component`` (its least id) of every row, rows without an alias alone."""
    space = Workspace(rows.sparkSession, "paragraphs")
    known = space.table("aliases", aliases.where("id IS NOT NULL"))
    heads = known.groupBy("alias").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    edges = known.join(heads, "alias").where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct()
    found = connected_components(edges, name="closure")
    every = rows.select(F.col(id_col).alias("id")).distinct()
    return every.join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component"))


def component_role(component: str | Column, weights: Mapping[str, int], seed: int = 0) -> Column:
    """A role for each component by hash, in proportion to whole weights, in the order of the names."""
    key = F.concat(F.lit(f"{seed}:"), (F.col(component) if isinstance(component, str) else component).cast("string"))
    draw, at, out = bucket(key, sum(weights.values())), 0, F.lit(None).cast("string")
    for name, weight in sorted(weights.items()):
        out = F.when((draw >= at) & (draw < at + weight), name).otherwise(out)
        at += weight
    return out


def assign_roles(rows: DataFrame, components: DataFrame, blocked: DataFrame, weights: Mapping[str, int], quotas: Mapping[Cell, int], seed: int = 0) -> DataFrame:
    """``rows`` (``id``, ``source``, ``type``) with ``component``, ``role`` and ``status``.

    ``status`` is *bridge* for a row without a type, *blocked* if any row of its component is in ``blocked``
    (``id``), *unplanned* if its (role, source, type) has no quota, else *selected* or *spare*: a cell takes one row of
    each component in turn, components by hash and their rows by id, until its quota is filled. Rows
    that a quota can use at most are kept before anything is shuffled by cell.
    """
    spark = rows.sparkSession
    space = Workspace(spark, "roles")
    bad = blocked.select(F.col("id").alias("_bad")).distinct().join(components, F.col("_bad") == F.col("id"), "left_semi")
    bad = components.join(bad.select(F.col("_bad").alias("id")), "id", "left_semi").select(F.col("component").alias("_blocked")).distinct()
    placed = rows.join(components, "id").withColumn("role", component_role("component", weights, seed))
    placed = placed.join(bad, F.col("component") == F.col("_blocked"), "left")
    plan = spark.createDataFrame([(*cell, n) for cell, n in quotas.items()] or [("", "", "", 0)], "role string, source string, type string, _quota long")
    placed = space.table("placed", placed.join(F.broadcast(plan), ["role", "source", "type"], "left"))  # the plan is an argument
    most = max(quotas.values(), default=0)
    usable = placed.where("type IS NOT NULL AND _blocked IS NULL AND _quota > 0").select("id", "role", "source", "type", "component", "_quota", hashed_order(seed, "component").alias("_h"))
    cell = ("role", "source", "type")
    # limits of the windows apply before their shuffles: a component or cell with most rows sends a quota's worth from each task
    turns = usable.withColumn("_turn", F.row_number().over(Window.partitionBy(*cell, "component").orderBy("id"))).where(F.col("_turn") <= most)
    picked = turns.withColumn("_at", F.row_number().over(Window.partitionBy(*cell).orderBy("_turn", "_h", "component", "id"))).where(F.col("_at") <= most).where("_at <= _quota")
    chosen = picked.select(F.col("id").alias("_chosen"))
    status = F.when(F.col("type").isNull(), "bridge").when(F.col("_blocked").isNotNull(), "blocked").when(F.col("_quota").isNull(), "unplanned").when(F.col("_chosen").isNotNull(), "selected").otherwise("spare")
    return placed.join(chosen, F.col("id") == F.col("_chosen"), "left").select(*rows.columns, "component", "role", status.alias("status"))


def quota_report(assigned: DataFrame, quotas: Mapping[Cell, int]) -> DataFrame:
    """For each planned cell its ``quota``, rows ``selected``, their ``components`` and what is ``missing``."""
    plan = assigned.sparkSession.createDataFrame([(*cell, n) for cell, n in quotas.items()], "role string, source string, type string, quota long")
    got = assigned.where("status = 'selected'").groupBy("role", "source", "type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("component").alias("k"))
    n, k = F.coalesce("n", F.lit(0)), F.coalesce("k", F.lit(0))
    return plan.join(got, ["role", "source", "type"], "left").select("role", "source", "type", "quota", n.alias("selected"), k.alias("components"), (F.col("quota") - n).alias("missing"))


def shared_between_roles(assigned: DataFrame, aliases: DataFrame) -> DataFrame:
    """Aliases that selected rows of more than one role hold: ``alias`` and ``n_roles``. Sound roles give none."""
    held = aliases.join(assigned.where("status = 'selected'").select("id", "role"), "id")
    return held.groupBy("alias").agg(F.count_distinct("role").alias("n_roles")).where("n_roles > 1")
