"""Queries over views of questions and indexes of sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.operators import permutation as V
from grainmill.operators import source_index as X
from grainmill.plans.registry import register
from grainmill.plans.tables import READS, reads, table

_DISPLAYS = {0: "range(0, k)", 1: "list_reverse(range(0, k))", 2: "list_concat(range(1, k), [0])"}
_ALIGN = "list_transform(range(0, k), lambda i: {0}[list_position(display, i)])"
_VIEWS = f"""{READS},
shown AS (
  SELECT id, type, k, view, display, list_transform(display, lambda d: y[d + 1]) AS y, CASE view WHEN 0 THEN pa WHEN 1 THEN list_transform(display, lambda d: pb[d + 1]) ELSE pa END AS p
  FROM reads, (VALUES (0), (1), (2)) AS v (view), LATERAL (SELECT CASE view WHEN 0 THEN {_DISPLAYS[0]} WHEN 1 THEN {_DISPLAYS[1]} ELSE {_DISPLAYS[2]} END AS display)
  WHERE NOT (k = 2 AND view = 2) AND NOT (id % 50 = 7 AND view = 1)
), aligned AS (SELECT id, type, k, view, {_ALIGN.format("p")} AS p, {_ALIGN.format("y")} AS y FROM shown WHERE id % 50 <> 7)"""


def _views(spark, sf_dir):
    """Reads shown in their planned orders; of some questions one view is missing, so they are refused."""
    base = reads(spark, sf_dir)
    k = F.size("y")
    orders = V.planned_orders(k)
    shown = base.select("id", "type", "pa", "pb", "y", F.posexplode(orders).alias("view", "display"))
    by = lambda c: F.transform("display", lambda d: F.get(c, d))
    shown = shown.select("id", "type", "view", "display", F.when(F.col("view") == 1, by("pb")).otherwise(F.col("pa")).alias("p"), by("y").alias("y"))
    return shown.where("NOT (id % 50 = 7 AND view = 1)")


@register(
    "permutation_views",
    f"""WITH {_VIEWS}, tops AS (SELECT id, view, list_position(p, list_max(p)) AS top FROM aligned),
spread AS (SELECT id, max(high - low) AS label_range FROM (SELECT id, i, max(p[i]) AS high, min(p[i]) AS low FROM aligned, unnest(range(1, k + 1)) AS u(i) GROUP BY id, i) GROUP BY id),
apart AS (SELECT a.id, max(0.5 * list_sum(list_transform(list_zip(a.p, b.p), lambda z: abs(z[1] - z[2])))) AS tv FROM aligned a JOIN aligned b ON a.id = b.id GROUP BY a.id)
SELECT id, CAST(count(*) AS BIGINT) AS views, round(any_value(label_range), 9) AS label_range, round(any_value(tv), 9) AS total_variation, CAST(count(*) FILTER (WHERE top <> first) AS BIGINT) AS flips
FROM tops JOIN (SELECT id, top AS first FROM tops WHERE view = 0) USING (id) JOIN spread USING (id) JOIN apart USING (id) GROUP BY id""",
)
def permutation_views(spark, sf_dir):
    """Spread of each question's answers over its display orders."""
    found = V.permutation_diagnostics(_views(spark, sf_dir), "id")
    return found.select("id", "views", F.round("label_range", 9).alias("label_range"), F.round("total_variation", 9).alias("total_variation"), F.col("flips").cast("long").alias("flips"))


@register("permutation_faults", f"WITH {READS} SELECT CASE WHEN id % 50 = 7 THEN 'incomplete' ELSE 'none' END AS fault, count(*) AS n, CAST(sum(CASE WHEN k = 2 THEN 2 ELSE 3 END - CASE WHEN id % 50 = 7 THEN 1 ELSE 0 END) AS BIGINT) AS views FROM reads GROUP BY 1")
def permutation_faults(spark, sf_dir):
    return V.checked_views(_views(spark, sf_dir), "id").groupBy(F.coalesce("fault", F.lit("none")).alias("fault")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_views").alias("views"))


@register("source_cover", r"SELECT doc_id, sha256(coalesce(text, '')) AS joined, CAST(len(regexp_extract_all(text, '\b\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}(?::\d{2})?)?\b')) AS BIGINT) AS n_dates, true AS tiles FROM documents")
def source_cover(spark, sf_dir):
    """The spans of every document joined again, whether each starts where the one before stops, and the dates in them."""
    cut = table(spark, sf_dir, "documents").select("doc_id", X.spans(F.coalesce("text", F.lit(""))).alias("s"))
    tiles = F.forall(F.arrays_zip(F.slice("s", 2, 1 << 30).alias("b"), F.slice("s", 1, F.greatest(F.size("s") - 1, F.lit(0))).alias("a")), lambda z: z["a"]["stop"] == z["b"]["start"])
    found = F.aggregate("s", F.lit(0).cast("long"), lambda n, s: n + F.size(X.dates(s["text"])))
    return cut.select("doc_id", F.sha2(F.array_join(F.transform("s", lambda s: s["text"]), ""), 256).alias("joined"), found.alias("n_dates"), tiles.alias("tiles"))


@register("source_fields")
def source_fields(spark, sf_dir):
    return X.source_fields(table(spark, sf_dir, "documents"))
