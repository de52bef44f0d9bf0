"""Queries that cut ordered rows: token budgets, shared prefixes, budgeted hold-outs."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.functions.hashing import hashed_order
from grainmill.functions.text import fold
from grainmill.operators import batching as T
from grainmill.operators.holdout import hold_out
from grainmill.plans.queries_corpus import _FOLD
from grainmill.plans.registry import register
from grainmill.plans.tables import table

MAX_TOKENS, MAX_ROWS, CHUNK_TOKENS = 16_384, 64, 1_024
_TOKENS = "CAST(ceil(length(coalesce({0}, '')) / 4.0) AS BIGINT)"


def _walk(rows: str, order: str, budget: str, most: int) -> str:
    """CTEs that walk rows of ``rows`` (g, size, cap) one after the other; ``walk`` has their batch."""
    return f"""numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY size, {order}) AS i FROM {rows}),
walk AS (
  SELECT g, id, i, size, cap, CAST(0 AS BIGINT) AS batch, 1 AS held FROM numbered WHERE i = 1
  UNION ALL
  SELECT n.g, n.id, n.i, n.size, n.cap, w.batch + CASE WHEN n.size * (w.held + 1) > {budget} OR w.held >= {most} THEN 1 ELSE 0 END,
    CASE WHEN n.size * (w.held + 1) > {budget} OR w.held >= {most} THEN 1 ELSE w.held + 1 END
  FROM walk w JOIN numbered n ON n.g = w.g AND n.i = w.i + 1
)"""


@register("token_batches", f"WITH RECURSIVE items AS (SELECT 0 AS g, doc_id AS id, {_TOKENS.format('text')} AS size, 0 AS cap FROM documents), {_walk('items', 'id', str(MAX_TOKENS), MAX_ROWS)} SELECT id AS doc_id, size AS tokens, batch FROM walk")
def token_batches(spark, sf_dir):
    items = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_TOKENS.format('text')} AS tokens")
    return T.budget_batches(items, "tokens", MAX_TOKENS, MAX_ROWS, ["doc_id"])


_ITEMS = f"""turns AS (SELECT conv_id, turn, {_TOKENS.format("text")} AS n, first_value(turn) OVER w AS head, first_value({_TOKENS.format("text")}) OVER w AS prefix FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
items AS (SELECT conv_id, turn, prefix, n AS suffix, count(*) OVER (PARTITION BY conv_id) AS k FROM turns WHERE turn <> head),
singles AS (SELECT 0 AS g, conv_id * 1000 + turn AS id, prefix + suffix AS size, 0 AS cap FROM items WHERE k < 2 OR (k - 1) * prefix < {T.LEAST_SAVING}),
pairs AS (SELECT conv_id AS g, conv_id * 1000 + turn AS id, suffix AS size, {CHUNK_TOKENS} - prefix AS cap FROM items WHERE k >= 2 AND (k - 1) * prefix >= {T.LEAST_SAVING})"""


@register(
    "prefix_chunks",
    f"""WITH RECURSIVE {_ITEMS}, {_walk("singles", "id", str(CHUNK_TOKENS), MAX_ROWS)},
{_walk("pairs", "id", "n.cap", 1 << 40).replace("numbered", "numbered2").replace("walk", "walk2")}
SELECT id, 'rows' AS kind, batch AS chunk FROM walk UNION ALL SELECT id, 'shared', batch FROM walk2""",
)
def prefix_chunks(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{_TOKENS.format('text')} AS suffix")
    # the first turn of a conversation is the prefix of the others: found by aggregation, so a long one needs no window
    heads = turns.groupBy("conv_id").agg(F.min("turn").alias("head"), F.min_by("suffix", "turn").alias("prefix"))
    items = turns.join(heads, "conv_id").where("turn <> head").selectExpr("conv_id", "conv_id * 1000 + turn AS id", "prefix", "suffix")
    return T.plan_chunks(items, "conv_id", "prefix", "suffix", CHUNK_TOKENS, ["id"], MAX_ROWS).select("id", "kind", "chunk")


_SEED = 11
_GROUPS = f"""docs AS (SELECT sha256({_FOLD.format("coalesce(text, '')")}) AS g, source || '|' || lang AS cell, lang, source, length(coalesce(text, '')) AS n FROM documents),
cells AS (SELECT DISTINCT g, cell FROM docs),
numbers AS (SELECT cell, count(*) AS total, row_number() OVER (ORDER BY cell) AS c FROM cells GROUP BY cell),
totals AS (SELECT list(total ORDER BY c) AS total FROM numbers),
of_group AS (SELECT g, list(c) AS cs FROM cells JOIN numbers USING (cell) GROUP BY g)"""
EVAL_QUESTIONS, BUCKET_QUESTIONS, LONG_TEXT, MOST_TAKEN = 200, 12, 2_000, 0.5
_LANGS = ("en", "fr", "de", "es")
_BUCKETS = {f"{lang}_{size}": f"lang = '{lang}' AND length(coalesce(text, '')) {op} {LONG_TEXT}" for lang in _LANGS for size, op in (("long", ">="), ("short", "<"))}


def _sql_walk(counts: str, order: str, helps: str, limit: str) -> str:
    """CTEs that walk groups one by one; needs and cells are lists that each step lowers."""
    return f"""ranked AS MATERIALIZED (SELECT g, cs, {counts} AS ns, row_number() OVER (ORDER BY {order}) AS r FROM of_group JOIN counted USING (g)),
walk AS (
  SELECT CAST(0 AS BIGINT) AS r, CAST(NULL AS VARCHAR) AS g, total AS remain, needs, CAST(0 AS BIGINT) AS n_taken, false AS taken, false AS spared FROM totals, needed
  UNION ALL
  SELECT r, g, CASE WHEN taken THEN list_transform(remain, lambda x, i: x - CASE WHEN list_contains(cs, i) THEN 1 ELSE 0 END) ELSE remain END,
    CASE WHEN taken THEN list_transform(needs, lambda x, i: greatest(x - ns[i], 0)) ELSE needs END, n_taken + CASE WHEN taken THEN 1 ELSE 0 END, taken, wanted AND NOT taken
  FROM (
    SELECT *, wanted AND list_min(list_transform(cs, lambda c: remain[c])) > 1 AS taken FROM (
      SELECT k.r, k.g, k.cs, k.ns, w.remain, w.needs, w.n_taken, list_max(w.needs) > 0 AND w.n_taken < {limit} AND {helps} AS wanted FROM walk w JOIN ranked k ON k.r = w.r + 1
    )
  )
)"""


def _groups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("group", F.sha2(fold(F.coalesce("text", F.lit(""))), 256))
    return docs, docs.select("group", F.concat_ws("|", "source", "lang").alias("cell"))


@register(
    "eval_holdout",
    f"""WITH RECURSIVE {_GROUPS}, counted AS (SELECT g, count(*) AS n FROM docs GROUP BY g), needed AS (SELECT [CAST({EVAL_QUESTIONS} AS BIGINT)] AS needs),
{_sql_walk("[n]", f"sha256('{_SEED}:' || g), g", "true", "(SELECT floor(count(*) * " + str(MOST_TAKEN) + ") FROM of_group)")}
SELECT g AS "group", taken, spared AS kept_for_cell FROM walk WHERE r > 0""",
)
def eval_holdout(spark, sf_dir):
    """Whole groups of equal documents held out until they hold 200 documents, none of a cell's last."""
    docs, cells = _groups(spark, sf_dir)
    counts = docs.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    limit = max(1, int(counts.count() * MOST_TAKEN))
    return hold_out(counts, cells, {"n": EVAL_QUESTIONS}, [hashed_order(_SEED, "group"), "group"], limit=limit, any_group=True).select("group", "taken", "kept_for_cell")


@register(
    "calibration_reserve",
    f"""WITH RECURSIVE {_GROUPS}, of_docs AS (SELECT sha256({_FOLD.format("coalesce(text, '')")}) AS g, lang, source, text FROM documents),
counted AS (SELECT g, max(source LIKE 'src1%') AS made, {", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in _BUCKETS.items())} FROM of_docs GROUP BY g),
needed AS (SELECT list_transform(range(0, {len(_BUCKETS)}), lambda x: CAST({BUCKET_QUESTIONS} AS BIGINT)) AS needs),
{_sql_walk("[" + ", ".join(_BUCKETS) + "]", f"made, sha256('{_SEED}:' || g), g", "list_bool_or(list_transform(list_zip(k.ns, w.needs), lambda z: z[1] > 0 AND z[2] > 0))", "(SELECT count(*) FROM of_group)")}
SELECT g AS "group", taken, spared AS kept_for_cell FROM walk WHERE r > 0""",
)
def calibration_reserve(spark, sf_dir):
    """Groups held out until every language has 12 long and 12 short documents, those of some sources last."""
    docs, cells = _groups(spark, sf_dir)
    counts = docs.groupBy("group").agg(F.max(F.col("source").like("src1%")).alias("made"), *[F.count_if(F.expr(c)).alias(n) for n, c in _BUCKETS.items()])
    taken = hold_out(counts, cells, dict.fromkeys(_BUCKETS, BUCKET_QUESTIONS), ["made", hashed_order(_SEED, "group"), "group"])
    return taken.select("group", "taken", "kept_for_cell")
