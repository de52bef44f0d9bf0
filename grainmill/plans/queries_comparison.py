"""Queries that compare systems and check tables against each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.functions import probability as P
from grainmill.operators import comparison as C
from grainmill.operators import contracts as K
from grainmill.operators import scoring as S
from grainmill.plans.registry import register
from grainmill.plans.tables import READS, reads, system, table, typed

_BOTH = typed() + "," + typed("pb")[len(READS) :].lstrip(",").replace("typed AS", "typed_b AS", 1)


def _pairs(spark, sf_dir):
    """Typed rows of systems a and b side by side, from one scan: no join."""
    base = reads(spark, sf_dir)
    keep = ["nll", "brier", "rps", "nmae", "correct", "p", "y"]
    rows = S.typed_rows(system(base, "a")).withColumn("a", F.struct(*keep)).select("id", "type", "tier", "y", "pb", "a")
    return S.typed_rows(rows.withColumnRenamed("pb", "p")).withColumn("b", F.struct(*keep)).select("id", "type", "tier", "y", "a", "b")


@register(
    "best_threshold",
    f"""WITH {READS}, r AS (SELECT tier, gold, ln(p / (1 - p)) AS v FROM (SELECT tier, gold, greatest(least(round(pa[2], 3), 0.999), 0.001) AS p FROM reads WHERE type = 'noul')),
d AS (SELECT DISTINCT tier, v FROM r), g AS (SELECT tier, (v + lead(v) OVER (PARTITION BY tier ORDER BY v)) / 2 AS t FROM d UNION ALL SELECT DISTINCT tier, unnest([-20.0, 20.0]) FROM r),
s AS (SELECT g.tier, t, sum(CAST((v > t) = (gold = 1) AS INT)) AS c, count(*) AS n FROM g JOIN r ON g.tier = r.tier WHERE t IS NOT NULL GROUP BY ALL)
SELECT tier, round(arg_max(t, (c, -abs(t), -t)), 6) AS threshold, round(max(c) / max(n), 6) AS accuracy FROM s GROUP BY tier""",
)
def best_threshold(spark, sf_dir):
    p = F.greatest(F.least(F.round(F.get("pa", F.lit(1)), 3), F.lit(0.999)), F.lit(0.001))
    rows = reads(spark, sf_dir).where("type = 'noul'").select("tier", "gold", F.log(p / (1 - p)).alias("v"))
    return C.best_threshold(rows, ["tier"], "v", "gold").select("tier", F.round("threshold", 6).alias("threshold"), F.round("accuracy", 6).alias("accuracy"))


@register(
    "intelligence_proxy",
    f"""WITH {typed()}, t AS (SELECT type, CASE tier WHEN 'standard' THEN 'original' ELSE tier END AS tier, avg(correct) AS acc, avg(chance) AS ch FROM typed GROUP BY 1, 2),
w AS (SELECT type, CASE tier WHEN 'easy' THEN 14 WHEN 'original' THEN 28 WHEN 'hard' THEN 30 END AS w, greatest(0, (acc - ch) / (1 - ch)) AS g FROM t)
SELECT type, round(coalesce(100 * sum(w * g) / sum(w), 0), 6) AS intelligence_proxy FROM w GROUP BY type""",
)
def intelligence_proxy(spark, sf_dir):
    rows = S.typed_rows(system(reads(spark, sf_dir), "a")).withColumn("tier", F.when(F.col("tier") == "standard", "original").otherwise(F.col("tier")))
    tiers = rows.groupBy("type", "tier").agg(F.avg("correct").alias("accuracy"), F.avg("chance").alias("chance"))
    return C.intelligence_proxy(tiers, ["type"]).select("type", F.round("intelligence_proxy", 6).alias("intelligence_proxy"))


@register(
    "latency_summary",
    f"""WITH {READS}, l AS (SELECT tier, avg(latency) AS m, list_sort(list(latency)) AS l, count(*) AS n FROM reads GROUP BY tier)
SELECT tier, round(m, 6) AS mean_s, round(l[n // 2 + 1], 6) AS p50_s, round(l[(19 * n + 19) // 20], 6) AS p95_s FROM l""",
)
def latency_summary(spark, sf_dir):
    return C.latency_summary(reads(spark, sf_dir), ["tier"], "latency").select("tier", *[F.round(c, 6).alias(c) for c in ("mean_s", "p50_s", "p95_s")])


@register(
    "reading_changes",
    f"""WITH {_BOTH}, p AS (SELECT a.type, CASE WHEN a.type = 'score' THEN a.nmae - b.nmae ELSE b.correct - a.correct END AS g, CASE WHEN a.type = 'score' THEN 1e-6 ELSE 0 END AS least, b.nll - a.nll AS nll, b.brier - a.brier AS brier, b.rps - a.rps AS rps,
  a.y[list_position(a.pa, list_max(a.pa))] AS ca, b.y[list_position(b.pb, list_max(b.pb))] AS cb, a.correct AS ra, b.correct AS rb FROM typed a JOIN typed_b b USING (id))
SELECT type, count(*) AS n, count(*) FILTER (WHERE g > least) AS better, count(*) FILTER (WHERE g < -least) AS worse, round(avg(nll), 6) AS nll_delta, round(avg(brier), 6) AS brier_delta, round(avg(rps), 6) AS rps_delta,
  round(avg(CASE WHEN type = 'noul' THEN cb - ca END), 6) AS argmax_credit_delta, round(avg(CASE WHEN type = 'noul' THEN (cb - rb) - (ca - ra) END), 6) AS abstention_penalty_delta FROM p GROUP BY type""",
)
def reading_changes(spark, sf_dir):
    out = C.changes(_pairs(spark, sf_dir))
    return out.select("type", "n", "better", "worse", *[F.round(c, 6).alias(c) for c in ("nll_delta", "brier_delta", "rps_delta", "argmax_credit_delta", "abstention_penalty_delta")])


@register(
    "acceptance_reasons",
    f"""WITH {_BOTH} SELECT id, concat_ws(',', CASE WHEN b.nll >= a.nll - 1e-9 THEN 'no_gold_nll_gain' END, CASE WHEN b.brier > a.brier + 1e-9 THEN 'gold_brier_regression' END,
  CASE WHEN a.type = 'score' AND b.rps > a.rps + 1e-9 THEN 'score_rps_regression' END, CASE WHEN a.type = 'score' AND b.nmae > a.nmae + 1e-9 THEN 'score_nmae_regression' END,
  CASE WHEN a.type <> 'score' AND b.correct < a.correct - 1e-9 THEN 'thresholded_credit_regression' END, CASE WHEN a.type <> 'score' AND list_max(a.y) = 1 AND b.correct <> 1 THEN 'wrong_or_abstaining_hard_gold' END) AS reasons
FROM typed a JOIN typed_b b USING (id)""",
)
def acceptance_reasons(spark, sf_dir):
    return _pairs(spark, sf_dir).select("id", F.array_join(C.acceptance_reasons("a", "b", "y"), ",").alias("reasons"))


@register(
    "candidate_order",
    f"""WITH {typed()}, r AS (SELECT cluster AS system, 100 * avg(correct) AS cc, avg(nll) AS loss, CASE WHEN cluster % 5 > 0 THEN max(latency) END AS p95 FROM typed WHERE cluster % 9 > 0 GROUP BY cluster), t AS (SELECT *, max(cc) OVER () - cc <= 20 AS tied FROM r)
SELECT system, CAST(row_number() OVER (ORDER BY tied DESC, CASE WHEN tied THEN loss END ASC NULLS LAST, CASE WHEN tied THEN p95 END ASC NULLS LAST, cc DESC, system) AS INTEGER) AS place FROM t""",
)
def candidate_order(spark, sf_dir):
    rows = S.typed_rows(system(reads(spark, sf_dir), "a")).groupBy(F.col("cluster").alias("system")).agg((100 * F.avg("correct")).alias("cc"), F.avg("nll").alias("proper_loss"), F.max("latency").alias("l"))
    reports = rows.select("system", "cc", "proper_loss", F.expr("CASE WHEN system % 5 > 0 THEN l END").alias("p95_s"), F.lit(None).cast("double").alias("usd_per_1000"), F.expr("system % 9 > 0").alias("complete"))
    return C.candidate_order(reports, within=20.0).select("system", "place")


@register(
    "row_contract",
    """WITH r AS (SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY 1), j AS (SELECT coalesce(r.key, c_custkey) AS key, coalesce(n, 0) AS n, c_custkey IS NULL AS extra FROM r FULL JOIN customer ON r.key = c_custkey)
SELECT key, unnest(list_filter([CASE WHEN extra THEN 'unknown' END, CASE WHEN n > 1 THEN 'duplicate' END, CASE WHEN n = 0 THEN 'missing' END], lambda x: x IS NOT NULL)) AS problem FROM j""",
)
def row_contract(spark, sf_dir):
    return K.row_contract(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), ["key"])


@register(
    "variant_alignment",
    """WITH e AS (SELECT user_id, event_type, CAST(value > 100 AS INTEGER) AS high FROM events), a AS (SELECT count(DISTINCT event_type) AS v FROM e),
g AS (SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS v, min(high) <> max(high) AS d FROM e GROUP BY user_id)
SELECT user_id, unnest(list_filter([CASE WHEN g.n > g.v THEN 'duplicate' END, CASE WHEN g.v < a.v THEN 'missing variant' END, CASE WHEN d THEN 'high differs' END], lambda x: x IS NOT NULL)) AS problem FROM g, a""",
)
def variant_alignment(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", (F.col("value") > 100).cast("int").alias("high"))
    return K.variant_alignment(rows, "event_type", ["user_id"], ["high"])


@register("cell_differences", "SELECT key, sum(s) AS surplus FROM (SELECT o_custkey AS key, CASE o_orderstatus WHEN 'F' THEN 1 ELSE -1 END AS s FROM orders WHERE o_orderstatus IN ('F', 'O')) GROUP BY key HAVING sum(s) <> 0")
def cell_differences(spark, sf_dir):
    of = lambda s: table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("key"))
    return K.differences(of("F"), of("O"), ["key"])


@register(
    "lineage_groups",
    """WITH k AS (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN doc_id // 6 END AS root, CASE WHEN doc_id % 4 = 0 THEN lang END AS template FROM documents)
SELECT coalesce(CASE WHEN coalesce(template, '') <> '' THEN sha256(template || chr(31)) END, source || ':' || coalesce(root, doc_id)) AS key, count(*) AS n FROM k GROUP BY 1""",
)
def lineage_groups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "source", "CASE WHEN doc_id % 3 = 0 THEN doc_id div 6 END AS root", "CASE WHEN doc_id % 4 = 0 THEN lang END AS template")
    lineage = K.lineage_key(F.col("source"), F.col("doc_id"), F.lit(None), F.col("root"))
    return docs.groupBy(K.group_key([F.col("template"), F.lit("")], lineage, F.col("doc_id").cast("string")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "holdout_overlap",
    """SELECT DISTINCT field, hash FROM (SELECT 'state' AS field, sha256(text) AS hash FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'identity', sha256(source || ':' || doc_id) FROM documents)
WHERE (field, hash) IN (SELECT ('state', sha256(text)) FROM documents WHERE lang = 'en' AND text IS NOT NULL UNION ALL SELECT ('identity', sha256(source || ':' || doc_id)) FROM documents WHERE lang = 'en')""",
)
def holdout_overlap(spark, sf_dir):
    """Hashes that documents share with a commitment to the English ones."""
    docs = table(spark, sf_dir, "documents")
    fields = {"state": F.col("text"), "identity": F.array(F.concat_ws(":", "source", "doc_id"))}
    return K.commitment_overlap(docs, fields, K.commitment(docs.where("lang = 'en'"), fields))


@register(
    "preferred_reads",
    """SELECT o_orderkey, CASE WHEN c.c_custkey IS NOT NULL THEN c_acctbal ELSE o_totalprice END AS amount, c.c_custkey IS NULL AND o_orderstatus = 'O' AS gap FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey % 2 = 0) c ON o_custkey = c_custkey""",
)
def preferred_reads(spark, sf_dir):
    base = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("amount"), "o_orderstatus")
    over = table(spark, sf_dir, "customer").where("c_nationkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("amount"))
    return K.preferred(base, over, ["key"], ["amount"], F.col("o_orderstatus") == "O").select("o_orderkey", "amount", "gap")


@register(
    "partition_audit",
    """WITH b AS (SELECT vec_id, list_transform(range(0, 10), lambda i: CAST(i AS VARCHAR)) AS u, list_transform(list_filter(range(0, 10), lambda i: i % (2 + vec_id % 3) = 0), lambda i: CAST(i AS VARCHAR)) AS x,
  list_transform(list_filter(range(0, 10), lambda i: i % (2 + vec_id % 4) = 1), lambda i: CAST(i AS VARCHAR)) AS y, list_transform(list_filter(range(0, 10), lambda i: i % 2 = 0), lambda i: CAST(i AS VARCHAR)) AS z, list_transform(range(0, 8), lambda i: CAST(i AS VARCHAR)) AS p FROM embeddings),
c AS (SELECT *, list_distinct(x || y || z) AS un FROM b)
SELECT vec_id, concat_ws(',', CASE WHEN list_has_any(x, y) THEN 'x|y' END, CASE WHEN list_has_any(x, z) THEN 'x|z' END, CASE WHEN list_has_any(y, z) THEN 'y|z' END) AS overlap_pairs, concat_ws(',', CASE WHEN x = y THEN 'x|y' END, CASE WHEN x = z THEN 'x|z' END, CASE WHEN y = z THEN 'y|z' END) AS equivalent_pairs,
  array_to_string(list_sort(list_filter(un, lambda i: NOT list_contains(p, i))), ',') AS outside_parent, array_to_string(list_filter(p, lambda i: NOT list_contains(un, i)), ',') AS residual, round(len(list_filter(p, lambda i: list_contains(un, i))) / 8, 6) AS explicit_coverage, list_has_all(un, p) AS exhaustive, true AS valid FROM c""",
)
def partition_audit(spark, sf_dir):
    names = lambda a: F.transform(a, lambda i: i.cast("string"))
    ten = F.sequence(F.lit(0), F.lit(9))
    bucket = lambda name, keep: F.struct(F.lit(name).alias("id"), names(F.filter(ten, keep)).alias("outcomes"))
    made = F.array(bucket("x", lambda i: i % (2 + F.col("vec_id") % 3) == 0), bucket("y", lambda i: i % (2 + F.col("vec_id") % 4) == 1), bucket("z", lambda i: i % 2 == 0))
    out = table(spark, sf_dir, "embeddings").select("vec_id", K.partition_audit(names(ten), made, names(F.sequence(F.lit(0), F.lit(7)))).alias("a")).select("vec_id", "a.*")
    joined = ("overlap_pairs", "equivalent_pairs", "outside_parent", "residual")
    return out.withColumns({c: F.array_join(c, ",") for c in joined}).withColumn("explicit_coverage", F.round("explicit_coverage", 6))


@register("length_temperatures")
def length_temperatures(spark, sf_dir):
    """Temperatures by type and length bucket; the length is a stand-in."""
    rows = reads(spark, sf_dir).select("type", "gold", F.col("pa").alias("p"), F.expr("id * 7919 % 2048").alias("length"))
    return C.length_temperatures(rows).select("key", F.round("temperature", 4).alias("temperature"), "n")


@register("interaction_interval")
def interaction_interval(spark, sf_dir):
    """Difference of differences of mean competence: systems a and b, each against its reading at temperature 2."""
    base = reads(spark, sf_dir)
    arm = lambda name, p: base.select("cluster", "type", "y", p.alias("p"), F.lit(name).alias("arm"))
    rows = arm("a", F.col("pa")).unionByName(arm("a2", P.temperature_scale("pa", 2.0))).unionByName(arm("b", F.col("pb"))).unionByName(arm("b2", P.temperature_scale("pb", 2.0)))
    return C.bootstrap_competence(S.typed_rows(rows), {"a": 1, "a2": -1, "b": -1, "b2": 1})
