"""Queries over probability reads: row metrics, calibration, competence, pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.functions import probability as P
from grainmill.operators import scoring as S
from grainmill.plans.registry import register
from grainmill.plans.tables import READS, reads, system, typed


def _r(name: str, digits: int = 6):
    return F.round(F.col(name), digits).alias(name)


_PAIR = "list_zip(pa, pb)"


@register(
    "row_metrics",
    f"""WITH {READS} SELECT id, CAST(list_position(pa, list_max(pa)) = list_position(y, list_max(y)) AS DOUBLE) AS accuracy,
  round(-list_sum(list_transform(list_zip(pa, y), lambda z: z[2] * ln(greatest(z[1], 1e-12)))), 6) AS nll,
  round(list_sum(list_transform(list_zip(pa, y), lambda z: CASE WHEN z[2] > 0 THEN z[2] * (ln(z[2]) - ln(greatest(z[1], 1e-12))) ELSE 0 END)), 6) AS kl,
  round(list_sum(list_transform(list_zip(pa, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS brier,
  round(list_sum(list_transform(range(1, k), lambda j: (list_sum(pa[1:j]) - list_sum(y[1:j])) * (list_sum(pa[1:j]) - list_sum(y[1:j])))) / (k - 1), 6) AS rps,
  round(list_sum(list_transform(list_zip(pa, y), lambda z: 0.5 * CASE WHEN z[1] > 0 THEN z[1] * ln(2 * z[1] / (z[1] + z[2])) ELSE 0 END + 0.5 * CASE WHEN z[2] > 0 THEN z[2] * ln(2 * z[2] / (z[1] + z[2])) ELSE 0 END)), 6) AS jsd
FROM reads""",
)
def row_metrics(spark, sf_dir):
    rows = system(reads(spark, sf_dir), "a")
    out = rows.select("id", P.accuracy("p", "y").alias("accuracy"), P.nll("p", "y").alias("nll"), P.kl("p", "y").alias("kl"), P.brier("p", "y").alias("brier"), P.rps("p", "y").alias("rps"), P.jsd("p", "y").alias("jsd"))
    return out.select("id", "accuracy", *[_r(c) for c in ("nll", "kl", "brier", "rps", "jsd")])


@register(
    "metric_bundle",
    f"""WITH {typed()} SELECT coalesce(type, 'all') AS type, count(*) AS n, round(avg(CAST(list_position(pa, list_max(pa)) = list_position(y, list_max(y)) AS DOUBLE)), 6) AS accuracy,
  round(avg(nll), 6) AS nll, round(avg(list_sum(list_transform(list_zip(pa, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS brier, round(avg(list_max(pa)), 6) AS p_max
FROM typed GROUP BY GROUPING SETS ((), (type))""",
)
def metric_bundle(spark, sf_dir):
    rows = system(reads(spark, sf_dir), "a").withColumns({"accuracy": P.accuracy("p", "y"), "nll": P.nll("p", "y"), "brier": P.brier("p", "y"), "p_max": F.array_max("p")})
    return rows.rollup("type").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("accuracy", "nll", "brier", "p_max")]).withColumn("type", F.coalesce("type", F.lit("all")))


_TYPED = ("nll", "brier", "confidence", "correct", "chance", "calibration_target", "nmae", "nmae_chance", "rps")


@register("typed_rows", f"WITH {typed()} SELECT id, type, abstained, {', '.join(f'round({c}, 6) AS {c}' for c in _TYPED)} FROM typed")
def typed_rows(spark, sf_dir):
    return S.typed_rows(system(reads(spark, sf_dir), "a")).select("id", "type", "abstained", *[_r(c) for c in _TYPED])


_CC = "CASE WHEN max(type) = 'score' THEN 100 * (1 - sum(nmae) / sum(nmae_chance)) ELSE 100 * (avg(correct) - avg(chance)) / (1 - avg(chance)) END"
_WEIGHT = "CASE tier WHEN 'easy' THEN 0.1 WHEN 'standard' THEN 0.2 WHEN 'judge' THEN 0.3 WHEN 'hard' THEN 0.4 END"


@register(
    "type_summary",
    f"""WITH {typed()}, tiers AS (SELECT type, tier, {_CC} AS cc FROM typed GROUP BY type, tier),
cc AS (SELECT type, sum({_WEIGHT} * cc) / sum({_WEIGHT}) AS cc FROM tiers GROUP BY type),
bins AS (SELECT type, least(floor(confidence * 10), 9) AS b, abs(sum(confidence - calibration_target)) AS gap FROM typed GROUP BY 1, 2),
ece AS (SELECT type, sum(gap) AS gap FROM bins GROUP BY type),
rest AS (SELECT type, count(*) AS n, avg(nll) AS nll, avg(brier) AS brier, avg(rps) AS rps, count(*) FILTER (WHERE abstained) AS abstentions FROM typed GROUP BY type)
SELECT type, n, round(cc, 6) AS cc, round(nll, 6) AS nll, round(gap / n, 6) AS ece, round(brier, 6) AS brier, round(rps, 6) AS rps, abstentions FROM rest JOIN cc USING (type) JOIN ece USING (type)""",
)
def type_summary(spark, sf_dir):
    rows = S.typed_rows(system(reads(spark, sf_dir), "a"))
    rest = rows.groupBy("type").agg(F.avg("nll").alias("nll"), F.avg("brier").alias("brier"), F.avg("rps").alias("rps"), F.count_if("abstained").alias("abstentions"))
    out = S.competence_by_type(rows, []).join(S.calibration_error(rows, ["type"]), "type").join(rest, "type")
    return out.select("type", "n", *[_r(c) for c in ("cc", "nll", "ece", "brier", "rps")], "abstentions")


@register(
    "intelligence",
    f"""WITH {typed()}, tiers AS (SELECT type, tier, count(*) AS n, {_CC} AS cc FROM typed GROUP BY type, tier),
types AS (SELECT type, sum({_WEIGHT} * cc) / sum({_WEIGHT}) AS cc, sum(n) AS n FROM tiers GROUP BY type)
SELECT round(CASE WHEN count(*) = 3 THEN avg(cc) END, 6) AS intelligence, round(sum(cc * n) / sum(n), 6) AS question_weighted FROM types""",
)
def intelligence(spark, sf_dir):
    return S.intelligence(S.typed_rows(system(reads(spark, sf_dir), "a")), []).select(_r("intelligence"), _r("question_weighted"))


@register(
    "calibration_axes",
    f"""WITH {typed()}, hard AS (SELECT * FROM typed WHERE type <> 'choice' OR tier = 'hard'),
o AS (SELECT type, CASE WHEN type = 'noul' THEN pa[2] ELSE list_max(pa) END AS c, CASE WHEN type = 'noul' THEN CAST(gold = 1 AS INT) ELSE CAST(list_position(pa, list_max(pa)) - 1 = gold AS INT) END AS t FROM hard),
b AS (SELECT type, least(floor(c * 10), 9) AS b, abs(sum(c - t)) AS gap, count(*) AS n FROM o GROUP BY 1, 2)
SELECT type, round(sum(gap) / sum(n), 6) AS ece, round(100 * (1 - sum(gap) / sum(n) / 0.5), 6) AS ece_score FROM b GROUP BY type""",
)
def calibration_axes(spark, sf_dir):
    rows = system(reads(spark, sf_dir), "a").where("type <> 'choice' OR tier = 'hard'")
    noul = F.col("type") == "noul"
    rows = rows.select("type", F.when(noul, F.get("p", F.lit(1))).otherwise(F.array_max("p")).alias("c"), F.when(noul, (F.col("gold") == 1).cast("int")).otherwise((P.argmax("p") == F.col("gold")).cast("int")).alias("t"))
    out = S.calibration_error(rows, ["type"], "c", "t")
    return out.select("type", _r("ece"), F.round(100 * (1 - F.col("ece") / 0.5), 6).alias("ece_score"))


@register(
    "noul_auc",
    f"""WITH {READS}, r AS (SELECT tier, gold, round(pa[2], 3) AS p FROM reads WHERE type = 'noul'),
pairs AS (SELECT a.tier, avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) AS auc FROM r a JOIN r b ON a.tier = b.tier WHERE a.gold = 1 AND b.gold = 0 GROUP BY a.tier)
SELECT tier, round(auc, 6) AS auc FROM pairs""",
)
def noul_auc(spark, sf_dir):
    rows = system(reads(spark, sf_dir), "a").where("type = 'noul'").select("tier", "gold", F.round(F.get("p", F.lit(1)), 3).alias("p_true"))
    return S.auc(rows, ["tier"]).select("tier", _r("auc"))


@register(
    "noul_states",
    f"""WITH {READS}, r AS (SELECT tier, gold, pa[2] AS p, CASE WHEN pa[2] <= 0.2 THEN 0 WHEN pa[2] >= 0.8 THEN 1 END AS d FROM reads WHERE type = 'noul' AND id % 5 <> 0)
SELECT tier, count(*) AS questions, count(*) FILTER (WHERE d = gold) AS correct, count(*) FILTER (WHERE d <> gold) AS wrong, count(*) FILTER (WHERE d IS NULL) AS abstain,
  round(avg(p) FILTER (WHERE gold = 0), 6) AS p_false, round(avg(p) FILTER (WHERE gold = 1), 6) AS p_true FROM r GROUP BY tier""",
)
def noul_states(spark, sf_dir):
    rows = system(reads(spark, sf_dir), "a").where("type = 'noul' AND id % 5 <> 0").withColumn("t", F.get("p", F.lit(1)))
    rows = rows.withColumn("d", F.expr("CASE WHEN t <= 0.2 THEN 0 WHEN t >= 0.8 THEN 1 END"))
    return rows.groupBy("tier").agg(F.count(F.lit(1)).alias("questions"), F.expr("count_if(d = gold)").alias("correct"), F.expr("count_if(d <> gold)").alias("wrong"), F.expr("count_if(d IS NULL)").alias("abstain"), F.expr("round(avg(t) FILTER (WHERE gold = 0), 6)").alias("p_false"), F.expr("round(avg(t) FILTER (WHERE gold = 1), 6)").alias("p_true"))


@register(
    "state_transitions",
    f"""WITH {READS}, r AS (SELECT type, CASE WHEN list_position(pa, list_max(pa)) - 1 = gold THEN 'right' ELSE 'wrong' END AS a, CASE WHEN list_position(pb, list_max(pb)) - 1 = gold THEN 'right' ELSE 'wrong' END AS b FROM reads)
SELECT type, a || '->' || b AS transition, count(*) AS n FROM r GROUP BY 1, 2""",
)
def state_transitions(spark, sf_dir):
    state = lambda p: F.when(P.argmax(p) == F.col("gold"), "right").otherwise("wrong")
    return reads(spark, sf_dir).groupBy("type", F.concat_ws("->", state("pa"), state("pb")).alias("transition")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "selective_risk",
    f"""WITH {typed()}, r AS (SELECT type, correct, row_number() OVER (PARTITION BY type ORDER BY round(confidence, 9) DESC, id) AS k, count(*) OVER (PARTITION BY type) AS n FROM typed)
SELECT type, round(1 - avg(correct), 6) AS risk FROM r WHERE k <= greatest(1, floor(n * 0.3)) GROUP BY type""",
)
def selective_risk(spark, sf_dir):
    rows = S.typed_rows(system(reads(spark, sf_dir), "a")).withColumn("confidence", F.round("confidence", 9))
    return S.selective_risk(rows, 0.3, ["type"]).select("type", _r("risk"))


@register("latency_quantiles", f"""WITH {READS}, r AS (SELECT tier, latency, row_number() OVER (PARTITION BY tier ORDER BY latency) AS k, count(*) OVER (PARTITION BY tier) AS n FROM reads)
SELECT tier, round(quantile_cont(latency, 0.95), 6) AS interpolated, round(max(latency) FILTER (WHERE k = least(n, floor(0.95 * n) + 1)), 6) AS nearest, round(max(latency) FILTER (WHERE k = ceil(0.95 * n)), 6) AS ceiling, round(max(latency) FILTER (WHERE k = n // 2 + 1), 6) AS middle FROM r GROUP BY tier""")
def latency_quantiles(spark, sf_dir):
    rows = reads(spark, sf_dir).select("tier", "latency")
    rest = rows.selectExpr("tier", "latency", "row_number() OVER (PARTITION BY tier ORDER BY latency) AS k", "count(*) OVER (PARTITION BY tier) AS n").groupBy("tier").agg(F.expr("round(max(latency) FILTER (WHERE k = ceil(0.95 * n)), 6)").alias("ceiling"), F.expr("round(max(latency) FILTER (WHERE k = n div 2 + 1), 6)").alias("middle"))
    nearest = S.nearest_rank(rows, "latency", 0.95, ["tier"]).select("tier", F.round("quantile", 6).alias("nearest"))
    return rows.groupBy("tier").agg(F.round(F.percentile("latency", 0.95), 6).alias("interpolated")).join(nearest, "tier").join(rest, "tier")


@register(
    "axis_scores",
    f"""WITH {READS}, r AS (SELECT tier, quantile_cont(latency, 0.5) AS p50, quantile_cont(latency, 0.95) AS p95, avg(latency) AS m FROM reads GROUP BY tier),
a AS (SELECT tier, 60 + 10 * m AS i, 40 + 20 * m AS c, ((100 - 20 * log10((2 * p50 + 0.15) / 0.1)) + (100 - 20 * log10((2 * p95 + 0.15) / 0.1))) / 2 AS s, 100 - 30 * log10(m / 100 / 0.001) AS u FROM r),
h AS (SELECT *, CASE WHEN least(i, c, s, u) <= 0 THEN 0 ELSE 1 / (0.25 / i + 0.25 / c + 0.25 / s + 0.25 / u) * CASE WHEN i < 50 THEN (i / 50) ** 2 ELSE 1 END * CASE WHEN s < 50 THEN (s / 50) ** 2 ELSE 1 END * CASE WHEN u < 50 THEN (u / 50) ** 2 ELSE 1 END END AS view_a FROM a)
SELECT tier, round(s, 6) AS speed, round(u, 6) AS cost, round(view_a, 6) AS composite FROM h""",
)
def axis_scores(spark, sf_dir):
    rows = reads(spark, sf_dir).groupBy("tier").agg(F.percentile("latency", 0.5).alias("p50"), F.percentile("latency", 0.95).alias("p95"), F.avg("latency").alias("m"))
    raw = lambda c: S.speed_score(2 * F.col(c) + 0.15)
    rows = rows.select("tier", (60 + 10 * F.col("m")).alias("i"), (40 + 20 * F.col("m")).alias("c"), ((raw("p50") + raw("p95")) / 2).alias("s"), S.cost_score(F.col("m") / 100).alias("u"))
    return rows.select("tier", F.round("s", 6).alias("speed"), F.round("u", 6).alias("cost"), F.round(S.composite([F.col(x) for x in "icsu"], (0.25,) * 4), 6).alias("composite"))


@register(
    "paired_contrast",
    f"""WITH {READS}, r AS (SELECT tier, list_position(pa, list_max(pa)) - 1 = gold AS a, list_position(pb, list_max(pb)) - 1 = gold AS b FROM reads)
SELECT tier, count(*) AS n, count(*) FILTER (WHERE a AND NOT b) AS left_only, count(*) FILTER (WHERE b AND NOT a) AS right_only, round(avg(CAST(b AS INT)) - avg(CAST(a AS INT)), 6) AS delta FROM r GROUP BY tier""",
)
def paired_contrast(spark, sf_dir):
    rows = reads(spark, sf_dir).select("tier", (P.argmax("pa") == F.col("gold")).alias("a"), (P.argmax("pb") == F.col("gold")).alias("b"))
    return rows.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.expr("count_if(a AND NOT b)").alias("left_only"), F.expr("count_if(b AND NOT a)").alias("right_only"), F.expr("round(avg(cast(b AS int)) - avg(cast(a AS int)), 6)").alias("delta"))


@register(
    "mcnemar_exact",
    """WITH RECURSIVE c AS (SELECT DISTINCT label AS left_only, (label * 7 + 3) % 11 AS right_only FROM embeddings),
t AS (SELECT left_only, right_only, 0 AS i, CAST(1 AS DOUBLE) AS term, CAST(1 AS DOUBLE) AS s FROM c
  UNION ALL SELECT left_only, right_only, i + 1, term * (left_only + right_only - i) / (i + 1), s + term * (left_only + right_only - i) / (i + 1) FROM t WHERE i < least(left_only, right_only))
SELECT left_only, right_only, round(CASE WHEN left_only + right_only = 0 THEN 1 ELSE least(1, 2 * max(s) / 2 ** (left_only + right_only)) END, 6) AS p FROM t GROUP BY 1, 2""",
)
def mcnemar_exact(spark, sf_dir):
    from grainmill.plans.tables import table

    rows = table(spark, sf_dir, "embeddings").selectExpr("label AS left_only", "(label * 7 + 3) % 11 AS right_only").distinct()
    return rows.select("left_only", "right_only", F.round(S.mcnemar(F.col("left_only"), F.col("right_only")), 6).alias("p"))


@register(
    "factorial_cube",
    f"""WITH {READS}, r AS (SELECT type, tier, CAST(list_position(pa, list_max(pa)) - 1 = gold AS INT) AS a, CAST(list_position(pb, list_max(pb)) - 1 = gold AS INT) AS b, id % 2 AS f FROM reads)
SELECT coalesce(type, 'all') AS type, coalesce(tier, 'all') AS tier, round(avg(b) FILTER (WHERE f = 1) - avg(a) FILTER (WHERE f = 1), 6) AS effect_1, round(avg(b) FILTER (WHERE f = 0) - avg(a) FILTER (WHERE f = 0), 6) AS effect_0,
  round((avg(b) FILTER (WHERE f = 1) - avg(a) FILTER (WHERE f = 1)) - (avg(b) FILTER (WHERE f = 0) - avg(a) FILTER (WHERE f = 0)), 6) AS interaction FROM r GROUP BY CUBE (type, tier)""",
)
def factorial_cube(spark, sf_dir):
    rows = reads(spark, sf_dir).select("type", "tier", (P.argmax("pa") == F.col("gold")).cast("int").alias("a"), (P.argmax("pb") == F.col("gold")).cast("int").alias("b"), F.expr("id % 2").alias("f"))
    cells = rows.cube("type", "tier").agg(*[F.expr(f"avg({x}) FILTER (WHERE f = {f})").alias(f"{x}{f}") for x in "ab" for f in (0, 1)])
    return cells.select(F.coalesce("type", F.lit("all")).alias("type"), F.coalesce("tier", F.lit("all")).alias("tier"), F.expr("round(b1 - a1, 6)").alias("effect_1"), F.expr("round(b0 - a0, 6)").alias("effect_0"), F.expr("round((b1 - a1) - (b0 - a0), 6)").alias("interaction"))


_LISTS = {
    "temperature": (lambda: P.temperature_scale("pa", 2.5), "list_transform(pa, lambda x: pow(x, 0.4) / list_sum(list_transform(pa, lambda z: pow(z, 0.4))))"),
    "pooled": (lambda: P.log_linear_pool("pa", "pb"), f"list_transform({_PAIR}, lambda z: sqrt(z[1] * z[2]) / list_sum(list_transform({_PAIR}, lambda w: sqrt(w[1] * w[2]))))"),
    "fused": (lambda: P.linear_fusion("pa", "pb", 0.3, 0.6), f"CASE WHEN list_max(pa) <= 0.6 THEN list_transform({_PAIR}, lambda z: 0.7 * z[1] + 0.3 * z[2]) ELSE pa END"),
    "log_softmax": (lambda: P.log_softmax("logits"), "list_transform(logits, lambda x: x - ln(list_sum(list_transform(logits, lambda z: exp(z)))))"),
}


@register(
    "probability_transforms",
    f"WITH {READS}, t AS (SELECT id, unnest(range(1, k + 1)) AS i, " + ", ".join(f"{sql} AS {name}" for name, (_, sql) in _LISTS.items()) + " FROM reads) SELECT id, CAST(i AS INTEGER) AS i, " + ", ".join(f"round({name}[i], 6) AS {name}" for name in _LISTS) + " FROM t",
)
def probability_transforms(spark, sf_dir):
    rows = reads(spark, sf_dir).select("id", F.posexplode(F.arrays_zip(*[make().alias(name) for name, (make, _) in _LISTS.items()])).alias("i", "v"))
    return rows.select("id", (F.col("i") + 1).alias("i"), *[F.round(F.col("v")[name], 6).alias(name) for name in _LISTS])


_SCALARS = {
    "entropy": (lambda: P.entropy("pa"), "-list_sum(list_transform(pa, lambda x: x * ln(x)))"),
    "margin": (lambda: P.margin("pa"), "list_reverse_sort(pa)[1] - list_reverse_sort(pa)[2]"),
    "log_sum_exp": (lambda: P.log_sum_exp("logits"), "ln(list_sum(list_transform(logits, lambda z: exp(z))))"),
    "choice_confidence": (lambda: P.choice_confidence("pa"), "(list_max(pa) - 1.0 / k) / (1 - 1.0 / k)"),
    "expected_score": (lambda: P.expected_score("pa", F.transform("pa", lambda x, i: i.cast("double"))), "list_sum(list_transform(pa, lambda x, i: x * (i - 1)))"),
    "committed": (lambda: P.commit_band(F.element_at("pa", 2), 0.05, 0.1), "CASE WHEN pa[2] > 0.2 AND pa[2] < 0.8 AND pa[2] >= 0.5 AND pa[2] - 0.5 >= 0.1 THEN 0.801 WHEN pa[2] > 0.2 AND pa[2] < 0.8 AND pa[2] < 0.5 AND 0.5 - pa[2] >= 0.05 THEN 0.199 ELSE pa[2] END"),
    "affine": (lambda: P.affine_sigmoid(F.log(F.element_at("pa", 2) / F.element_at("pa", 1)), 1.2, -0.1), "1 / (1 + exp(-(1.2 * ln(pa[2] / pa[1]) - 0.1)))"),
    "total_variation": (lambda: P.total_variation("pa", "pb"), f"list_sum(list_transform({_PAIR}, lambda z: abs(z[1] - z[2]))) / 2"),
    "largest_gap": (lambda: P.largest_gap("pa", "pb"), f"list_max(list_transform({_PAIR}, lambda z: abs(z[1] - z[2])))"),
    "penalty": (lambda: P.missing_evidence_penalty("pa", 0.4), "greatest(list_max(pa) - 0.4, 0) * greatest(list_max(pa) - 0.4, 0)"),
    "log_space_nll": (lambda: P.log_space_nll("logits", "y"), "-list_sum(list_transform(list_zip(logits, y), lambda z: z[2] * (z[1] - ln(list_sum(list_transform(logits, lambda w: exp(w)))))))"),
}


@register("probability_scalars", f"WITH {READS} SELECT id, " + ", ".join(f"round({sql}, 6) AS {name}" for name, (_, sql) in _SCALARS.items()) + " FROM reads")
def probability_scalars(spark, sf_dir):
    return reads(spark, sf_dir).select("id", *[F.round(make(), 6).alias(name) for name, (make, _) in _SCALARS.items()])


@register(
    "shortlist_rescore",
    f"""WITH {READS}, c AS (SELECT id, pa, pb, list_sort(list_transform(pa, lambda x, i: {{'m': -x, 'i': i}}))[1:3] AS top FROM reads WHERE k > 3),
m AS (SELECT *, list_transform(top, lambda t: t.i) AS chosen, list_sum(list_transform(top, lambda t: pa[t.i])) AS mass, list_sum(list_transform(top, lambda t: pb[t.i])) AS weight FROM c)
SELECT id, CAST(i AS INTEGER) AS i, round(CASE WHEN list_contains(chosen, i) THEN mass * pb[i] / weight ELSE pa[i] END, 6) AS p FROM (SELECT *, unnest(range(1, len(pa) + 1)) AS i FROM m)""",
)
def shortlist_rescore(spark, sf_dir):
    return reads(spark, sf_dir).where(F.size("pa") > 3).select("id", F.posexplode(P.shortlist_rescore("pa", "pb", 3)).alias("i", "p")).select("id", (F.col("i") + 1).alias("i"), _r("p"))


@register(
    "policy_grid",
    f"""WITH {READS}, grid AS (SELECT unnest([0.5, 1.0, 2.0, 4.0]) AS t), r AS (SELECT id, t, gold, list_transform(pa, lambda x: pow(x, 1 / t)) AS q FROM reads, grid WHERE type = 'choice'),
s AS (SELECT t, avg(-ln(greatest(q[gold + 1] / list_sum(q), 1e-12))) AS nll, count(*) FILTER (WHERE list_max(q) / list_sum(q) >= 0.5) AS committed FROM r GROUP BY t)
SELECT t AS temperature, round(nll, 6) AS nll, committed, row_number() OVER (ORDER BY round(nll, 9), abs(ln(t))) = 1 AS chosen FROM s""",
)
def policy_grid(spark, sf_dir):
    """Every policy of a small grid on every row; the best by loss, then the nearest to no change."""
    from pyspark.sql import Window

    grid = spark.createDataFrame([(t,) for t in (0.5, 1.0, 2.0, 4.0)], "temperature double")
    rows = reads(spark, sf_dir).where("type = 'choice'").crossJoin(F.broadcast(grid)).withColumn("q", P.temperature_scale("pa", "temperature"))
    out = rows.groupBy("temperature").agg(F.avg(-F.log(F.greatest(F.get("q", F.col("gold")), F.lit(1e-12)))).alias("nll"), F.count_if(F.array_max("q") >= 0.5).alias("committed"))
    rank = F.row_number().over(Window.orderBy(F.round("nll", 9), F.abs(F.log("temperature"))))
    return out.select("temperature", _r("nll"), "committed", (rank == 1).alias("chosen"))
