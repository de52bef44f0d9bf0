"""Queries for uncertainty, fits and generated sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.functions import probability as P
from grainmill.operators import inference as I
from grainmill.plans.registry import register
from grainmill.plans.tables import READS, reads, system, table
from grainmill.sources import generators as G

_CASES = " ".join(f"WHEN u < {p!r} THEN {k}" for k, p in enumerate(I._POISSON))


@register(
    "cluster_bootstrap",
    f"""WITH {READS}, c AS (SELECT type, cluster, sum(CAST(list_position(pa, list_max(pa)) - 1 = gold AS INT)) AS num, count(*) AS den FROM reads GROUP BY 1, 2),
d AS (SELECT type, num, den, rep, CAST('0x' || substr(sha256('15:' || rep || ':' || cluster), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM c, range(0, 200) t(rep)),
r AS (SELECT type, rep, sum(w * num) / sum(w * den) AS v FROM (SELECT *, CASE {_CASES} ELSE 8 END AS w FROM d) GROUP BY 1, 2)
SELECT type, round((SELECT sum(num) / sum(den) FROM c WHERE c.type = r.type), 6) AS estimate, (SELECT count(*) FROM c WHERE c.type = r.type) AS clusters, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM r GROUP BY type""",
)
def cluster_bootstrap(spark, sf_dir):
    rows = reads(spark, sf_dir).select("type", "cluster", (P.argmax("pa") == F.col("gold")).cast("int").alias("right"), F.lit(1).alias("one"))
    out = I.cluster_bootstrap(rows, "right", "one", "cluster", ["type"], 200)
    return out.select("type", "clusters", *[F.round(c, 6).alias(c) for c in ("estimate", "low", "high")])


@register("temperature_fit")
def temperature_fit(spark, sf_dir):
    out = I.fit_temperature(system(reads(spark, sf_dir), "a"), ["type"])
    return out.select("type", F.round("temperature", 4).alias("temperature"), F.round("nll", 6).alias("nll"), "n")


def _route_rows(spark, sf_dir):
    rows = reads(spark, sf_dir)
    return rows.select("id", P.entropy("pa").alias("entropy"), P.margin("pa").alias("margin"), F.array_max("pa").alias("top"), F.size("pa").cast("double").alias("k"), (P.argmax("pb") == F.col("gold")).cast("double").alias("gain"))


_ROUTE = ["entropy", "margin", "top", "k"]


@register("ridge_router")
def ridge_router(spark, sf_dir):
    rows = _route_rows(spark, sf_dir)
    return rows.select("id", F.round(I.fit_ridge(rows, _ROUTE, "gain").score(_ROUTE), 6).alias("score"))


@register("logistic_router")
def logistic_router(spark, sf_dir):
    rows = _route_rows(spark, sf_dir)
    return rows.select("id", F.round(I.fit_logistic(rows, _ROUTE, "gain").score(_ROUTE), 6).alias("score"))


@register("ols_signals", f"WITH {READS}, r AS (SELECT type, list_max(pa) AS x, list_max(pb) AS y FROM reads) SELECT type, round(regr_slope(y, x), 6) AS slope, round(corr(y, x), 6) AS pearson, round(quantile_cont(y, 0.1), 6) AS p10, round(quantile_cont(y, 0.5), 6) AS median, round(quantile_cont(y, 0.9), 6) AS p90 FROM r GROUP BY type")
def ols_signals(spark, sf_dir):
    rows = reads(spark, sf_dir).select("type", F.array_max("pa").alias("x"), F.array_max("pb").alias("y"))
    return rows.groupBy("type").agg(F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.corr("y", "x"), 6).alias("pearson"), *[F.round(F.percentile("y", q), 6).alias(n) for n, q in (("p10", 0.1), ("median", 0.5), ("p90", 0.9))])


@register("distill_filter", f"""WITH {READS}, m AS (SELECT id, -list_sum(list_transform(list_zip(pa, y), lambda z: z[2] * ln(greatest(z[1], 1e-12)))) AS na, -list_sum(list_transform(list_zip(pb, y), lambda z: z[2] * ln(greatest(z[1], 1e-12)))) AS nb,
list_sum(list_transform(list_zip(pa, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS ba, list_sum(list_transform(list_zip(pb, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS bb FROM reads)
SELECT id, CASE WHEN na - nb > 1e-9 AND bb <= ba THEN 'accepted' WHEN na - nb > 1e-9 THEN 'brier' WHEN bb <= ba THEN 'nll' ELSE 'nll,brier' END AS reasons FROM m""")
def distill_filter(spark, sf_dir):
    """A teacher's answer is taken where the loss falls and no other score gets worse; else the reasons."""
    rows = reads(spark, sf_dir)
    worse = F.array_compact(F.array(F.when(~(P.nll("pa", "y") - P.nll("pb", "y") > 1e-9), F.lit("nll")), F.when(P.brier("pb", "y") > P.brier("pa", "y"), F.lit("brier"))))
    return rows.select("id", F.coalesce(F.nullif(F.array_join(worse, ","), F.lit("")), F.lit("accepted")).alias("reasons"))


def _mismatches(kind):
    @register(f"generator_{kind}", "SELECT CAST(2000 AS BIGINT) AS n, CAST(0 AS BIGINT) AS mismatches")
    def check(spark, sf_dir):
        make, verify = G.GENERATORS[kind]
        return verify(make(spark, 2000, 3)).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("label").eqNullSafe(F.col("again"))).alias("mismatches"))

    return check


for _kind in G.GENERATORS:
    _mismatches(_kind)


@register("curriculum", "SELECT kind, split, CAST(50 AS BIGINT) AS n FROM (SELECT unnest(['temporal', 'numeric', 'policy', 'calendar', 'bayes', 'draws']) AS kind), (SELECT unnest(['train', 'dev', 'test']) AS split)")
def curriculum(spark, sf_dir):
    return G.curriculum(spark, 50).groupBy("kind", "split").agg(F.count(F.lit(1)).alias("n"))


@register("usage_cost", "SELECT event_type, round((avg(length(props)) * 0.15 + avg(value) * 0.6) / 1000, 6) AS usd_per_1000 FROM events GROUP BY event_type")
def usage_cost(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round((F.avg(F.length("props")) * 0.15 + F.avg("value") * 0.6) / 1000, 6).alias("usd_per_1000"))


@register("subset_gate", f"""WITH {READS}, r AS (SELECT tier, CAST(list_position(pa, list_max(pa)) - 1 = gold AS INT) AS a, CAST(list_position(pb, list_max(pb)) - 1 = gold AS INT) AS b, latency FROM reads)
SELECT tier, round(100 * (avg(b) - avg(a)), 6) AS delta, 100 * (avg(b) - avg(a)) >= -2 AND quantile_cont(latency, 0.95) <= 1.1 * (SELECT quantile_cont(latency, 0.95) FROM r) AS passed FROM r GROUP BY tier""")
def subset_gate(spark, sf_dir):
    rows = reads(spark, sf_dir).select("tier", (P.argmax("pa") == F.col("gold")).cast("int").alias("a"), (P.argmax("pb") == F.col("gold")).cast("int").alias("b"), "latency")
    whole = rows.agg(F.percentile("latency", 0.95).alias("all"))
    by = rows.groupBy("tier").agg((100 * (F.avg("b") - F.avg("a"))).alias("delta"), F.percentile("latency", 0.95).alias("p95")).crossJoin(F.broadcast(whole))
    return by.select("tier", F.round("delta", 6).alias("delta"), F.expr("delta >= -2 AND p95 <= 1.1 * all").alias("passed"))


