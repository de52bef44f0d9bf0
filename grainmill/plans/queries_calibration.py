"""Queries that fit biases and corrections on reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.operators import calibration as C
from grainmill.plans.registry import register
from grainmill.plans.shipping import ship
from grainmill.plans.tables import READS, reads

_TEMPERATURE = {"choice": 1.5, "noul": 1.0, "score": 0.8}
_T = "CASE type WHEN 'choice' THEN 1.5 WHEN 'noul' THEN 1.0 ELSE 0.8 END"

#: Gradient descent with a step by the bound on curvature; the offsets of a noul start with a fixed zero.
_DESCENT = f"""{READS},
samples AS MATERIALIZED (SELECT type, k, {_T} AS t, list_transform(logits, lambda x: x - list_max(logits)) AS m, y, count(*) OVER (PARTITION BY type, k) AS n FROM reads),
descent AS (
  SELECT type, k, 0 AS step, list_transform(range(0, k), lambda i: 0.0::DOUBLE) AS b FROM samples WHERE n >= {C.BIAS_LEAST} GROUP BY type, k
  UNION ALL
  SELECT type, k, step + 1, list(CASE WHEN type = 'noul' AND i = 1 THEN 0.0 ELSE b_i - (g / n + {C.BIAS_L2} * b_i) / ((CASE type WHEN 'noul' THEN 0.25 ELSE 0.5 END) / (t * t) + {C.BIAS_L2}) END ORDER BY i)
  FROM (
    SELECT type, k, step, i, any_value(b[i]) AS b_i, any_value(t) AS t, any_value(n) AS n, sum((e[i] / list_sum(e) - y[i]) / t) AS g
    FROM (SELECT d.type, d.k, d.step, d.b, s.t, s.n, s.y, list_transform(list_zip(s.m, d.b), lambda z: exp((z[1] + z[2]) / s.t)) AS e FROM descent d JOIN samples s ON s.type = d.type AND s.k = d.k WHERE d.step < 600), unnest(range(1, k + 1)) AS u(i)
    GROUP BY type, k, step, i
  ) GROUP BY type, k, step
)"""


@register("letter_bias", f"WITH RECURSIVE {_DESCENT} SELECT type, CAST(k AS INTEGER) AS k, CAST(i - 1 AS INTEGER) AS letter, round(b[i], 6) AS bias FROM descent, unnest(range(1, k + 1)) AS u(i) WHERE step = 600 AND NOT (type = 'noul' AND i = 1)")
def letter_bias(spark, sf_dir):
    """Offsets of every letter by type and width, fitted together."""
    ship(spark)
    rows = reads(spark, sf_dir).select("type", F.col("logits").alias("masses"), "y")
    found = C.fit_letter_bias(rows, _TEMPERATURE).where("fitted").select("type", "k", F.posexplode("bias").alias("letter", "bias"))
    first = F.when(F.col("type") == "noul", 1).otherwise(0)
    return found.select("type", "k", (F.col("letter") + first).cast("int").alias("letter"), F.round("bias", 6).alias("bias"))


_MARGIN = "3 * (logits[{0} + 1] - logits[{0}]) + CASE WHEN gold = 1 THEN 2.5 ELSE 0.3 END"
_TRUE = "CASE WHEN id % 9 = 0 THEN 0.7 WHEN gold = 1 THEN 1.0 ELSE 0.0 END"
_NEWTON = f"""{READS},
nouls AS MATERIALIZED (
  SELECT {_MARGIN.format(1)} AS m, CAST({_TRUE} AS DOUBLE) AS y, id % 2 = 0 AS long, list_sum(list_transform(string_split(sha256(CAST(id // 3 AS VARCHAR)), ''), lambda c: CAST('0x' || c AS BIGINT))) % {C.FOLDS} AS fold FROM reads WHERE type = 'noul'
), heat AS (
  SELECT f, part, 0 AS step, 1.0::DOUBLE AS beta FROM (SELECT unnest(range(0, {C.FOLDS})) AS f), (VALUES ('all'), ('long'), ('short')) AS v (part)
  UNION ALL
  SELECT f, part, step + 1, least({C._BETA_MOST}, greatest({C._BETA_LEAST}, beta - g / h)) FROM (
    SELECT f, part, step, beta, sum(m * (1 / (1 + exp(-beta * m)) - y)) AS g, sum(m * m / (2 + exp(beta * m) + exp(-beta * m))) AS h FROM heat JOIN nouls ON fold <> f AND (part = 'all' OR long = (part = 'long')) WHERE step < 40 GROUP BY f, part, step, beta)
), affine AS (
  SELECT f, s, 0 AS step, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM (SELECT unnest(range(0, {C.FOLDS})) AS f), (VALUES {", ".join(f"({s}::DOUBLE)" for s in C.STRENGTHS)}) AS v (s)
  UNION ALL
  SELECT f, s, step + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) FROM (
    SELECT f, s, step, a, b, avg((p - y) * q) + 2 * s * a AS ga, avg(p - y) + 2 * s * b AS gb, avg(p * (1 - p) * q * q + (p - y) * q) + 2 * s AS haa, avg(p * (1 - p) * q) AS hab, avg(p * (1 - p)) + 2 * s AS hbb
    FROM (SELECT f, s, step, a, b, y, exp(a) * m AS q, 1 / (1 + exp(-(exp(a) * m + b))) AS p FROM affine JOIN nouls ON fold <> f WHERE step < 40) GROUP BY f, s, step, a, b)
), read AS (
  SELECT 0.0::DOUBLE AS strength, y, 1 / (1 + exp(-beta * m)) AS p FROM nouls JOIN heat ON f = fold AND step = 40 AND part = CASE WHEN long THEN 'long' ELSE 'short' END
  UNION ALL SELECT s, y, 1 / (1 + exp(-(exp(a) * m + b))) FROM nouls JOIN affine ON f = fold AND step = 40
)"""


@register(
    "noul_crossfit",
    f"""WITH RECURSIVE {_NEWTON}
SELECT strength, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS nll, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(CASE WHEN p <= 0.2 THEN 1 - y WHEN p >= 0.8 THEN y ELSE 0 END), 6) AS credit,
  count(*) FILTER (WHERE p > 0.2 AND p < 0.8) AS abstentions FROM read GROUP BY strength""",
)
def noul_crossfit(spark, sf_dir):
    """Held-out loss of temperatures (strength 0) and of affine corrections, each fold read by the fits of the others."""
    ship(spark)
    rows = reads(spark, sf_dir).where("type = 'noul'").selectExpr("cast(id div 3 AS string) AS cluster", f"{_MARGIN.format(0)} AS margin", f"{_TRUE} AS y", "CASE WHEN id % 2 = 0 THEN 2000 ELSE 100 END AS tokens")
    fit = C.fit_noul(rows)
    measured = {0.0: fit.baseline, **fit.candidates}
    out = [(s, m["nll"], m["brier"], m["credit"], m["abstentions"]) for s, m in measured.items() if m]
    return spark.createDataFrame(out, "strength double, nll double, brier double, credit double, abstentions long").select("strength", *[F.round(c, 6).alias(c) for c in ("nll", "brier", "credit")], "abstentions")
