"""Uncertainty and fits: cluster bootstrap, temperature, affine, ridge and logistic routers."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions import probability as P

#: Cumulative Poisson(1) probabilities: a hashed uniform below the k-th gives weight k.
_POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(8)]


def poisson_weight(uniform: Column) -> Column:
    out = F.lit(len(_POISSON))
    for k in reversed(range(len(_POISSON))):
        out = F.when(uniform < _POISSON[k], k).otherwise(out)
    return out


def hashed_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits of a SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, 13), 16, 10).cast("double") / float(1 << 52)


def cluster_bootstrap(rows: DataFrame, numerator: str, denominator: str, cluster: str, keys: list[str], replicates: int = 2000, seed: int = 15) -> DataFrame:
    """2.5, 50 and 97.5 percent points of a ratio of sums, clusters weighted by hashed Poisson draws.

    Rows are summed by cluster first. Every system in ``keys`` meets the same draws,
    because a draw hangs on cluster and replicate only.
    """
    per = rows.groupBy(*keys, cluster).agg(F.sum(numerator).alias("num"), F.sum(denominator).alias("den"))
    draws = per.crossJoin(F.broadcast(rows.sparkSession.range(replicates).withColumnRenamed("id", "rep")))
    weight = poisson_weight(hashed_uniform(F.lit(seed), F.col("rep"), F.col(cluster)))
    reps = draws.withColumn("w", weight).groupBy(*keys, "rep").agg((F.sum(F.col("w") * F.col("num")) / F.nullif(F.sum(F.col("w") * F.col("den")), F.lit(0))).alias("v"))
    point = per.groupBy(*keys).agg((F.sum("num") / F.sum("den")).alias("estimate"), F.count(F.lit(1)).alias("clusters"))
    spread = reps.groupBy(*keys).agg(F.percentile("v", 0.025).alias("low"), F.percentile("v", 0.975).alias("high"))
    return point.join(spread, keys) if keys else point.crossJoin(spread)


def conservative_interval(values: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Order statistics at floor(.025 (n-1)) and ceil(.975 (n-1))."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys)
    ranked = values.withColumn("_i", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    pick = lambda at: F.max(F.when(F.col("_i") == at, F.col(value)))
    return ranked.groupBy(*keys).agg(pick(F.floor(0.025 * (F.col("_n") - 1))).alias("low"), pick(F.ceil(0.975 * (F.col("_n") - 1))).alias("high"))


def fit_temperature(reads: DataFrame, keys: list[str], p: str = "p", gold: str = "gold", low: float = 0.25, high: float = 10.0, steps: int = 41, rounds: int = 3) -> DataFrame:
    """Temperature of least mean NLL by group: a logarithmic grid, refined around its best point each round.

    All groups and grid points are one aggregation a round; grids are ``steps`` points.
    """
    spark = reads.sparkSession
    grid = spark.createDataFrame([(i / (steps - 1),) for i in range(steps)], "at double")
    bounds = reads.select(*keys).distinct().withColumn("lo", F.lit(math.log(low))).withColumn("hi", F.lit(math.log(high)))
    for _ in range(rounds):
        points = bounds.crossJoin(F.broadcast(grid)).withColumn("log_t", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("at"))
        tried = reads.join(F.broadcast(points), keys).withColumn("nll", -F.log(F.greatest(F.get(P.temperature_scale(p, F.exp("log_t")), F.col(gold)), F.lit(1e-12))))
        loss = tried.groupBy(*keys, "lo", "hi", "log_t").agg(F.avg("nll").alias("nll"), F.count(F.lit(1)).alias("n"))
        best = loss.groupBy(*keys, "lo", "hi").agg(F.min_by(F.struct("log_t", "nll", "n"), F.struct(F.round("nll", 12), F.abs("log_t"))).alias("b"))
        step = (F.col("hi") - F.col("lo")) / (steps - 1)
        bounds = best.select(*keys, F.greatest(F.col("b.log_t") - step, F.lit(math.log(low))).alias("lo"), F.least(F.col("b.log_t") + step, F.lit(math.log(high))).alias("hi"), F.col("b.log_t").alias("log_t"), F.col("b.nll").alias("nll"), F.col("b.n").alias("n"))
        result, bounds = bounds, bounds.drop("log_t", "nll", "n")
    return result.select(*keys, F.exp("log_t").alias("temperature"), "nll", "n")


@dataclass(frozen=True)
class LinearRouter:
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    intercept: float

    def score(self, features: list[str]) -> Column:
        out = F.lit(self.intercept)
        for f, m, s, w in zip(features, self.mean, self.scale, self.weights, strict=True):
            out = out + (F.col(f) - m) / s * w
        return out


def fit_ridge(rows: DataFrame, features: list[str], target: str, penalty: float = 1.0) -> LinearRouter:
    """Ridge regression from sums of products: one aggregation of fixed size, solved on the driver."""
    names = [*features, target]
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(names)], *[F.sum(F.col(a) * F.col(b)).alias(f"p{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]).first()
    n, k = sums["n"], len(features)
    mean = np.array([sums[f"s{i}"] for i in range(k + 1)]) / n
    cov = np.array([[sums[f"p{min(i, j)}_{max(i, j)}"] - n * mean[i] * mean[j] for j in range(k + 1)] for i in range(k + 1)])
    scale = np.sqrt(np.maximum(np.diag(cov)[:k] / max(n - 1, 1), 0))
    scale[scale == 0] = 1.0
    a = cov[:k, :k] / np.outer(scale, scale) + penalty * np.eye(k)
    weights = np.linalg.solve(a, cov[:k, k] / scale)
    return LinearRouter(tuple(mean[:k]), tuple(scale), tuple(weights), float(mean[k]))


def fit_logistic(rows: DataFrame, features: list[str], target: str, penalty: float = 0.01, steps: int = 12) -> LinearRouter:
    """L2 logistic regression on standardised features by Newton steps; each is one aggregation of fixed size."""
    stats = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)], *[F.stddev_pop(c).alias(f"d{i}") for i, c in enumerate(features)]).first()
    k = len(features)
    mean = [float(stats[f"m{i}"] or 0) for i in range(k)]
    scale = [float(stats[f"d{i}"] or 0) or 1.0 for i in range(k)]
    x = [F.lit(1.0)] + [(F.col(c) - m) / s for c, m, s in zip(features, mean, scale, strict=True)]
    beta = np.zeros(k + 1)
    ridge = penalty * np.diag([0.0] + [1.0] * k)
    for _ in range(steps):
        z = sum((F.lit(float(b)) * c for b, c in zip(beta, x, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        named = rows.select(p.alias("p"), F.col(target).cast("double").alias("y"), *[c.alias(f"x{i}") for i, c in enumerate(x)])
        s = named.agg(*[F.avg((F.col("y") - F.col("p")) * F.col(f"x{i}")).alias(f"g{i}") for i in range(k + 1)], *[F.avg(F.col("p") * (1 - F.col("p")) * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]).first()
        slope = np.array([s[f"g{i}"] for i in range(k + 1)]) - ridge @ beta
        curve = np.array([[s[f"h{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)]) + ridge + 1e-9 * np.eye(k + 1)
        move = np.linalg.solve(curve, slope)
        beta = beta + move
        if np.abs(move).max() < 1e-9:
            break
    return LinearRouter(tuple(mean), tuple(scale), tuple(beta[1:]), float(beta[0]))


def gate(values: dict[str, Column]) -> Column:
    """Adoption checks: gain certain, no loss of competence, types and latency within limits."""
    checks = [values["gain_low"] > 0, values["competence_high"] >= 0, values["competence_delta"] >= -0.5, values["worst_type_delta"] >= -2, values["p95_ratio"] <= 1.10]
    out = checks[0]
    for c in checks[1:]:
        out = out & c
    return F.coalesce(out, F.lit(False))
