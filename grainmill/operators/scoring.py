"""Scores over reads: one row a question and system, with probability and target arrays.

Columns used: ``type`` (choice, noul, score), ``tier``, ``p`` and ``y``
(``array<double>`` in candidate order; for a score in ordinal order, for a noul
[false, true]).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.functions import probability as P

#: Weights of the tiers, renormalised over those present.
TIER_WEIGHTS = {"easy": 0.1, "standard": 0.2, "judge": 0.3, "hard": 0.4}
TYPES = ("choice", "noul", "score")


def typed_rows(reads: DataFrame) -> DataFrame:
    """Adds nll, brier, confidence, correct, chance, calibration_target, abstained, nmae, nmae_chance and rps by the question's type."""
    at = P.argmax("p")
    noul, score = F.col("type") == "noul", F.col("type") == "score"
    true, gold_true = F.get("p", F.lit(1)), F.get("y", F.lit(1))
    decided = F.when(true <= 0.2, 0).when(true >= 0.8, 1)
    k = F.size("p")
    place = P.total(F.transform("p", lambda v, i: v * i))
    error = P.total(F.transform("y", lambda v, i: v * F.abs(place - i))) / (k - 1)
    levels = lambda i: P.total(F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.abs(j - i).cast("double")))
    chance = P.total(F.transform("y", lambda v, i: v * levels(i) / k)) / (k - 1)
    return reads.withColumns(
        {
            "nll": P.nll("p", "y"),
            "brier": F.when(noul, (true - gold_true) ** 2).otherwise(P.brier("p", "y")),
            "confidence": F.when(noul, true).otherwise(F.array_max("p")),
            "correct": F.when(noul, F.coalesce(F.get("y", decided), F.lit(0.0))).otherwise(F.get("y", at)),
            "chance": F.when(noul, 0.5).otherwise(1.0 / k),
            "calibration_target": F.when(noul, gold_true).otherwise(F.get("y", at)),
            "abstained": F.when(noul, decided.isNull()),
            "nmae": F.when(score, error),
            "nmae_chance": F.when(score, chance),
            "rps": F.when(score, P.rps("p", "y")),
        }
    )


def competence() -> Column:
    """Aggregate of typed rows of one type: 100 x the share of possible gain over chance."""
    by_choice = 100 * (F.avg("correct") - F.avg("chance")) / (1 - F.avg("chance"))
    return F.when(F.max("type") == "score", 100 * (1 - F.sum("nmae") / F.sum("nmae_chance"))).otherwise(by_choice)


def calibration_error(rows: DataFrame, keys: list[str], confidence: str = "confidence", outcome: str = "calibration_target", bins: int = 10) -> DataFrame:
    """Equal-width binned |confidence - outcome| as a share of all rows, by ``keys``; p = 1 is in the last bin."""
    bin_ = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1))
    per_bin = rows.groupBy(*keys, bin_.alias("bin")).agg(F.abs(F.sum(F.col(confidence) - F.col(outcome))).alias("gap"), F.count(F.lit(1)).alias("n"))
    return per_bin.groupBy(*keys).agg((F.sum("gap") / F.sum("n")).alias("ece"))


def tier_weight(tier: str = "tier") -> Column:
    out = F.lit(None).cast("double")
    for name, weight in TIER_WEIGHTS.items():
        out = F.when(F.col(tier) == name, weight).otherwise(out)
    return out


def competence_by_type(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Tier-weighted competence of each type, over the tiers that are present."""
    per_tier = rows.groupBy(*keys, "type", "tier").agg(competence().alias("cc"), F.count(F.lit(1)).alias("n"))
    return per_tier.groupBy(*keys, "type").agg((F.sum(tier_weight() * F.col("cc")) / F.sum(tier_weight())).alias("cc"), F.sum("n").alias("n"))


def intelligence(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean competence of the three types; null unless all are present."""
    per_type = competence_by_type(rows, keys)
    return per_type.groupBy(*keys).agg(F.when(F.count_distinct("type") == len(TYPES), F.avg("cc")).alias("intelligence"), (F.sum(F.col("cc") * F.col("n")) / F.sum("n")).alias("question_weighted"))


def auc(rows: DataFrame, keys: list[str], p: str = "p_true", y: str = "gold") -> DataFrame:
    """P(a true question scores above a false one), ties half, from average ranks: one sort a group and no pairs.

    Rows are summed by value first; a group's distinct values are ranked by a running sum.
    """
    values = rows.where(F.col(y).isin(0, 1)).groupBy(*keys, F.col(p).alias("v")).agg(F.sum(F.col(y)).alias("pos"), F.sum(1 - F.col(y)).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = values.withColumn("wins", F.col("pos") * (below + F.col("neg") / 2))
    return wins.groupBy(*keys).agg((F.sum("wins") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))


def selective_risk(rows: DataFrame, coverage: float, keys: list[str], confidence: str = "confidence", correct: str = "correct", order: str = "id") -> DataFrame:
    """Error among the most confident rows: max(1, floor(n x coverage)) of each group."""
    w = Window.partitionBy(*keys)
    ranked = rows.withColumn("_rank", F.row_number().over(w.orderBy(F.col(confidence).desc(), F.col(order)))).withColumn("_n", F.count(F.lit(1)).over(w))
    return ranked.where(F.col("_rank") <= F.greatest(F.lit(1), F.floor(F.col("_n") * coverage))).groupBy(*keys).agg((1 - F.avg(correct)).alias("risk"))


def nearest_rank(rows: DataFrame, value: str, q: float, keys: list[str]) -> DataFrame:
    """The ordered value at position min(n-1, floor(q n))."""
    w = Window.partitionBy(*keys)
    ranked = rows.withColumn("_rank", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count(F.lit(1)).over(w))
    return ranked.where(F.col("_rank") == F.least(F.col("_n"), F.floor(F.lit(q) * F.col("_n")) + 1)).select(*keys, F.col(value).alias("quantile"))


def speed_score(seconds: Column) -> Column:
    return 100 - 20 * F.log10(seconds / 0.1)


def cost_score(usd_per_1000: Column) -> Column:
    return 100 - 30 * F.log10(usd_per_1000 / 0.001)


def composite(axes: list[Column], weights: tuple[float, ...], penalised: tuple[int, ...] = (0, 2, 3)) -> Column:
    """Weighted harmonic mean; 0 if any axis is not positive; squared shortfall below 50 on the penalised axes."""
    out = 1 / sum((F.lit(w) / a for w, a in zip(weights, axes, strict=True)), F.lit(0.0))
    for i in penalised:
        out = out * F.when(axes[i] < 50, (axes[i] / 50) ** 2).otherwise(1.0)
    return F.when(F.least(*axes) <= 0, 0.0).otherwise(out)


def mcnemar(left_only: Column, right_only: Column) -> Column:
    """Two-sided exact binomial p-value of discordant counts; terms in logarithms, so counts may be large."""
    n = left_only + right_only
    low = F.least(left_only, right_only)
    steps = F.sequence(F.lit(0).cast("long"), low.cast("long"))
    # the running logarithm of C(n, i) is C(n, i-1) times (n - i + 1) / i
    start = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("s"))
    fold = F.aggregate(steps, start, lambda a, i: P.let(F.when(i == 0, 0.0).otherwise(a["c"] + F.log((n - i + 1) / i)), lambda c: F.struct(c.alias("c"), (a["s"] + F.exp(c - n * F.log(F.lit(2.0)))).alias("s"))), lambda a: a["s"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * fold))
