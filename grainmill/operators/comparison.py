"""Comparing systems: thresholds, changes between two readings, acceptance, orders of candidates, bootstraps of differences."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.functions import probability as P
from grainmill.operators import scoring as S
from grainmill.operators.inference import fit_temperature

#: Weights of the public tiers, renormalised over those present.
PUBLIC_TIER_WEIGHTS = {"easy": 14, "original": 28, "hard": 30}
#: Ends of the threshold grid, and the fewest questions a temperature is fitted on.
THRESHOLD_ENDS = (-20.0, 20.0)
MIN_QUESTIONS = 20


def best_threshold(rows: DataFrame, keys: Sequence[str], value: str, gold: str) -> DataFrame:
    """The threshold of most right answers ``(value > t) == gold`` of each group, nearest to 0 among equals.

    Candidates are the middles of neighbouring distinct values and two fixed ends. Rows are summed by value
    and the counts run once over the sorted values: no join of rows with thresholds.
    """
    sums = rows.groupBy(*keys, F.col(value).alias("v")).agg(F.sum(gold).alias("pos"), F.sum(1 - F.col(gold)).alias("neg"))
    w = Window.partitionBy(*keys).orderBy("v")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    ran = sums.withColumns({"next": F.lead("v").over(w), "below": F.sum("neg").over(upto), "above": F.sum("pos").over(whole) - F.sum("pos").over(upto)})
    middles = ran.where("next IS NOT NULL").select(*keys, ((F.col("v") + F.col("next")) / 2).alias("threshold"), (F.col("below") + F.col("above")).alias("right"))
    ends = [sums.groupBy(*keys).agg(F.lit(e).alias("threshold"), F.sum(F.when(F.col("v") > e, F.col("pos")).otherwise(F.col("neg"))).alias("right")) for e in THRESHOLD_ENDS]
    tried = middles.unionByName(ends[0]).unionByName(ends[1])
    best = tried.groupBy(*keys).agg(F.max_by(F.struct("threshold", "right"), F.struct("right", -F.abs("threshold"), -F.col("threshold"))).alias("b"))
    return best.join(sums.groupBy(*keys).agg(F.sum(F.col("pos") + F.col("neg")).alias("n")), list(keys)).select(*keys, "b.threshold", (F.col("b.right") / F.col("n")).alias("accuracy"))


def intelligence_proxy(tiers: DataFrame, keys: Sequence[str], accuracy: str = "accuracy", chance: str = "chance") -> DataFrame:
    """100 x the weighted mean over the public tiers present of accuracy above chance, floored at 0; other tiers count nothing."""
    weight = F.lit(None).cast("double")
    for tier, w in PUBLIC_TIER_WEIGHTS.items():
        weight = F.when(F.col("tier") == tier, float(w)).otherwise(weight)
    gain = F.greatest(F.lit(0.0), (F.col(accuracy) - F.col(chance)) / (1 - F.col(chance)))
    return tiers.groupBy(*keys).agg(F.coalesce(100 * F.sum(weight * gain) / F.sum(weight), F.lit(0.0)).alias("intelligence_proxy"))


def latency_summary(rows: DataFrame, keys: Sequence[str], seconds: str) -> DataFrame:
    """Mean, the value at place n // 2, and the one at place ceil(0.95 n) - 1, of each group."""
    w = Window.partitionBy(*keys)
    ranked = rows.select(*keys, F.col(seconds).alias("s")).withColumn("i", F.row_number().over(w.orderBy("s")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    # places in whole numbers: 0.95 n as a binary fraction may round up
    p95 = F.floor((19 * F.col("n") + 19) / 20).cast("long") - 1
    at = lambda place: F.max(F.when(F.col("i") == place, F.col("s")))
    return ranked.groupBy(*keys).agg(F.avg("s").alias("mean_s"), at(F.floor(F.col("n") / 2)).alias("p50_s"), at(p95).alias("p95_s"))


def decided(p_true: Column) -> Column:
    return F.when(p_true <= 0.2, "no").when(p_true >= 0.8, "yes").otherwise("abstain")


def changes(pairs: DataFrame, keys: Sequence[str] = ("type",)) -> DataFrame:
    """What two readings of the same questions change, by type.

    ``pairs`` holds structs ``a`` and ``b`` of typed rows. Fixed and broken answers are counted for choices and
    yes/no questions, improved and worsened ones (by over 1e-6) for scores. The change of credit of yes/no
    questions is that of the likeliest answer less that of what abstaining costs.
    """
    gain = F.when(F.col("type") == "score", F.col("a.nmae") - F.col("b.nmae")).otherwise(F.col("b.correct") - F.col("a.correct"))
    least = F.when(F.col("type") == "score", 1e-6).otherwise(0.0)
    noul = F.col("type") == "noul"
    credit = lambda s: F.get(f"{s}.y", P.argmax(f"{s}.p"))
    lost = lambda s: credit(s) - F.col(f"{s}.correct")
    return pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(gain > least).alias("better"),
        F.count_if(gain < -least).alias("worse"),
        F.avg(F.col("b.nll") - F.col("a.nll")).alias("nll_delta"),
        F.avg(F.col("b.brier") - F.col("a.brier")).alias("brier_delta"),
        F.avg(F.col("b.rps") - F.col("a.rps")).alias("rps_delta"),
        F.avg(F.when(noul, credit("b") - credit("a"))).alias("argmax_credit_delta"),
        F.avg(F.when(noul, lost("b") - lost("a"))).alias("abstention_penalty_delta"),
    )


def acceptance_reasons(a: str, b: str, y: str, kind: str = "type") -> Column:
    """Why a teacher's reading ``b`` is not taken over the direct one ``a`` (structs of typed rows); empty if it is.

    It must lower the loss by over 1e-9 and raise no other one by that, keep its credit, and answer a hard target right.
    """
    worse = lambda m: F.col(f"{b}.{m}") > F.col(f"{a}.{m}") + 1e-9
    score = F.col(kind) == "score"
    return F.array_compact(
        F.array(
            F.when(F.col(f"{b}.nll") >= F.col(f"{a}.nll") - 1e-9, "no_gold_nll_gain"),
            F.when(worse("brier"), "gold_brier_regression"),
            F.when(score & worse("rps"), "score_rps_regression"),
            F.when(score & worse("nmae"), "score_nmae_regression"),
            F.when(~score & (F.col(f"{b}.correct") < F.col(f"{a}.correct") - 1e-9), "thresholded_credit_regression"),
            F.when(~score & (F.array_max(y) == 1) & (F.col(f"{b}.correct") != 1), "wrong_or_abstaining_hard_gold"),
        )
    )


def candidate_order(reports: DataFrame, cc: str = "cc", loss: str = "proper_loss", p95: str = "p95_s", cost: str = "usd_per_1000", within: float = 1.0) -> DataFrame:
    """``place`` of complete reports: those within a point of the best by loss, latency, cost (unknown last), then the rest by competence.

    One row a system; the order of so few rows may be made in one task.
    """
    rows = reports.where("complete").withColumn("_tied", F.max(cc).over(Window.partitionBy(F.lit(1))) - F.col(cc) <= within)
    inside = [F.when(F.col("_tied"), F.col(c)) for c in (loss, p95, cost)]
    order = [F.col("_tied").desc(), *[c.asc_nulls_last() for c in inside], F.col(cc).desc(), F.col("system")]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))).drop("_tied")


def variant_choice(reports: DataFrame, low: float, high: float) -> DataFrame:
    """The variant of highest ``composite``; if the interval against the runner-up holds 0, the one of the two with fewer mean input tokens."""
    two = reports.orderBy(F.col("composite").desc(), "variant").limit(2)
    uncertain = low <= 0 <= high
    best = F.min_by("variant", F.struct(-F.col("composite"), F.col("variant")))
    cheap = F.min_by("variant", F.struct(F.col("mean_input_tokens"), -F.col("composite"), F.col("variant")))
    return two.agg(best.alias("highest"), (cheap if uncertain else best).alias("selected")).withColumn("token_fallback", F.lit(uncertain))


def length_temperatures(reads: DataFrame, kind: str = "type", length: str = "length", long_from: int = 1024, p: str = "p", gold: str = "gold", least: int = MIN_QUESTIONS) -> DataFrame:
    """Temperatures by type and by type and length bucket (``type@short``, ``type@long``): ``key``, temperature, n; groups of too few questions give none."""
    bucket = F.concat_ws("@", F.col(kind), F.when(F.col(length) >= long_from, "long").otherwise("short"))
    return keyed_temperatures(reads, [F.col(kind), bucket], p, gold, least)


def keyed_temperatures(reads: DataFrame, levels: Sequence[Column], p: str = "p", gold: str = "gold", least: int = MIN_QUESTIONS) -> DataFrame:
    """Temperatures of every value of every level, coarse to fine, of at least ``least`` questions."""
    keyed = reads.select(F.explode(F.array(*levels)).alias("key"), F.col(p).alias("p"), F.col(gold).alias("gold"))
    enough = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("key")
    return fit_temperature(keyed.join(enough, "key", "left_semi"), ["key"])


def apply_temperatures(reads: DataFrame, temperatures: DataFrame, levels: Sequence[Column], p: str = "p") -> DataFrame:
    """``p`` at the temperature of the finest level that has one, else unchanged. The levels' values are few (types, routes, bands)."""
    table = temperatures.agg(F.map_from_entries(F.collect_list(F.struct("key", "temperature"))).alias("_t"))
    found = F.coalesce(*[F.try_element_at("_t", level) for level in reversed(list(levels))], F.lit(1.0))
    return reads.crossJoin(F.broadcast(table)).withColumn(p, P.temperature_scale(p, found)).drop("_t")


def bootstrap_competence(rows: DataFrame, arms: Mapping[str, float], cluster: str = "cluster", arm: str = "arm", replicates: int = 2000, seed: int = 15) -> DataFrame:
    """A weighted sum of the arms' mean competence, with 2.5 and 97.5 % points over clusters: differences, and differences of differences.

    ``rows`` are typed rows of every arm. Sums of each cluster, arm and type are weighted by hashed Poisson draws
    that hang on cluster and replicate alone, so all arms meet the same draws. A batch of clusters becomes sums of
    each replicate before anything is shuffled: what moves grows with batches x replicates, not with clusters.
    """
    parts = ["n", "correct", "chance", "nmae", "nmae_chance"]
    per = rows.where(F.col(arm).isin(*arms)).groupBy(cluster, F.col(arm).alias("arm"), "type").agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(F.coalesce(F.col(c), F.lit(0.0)).cast("double")).alias(c) for c in parts[1:]])
    keyed = per.withColumn("h", F.xxhash64(F.lit(seed), F.col(cluster).cast("string"))).select("h", "arm", "type", *parts)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rep = np.arange(replicates + 1, dtype=np.uint64)
        limits = np.cumsum(np.exp(-1) / np.cumprod(np.r_[1, np.arange(1, 12)]))
        totals: dict[tuple[str, str], np.ndarray] = {}
        for batch in batches:
            for at in range(0, len(batch), 1000):
                b = batch.iloc[at : at + 1000]
                x = b["h"].to_numpy(np.int64).view(np.uint64)[:, None] + rep * np.uint64(0x9E3779B97F4A7C15)
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                w = np.searchsorted(limits, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / 2.0**53, side="right").astype(float)
                w[:, 0] = 1  # replicate 0 is the sample itself
                for key, own in b.groupby(["arm", "type"]).indices.items():
                    totals[key] = totals.get(key, 0) + w[own].T @ b[parts].to_numpy(float)[own]
        for (a, t), sums in totals.items():
            yield pd.DataFrame({"rep": rep.astype(np.int64), "arm": a, "type": t, **{c: sums[:, i] for i, c in enumerate(parts)}})

    sums = keyed.mapInPandas(weigh, "rep long, arm string, type string, n double, correct double, chance double, nmae double, nmae_chance double")
    by = sums.groupBy("rep", "arm", "type").agg(*[F.sum(c).alias(c) for c in parts])
    cc = F.when(F.col("type") == "score", 100 * (1 - F.col("nmae") / F.nullif(F.col("nmae_chance"), F.lit(0.0)))).otherwise(100 * (F.col("correct") - F.col("chance")) / F.nullif(F.col("n") - F.col("chance"), F.lit(0.0)))
    sign = F.lit(0.0)
    for name, weight in arms.items():
        sign = F.when(F.col("arm") == name, float(weight)).otherwise(sign)
    value = by.groupBy("rep", "arm").agg(F.avg(cc).alias("cc")).groupBy("rep").agg(F.sum(sign * F.col("cc")).alias("v"))
    points = lambda q: F.percentile(F.when(F.col("rep") > 0, F.col("v")), q)
    return value.agg(F.max(F.when(F.col("rep") == 0, F.col("v"))).alias("estimate"), points(0.025).alias("low"), points(0.975).alias("high"))


def type_competence(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Competence of each type without tiers, and their mean by ``keys``."""
    return rows.groupBy(*keys, "type").agg(S.competence().alias("cc")).groupBy(*keys).agg(F.avg("cc").alias("cc_equal_types"))
