"""Variation of reads over display orders, after the answers are put back in canonical order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions import probability as P
from grainmill.operators.scoring import typed_rows

#: Views planned for a question at most: canonical, reversed, rotated by one.
MOST_VIEWS = 3
_CLOSE = 1e-6


def planned_orders(k: Column, most: int = MOST_VIEWS) -> Column:
    """The display orders of a question with ``k`` labels: as they are, reversed, rotated by one; equal ones once."""
    same = F.sequence(F.lit(0), k - 1)
    return F.slice(F.array_distinct(F.array(same, F.reverse(same), F.concat(F.slice(same, 2, k), F.array(F.lit(0))))), 1, most)


def align(values: Column, display: Column) -> Column:
    """Values in canonical order; ``display`` names the canonical place of each shown one."""
    return F.transform(F.sequence(F.lit(0), F.size(display) - 1), lambda i: F.get(values, F.array_position(display, i).cast("int") - 1))


def checked_views(views: DataFrame, question: str, most: int = MOST_VIEWS) -> DataFrame:
    """One row per ``question``: ``n_views`` and ``fault``, null if its views are sound.

    ``views`` has one row per question and ``view`` with ``display`` (array of int) and ``p``, ``y`` (arrays in display
    order). Faults, the first that applies: *order* (a display is no permutation), *probabilities* (not as many, negative, not
    finite, or their sum is not 1), *repeated* (a display twice), *incomplete* (not exactly the planned ones), *gold* (targets differ
    once they are aligned). Aggregates only, so a question with very many views costs one row.
    """
    k = F.size("display")
    sound = F.array_sort("display") == F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0)))
    normal = (F.size("p") == k) & (F.size("y") == k) & F.forall("p", lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0)) & (F.abs(P.total("p") - 1) <= _CLOSE)
    rows = views.withColumns({"_sound": F.coalesce(sound & (k > 0), F.lit(False)), "_normal": F.coalesce(normal, F.lit(False))})
    rows = rows.withColumn("_gold", F.when(F.col("_sound") & F.col("_normal"), align(F.col("y"), F.col("display"))))
    # displays outside the plan make a question incomplete: only planned ones are gathered, three at most
    planned = F.array_contains(planned_orders(k, most), F.col("display"))
    by = rows.groupBy(question).agg(
        F.count(F.lit(1)).alias("n_views"),
        F.min("_sound").alias("sound"),
        F.min("_normal").alias("normal"),
        F.collect_set(F.when(F.col("_sound") & planned, F.col("display"))).alias("seen"),
        F.min(F.coalesce(planned, F.lit(False))).alias("planned"),
        F.max(F.when(F.col("_sound"), k)).alias("k"),
        F.min("_gold").alias("low"),
        F.max("_gold").alias("high"),
    )
    distinct = F.size("seen")
    fault = (
        F.when(~F.col("sound"), "order")
        .when(~F.col("normal"), "probabilities")
        .when(F.col("planned") & (F.col("n_views") > distinct), "repeated")
        .when(~F.col("planned") | (distinct != F.size(planned_orders(F.col("k"), most))), "incomplete")
        .when(F.col("low") != F.col("high"), "gold")
    )
    return by.select(question, "n_views", fault.alias("fault"))


def permutation_diagnostics(views: DataFrame, question: str, most: int = MOST_VIEWS) -> DataFrame:
    """How far a question's answers move with the display order; questions whose views are not sound are left out.

    ``views`` also has ``type`` (choice, noul, score). Columns: ``label_range`` (largest spread of one label's
    probability), ``total_variation`` (largest between two views), ``flips`` (views whose first answer is not the
    canonical one's) and the least and greatest of ``nll``, ``brier`` and ``correct``, for scores ``rps`` and ``nmae`` instead of the
    last (null otherwise). Spreads come from extremes of each label; pairs are compared within the planned views only.
    """
    sound = checked_views(views, question, most).where("fault IS NULL").select(F.col(question).alias("_q"))
    rows = views.join(sound, F.col(question) == F.col("_q"), "left_semi")
    aligned = rows.select(question, "type", (F.col("display") == F.sequence(F.lit(0), F.size("display") - 1)).alias("canonical"), align(F.col("p"), F.col("display")).alias("p"), align(F.col("y"), F.col("display")).alias("y"))
    metrics = typed_rows(aligned).withColumn("top", P.argmax("p"))
    both = lambda c: [F.min(c).alias(f"{c}_least"), F.max(c).alias(f"{c}_most")]
    score = F.col("type") == "score"
    metrics = metrics.withColumn("correct", F.when(~score, F.col("correct")))
    per = metrics.groupBy(question, "type").agg(
        F.count(F.lit(1)).alias("views"),
        F.max(F.when(F.col("canonical"), F.col("top"))).alias("first"),
        F.collect_list("top").alias("tops"),
        F.collect_list("p").alias("ps"),  # as many as planned
        *[x for c in ("nll", "brier", "correct", "rps", "nmae") for x in both(c)],
    )
    labels = F.sequence(F.lit(0), F.size(F.get("ps", F.lit(0))) - 1)
    spread = F.array_max(F.transform(labels, lambda i: F.array_max(F.transform("ps", lambda p: F.get(p, i))) - F.array_min(F.transform("ps", lambda p: F.get(p, i)))))
    apart = F.array_max(F.flatten(F.transform("ps", lambda p: F.transform("ps", lambda q: P.total_variation(p, q)))))
    flips = F.size(F.filter("tops", lambda t: t != F.col("first")))
    return per.select(question, "type", "views", spread.alias("label_range"), apart.alias("total_variation"), flips.alias("flips"), *[f"{c}_{e}" for c in ("nll", "brier", "correct", "rps", "nmae") for e in ("least", "most")])
