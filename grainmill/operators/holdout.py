"""Budgeted hold-out of whole groups: a sequential walk, settled in a few parallel steps.

The walk goes over groups in a hashed order. It takes a group that still helps a
budget, unless that would empty a cell that the group touches, and ends when the
budgets are met. Two facts make it parallel. A cell can only be emptied by its
last group in the order, and only if all its other groups were taken: so all
groups but those last ones, at most one a cell, are decided by their own counts,
and the last ones by each other in a few rounds. And which budgets are open
changes only where one of them is met, so there is one phase for each, whose
end is found by sums over a thousand ranges of ranks at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.operators.ordered import running_sums
from grainmill.plans.workspace import Workspace

#: Ranges whose sums pass through the driver at once.
RANGES = 1024


def _first_reached(rows: DataFrame, sums: dict[str, str], needs: dict[str, int], low: int, high: int) -> tuple[int, dict[str, int]] | None:
    """The first rank in (low, high] at which a running sum reaches its need, and all sums up to it; None if none does."""
    base = dict.fromkeys(needs, 0)
    while True:
        width = -(-(high - low) // RANGES)
        if width < 1:
            return None
        part = F.floor((F.col("_rank") - low - 1) / width).alias("_part")
        found = rows.where(F.col("_rank").between(low + 1, high)).groupBy(part).agg(*[F.sum(e if isinstance(e, Column) else F.expr(e)).alias(n) for n, e in sums.items()]).collect()
        so_far, at = dict(base), None
        for r in sorted(found, key=lambda r: r["_part"]):
            after = {n: so_far[n] + (r[n] or 0) for n in needs}
            if any(after[n] >= needs[n] for n in needs):
                at = r["_part"]
                break
            so_far = after
        if at is None:
            return None
        if width == 1:
            return low + at + 1, after
        base, low, high = so_far, low + at * width, min(high, low + (at + 1) * width)


def _skipped(cells: DataFrame, lasts: DataFrame, eligible: Column, space: Workspace, name: str) -> DataFrame:
    """Groups that the walk passes over since they would empty a cell: ``_group``."""
    seen = cells.withColumn("_ok", eligible).join(lasts, "cell")
    # cells that their last group could empty: it is eligible and so are all others
    could = seen.groupBy("cell", "_last").agg(F.min("_ok").alias("all_ok")).where("all_ok").select("cell", F.col("_last").alias("_group"))
    could = space.table(f"could-{name}", could)
    if could.isEmpty():
        return could.select("_group")
    heads = could.select(F.col("_group").alias("_other")).distinct()
    # of the other groups of such a cell only those can be missing that are themselves last in such a cell
    needs = could.join(cells.select("cell", F.col("_group").alias("_other")), "cell").where("_group <> _other").join(heads, "_other", "left_semi")
    needs = space.table(f"needs-{name}", needs.select("cell", "_group", "_other"))
    status = space.table(f"status-{name}-0", heads.select(F.col("_other").alias("_group"), F.lit(None).cast("boolean").alias("taken")))
    turn = 0
    while not status.where("taken IS NULL").isEmpty():
        known = needs.join(status.select(F.col("_group").alias("_other"), "taken"), "_other")
        by_cell = known.groupBy("cell", "_group").agg(F.count_if(~F.col("taken")).alias("missing"), F.count_if(F.col("taken").isNull()).alias("open"))
        verdict = could.join(by_cell, ["cell", "_group"], "left").select("_group", F.coalesce(F.col("missing") > 0, F.lit(False)).alias("left_over"), F.coalesce(F.col("open") > 0, F.lit(False)).alias("unknown"))
        empties, unsure = ~F.col("left_over") & ~F.col("unknown"), ~F.col("left_over") & F.col("unknown")
        status = verdict.groupBy("_group").agg(F.when(F.max(empties), False).when(F.max(unsure), None).otherwise(True).alias("taken"))
        turn += 1
        status = space.table(f"status-{name}-{turn}", status)
        space.drop(f"status-{name}-{turn - 1}")
    return status.where("NOT taken").select("_group")


def hold_out(groups: DataFrame, cells: DataFrame, needs: dict[str, int], order: list[str | Column], group: str = "group", limit: int | None = None, most: int | None = None, any_group: bool = False) -> DataFrame:
    """``groups`` with ``rank`` in the walk, ``taken``, and ``kept_for_cell`` where only a cell's last group was spared.

    ``groups`` has one row per group and a count column for each budget of ``needs``; ``cells`` (``group``,
    ``cell``) says which cells a group touches. The walk takes a group that has a row for a budget still
    open (with ``any_group``, every group), unless one of its cells has no other group left; it ends
    when every budget is met, when ``limit`` groups are taken, or after the first ``most`` groups. A group may
    overshoot a budget. ``order`` must be total. Null counts are zero; an empty table gives an empty result.
    """
    spark = groups.sparkSession
    space = Workspace(spark, "hold-out")
    numbers = {n: F.coalesce(F.col(n), F.lit(0)) for n in needs}
    ranked = space.table("ranked", running_sums(groups, order, {"_rank": F.lit(1)}).withColumn("_group", F.col(group)))
    at = cells.select(F.col(group).alias("_group"), F.col("cell").cast("string").alias("cell")).distinct()
    placed = space.table("cells", at.join(ranked.select("_group", "_rank", *needs), "_group"))
    lasts = space.table("lasts", placed.groupBy("cell").agg(F.max_by("_group", "_rank").alias("_last")))
    total = ranked.agg(F.max("_rank")).first()[0] or 0
    end = min(total, most if most is not None else total)
    open_needs = {n: v for n, v in needs.items() if v > 0}
    room = limit if limit is not None else total
    passed, start, phase = F.lit(False), 0, 0
    spared = ranked.select("_group").limit(0)
    while open_needs and room > 0 and start < end:
        helps = F.lit(True) if any_group else F.lit(False)
        for n in open_needs:
            helps |= numbers[n] > 0
        here = F.col("_rank").between(start + 1, end)
        eligible = passed | (here & helps)
        spared = _skipped(placed, lasts, eligible, space, str(phase))
        rows = ranked.where(here & helps).join(spared, "_group", "left_anti")
        sums = {n: numbers[n] for n in open_needs} | {"_taken": F.lit(1)}
        found = _first_reached(rows, sums, open_needs | {"_taken": room}, start, end)
        stop = found[0] if found else end
        passed = passed | (F.col("_rank").between(start + 1, stop) & helps)
        if not found:
            break
        room -= found[1]["_taken"]
        open_needs = {n: v - found[1][n] for n, v in open_needs.items() if v > found[1][n]}
        start, phase = stop, phase + 1
    out = ranked.join(spared.withColumn("_spared", F.lit(True)), "_group", "left")
    spared_here = F.coalesce("_spared", F.lit(False)) & passed
    return out.select(*[c for c in groups.columns], F.col("_rank").alias("rank"), (passed & ~spared_here).alias("taken"), spared_here.alias("kept_for_cell"))
