"""Rows in one order over many tasks: pieces, ranks, running sums and greedy cuts.

A table is sorted by range once and written, each partition one *piece* with
the places of its rows. What a rule needs from the rows before is carried from
piece to piece as a few numbers, which the driver adds up: never the rows, and
never more than a fixed amount for each piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.plans.workspace import Workspace


def ordered_pieces(df: DataFrame, order: list[str | Column], space: Workspace, name: str = "pieces") -> DataFrame:
    """``df`` with ``_piece`` and ``_place`` (ascending in the order), as a table; equal rows may lie in two pieces."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    placed = rows.withColumn("_place", F.monotonically_increasing_id())
    return space.table(name, placed.withColumn("_piece", F.shiftright("_place", 33)))


def _before(pieces: DataFrame, sums: list[Column]) -> DataFrame:
    """For each piece the sums of all pieces before it; a row a piece passes through the driver."""
    names = [f"_s{i}" for i in range(len(sums))]
    totals = pieces.groupBy("_piece").agg(*[s.alias(n) for s, n in zip(sums, names, strict=True)])
    schema, rows, so_far = totals.schema, [], [0] * len(sums)
    for r in sorted(totals.collect(), key=lambda r: r["_piece"]):
        rows.append((r["_piece"], *so_far))
        so_far = [a + (r[n] or 0) for a, n in zip(so_far, names, strict=True)]
    return pieces.sparkSession.createDataFrame(rows, schema)


def running_sums(df: DataFrame, order: list[str | Column], values: dict[str, str | Column], name: str = "running") -> DataFrame:
    """``df`` with a running sum, its own row included, under each name of ``values``, over the whole table in order.

    The order must be total. Null values count as zero. Sums start anew in each piece and are
    raised by what lies before it, so no window spans more than a partition.
    """
    space = Workspace(df.sparkSession, name)
    columns = {n: F.coalesce(F.expr(v) if isinstance(v, str) else v, F.lit(0)) for n, v in values.items()}
    pieces = ordered_pieces(df.withColumns({f"_v_{n}": c for n, c in columns.items()}), order, space)
    before = _before(pieces, [F.sum(f"_v_{n}") for n in columns])
    from pyspark.sql import Window

    w = Window.partitionBy("_piece").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    rows = pieces.join(F.broadcast(before), "_piece")  # a row for each partition
    return rows.withColumns({n: F.sum(f"_v_{n}").over(w) + F.col(f"_s{i}") for i, n in enumerate(columns)}).select(*[c for c in df.columns if c not in columns], *columns)


_ANY = 1 << 62


def next_cuts(sizes: np.ndarray, budget: int, most: int) -> np.ndarray:
    """For ascending sizes, where the batch that starts at each row ends: the first later row that does not fit.

    A row fits while its size times the rows with it is within ``budget`` and there are at most
    ``most`` of them. For a later start the end is never earlier, so bisection finds every end at once.
    """
    n = len(sizes)
    start = np.arange(n)
    low, high = start + 1, np.minimum(start + most, n)  # the answer lies in [low, high]
    while (low < high).any():
        middle = (low + high) // 2
        at = np.minimum(middle, n - 1)
        fits = sizes[at] * (at - start + 1) <= budget
        open_ = low < high
        low = np.where(open_ & fits, middle + 1, low)
        high = np.where(open_ & ~fits, middle, high)
    return low


def _rooms(sizes: np.ndarray, budget: int, most: int) -> np.ndarray:
    """How many rows an open batch may hold before a run for each of its rows still to join; falls from row to row, rows that never join are left out."""
    wide = np.where(sizes > 0, budget // np.maximum(sizes, 1), _ANY if budget >= 0 else -1)
    rooms = np.minimum(wide, most) - np.arange(1, len(sizes) + 1)
    return rooms[rooms >= 1]


def _first_cut(rooms: np.ndarray | list[int], held: int) -> int:
    """Rows of a run that join a batch of which ``held`` rows lie before it."""
    return len(rooms) - int(np.searchsorted(np.asarray(rooms, np.int64)[::-1], held, "left"))


def _followed(cuts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """From each start, the rows of the last batch within ``n`` rows and the batches before it, by doubling the jumps."""
    jump = np.append(cuts, n)
    steps = (jump < n).astype(np.int64)
    # rows whose batch reaches the end stay where they are
    jump = np.where(jump < n, jump, np.arange(n + 1))
    while True:
        further = jump[jump]
        if (further == jump).all():
            break
        steps = steps + steps[jump]
        jump = further
    return n - jump, steps


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """The rows of a piece, and where each group's run starts and ends in it."""
    held: list[pa.RecordBatch] = []

    def done() -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
        table = pa.Table.from_batches(held).combine_chunks()
        group = table.column("_group").combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
        yield table, list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))

    piece = None
    for batch in batches:
        at = batch.column(batch.schema.get_field_index("_piece")).to_numpy()
        for low, high in zip(*(lambda e: (e[:-1], e[1:]))(np.flatnonzero(np.diff(at, prepend=-1, append=-1))), strict=True):
            if at[low] != piece and held:
                yield from done()
                held = []
            piece = at[low]
            held.append(batch.slice(low, high - low))
    if held:
        yield from done()


def _maps(cut_groups: DataFrame) -> dict:
    """Rows open before, and cuts so far, for each run of a group that crosses a border, by its first place.

    A run sends as many numbers as a batch may have rows: for every count of its rows
    that may join the open batch, the rows open behind the run and the cuts in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, runs in _grouped(batches):
            sizes, budgets, most = (table.column(c).to_numpy() for c in ("_size", "_budget", "_most"))
            for low, high in runs:
                own, n = sizes[low:high], high - low
                budget, limit = int(budgets[low]), int(most[low])
                cuts = next_cuts(own, budget, limit)
                rest, steps = _followed(cuts, n)
                rooms = _rooms(own, budget, limit)
                # by the rows that join the open batch: rows open behind the run, and cuts in it (none: the batch goes on)
                behind, count = np.append(rest[:n], n), np.append(steps[:n] + 1, 0)
                fresh = int(cuts[0])
                at = [*range(min(len(rooms), n) + 1)]
                values = {"rooms": rooms, "behind": np.append(behind[at], behind[fresh]), "cuts": np.append(count[at], count[fresh])}
                ids = {"group": table.column("_group").slice(low, 1).combine_chunks(), "place": table.column("_place").slice(low, 1).combine_chunks(), "n": pa.array([n], pa.int64())}
                yield pa.RecordBatch.from_pydict(ids | {k: pa.array([v], pa.list_(pa.int64())) for k, v in values.items()})

    rows = cut_groups.mapInArrow(run, "group string, place long, n long, rooms array<long>, behind array<long>, cuts array<long>").collect()
    links: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: r["place"]):
        links.setdefault(r["group"], []).append(r)
    entries = {}
    for chain in links.values():
        held = cut = 0
        for r in chain:
            entries[r["place"]] = (held, cut)
            at = _first_cut(r["rooms"], held) if held else -1
            held, cut = (held + r["n"], cut) if r["cuts"][at] == 0 else (r["behind"][at], cut + r["cuts"][at])
    return entries


def greedy_batches(df: DataFrame, size: str | Column, budget: int | str | Column, order: list[str], most: int, group: str | Column | None = None, name: str = "batches") -> DataFrame:
    """``df`` with ``batch``: rows by ascending size in batches whose largest size times their rows keeps within a budget.

    Within each ``group`` (all rows, if None) rows go by size, then ``order``; a batch is closed when the
    next row's size times one row more would exceed ``budget`` (equal for all rows of a group) or when it has
    ``most`` rows. A row that exceeds the budget alone is a batch of its own. Equal to the walk over
    all rows, but no task sees more than a partition: runs of a group that cross a border
    map the rows open before them to those open behind them, and only these maps are chained;
    a map is as long as a batch has rows.
    Null sizes count as zero; null groups are one group. An empty table gives an empty result.
    """
    spark = df.sparkSession
    space = Workspace(spark, name)
    as_column = lambda c: F.lit(c) if isinstance(c, int) else F.col(c) if isinstance(c, str) else c
    key = F.lit("") if group is None else F.coalesce(as_column(group).cast("string"), F.lit("\x00"))
    rows = df.withColumns({"_group": key, "_size": F.coalesce(as_column(size).cast("long"), F.lit(0)), "_budget": as_column(budget).cast("long"), "_most": F.lit(most).cast("long")})
    pieces = ordered_pieces(rows, ["_group", "_size", *order], space)
    ends = pieces.groupBy("_piece").agg(F.min_by("_group", "_place").alias("low"), F.max_by("_group", "_place").alias("high")).orderBy("_piece").collect()  # a row for each partition
    crossing = {(p, a["high"]) for a, b in zip(ends, ends[1:], strict=False) if a["high"] == b["low"] for p in (a["_piece"], b["_piece"])}
    entries = {}
    if crossing:
        keys = spark.createDataFrame(sorted(crossing), "_piece long, _group string")
        cut = pieces.select("_group", "_size", "_budget", "_most", "_piece", "_place").join(F.broadcast(keys), ["_piece", "_group"], "left_semi")
        entries = _maps(cut.repartition("_piece").sortWithinPartitions("_piece", "_place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, runs in _grouped(batches):
            sizes, budgets, most_, places = (table.column(c).to_numpy() for c in ("_size", "_budget", "_most", "_place"))
            out = np.zeros(len(sizes), np.int64)
            for low, high in runs:
                own, n = sizes[low:high], high - low
                held, batch = entries.get(int(places[low]), (0, 0))
                budget, limit = int(budgets[low]), int(most_[low])
                cuts = next_cuts(own, budget, limit)
                starts = np.zeros(n, np.int64)
                first = _first_cut(_rooms(own, budget, limit), held) if held else int(cuts[0])
                while first < n:
                    starts[first] = 1
                    first = int(cuts[first])
                out[low:high] = batch + np.cumsum(starts)
            yield from table.drop_columns(["_group", "_size", "_budget", "_most", "_piece", "_place"]).append_column("batch", pa.array(out)).to_batches()

    from grainmill.plans.shipping import ship

    ship(spark)
    schema = df.schema.fromJson(df.schema.jsonValue()).add("batch", "long", False)
    return pieces.repartition("_piece").sortWithinPartitions("_piece", "_place").mapInArrow(run, schema)
