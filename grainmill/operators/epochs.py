"""Endless batches with exact quotas, and proofs that epochs cover every row.

The rows of a cell are numbered once. The order of an epoch is a keyed permutation of
those numbers that can be entered at any place, so batch ``b`` of a cell is found
without the batches before it: nothing is sorted anew and nothing is remembered.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.operators.ordered import running_sums
from grainmill.plans.workspace import Workspace

_ROUNDS = 4


def _round_keys(*name: object) -> list[np.uint64]:
    digest = blake2b(":".join(map(str, name)).encode(), digest_size=8 * _ROUNDS).digest()
    return list(np.frombuffer(digest, np.uint64))


def permuted(places: np.ndarray, n: int, *name: object) -> np.ndarray:
    """Where a permutation of 0..n-1, keyed by ``name``, sends each place: a Feistel network on even bits, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = _round_keys(*name)
    out, open_ = places.astype(np.uint64), np.ones(len(places), bool)
    while open_.any():
        left, right = out[open_] >> np.uint64(half), out[open_] & low
        for key in keys:
            mixed = (right + key) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed = mixed * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & low)
        out[open_] = left << np.uint64(half) | right
        open_ = out >= n
    return out.astype(np.int64)


def number_cells(df: DataFrame, cell: str, order: list[str | Column], space: Workspace) -> tuple[DataFrame, dict[str, int]]:
    """``df`` with ``_number`` from 0 within its cell, as a table, and the rows of each cell (a plan's cells are few).

    Numbers come from ranks over the whole table, so a cell with most rows is not one task.
    """
    ranked = space.table("ranked", running_sums(df.where(F.col(cell).isNotNull()), [cell, *order], {"_rank": F.lit(1)}))
    first = ranked.groupBy(F.col(cell).alias("_cell")).agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("_n"))
    sizes = {r["_cell"]: (r["_first"], r["_n"]) for r in first.collect()}
    firsts = df.sparkSession.createDataFrame([(c, f) for c, (f, _) in sizes.items()] or [("", 0)], "_cell string, _first long")
    numbered = ranked.join(F.broadcast(firsts), F.col(cell) == F.col("_cell")).withColumn("_number", F.col("_rank") - F.col("_first")).drop("_rank", "_first", "_cell")
    return space.table("numbered", numbered), {c: n for c, (_, n) in sizes.items()}


PLACES = "batch long, cell string, epoch long, place long, number long"


def batch_places(cell: str, n: int, quota: int, first: int, last: int, seed: int) -> pa.RecordBatch:
    """Epoch, place and row number of all rows that a cell of ``n`` rows gives to batches ``first`` to ``last`` (excluded)."""
    at = np.arange(first * quota, last * quota, dtype=np.int64)
    epoch, place = at // n, at % n
    number = np.empty_like(place)
    for e in np.unique(epoch).tolist():
        number[epoch == e] = permuted(place[epoch == e], n, seed, cell, e)
    columns = [pa.array(at // quota), pa.array([cell] * len(at), pa.string()), pa.array(epoch), pa.array(place), pa.array(number)]
    return pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in PLACES.split(", ")])


def planned_places(spark, sizes: Mapping[str, int], quotas: Mapping[str, int], first: int, last: int, seed: int = 0) -> DataFrame:
    """``batch``, ``cell``, ``epoch``, ``place``, ``number`` of batches ``first`` to ``last`` (excluded): each cell gives its quota to every batch."""
    cells = {c: (sizes[c], q) for c, q in quotas.items() if q > 0 and sizes.get(c)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(0).to_numpy()  # a range gives consecutive numbers
            for cell, (n, quota) in cells.items():
                if len(numbers):
                    yield batch_places(cell, n, quota, int(numbers[0]), int(numbers[-1]) + 1, seed)

    return spark.range(first, last).mapInArrow(run, PLACES)


def drawn_rows(places: DataFrame, numbered: DataFrame, cell: str) -> DataFrame:
    """The rows of planned places: ``batch``, ``epoch``, ``place`` and all columns of the numbered table."""
    rows = numbered.withColumnRenamed("_number", "_row")
    return places.join(rows, (F.col("cell") == F.col(cell)) & (F.col("number") == F.col("_row"))).select("batch", "epoch", "place", *[c for c in numbered.columns if c != "_number"])


def _weight(keys: list[str]) -> list[Column]:
    """Four numbers of 62 bits from a SHA-256 of a row's key: their sums over rows do not depend on order."""
    digest = F.sha2(F.to_json(F.array(*[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys])), 256)
    return [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]


def coverage_proof(inventory: DataFrame, visits: DataFrame, keys: list[str], epochs: int) -> DataFrame:
    """One row: ``rows``, ``visits`` and ``covered``, whether the visits are each inventory row exactly ``epochs`` times.

    Compares sums of 240 hashed bits over the visits with ``epochs`` times those over the inventory:
    a lost and a doubled visit have different keys, so they cannot cancel. Nothing is sorted or joined.
    """
    parts = [w.alias(f"w{i}") for i, w in enumerate(_weight(keys))]
    sums = lambda df, p: df.select(*parts).agg(F.count(F.lit(1)).alias(f"{p}n"), *[F.coalesce(F.sum(f"w{i}"), F.lit(0)).alias(f"{p}{i}") for i in range(4)])
    both = sums(inventory, "a").join(F.broadcast(sums(visits, "b")))  # a row each
    equal = reduce(lambda x, y: x & y, [F.col(f"a{i}") * epochs == F.col(f"b{i}") for i in range(4)], F.col("an") * epochs == F.col("bn"))
    return both.select(F.col("an").alias("rows"), F.col("bn").alias("visits"), equal.alias("covered"))


def coverage_differences(inventory: DataFrame, visits: DataFrame, keys: list[str], epochs: int) -> DataFrame:
    """``keys`` and ``visits`` of rows not visited exactly ``epochs`` times, and of visits to rows that the inventory lacks."""
    due = inventory.groupBy(*keys).agg((F.count(F.lit(1)) * epochs).alias("_due"), F.lit(0).cast("long").alias("_got"))
    got = visits.groupBy(*keys).agg(F.lit(0).cast("long").alias("_due"), F.count(F.lit(1)).alias("_got"))
    both = due.unionByName(got).groupBy(*keys).agg(F.sum("_due").alias("due"), F.sum("_got").alias("visits"))
    return both.where("due <> visits")


def quota_differences(rows: DataFrame, plan: DataFrame, by: list[str]) -> DataFrame:
    """``by``, ``planned`` and ``found`` where the rows of a cell are not exactly the ``planned`` ones; nulls are a cell of their own."""
    found = rows.groupBy(*by).agg(F.lit(0).cast("long").alias("planned"), F.count(F.lit(1)).alias("found"))
    wanted = plan.groupBy(*by).agg(F.sum("planned").cast("long").alias("planned"), F.lit(0).cast("long").alias("found"))
    return found.unionByName(wanted).groupBy(*by).agg(F.sum("planned").alias("planned"), F.sum("found").alias("found")).where("planned <> found")


def whole_epochs(inventory: DataFrame, keys: list[str], epochs: int, rows_per_batch: int, seed: int = 0) -> DataFrame:
    """``keys``, ``epoch`` and ``batch`` of a plan that visits each row once an epoch in batches of equal size.

    Refuses a plan with a partial last batch. Rows are in a keyed order of their own in every epoch.
    """
    spark = inventory.sparkSession
    space = Workspace(spark, "epochs")
    numbered, sizes = number_cells(inventory.select(*keys).withColumn("_all", F.lit("all")), "_all", [F.sha2(F.concat_ws(":", *keys), 256), *keys], space)
    n = sizes.get("all", 0)
    if not n or n * epochs % rows_per_batch:
        raise ValueError("whole epochs need full batches and at least one row")
    places = planned_places(spark, sizes, {"all": rows_per_batch}, 0, n * epochs // rows_per_batch, seed)
    return drawn_rows(places, numbered, "_all").select(*keys, "epoch", "batch")
