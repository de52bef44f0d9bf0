"""Endless batches: permutations, quotas, restarts at any offset; proofs of coverage."""

import json
import random

import numpy as np
import pytest

from grainmill.operators import epochs as E
from grainmill.plans.workspace import Workspace
from grainmill.streaming.endless import endless_batches

QUOTAS = {"a": 5, "b": 3, "c": 2, "none": 4, "zero": 0}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000, 4097])
def test_permutations(n):
    first = E.permuted(np.arange(n), n, 1, "a", 0)
    assert sorted(first.tolist()) == list(range(n))
    # entering at any place gives the same numbers
    assert E.permuted(np.arange(n // 2, n), n, 1, "a", 0).tolist() == first[n // 2 :].tolist()
    if n > 64:
        assert E.permuted(np.arange(n), n, 1, "a", 1).tolist() != first.tolist() != list(range(n))


@pytest.fixture(scope="module")
def cells(spark):
    random.seed(14)
    rows = [(i, c) for i, c in enumerate(["a"] * 37 + ["b"] * 11 + ["c"] * 1 + [None] * 3 + ["zero"])]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, cell_name string").repartition(5)
    return (*E.number_cells(df, "cell_name", ["id"], Workspace(spark, "test-cells")), rows)


def test_epochs_take_each_row_once(spark, cells):
    numbered, sizes, rows = cells
    assert sizes == {"a": 37, "b": 11, "c": 1, "zero": 1}
    got = E.drawn_rows(E.planned_places(spark, sizes, QUOTAS, 0, 40, 3), numbered, "cell_name").collect()
    for batch in range(40):
        mine = [r["cell_name"] for r in got if r["batch"] == batch]
        assert {c: mine.count(c) for c in set(mine)} == {"a": 5, "b": 3, "c": 2}
    for cell in "abc":
        ids = sorted(i for i, c in rows if c == cell)
        whole = 40 * QUOTAS[cell] // len(ids)
        for epoch in range(whole):
            assert sorted(r["id"] for r in got if r["cell_name"] == cell and r["epoch"] == epoch) == ids


def stream_rows(spark, cells, path, **options):
    numbered, sizes, _ = cells
    query = endless_batches(spark, numbered, "cell_name", sizes, QUOTAS, seed="3", **options).writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return sorted((r["batch"], r["cell_name"], r["place"], r["id"]) for r in spark.read.parquet(f"{path}/rows").collect())


def test_a_restart_at_any_offset_gives_the_same_rows(spark, cells, tmp_path):
    numbered, sizes, _ = cells
    want = sorted((r["batch"], r["cell_name"], r["place"], r["id"]) for r in E.drawn_rows(E.planned_places(spark, sizes, QUOTAS, 0, 9, 3), numbered, "cell_name").collect())
    whole = stream_rows(spark, cells, tmp_path / "one", until="9", perTrigger="4")
    assert whole == want
    part = stream_rows(spark, cells, tmp_path / "two", until="3", perTrigger="1")
    assert part == [r for r in want if r[0] < 3]
    assert stream_rows(spark, cells, tmp_path / "two", until="9", perTrigger="2") == want  # from the checkpoint
    assert stream_rows(spark, cells, tmp_path / "three", start="6", until="9", perTrigger="5") == [r for r in want if r[0] >= 6]  # without one


def test_coverage_names_planted_faults(spark):
    inventory = spark.createDataFrame([(f"s{i}", j) for i in range(60) for j in range(3)] + [(None, 1)], "sample string, row int")
    with pytest.raises(ValueError):
        E.whole_epochs(inventory, ["sample", "row"], 2, 4)
    rows = inventory.where("sample IS NOT NULL")
    visits = Workspace(spark, "test-visits").table("v", E.whole_epochs(rows, ["sample", "row"], 2, 8, seed=4))
    keys = ["sample", "row"]
    assert E.coverage_proof(rows, visits, keys, 2).first().covered and E.coverage_differences(rows, visits, keys, 2).count() == 0
    assert {r["count"] for r in visits.groupBy("batch").count().collect()} == {8}
    # one visit lost, another doubled: the number of visits is right, the proof is not
    lost = visits.where("NOT (sample = 's7' AND row = 1 AND epoch = 0)").unionByName(visits.where("sample = 's9' AND row = 2 AND epoch = 1"))
    proof = E.coverage_proof(rows, lost, keys, 2).first()
    assert proof["visits"] == 2 * proof["rows"] and not proof.covered
    assert sorted(map(tuple, E.coverage_differences(rows, lost, keys, 2).collect())) == [("s7", 1, 2, 1), ("s9", 2, 2, 3)]
    alien = visits.unionByName(spark.createDataFrame([("x", 0, 0, 0)], visits.schema))
    assert [tuple(r) for r in E.coverage_differences(rows, alien, keys, 2).collect()] == [("x", 0, 0, 1)]
    none = rows.limit(0)
    assert E.coverage_proof(none, visits.limit(0), keys, 2).first().covered and not E.coverage_proof(none, visits, keys, 2).first().covered


def test_quota_differences(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), (None, "x")], "s string, t string")
    plan = spark.createDataFrame([("a", "x", 3), ("b", "y", 1)], "s string, t string, planned long")
    assert sorted(map(tuple, E.quota_differences(rows, plan, ["s", "t"]).collect()), key=str) == [("a", "x", 3, 2), ("b", "y", 1, 0), (None, "x", 0, 1)]
    exact = spark.createDataFrame([("a", "x", 2), (None, "x", 1)], "s string, t string, planned long")
    assert E.quota_differences(rows, exact, ["s", "t"]).count() == 0


def test_offsets_are_json():
    from grainmill.streaming.endless import EndlessSource

    reader = EndlessSource({"cells": json.dumps({"a": [3, 2]}), "until": "2"}).streamReader(None)
    assert reader.initialOffset() == {"batch": 0} and [reader.latestOffset()["batch"] for _ in range(3)] == [1, 2, 2]
