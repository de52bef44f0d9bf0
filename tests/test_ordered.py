"""Greedy cuts, running sums and hold-outs over many pieces against the walk over all rows."""

import random
from collections import defaultdict

import pytest

from grainmill.operators.batching import LEAST_SAVING, budget_batches, plan_chunks
from grainmill.operators.holdout import hold_out
from grainmill.operators.ordered import greedy_batches, running_sums


def walk(rows, budget, most):
    """Batch number of every (size, id), by the sequential rule."""
    out, batch, held = {}, 0, 0
    for size, i in sorted(rows):
        if held and (size * (held + 1) > budget or held >= most):
            batch, held = batch + 1, 0
        out[i] = batch
        held += 1
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("shape", ["even", "tied", "zeros"])
def test_batches_equal_walk(spark, seed, shape):
    random.seed(seed)
    size = {"even": lambda: random.randrange(1, 900), "tied": lambda: random.choice([7, 7, 7, 120]), "zeros": lambda: random.choice([0, 0, 0, 1, 3000])}[shape]
    rows = [(size(), i) for i in range(1500)]
    budget, most = random.choice([(1000, 64), (5000, 7), (100, 3), (1 << 40, 1 << 40)])
    df = spark.createDataFrame([(s, i, "x") for s, i in rows], "size long, id long, extra string").repartition(7)
    got = {r["id"]: r["batch"] for r in budget_batches(df, "size", budget, most).collect()}
    assert got == walk(rows, budget, most)


def test_one_group_over_many_pieces(spark):
    """A group with most rows is cut across pieces; every group has a budget of its own; a null group is a group."""
    random.seed(9)
    rows = [(random.choice([None, "hot", "hot", "hot", f"g{i % 40}"]), random.randrange(50), i) for i in range(2000)]
    budget = lambda g: 900 if g == "hot" else -5 if g == "g3" else 200
    df = spark.createDataFrame([(g, s, i, budget(g)) for g, s, i in rows], "g string, size long, id long, cap long")
    got = {r["id"]: r["batch"] for r in greedy_batches(df, "size", "cap", ["id"], 1 << 40, group="g").collect()}
    groups = defaultdict(list)
    for g, s, i in rows:
        groups[g].append((s, i))
    want = {i: b for g, members in groups.items() for i, b in walk(members, budget(g), 1 << 40).items()}
    assert got == want


def test_chunks_equal_plan(spark):
    random.seed(10)
    rows = [(f"s{random.choice([1, 1, 1, *range(2, 90)])}", i) for i in range(800)]
    prefix = {s: random.randrange(0, 400) for s, _ in rows}
    items = [(s, i, prefix[s], random.randrange(0, 60)) for s, i in rows] + [(None, 900, 5, 6), (None, 901, 500, 6)]
    df = spark.createDataFrame(items, "sample string, id long, p long, s long")
    got = {r["id"]: (r["kind"], r["chunk"]) for r in plan_chunks(df, "sample", "p", "s", 700, ["id"], max_rows=5).collect()}
    groups = defaultdict(list)
    for s, i, p, n in items:
        groups[s if s else f"null{i}"].append((n, i, p))
    want, singles = {}, []
    for members in groups.values():
        p = members[0][2]
        if len(members) < 2 or (len(members) - 1) * p < LEAST_SAVING:
            singles += [(p + n, i) for n, i, _ in members]
        else:
            want |= {i: ("shared", b) for i, b in walk([(n, i) for n, i, _ in members], 700 - p, 1 << 40).items()}
    want |= {i: ("rows", b) for i, b in walk(singles, 700, 5).items()}
    assert got == want and {k for k, _ in want.values()} == {"shared", "rows"}


def test_running_sums(spark):
    random.seed(11)
    rows = [(random.randrange(9), i, random.choice([None, 1, 5, -2])) for i in range(700)]
    df = spark.createDataFrame(rows, "k long, id long, v long").repartition(9)
    got = {r["id"]: (r["n"], r["total"]) for r in running_sums(df, ["k", "id"], {"n": "1", "total": "v"}).collect()}
    want, n, total = {}, 0, 0
    for _, i, v in sorted(rows, key=lambda r: r[:2]):
        n, total = n + 1, total + (v or 0)
        want[i] = (n, total)
    assert got == want


def test_empty_tables(spark):
    df = spark.createDataFrame([], "sample string, id long, p long, s long")
    assert budget_batches(df, "s", 10).collect() == [] and plan_chunks(df, "sample", "p", "s", 10, ["id"]).collect() == []
    assert running_sums(df, ["id"], {"n": "1"}).collect() == []
    groups, cells = spark.createDataFrame([], "group string, n long"), spark.createDataFrame([], "group string, cell string")
    assert hold_out(groups, cells, {"n": 5}, ["group"]).collect() == []


def walk_groups(order, counts, cells, needs, limit, any_group):
    remain = defaultdict(int)
    for of in cells.values():
        for c in of:
            remain[c] += 1
    needs, taken, spared = dict(needs), set(), set()
    for g in order:
        if not any(v > 0 for v in needs.values()) or len(taken) >= limit:
            break
        if not any_group and not any(needs[n] > 0 and counts[g].get(n) for n in needs):
            continue
        if any(remain[c] <= 1 for c in cells[g]):
            spared.add(g)
            continue
        taken.add(g)
        for c in cells[g]:
            remain[c] -= 1
        for n in needs:
            needs[n] -= counts[g].get(n) or 0
    return taken, spared


@pytest.mark.parametrize("seed", range(6))
def test_hold_out_equals_walk(spark, seed):
    """Few groups in many small cells, so that cells' last groups depend on each other."""
    random.seed(seed)
    names = [f"g{i:03d}" for i in range(random.choice([12, 60, 150]))]
    cells = {g: set(random.choices([f"c{i}" for i in range(random.choice([6, 30, 90]))], k=random.choice([1, 1, 2, 4]))) for g in names}
    counts = {g: {"a": random.choice([None, 0, 1, 2]), "b": random.choice([0, 0, 3])} for g in names}
    needs, limit, any_group = random.choice([({"a": 20, "b": 9}, 99, False), ({"a": 10**6, "b": 10**6}, 10**6, True), ({"a": 10**6, "b": 4}, 30, False), ({"a": 0, "b": 0}, 5, True)])
    groups = spark.createDataFrame([(g, counts[g]["a"], counts[g]["b"]) for g in names], "group string, a long, b long")
    pairs = spark.createDataFrame([(g, c) for g in names for c in cells[g]] * 2, "group string, cell string")
    got = hold_out(groups, pairs, needs, ["group"], limit=limit, any_group=any_group).collect()
    taken, spared = walk_groups(names, counts, cells, needs, limit, any_group)
    assert {r["group"] for r in got if r["taken"]} == taken
    assert {r["group"] for r in got if r["kept_for_cell"]} == spared
