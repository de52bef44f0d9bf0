"""Every registered query that has SQL gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest

from grainmill.plans import registry

NAMES = sorted(registry.oracle_sql())


@pytest.fixture(scope="session")
def duck(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return c


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(x):
        if isinstance(x, float):
            return "null" if math.isnan(x) else f"{x:.5f}"
        return "null" if x is None else f"{float(x):.5f}" if type(x).__name__ == "Decimal" else str(x)

    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, data, name):
    got = registry.queries()[name](spark, data)
    want = duck.execute(registry.oracle_sql()[name])
    assert canonical(got.columns, [tuple(r) for r in got.collect()]) == canonical([d[0] for d in want.description], want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(NAMES)))
def test_gives_rows(spark, data, name):
    assert registry.queries()[name](spark, data).count() > 0
