"""Registered queries against SQL at the smallest scale, and the guard that keeps the rest apart."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from grainmill.llm import queries as Q

ROOT = Path(__file__).resolve().parents[2]


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_matches_sql(spark, data, name):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    got = Q.queries()[name](spark, data)
    want = c.execute(Q.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(str, want.fetchall()))


def test_rest_imports_without_this_package(tmp_path):
    import shutil

    for name in ("grainmill", "__spark_entry__.py"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "grainmill" / "llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_names_cover_all():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.queries()) == list(range(1, 14))
