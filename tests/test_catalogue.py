"""Every registered query of the engine against its SQL."""

from __future__ import annotations

import shutil
import subprocess
import sys

import pytest

from conftest import TOP
from driftwell.catalogue import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, same):
    same(name, QUERIES, ORACLE_SQL)


@pytest.mark.parametrize("name", ["engine_sample", "streaming_ingest_equiv", "streaming_engine_equiv", "irs_orders", "flatten_sorted", "record_batches"])
def test_second_run_is_the_same(name, same):
    """Queries that write leave nothing that a further run in the session would read."""
    same(name, QUERIES, ORACLE_SQL)
    same(name, QUERIES, ORACLE_SQL)


def test_oracles_follow_the_data(duck):
    """No oracle is a constant: each gives other rows for other tables, but where it reads no table."""
    import duckdb

    from conftest import TABLES

    other = duckdb.connect()
    for t in TABLES:
        other.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        if any(t in sql for t in ("orders", "lineitem", "events")):
            a, b = duck.execute(sql).fetchall(), other.execute(sql).fetchall()
            assert sorted(map(str, a)) != sorted(map(str, b)), name


def test_library_without_the_training_data_operators(tmp_path):
    """With both their folders gone the rest imports, and its entry runs."""
    copy = tmp_path / "repo"
    shutil.copytree(TOP, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "*.json", "spark-warehouse"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 50 and not any(n.startswith('op') or n == 'pipeline' for n in q); import bench"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
