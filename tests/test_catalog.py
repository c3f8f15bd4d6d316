"""Every named query against its SQL on the smallest tables, and plans."""

import glob
import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from millrace.plans.catalog import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {Path(f).stem} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[want.columns.index(c)]) for c in cols) for r in want.fetchall()), key=repr)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(QUERIES["filter_qty"](spark, DATA))
    assert "GreaterThan(l_quantity,45.0)" in plan
    assert "l_comment" not in plan and "l_shipdate" not in plan


@pytest.mark.parametrize("name", ["many_step", "word_count", "join_cust_orders", "change_tracking", "repeat_and_sum", "nation_order_totals"])
def test_declarative_queries_run_no_python(spark, name):
    assert "Python" not in (plan := plan_of(QUERIES[name](spark, DATA))) and "Arrow" not in plan


def test_join_is_no_cogroup(spark):
    assert "collect_list" not in plan_of(QUERIES["join_cust_orders"](spark, DATA))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_llm_folders(tmp_path):
    """A copy of the repository without millrace/llm and tests/llm, with and without corpus_pipeline.py."""
    root = Path(__file__).resolve().parent.parent
    for gone in ((), ("corpus_pipeline.py",)):
        copy = tmp_path / f"copy{len(gone)}"
        shutil.copytree(root, copy, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", *gone))
        code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') for n in e.queries()), 'pipeline' in e.queries())"
        said = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""}, check=True)
        assert said.stdout.split() == [str(len(QUERIES)), str(len(ORACLE_SQL)), "False", "False"]
