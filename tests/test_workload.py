"""Every registered query against its SQL counterpart in DuckDB, on the smallest tables."""

import glob
import os
from decimal import Decimal

import duckdb
import pytest

from twinlake import workload

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = workload.queries(), workload.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


def plain(value):
    if isinstance(value, (Decimal, float)):
        return int(value) if value == int(value) else float(value)
    return value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        assert sorted(want.columns) == sorted(df.columns)
        assert got == rows(want.columns, want.fetchall())


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(workload.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["o_orderkey", "status"]


def test_core_does_not_import_the_optional_part():
    import ast
    from pathlib import Path

    top = Path(workload.__file__).parent
    for path in top.rglob("*.py"):
        if "llm" in path.relative_to(top).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("twinlake.llm") for n in names), path
