"""Every query with SQL against DuckDB over the smallest tables; the others run and keep their schema."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from granary.plans import registry


def _plain(v):
    if isinstance(v, (float,)) or hasattr(v, "as_tuple"):
        return round(float(v), 6)
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, data, name):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = registry.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    found = sorted([tuple(_plain(r[c]) for c in columns) for r in df.collect()], key=repr)
    want = con.sql(registry.ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert found == sorted([tuple(_plain(r[k]) for k in at) for r in want.fetchall()], key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, data, name):
    assert registry.QUERIES[name](spark, data).columns


def test_entry(spark, data):
    rows = entry.entry(spark)
    assert rows.columns == ["id", "job_id", "task_type", "recommendation", "n_tags"]
    assert rows.count() > 0


def test_names_are_covered():
    assert set(entry.oracle_sql()) <= set(entry.queries())
