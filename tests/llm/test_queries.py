"""The training-data queries run over the smallest tables with the columns that are asked for."""

import glob
import os

import duckdb
import pytest

from granary.llm import queries

FOUND = {
    "p1_found": ["id", "pair_no", "defect"], "p2_found": ["request_id", "message_no", "segment_no", "lang"], "p3_found": ["id_a", "id_b"],
    "p4_found": ["key_a", "key_b"], "p5_found": ["group_id", "id"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "sent_no", "start_char", "end_char"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    if name in FOUND:
        assert df.columns == FOUND[name]
    assert df.count() >= 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, data, name):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = queries.QUERIES[name](spark, data)
    want = con.sql(queries.ORACLES[name]).select(*df.columns).fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
