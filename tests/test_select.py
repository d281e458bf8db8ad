"""Selections and set comparisons: gates, order, empty tables, nulls."""

import pytest
from pyspark.sql import functions as F

from granary.operators import metrics as M
from granary.operators import select as S
from granary.operators.keyed import GateError


@pytest.fixture()
def rows(spark):
    return spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), (None, 4)], "id string, n int")


def test_pick_keeps_the_requests_order(rows):
    assert [(r["id"], r["place"]) for r in S.pick(rows, ["c", "a"]).orderBy("place").collect()] == [("c", 0), ("a", 1)]
    with pytest.raises(GateError):
        S.pick(rows, ["c", "zz"])
    with pytest.raises(GateError):
        S.pick(rows, ["c", "c"])
    assert S.pick(rows, ["zz"], gate=False).count() == 0


def test_prefixes_must_match(rows):
    assert S.without_prefixes(rows, "id", ["a", "b"]).count() == 2
    with pytest.raises(GateError):
        S.without_prefixes(rows, "id", ["a", "q"])
    assert S.without_prefixes(rows, "id", []).count() == 4


def test_sets_and_expectations(spark, rows):
    assert S.same_set(rows, rows.unionByName(rows))
    assert not S.same_set(rows, rows.filter("n > 1"))
    other = spark.createDataFrame([("a", 1), ("b", 9), ("d", None)], "id string, n int")
    found = {r["id"]: (r["expected"], r["actual"]) for r in S.expected_against_actual(rows.filter("id is not null"), other, "id", "n").collect()}
    assert found == {"b": (2, 9), "c": (3, None)}


def test_take_first(rows):
    assert [r["n"] for r in S.take_first(rows, 2, "n").collect()] == [1, 2]
    with pytest.raises(GateError):
        S.take_first(rows, 9, "n")


def test_lists_tags_and_metrics(spark):
    df = spark.createDataFrame([("a , b,,c", ["license:mit", "x", "license:apache", "license:mit"], {"p": 1.0, "q": None, "r": 2.0}), (None, [], {})], "t string, tags array<string>, m map<string,double>")
    got = df.select(S.listed(F.col("t")).alias("t"), S.tagged_values(F.col("tags"), "license:").alias("v"), S.kept_metrics(F.col("m"), ["p", "q"]).alias("m")).collect()
    assert [tuple(r) for r in got] == [(["a", "b", "c"], ["apache", "mit"], {"p": 1.0}), ([], [], {})]


def test_run_summary_without_success(spark):
    df = spark.createDataFrame([("t1", "error", None, None, None, None, 3.5), ("t2", "error", None, None, None, None, None)], "task_id string, status string, finish_reason string, output_tokens int, latency_seconds double, tokens_per_second double, peak_unified_memory_gb double")
    row = M.run_summary(df).head()
    assert (row["n_rows"], row["n_ok"], row["tokens"], row["median_tokens"], row["minutes"], row["peak_memory"]) == (2, 0, None, None, None, 3.5)
    assert M.run_summary(df.limit(0), "status").count() == 0


def test_ratios_of_nothing(spark):
    df = M.tokenization(spark.createDataFrame([("", "a"), ("!!", None), ("one two", "a")], "text string, lang string"), "text", F.lit(3))
    assert [r["tokens_per_word"] for r in df.collect()] == [0.0, 0.0, 1.5]
    assert {r["lang"]: r["texts"] for r in M.ratio_by_group(df, "lang").collect()} == {"a": 2, "none": 1, "all": 3}
