"""Curation plans, sources and sinks on small fixtures against plain Python."""

import hashlib
import json
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import baseline as B
from granary.operators import builders, keyed
from granary.operators.order import ordered_fill
from granary.plans import curation_queries as Q
from granary.plans.review_queries import reviewed_decision
from granary.sources import lines as L
from granary.sources import sinks as S

MESSAGES = "array<struct<role:string,content:string>>"


def _m(*said):
    return [{"role": ("user", "assistant")[k % 2], "content": s} for k, s in enumerate(said)]


def test_labels_stand_alone(spark):
    said = "USER:\nHi\nUSER: is what you type first\nASSISTANT:  \n\nYes\nASSISTANT:\nUSER:\n"
    got = spark.createDataFrame([(said,), (None,), ("",)], "t string").select(T.turns(F.col("t")).alias("m")).collect()
    assert [(x["role"], x["content"]) for x in got[0]["m"]] == [("user", "Hi\nUSER: is what you type first"), ("assistant", "Yes")]
    assert got[1]["m"] is None and got[2]["m"] == []


def test_control_tokens_are_those_of_media(spark):
    from granary.operators.metrics import control_tokens

    rows = spark.createDataFrame([("<b>bold</b> <think>x</think> <audio> <|image|> <|video>",), (None,)], "t string").select(*control_tokens(F.col("t"))).collect()
    assert tuple(rows[0]) == (3, "<audio> <|image|> <|video>") and rows[1][0] in (0, -1)


def _selected(spark, repaired):
    drafts = spark.createDataFrame([("a", _m("q", "x")), ("b", _m("q", "x")), ("c", _m("p", "y")), ("d", _m("r", "z")), ("e", None), ("f", _m("q", "w"))], f"id string, messages {MESSAGES}")
    jobs = spark.createDataFrame([(x, f"j{x}") for x in "abcdef"], "id string, job_id string")
    ok = {"s": 5}
    fixed = json.dumps(_m("p", "better"))
    rows = [
        ("ja", "accept", ok, [], "n", None), ("jb", "accept", ok, [], "n", None), ("jc", "repair", {"s": 1}, ["t"], "n", fixed),
        ("jd", "accept", {"s": 3}, [], "n", None), ("je", "repair", ok, [], "n", "[]"), ("jf", "reject", ok, [], "n", None),
    ]
    assessed = spark.createDataFrame(rows, "job_id string, recommendation string, scores map<string,int>, failure_tags array<string>, brief_notes string, revised string")
    return {r["id"]: r for r in B.with_duplicates(B.selected(drafts, jobs, assessed, repaired)).collect()}


def test_baseline_selection_in_both_modes(spark):
    got = _selected(spark, False)
    assert set(got) == {"a", "b"} and got["b"]["duplicate_of"] == "a" and got["a"]["duplicate_of"] is None and got["a"]["original_hash"] is None
    got = _selected(spark, True)
    canon = lambda m: hashlib.sha256(json.dumps(m, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert set(got) == {"a", "b", "c"} and got["c"]["review_status"] == "critic-repaired"
    assert got["c"]["original_hash"] == canon(_m("p", "y")) and got["c"]["conversation_hash"] == canon(_m("p", "better"))


def test_baseline_keeps_connected_records_together(spark, data):
    rows = Q.baseline_rows(spark, data, True).filter("duplicate_of is null").collect()
    parent = {r["id"]: r["id"] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    owner = {}
    for r in rows:
        keys = [(f, v) for f in Q.GROUPING_KEYS if r[f] and (v := re.sub(r"[\W_]+", "", r[f].lower())) and v not in __import__("granary.plans.document_queries", fromlist=["x"]).NOT_KNOWN]
        keys += [(m["role"], " ".join(re.sub(r"[^\w]+", " ", m["content"].lower()).split())) for m in r["messages"] or [] if m["role"] in ("user", "assistant") and m["content"]]
        for k in keys:
            if k[1]:
                a, b = find(r["id"]), find(owner.setdefault(k, r["id"]))
                parent[max(a, b)] = min(a, b)
    got = {r["id"]: r for r in Q.baseline_records(spark, data).collect()}
    assert {i: r["group_id"] for i, r in got.items()} == {i: find(i) for i in parent}
    by = {}
    for r in got.values():
        by.setdefault(r["group_id"], set()).add(r["split"])
    assert all(len(s) == 1 for s in by.values())
    train = sum(r["split"] == "experimental-train" for r in got.values())
    assert 0.8 * len(got) < train <= 0.9 * len(got)


def test_reviewer_decisions(spark):
    rows = [("critic accepted", "Keep", None), ("repair first", "keep", None), ("repair first", "use revision", "text"), ("repair first", "revision", " "), ("critic accepted", None, None), ("critic accepted", "perhaps", None), ("new", "keep", None)]
    df = spark.createDataFrame(rows, "p string, f string, r string")
    got = [r[0] for r in df.select(reviewed_decision(F.col("p"), F.col("f"), F.col("r"))).collect()]
    assert got == ["original", "withheld", "revision", "error: no revision", "withheld", "error: unknown flag perhaps", "error: unknown priority new"]
    assert df.select(reviewed_decision(F.col("p"), F.col("f"), F.col("r"), True)).collect()[1][0] == "original"


def test_a_fill_that_does_not_end_is_an_error(spark):
    groups = spark.createDataFrame([(f"g{k}", 3 + k % 2) for k in range(40)], "group_id string, n long")
    assert ordered_fill(groups, 0.5, "x").count() == 40
    with pytest.raises(RuntimeError):
        ordered_fill(groups, 0.5, "x", most_rounds=1)


def test_first_delivery_moves_only_repeated_keys(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z"), ("c", None, "u"), ("c", 1, "v")], "k string, t int, v string")
    assert sorted(tuple(r) for r in keyed.first_delivery(df, "k", [F.col("t")]).collect()) == [("a", 1, "y"), ("b", 5, "z"), ("c", None, "u")]
    assert keyed.first_delivery(df.limit(0), "k", [F.col("t")]).count() == 0


def test_builders_and_defaults(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "y", "s"), (3, None, None)], "id int, kind string, source string")
    two = lambda rows: rows.select("id", F.lit(1).alias("n")).unionByName(rows.select("id", F.lit(2).alias("n")))
    assert sorted(tuple(r) for r in builders.built(df, "kind", {"x": two, "y": lambda r: two(r).filter("n = 1")}).collect()) == [(1, 1), (1, 2), (2, 1)]
    with pytest.raises(keyed.GateError):
        builders.built(df, "kind", {"x": two})
    got = builders.with_defaults(df, {"source": "none", "split": "draft"}, {"kind": "z"}).orderBy("id").collect()
    assert [(r["source"], r["split"], r["kind"]) for r in got] == [("none", "draft", "z"), ("s", "draft", "z"), ("none", "draft", "z")]


def test_profiles_and_specs(spark, tmp_path):
    good = tmp_path / "p.json"
    good.write_text(json.dumps({"target_total": 5, "target_counts": {"a": 2, "b": 3}}))
    assert L.read_profile(spark, str(good), 2)["target_total"] == 5
    with pytest.raises(ValueError):
        L.read_profile(spark, str(good), 3)
    bad = tmp_path / "q.json"
    bad.write_text(json.dumps({"target_total": 6, "target_counts": {"a": 2, "b": 3}}))
    with pytest.raises(ValueError):
        L.read_profile(spark, str(bad))
    specs = tmp_path / "s.json"
    specs.write_text(json.dumps({"benchmarks": [{"id": "x", "n": 3}, {"id": "y", "n": None}]}))
    assert L.read_specs(spark, str(specs), "benchmarks", "id string, n int", ["id"], ["n"]).count() == 2
    specs.write_text(json.dumps({"benchmarks": [{"id": "", "n": 0}]}))
    with pytest.raises(ValueError):
        L.read_specs(spark, str(specs), "benchmarks", "id string, n int", ["id"], ["n"])


def test_task_rows_start_with_their_letter(spark, tmp_path):
    (tmp_path / "t.md").write_text("| id | task |\n|---|---|\n| T1 | a |\n| note | b |\n| T2 | c |\n")
    got = L.read_markdown_table(spark, str(tmp_path / "t.md"), ["id", "task"], ["id", "task"], "T")
    assert sorted(r["id"] for r in got.collect()) == ["T1", "T2"]


def test_inventory_counts_filled_lines(spark, tmp_path):
    (tmp_path / "a b.jsonl").write_text('{"x":1}\n\n{"x":2}\n')
    (tmp_path / "n.txt").write_text("one\n")
    got = {r["file"].rsplit("/", 1)[1].replace("%20", " "): r for r in L.inventory(spark, str(tmp_path)).collect()}
    assert got["a b.jsonl"]["rows"] == 2 and got["n.txt"]["rows"] is None and got["n.txt"]["bytes"] == 4


def test_reports_leave_nothing_out(spark, tmp_path):
    df = spark.createDataFrame([(f"k{k}", "<b>", None) for k in range(5)], "k string, l string, r string")
    assert S.markdown_table(df, 5).count("\n") == 7
    with pytest.raises(ValueError):
        S.markdown_table(df, 4)
    page = S.side_by_side(df, "k", "l", "r", "a & b")
    assert "&lt;b&gt;" in page and "(missing)" in page and "a &amp; b" in page
    assert S.report("t", {"one": "text", "two": df}).startswith("# t\n\n## one\n\ntext\n\n## two\n\n| k |")
    (tmp_path / "x").write_text("said")
    S.write_archive({"in/x": str(tmp_path / "x")}, str(tmp_path / "o.zip"))
    with zipfile.ZipFile(tmp_path / "o.zip") as z:
        assert z.namelist() == ["in/x"] and z.read("in/x") == b"said"
    rows = spark.createDataFrame([("b1", 0, "x"), ("b1", 1, "y"), ("b2", 0, "z")], "batch string, shard int, v string")
    assert "`batch=b1`: 2 rows in 2 shards" in S.stage_batches(rows, str(tmp_path / "stage")) and spark.read.json(str(tmp_path / "stage")).count() == 3
