"""Core operators on small tables: edge cases and brute force."""

import json
import random

import pytest
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.functions.words import words
from granary.operators import conversations as C
from granary.operators import keyed as K
from granary.operators import order as O
from granary.operators import validate as V
from granary.operators.components import connected_components, star_edges
from granary.sources import lines as L
from granary.sources import sinks as S
from granary.streaming import logs


def _one(spark, expr, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(expr.alias("v")).head()[0]


def _union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def test_components_against_union_find(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (7, None)]
    found = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = _union_find([(a, b) for a, b in edges if b is not None and a != b])
    assert found == want


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "u string, v string")).count() == 0


def test_star_edges_link_a_hot_key_once_each(spark):
    rows = [(f"r{k:04d}", 0, "hot") for k in range(500)] + [("r0001", 0, "hot"), (None, 0, "hot"), ("x", 1, "alone")]
    edges = star_edges(spark.createDataFrame(rows, "id string, field int, key string"), "id", ["field", "key"])
    assert edges.count() == 499
    assert {r["v"] for r in edges.collect()} == {"r0000"}


def test_hot_nodes_take_the_broadcast_path(spark, monkeypatch):
    from granary.operators import components

    monkeypatch.setattr(components, "HOT_LINKS", 20)
    monkeypatch.setattr(components, "HOT_SHARE", 0.0)
    edges = [("a", f"n{k:03d}") for k in range(100)] + [("m1", "m2"), ("m2", "m3")]
    found = {r[0]: r[1] for r in components.connected_components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert found == _union_find(edges)


def test_records_are_connected_by_any_key(spark, tmp_path):
    from granary.plans import registry

    said = lambda q, a: [{"role": "system", "content": "be kind"}, {"role": "user", "content": q}, {"role": "assistant", "content": a}]
    rows = [
        ("a", "CK_01", None, None, said("one", "1")), ("b", " ck:01 ", "G7", None, said("two", "2")), ("c", None, "g-7", "D 9", None),
        ("d", "unknown", "N/A", "d/9", said("four", "4")), ("e", "Unknown", "n/a", "", said("five", "5")), ("f", "d9", None, None, said("Six, please!", "6")),
        ("g", None, None, None, said("six please", "7")), ("h", None, None, None, said("7", "...")), (None, "ck01", None, None, None),
    ]
    schema = "id string, content_key string, source_group_id string, source_document_id string, messages array<struct<role:string,content:string>>"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/sft_records.parquet")
    found = {r["id"]: r["group_id"] for r in registry.QUERIES["connected_records_any_key"](spark, str(tmp_path)).collect()}
    assert found == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "f": "f", "g": "f", "h": "h"}


def test_ordinals_are_gapless_and_in_order(spark):
    df = spark.createDataFrame([(f"k{(k * 7919) % 1000:04d}", k) for k in range(1000)], "key string, x int")
    rows = sorted((r["ordinal"], r["key"]) for r in O.with_ordinal(df, "key").collect())
    assert [r[0] for r in rows] == list(range(1000))
    assert [r[1] for r in rows] == sorted(r[1] for r in rows)
    assert O.with_ordinal(df.filter("x < 0"), "key").count() == 0


@pytest.mark.parametrize("share", [0.0, 0.35, 0.9, 1.0])
def test_ordered_fill_is_the_greedy_walk(spark, share):
    import hashlib

    rnd = random.Random(9)
    sizes = {f"g{k}": rnd.choice([1, 1, 2, 5, 40, 300]) for k in range(400)}
    order = sorted(sizes, key=lambda g: hashlib.sha256(f"s:{g}".encode()).hexdigest())
    left, want = int(sum(sizes.values()) * share), {}
    for g in order:
        want[g] = "train" if sizes[g] <= left else "validation"
        left -= sizes[g] if want[g] == "train" else 0
    found = O.ordered_fill(spark.createDataFrame(list(sizes.items()), "group_id string, n long"), share, "s")
    assert {r["group_id"]: r["split"] for r in found.collect()} == want


def test_keyed_operators(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", None, "z"), (None, 5, "n")], "k string, at int, v string")
    assert {(r["k"], r["v"]) for r in K.latest(log, ["k"], [F.col("at")]).collect()} == {("a", "y"), ("b", "z"), (None, "n")}
    assert {r["k"] for r in K.duplicate_keys(log, "k").collect()} == {"a", None}
    other = spark.createDataFrame([("b",), ("c",)], "k string")
    assert {(r["k"], r["side"]) for r in K.key_mismatch(log.filter("k is not null"), other, "k").collect()} == {("a", "left only"), ("c", "right only")}
    with pytest.raises(K.GateError):
        K.gate(K.unmatched(other, log, "k"), "unknown keys")
    docs = spark.createDataFrame([(1, "A"), (2, "A"), (3, None), (4, None)], "d int, t string")
    assert {(r["d"], r["duplicate_of"]) for r in K.keep_first(docs, F.col("t"), "d").collect()} == {(1, None), (2, 1), (3, None), (4, None)}


def test_text_functions(spark):
    t = F.col("t")
    assert _one(spark, T.leakage_text(t), t="  Straße -- ok!\n") == "strasse ok"
    assert _one(spark, T.draft_text(t), t="\n A  b!\t") == "a b!"
    assert _one(spark, T.slug(t), t="--A b/C--") == "a-b-c"
    assert _one(spark, T.slug(t), t="?!") is None
    assert _one(spark, T.batch_code(t), t="sft-batch-7") == "b007"
    assert _one(spark, T.visible_response(t), t="<think>a</think> b <think>c") == "b"
    assert _one(spark, T.thought(t), t="<think>a</think> b <think>c") == "a\nc"
    assert _one(spark, T.try_int(t), t=" 5 ") == 5
    assert _one(spark, T.try_int(t), t="4x") is None
    assert _one(spark, T.word_count(t), t="l'eau est-elle 3 là") == 3
    assert _one(spark, T.is_revision(t), t="a" * 40) is True
    turns = _one(spark, T.turns(t), t="USER:\nHi\nASSISTANT:\n\nUSER:\nBye\nnow")
    assert [(m["role"], m["content"]) for m in turns] == [("user", "Hi"), ("user", "Bye\nnow")]
    message = "array(named_struct('role', 'user', 'content', 'a\"b'))"
    assert spark.sql(f"select {message} as m").select(T.canonical_messages(F.col("m"))).head()[0] == '[{"content":"a\\"b","role":"user"}]'


def test_words_normalise_and_drop_format_characters():
    assert words("ﬁn­al ＡＢＣ １２! l​o") == ["final", "abc", "12", "lo"]
    assert words(None) == words("") == words("... ​") == []


def test_histories(spark):
    m = "array<struct<role:string,content:string>>"
    many = [{"role": "user" if k % 2 == 0 else "assistant", "content": str(k)} for k in range(20)]
    df = spark.createDataFrame([("a", many), ("b", many[:1]), ("c", []), ("d", None)], f"id string, messages {m}")
    kept = {r["id"]: r["k"] for r in df.select("id", F.size(C.last_messages(F.col("messages"), 13)).alias("k")).collect()}
    assert kept["a"] == 12 and kept["b"] == 1 and kept["c"] == 0
    turns = {r["id"]: r["k"] for r in df.select("id", F.size(C.last_turns(F.col("messages"), 2)).alias("k")).collect()}
    assert turns["a"] == 5 and turns["b"] == 1
    errors = {r["id"]: r["e"] for r in df.select("id", C.message_errors(F.col("messages")).alias("e")).collect()}
    assert errors == {"a": [], "b": ["fewer than two"], "c": ["fewer than two"], "d": ["no messages"]}
    assert C.prompt_completions(df, "id").count() == 10


def test_jsonl_lines_rejects_and_missing_against_null(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "a-1", "split": null}\n\n[1]\nnot json\n{"id": 3, "id": "a-2"}\n{"id": "a-1", "split": "train"}\n')
    rows, rejects = L.read_jsonl(spark, str(tmp_path / "a.jsonl"))
    assert sorted(r["line_no"] for r in rows.collect()) == [1, 5, 6]
    assert sorted((r["line_no"], r["error"]) for r in rejects.collect()) == [(3, "no object"), (4, "no JSON")]
    errors = {r["line_no"]: r["errors"] for r in V.checked(rows, "doc", ["id", "split"], {"split": ["train"]}, key="id").collect()}
    assert errors == {1: ["split is no string"], 5: ["missing split"], 6: ["repeated id"]}


def test_lines_are_numbered_over_splits(spark, tmp_path):
    (tmp_path / "big.txt").write_text("".join(f"{k}\n" for k in range(1, 60_001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        found = L.lines(spark, str(tmp_path / "big.txt"))
        assert found.filter("line_no <> cast(value as long)").count() == 0 and found.count() == 60_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_tables_and_specs(spark, tmp_path):
    (tmp_path / "t.md").write_text("# T\n| ID | Text |\n| --- | --- |\n| T1 | a |\n| T2 | b | c |\n text\n| T3 | d |\n")
    assert [(r["id"], r["text"]) for r in L.read_markdown_table(spark, str(tmp_path / "t.md"), ["ID", "Text"], ["id", "text"]).orderBy("line_no").collect()] == [("T1", "a"), ("T3", "d")]
    (tmp_path / "x.tsv").write_text("id\ttext\nA\t one \n\ttwo\n")
    rows, bad = L.read_tsv(spark, str(tmp_path / "x.tsv"), ["id", "text"], ["id"])
    assert [tuple(r) for r in rows.collect()] == [("A", "one")] and bad.count() == 1
    with pytest.raises(ValueError):
        L.read_tsv(spark, str(tmp_path / "x.tsv"), ["nope"])
    (tmp_path / "s.json").write_text(json.dumps({"items": [{"id": "a", "n": 1}, {"id": "b", "n": None}]}))
    assert L.read_specs(spark, str(tmp_path / "s.json"), "items", "id string, n int").count() == 2
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.jsonl").write_text("{}\n\n{}\n")
    (tmp_path / "d" / "b.bin").write_bytes(b"xy")
    have = {r["file"].rsplit("/", 1)[1]: (r["bytes"], r["rows"]) for r in L.inventory(spark, str(tmp_path / "d")).collect()}
    assert have == {"a.jsonl": (7, 2), "b.bin": (2, None)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(k, f"t\n{k}") for k in range(10)], "k int, t string")
    S.write_jsonl(df, str(tmp_path / "j"), "k")
    assert spark.read.json(str(tmp_path / "j")).count() == 10
    S.write_shards(df, str(tmp_path / "sh"), 3, "k")
    assert {r["shard"]: r["count"] for r in spark.read.json(str(tmp_path / "sh")).groupBy("shard").count().collect()} == {0: 4, 1: 3, 2: 3}
    S.write_review_sheet(df, str(tmp_path / "r"), ["k", "t"], ["score"])
    sheet = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "r"))
    assert sheet.columns == ["k", "t", "score"] and sheet.filter("t like '%\\\\\\\\n%'").count() == 10
    path = str(tmp_path / "m.json")
    assert S.guard_manifest(spark, path, {"sha": "1", "n": 2}, ["sha"]) is True
    assert S.guard_manifest(spark, path, {"sha": "1", "n": 3}, ["sha"]) is False
    with pytest.raises(S.ManifestError):
        S.guard_manifest(spark, path, {"sha": "2"}, ["sha"])
    assert S.markdown_table(df.limit(1)).count("\n") == 3


def test_streams(spark, tmp_path):
    src = tmp_path / "log"
    rows = spark.createDataFrame([("a", 1, "error"), ("b", 1, "ok"), ("a", 2, "ok")], "task string, at int, status string")
    rows.repartition(3).write.parquet(str(src))
    stream = logs.file_stream(spark, str(src), max_files=1)
    last = logs.latest_state(stream, ["task"], [F.col("at")], str(tmp_path / "state"), str(tmp_path / "cp"))
    assert {(r["task"], r["status"]) for r in spark.read.parquet(last).collect()} == {("a", "ok"), ("b", "ok")}
