"""Near-duplicates, cross-split overlaps and grouped splits against brute force, and their edge cases."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from granary.llm import grouped_splits as G
from granary.llm import near_duplicates as N
from granary.llm import prefixes as P
from granary.llm import similar as S
from granary.llm import split_overlap as O

SCHEMA = (
    "id string, split string, source string, messages array<struct<role:string,content:string>>, content_key string, "
    "source_group_id string, source_document_id string, ingested_at timestamp, sig long, n int"
)


def _rec(i, text, split="train", keys=(None, None, None), said=True):
    messages = None if text is None else [{"role": "user", "content": text[: len(text) // 2]}, {"role": "assistant", "content": text[len(text) // 2 :]}] if said else []
    return (i, split, "src", messages, *keys, None, 1, 1)


def _noisy(rnd, ws, vocab, p):
    out = []
    for w in ws:
        x = rnd.random()
        if x < p / 3:
            continue
        if x < 2 * p / 3:
            out.append(rnd.choice(vocab))
            continue
        out.append(w)
        if x < p:
            out.append(rnd.choice(vocab))
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    vocab = [f"w{k}" for k in range(60)] + [f"name{k}" for k in range(900)]
    common, rare = vocab[:60], vocab[60:]
    base = [[rnd.choice(common if rnd.random() < 0.6 else rare) for _ in range(rnd.choice([1, 3, 6, 30, 90, 250]))] for _ in range(90)]
    out = []
    for k, ws in enumerate(base):
        for c in range(rnd.choice([1, 1, 2, 3])):
            text = " ".join(ws if c == 0 else _noisy(rnd, ws, vocab, rnd.choice([0.0, 0.1, 0.2, 0.3])))
            out.append(_rec(f"r{k:03d}-{c}", text, rnd.choice(["train", " TRAIN", "validation", "benchmark-only", "draft", None])))
    out += [_rec("empty", None), _rec("blank", " .!? "), _rec("none", "x", said=False), _rec(None, "w1 w2 w3"), out[0]]
    return out


def _brute(rows, t=S.SIMILARITY):
    texts = {}
    for r in rows:
        if r[0] is not None and r[3] and r[0] not in texts:
            ws = [w for m in r[3] for w in S.words(m["content"])]
            if ws:
                texts[r[0]] = ws
    return texts, {(a, b) for a, b in combinations(sorted(texts), 2) if S.similarity(texts[a], texts[b]) >= t}


def test_pairs_are_those_of_brute_force(spark, rows):
    _, want = _brute(rows)
    found = [tuple(r) for r in N.near_duplicate_pairs(spark.createDataFrame(rows, SCHEMA)).select("id_a", "id_b").collect()]
    assert len(want) > 20 and set(found) == want and len(found) == len(want)


@pytest.mark.parametrize("threshold", [0.8, 0.9])
def test_other_thresholds(spark, rows, threshold):
    _, want = _brute(rows, threshold)
    found = {tuple(r) for r in N.near_duplicate_pairs(spark.createDataFrame(rows, SCHEMA), threshold).select("id_a", "id_b").collect()}
    assert found == want


def test_large_classes_of_copies_become_stars(spark):
    rows = [_rec(f"c{k:03d}", "one two three four five six seven eight nine ten") for k in range(12)]
    rows.append(_rec("d", "one two three four five six seven eight nine XYZ"))
    found = {tuple(r) for r in N.near_duplicate_pairs(spark.createDataFrame(rows, SCHEMA), copies=5).select("id_a", "id_b").collect()}
    assert found == {("c000", f"c{k:03d}") for k in range(1, 12)} | {("c000", "d")}


def test_groups_hold_every_link(spark, rows):
    texts, want = _brute(rows)
    found = {r["id"]: r for r in N.near_duplicate_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(found) == set(texts)
    assert all(found[a]["group_id"] == found[b]["group_id"] for a, b in want)
    linked = {x for p in want for x in p}
    assert all(found[i]["group_id"] == i and found[i]["links"] == 0 for i in texts if i not in linked)


def test_nothing_in_nothing_out(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert N.near_duplicate_pairs(empty).count() == 0
    assert G.torn_groups(empty).count() == 0
    assert O.overlap_pairs(empty, spark.createDataFrame([], "id string, split string, prompt string")).count() == 0


@pytest.mark.parametrize("most", [40, 120, 400])
def test_sketches_never_rule_out_a_similar_pair(most):
    rnd = random.Random(most)
    hashes, similar, other = P.WordHashes(), [], []
    for _ in range(300):
        a = [f"x{rnd.randrange(500)}" for _ in range(rnd.randrange(1, most))]
        b = _noisy(rnd, a, a, 0.3)
        if b and S.similarity(a, b) >= S.SIMILARITY:
            similar.append((a, b))
            other.append((a, [f"y{w}" for w in b]))

    def kept(pairs):
        # one signature for all: nothing but sizes and sketches can rule a pair out
        texts = [ws for p in pairs for ws in p]
        h, size = P.token_hashes(texts, hashes)
        s, _, _ = P.sketches(h, size)
        batch = pa.RecordBatch.from_arrays([pa.array(size, pa.int32()), pa.array(range(len(size)), pa.int64()), *[pa.array(s[:, k]) for k in range(P.LONGS)]], names=["n", "rid", *P.SKETCH])
        owner = np.arange(len(size))
        rows = P.index_batch(batch, owner, owner // 2, owner * 0, owner * 0, S.SIMILARITY, 3)
        found = {tuple(sorted(x)) for piece in rows.column("rows").to_pylist() for a, b in P.meet([piece], S.SIMILARITY, False) for x in zip(a.tolist(), b.tolist())}
        return sum((2 * k, 2 * k + 1) in found for k in range(len(pairs)))

    assert len(similar) > 30 and kept(similar) == len(similar)
    assert kept(other) < 0.1 * len(other)


def _classes_apart(n):
    """n words of n different classes of the order, whatever the number of classes."""
    out, seen = [], set()
    for k in range(100_000):
        c = xxhash.xxh3_64_intdigest(f"q{k}") >> 8
        if c % P.CLASSES not in seen or len(seen) == P.CLASSES:
            seen.add(c % P.CLASSES)
            out.append(f"q{k}")
        if len(out) == n:
            return out


@pytest.mark.parametrize("n, more, changed", [(29, 12, 0), (30, 12, 0), (41, 0, 7), (44, 0, 7), (48, 0, 8), (52, 0, 9), (56, 0, 9), (12, 5, 0), (3, 1, 0), (1, 0, 0), (190, 20, 15), (260, 100, 0), (230, 0, 30)])
def test_frequent_tokens_of_different_classes_lose_no_pair(n, more, changed):
    # every token is frequent, so no prefix can rest on rare ones
    rnd = random.Random(n)
    words = _classes_apart(n + more + changed)
    a = words[:n]
    b = words[changed : n + more] + words[n + more :] if changed else words[: n + more]
    assert S.similarity(a, b) >= S.SIMILARITY
    order = P.Order(np.full(P.BUCKETS, 10**6) + np.array([rnd.randrange(1000) for _ in range(P.BUCKETS)]), hot=10**9)
    h, size = P.token_hashes([a, b], P.WordHashes())
    owner, sig, w = order.rows(h, size, S.SIMILARITY)
    far = P.farthest(size[owner], w, S.SIMILARITY)
    one = {x for x, o, f in zip(sig.tolist(), owner, far) if o == 0 and f >= size[1]}
    two = {x for x, o, f in zip(sig.tolist(), owner, far) if o == 1 and f >= size[0]}
    assert one & two


def test_hot_lists_split_by_size_lose_no_pair(spark, rows, monkeypatch):
    _, want = _brute(rows)
    monkeypatch.setattr(N, "Order", lambda counts: P.Order(counts, rare=2, hot=1))
    found = {tuple(r) for r in N.near_duplicate_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == want


def test_frequent_tokens_are_indexed_by_pairs_and_lose_no_pair(spark, rows, monkeypatch):
    _, want = _brute(rows)
    monkeypatch.setattr(N, "Order", lambda counts: P.Order(counts, classes=8, step=60, rare=1))
    assert {tuple(r) for r in N.near_duplicate_pairs(spark.createDataFrame(rows, SCHEMA)).collect()} == want


def test_overlaps_across_splits(spark, rows):
    texts, want = _brute(rows)
    part = {r[0]: {"train": "train", "validation": "eval", "benchmark-only": "eval"}.get((r[1] or "").strip().lower()) for r in rows}
    want = {p for p in want if {part[p[0]], part[p[1]]} == {"train", "eval"}}
    prompt = "please explain the word igare to a class of beginners in the school today"
    rows = rows + [_rec("t1", f"{prompt} {'zz ' * len(prompt)}"), _rec("t2", f"{prompt} {'zz ' * len(prompt)}", "validation")]
    rows[-2] = ("t1", "train", "src", [{"role": "user", "content": "hello there"}, {"role": "assistant", "content": "hi"}, {"role": "user", "content": prompt.upper() + "!"}], None, None, None, None, 1, 1)
    rows[-1] = ("t2", "validation", "src", [{"role": "user", "content": prompt}, {"role": "assistant", "content": "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3}], None, None, None, None, 1, 1)
    tasks = spark.createDataFrame([("T1", "benchmark-only", prompt), ("T2", "train-template", prompt), (None, "benchmark-only", prompt), ("T3", "benchmark-only", None)], "id string, split string, prompt string")
    found = {tuple(r) for r in O.overlap_pairs(spark.createDataFrame(rows, SCHEMA), tasks).select("key_a", "key_b").collect()}
    assert ("T1", "t1") in found
    assert {p for p in found if "T1" not in p} == want


def test_texts_without_a_common_chunk_overlap(spark):
    rnd = random.Random(8)
    vocab = [f"v{k}" for k in range(200)]
    rows, prompts, want = [], [], set()
    for k, n in enumerate([4, 9, 14, 20, 27, 28, 29, 34, 40, 41, 60, 86, 120, 250] * 3):
        ws = [rnd.choice(vocab) for _ in range(n)]
        mixed = rnd.sample(ws, n)
        for at in rnd.sample(range(n), n * 15 // 100):
            mixed[at] = rnd.choice(vocab)
        if S.similarity(ws, mixed) >= S.SIMILARITY:
            want |= {(f"e{k}", f"t{k}"), (f"T{k}", f"t{k}")}
        # only the user message is similar to the prompt, and the whole record to the evaluation record
        rows += [(i, split, "src", [{"role": "user", "content": " ".join(x)}, {"role": "assistant", "content": "yes"}], None, None, None, None, 1, 1) for i, split, x in ((f"t{k}", "train", ws), (f"e{k}", "validation", mixed))]
        prompts.append((f"T{k}", "benchmark-only", " ".join(mixed)))
    tasks = spark.createDataFrame(prompts, "id string, split string, prompt string")
    assert len(want) > 60
    assert want <= {tuple(r) for r in O.overlap_pairs(spark.createDataFrame(rows, SCHEMA), tasks).collect()}


def test_fractions_of_an_exact_copy_are_whole(spark):
    text = " ".join(f"word{k}" for k in range(60))
    rows = [_rec("a", text), _rec("b", text, "validation"), _rec("c", "other words here and there", "validation")]
    found = O.overlaps(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r["train_key"], r["eval_key"], r["part"]) for r in found] == [("a", "b", "validation")]
    assert found[0]["train_fraction"] == found[0]["eval_fraction"] == found[0]["similarity"] == 1.0


def test_fractions_count_every_shared_chunk(spark):
    ws = [f"word{k}" for k in range(300)]
    edited = [*ws[:150], "new", *ws[151:]]
    rows = [_rec("a", " ".join(ws)), _rec("b", " ".join(ws), "validation"), _rec("c", " ".join(edited), "validation")]
    found = {r["eval_key"]: (r["train_fraction"], r["eval_fraction"]) for r in O.overlaps(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found["b"] == (1.0, 1.0)
    texts = {r[0]: [w for m in r[3] for w in S.words(m["content"])] for r in rows}
    held = {d: n for d, n in O.chunks(texts["c"])}
    shared = sum(n for d, n in O.chunks(texts["a"]) if d in held)
    assert found["c"] == pytest.approx((shared / len(texts["a"]), shared / len(texts["c"]))) and found["c"][0] > 0.95


def test_chunks_cover_a_text_and_move_only_where_it_is_edited():
    ws = [f"w{k * 37 % 101}" for k in range(200)]
    a, b = O.chunks(ws), O.chunks(["new", *ws])
    assert sum(n for _, n in a) == 200 and max(n for _, n in a) <= O.MOST
    assert len({d for d, _ in a} & {d for d, _ in b}) >= len(set(a)) - 5
    assert O.chunks([]) == []
    assert O.chunks(["a"]) == O.chunks(["a"]) and sum(n for _, n in O.chunks(["é"] * 50)) == 50


def test_a_cut_depends_on_the_bytes_before_it_across_words():
    plain = O.rolling_hash(b"one two three four")
    other = O.rolling_hash(b"one twx three four")
    assert (plain != other).sum() == O.WINDOW
    # the same word after other words does not always end a chunk: the window reaches beyond it
    ends = {int(O.rolling_hash(f"{x} is".encode())[-1]) for x in ("some", "other", "words", "here")}
    assert len(ends) == 4


def test_copies_on_both_sides_are_all_told(spark):
    text = " ".join(f"word{k}" for k in range(40))
    rows = [_rec(f"t{k}", text) for k in range(5)] + [_rec(f"e{k}", text, "validation") for k in range(4)]
    tasks = spark.createDataFrame([], "id string, split string, prompt string")
    assert O.overlap_pairs(spark.createDataFrame(rows, SCHEMA), tasks).count() == 20
    _, links = O.text_classes(spark.createDataFrame(rows, SCHEMA))
    assert links.count() == 1


def test_torn_groups_follow_keys_however_spelled(spark):
    rows = [
        _rec("a", "x", "train", ("Key-1", None, None)), _rec("b", "x", " Validation ", ("key 1", "g", None)), _rec("c", "x", "draft", (None, "G", "doc")),
        _rec("d", "x", None, ("unknown", "N/A", "Doc!")), _rec("e", "x", "train", ("key2", "none", None)), _rec("f", "x", "validation", ("unknown", "none", "-")),
        _rec("g", "x", "experimental-train", ("key2", None, None)), _rec(None, "x", "validation", ("key2", None, None)),
    ]
    found = {tuple(r) for r in G.torn_groups(spark.createDataFrame(rows, SCHEMA)).select("group_id", "id").collect()}
    assert found == {("a", i) for i in "abcd"}


def test_splits_keep_groups_and_proportions(spark):
    rnd = random.Random(2)
    groups = [(f"i{k}", "big" if k < 300 else f"g{rnd.randrange(1500)}") for k in range(3000)]
    found = G.assign_splits(spark.createDataFrame(groups, "id string, group_id string")).collect()
    assert len(found) == 3000
    by = {}
    for r in found:
        by.setdefault(r["group_id"], set()).add(r["split"])
    assert all(len(s) == 1 for s in by.values())
    share = {s: sum(r["split"] == s for r in found) / 3000 for s in G.SPLITS}
    assert all(abs(share[s] - p) < 0.04 for s, p in G.SPLITS.items())


def test_extra_columns_with_clashing_names_do_no_harm(spark, rows):
    df = spark.createDataFrame(rows[:40], SCHEMA)
    for c in ("said", "uid", "key", "kind", "s1", "digest", "a", "b", "u", "v", "group_id", "component", "part"):
        df = df.withColumn(c, F.lit("clash"))
    assert N.near_duplicate_pairs(df).columns == ["id_a", "id_b"]
    N.near_duplicate_pairs(df).collect()
    G.torn_groups(df).collect()
    O.overlaps(df).collect()
