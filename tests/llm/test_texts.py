"""Pair defects, languages, packing, leakage and sentences: known cases, held-out accuracy, edge cases."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import chain, crf, language, leakage, packing, pair_defects, sentences
from granary.llm.ppm import PpmModels, folded
from granary.llm.seeds import SEED_TEXTS

M = "array<struct<role:string,content:string>>"


# --- prediction by partial matching ---------------------------------------------------------------------------------


def test_code_lengths_are_those_of_a_plain_walk():
    texts = {"a": ["abracadabra abra", "cad bar"], "b": ["xyzzy yxzzy abra"]}
    models = PpmModels(texts, order=3)
    trees = {k: b"\n".join(folded(t) for t in v) for k, v in texts.items()}

    def cost(data, text):
        bits = 0.0
        for k in range(len(text)):
            for d in range(3, -1, -1):
                ctx = (b"\0" * 3 + text)[k + 3 - d : k + 3]
                follow = [data[n + d] for n in range(len(data) - d) if data[n : n + d] == ctx]
                if not follow:
                    continue
                q, times = len(set(follow)), follow.count(text[k])
                if times:
                    bits -= np.log2(times / (len(follow) + q))
                    break
                bits -= np.log2(q / (len(follow) + q))
            else:
                bits += 8.0
        return bits

    for s in ("abra", "zzz", "cadabra xy", "q"):
        got = models.bits([folded(s)])[0]
        assert got == pytest.approx([cost(trees[k], folded(s)) for k in models.langs], rel=1e-4)


def test_held_out_sentences_get_their_language():
    models = language.train([])
    said = {
        "rw": "Umwarimu yigishije abana gusoma ariko nta gitabo cyari gihari.", "en": "The teacher was reading a long story to the children.",
        "fr": "La maîtresse a lu une longue histoire avec les enfants.", "sw": "Mwalimu alisoma hadithi ndefu kwa watoto wa shule.",
    }
    langs, sure = language.classify(models, list(said.values()))
    assert langs == list(said) and all(0.25 <= p <= 1 for p in sure)


REQUESTS = f"request_id string, language string, messages {M}, received_at timestamp, lang string, segment_no int"


def _request(i, label, *texts):
    return (i, label, [{"role": "user" if k % 2 == 0 else "assistant", "content": t} for k, t in enumerate(texts)], None, "x", 9)


def test_wrong_labels(spark):
    rw, en, fr = "Mwaramutse, mwarimu. Ndashaka kwiga byinshi kurushaho.", "Good morning, teacher. I want to learn more.", "Je veux apprendre davantage."
    rows = [
        _request("r1", "rw", rw), _request("r2", "en-US", rw, en), _request("r3", None, f"{rw} {en}"), _request("r4", "AUTO", "", en, fr),
        _request("r5", "Kinyarwanda", en), _request("r5", "Kinyarwanda", en), _request("r6", "fr", "What does `mon livre` mean when she says it?"),
        _request(None, "fr", en), ("r7", "und", None, None, "x", 9), _request("r8", "de", en), _request("r9", "", None, en, ":) 123"),
    ]
    found = sorted(tuple(r) for r in language.wrong_labels(spark.createDataFrame(rows, REQUESTS)).collect())
    assert found == [("r2", 0, 0, "rw"), ("r3", 0, 0, "rw"), ("r3", 0, 1, "en"), ("r4", 2, 0, "fr"), ("r5", 0, 0, "en"), ("r6", 0, 0, "en"), ("r8", 0, 0, "en")]


def test_no_requests(spark):
    assert language.wrong_labels(spark.createDataFrame([], REQUESTS)).count() == 0


def test_segments_of_a_long_text(spark):
    text = " ".join(["The teacher was reading to the children."] * 2000 + ["Umwarimu yigishije abana gusoma."] * 2000)
    df = spark.createDataFrame([(1, text)], "k int, content string")
    found = language.segments(df, language.train([]), ["k"]).collect()
    assert [(r["segment_no"], r["lang"]) for r in found] == [(0, "en"), (1, "rw")]


# --- conditional random field and pair defects ----------------------------------------------------------------------


def test_viterbi_and_marginals_against_all_sequences():
    from itertools import product

    model = crf.Crf(["x", "y"])
    model.fit([([["a"], ["b"], ["a"]], ["x", "y", "x"]), ([["b"], ["b"]], ["y", "y"]), ([["a"], ["a"]], ["x", "x"])], epochs=3)
    s = model.scores(model.encode([["a"], ["b"], ["c"]]))
    value = {p: sum(s[k, v] for k, v in enumerate(p)) + sum(model.t[a, b] for a, b in zip(p, p[1:])) for p in product(range(2), repeat=3)}
    assert tuple(model.viterbi(s)) == max(value, key=lambda p: value[p])
    z = sum(np.exp(v) for v in value.values())
    p, _ = model._marginals(s)
    assert p[1, 0] == pytest.approx(sum(np.exp(v) for q, v in value.items() if q[1] == 0) / z)


@pytest.fixture(scope="module")
def tagger(spark, data):
    return pair_defects.fit(pair_defects.sample_pairs(spark.read.parquet(f"{data}/sft_records.parquet")))


def test_defects_of_plain_cases(tagger):
    q = "Write 3 quiz questions about `igare` from this line: `The driver Kana sold a blue bicycle at the market of Huye.`"
    good = "The driver Kana sold a blue bicycle near Huye because the rain was strong. Remember that `igare` takes a different plural."
    cases = {
        None: "empty", " ​ ": "empty", "N/A": "empty", "...": "empty", "(nta gisubizo)": "empty", good: None,
        "I'm sorry, but I can't help with Huye.": "refusal", "Mumbabarire, sinshobora kugufasha ku byerekeye igare. Baza umwarimu w'i Huye.": "refusal",
        "Désolé, il m'est impossible de répondre à propos de Huye.": "refusal", "Samahani, siwezi kujibu swali hili.": "refusal",
        f"Question: {q}": "echo", q.upper(): "echo", "the driver kana sold a blue bicycle at the market of huye": "echo",
        "L'infirmière a acheté un vélo rouge au marché parce que la pluie était forte. Le voisin a vendu la lampe.": "wrong_language",
        good + " The driver Kana sold a blue bicycle because": "truncated", good + " In the dry season, the coach `umu": "truncated",
        "I can't confirm every use of `igare`; still, here is what a teacher says. " + good: None,
        "`I can't help with inka.` is what Kana says when refusing politely. " + good: None,
    }
    live = [a for a in cases if not pair_defects.is_empty(a)]
    found = dict(zip(live, tagger.tag([(q, a) for a in live])))
    got = {a: pair_defects.defect_of(a, *found.get(a, ([], []))) for a in cases}
    assert got == cases


def test_pieces_hold_their_own_loss_tokens(spark):
    limits = packing.Limits(2_048, 16, 1_280)
    assert packing.cut_runs([-1_500, 1_500], limits) == [(2_048, 548), (952, 952)]
    assert packing.cut_runs([3_000], limits) == [(1_280, 1_280), (1_280, 1_280), (440, 440)]
    assert packing.cut_runs([-10, 1_280, -758], limits) == [(2_048, 1_280)] and packing.cut_runs([], limits) == []
    said, told = " word" * 1_500, " word" * 1_500
    rows = [("r", [{"role": "user", "content": said}, {"role": "assistant", "content": told}], None), ("n", None, None)]
    found = packing.pack_instructions(spark.createDataFrame(rows, f"id string, messages {M}, ingested_at timestamp")).orderBy("piece_no").collect()
    enc = packing.encoding()
    u, a = len(enc.encode_ordinary(said)), len(enc.encode_ordinary(told))
    want, start = [], 0
    while start < u + a:
        end = min(start + 2_048, u + a)
        want.append((start, end - start, max(0, end - max(start, u))))
        start = end
    assert [(r["start_token"], r["tokens"], r["loss_tokens"]) for r in found] == want


def test_a_frequent_wrong_language_stays_a_defect(spark, data):
    pairs = pair_defects.sample_pairs(spark.read.parquet(f"{data}/sft_records.parquet"))
    french = "L'infirmière a acheté un vélo rouge au marché parce que la pluie était forte. Le voisin a vendu la lampe."
    rwanda = "Ku wa gatatu umucuruzi yaguze igare ku isoko kubera ko imvura yari nyinshi. Abaturanyi basomye ibaruwa mu rugo."
    plain, exchange = "Why did the driver sell a blue bicycle at the market of Huye?", "Write a short exchange between Kana and Kezi in Huye. Start from: The driver sold a blue bicycle."
    made = [(f"{plain[:-1]} in year {1900 + k}?", (french, rwanda)[k % 2]) for k in range(len(pairs))]
    tagger = pair_defects.fit([p for both in zip(pairs, made) for p in both])
    want = {(plain, french): "wrong_language", (plain, rwanda): "wrong_language", (exchange, rwanda): None, (exchange, french): "wrong_language"}
    assert {p: pair_defects.defect_of(p[1], *t) for p, t in zip(want, tagger.tag(list(want)))} == want


def test_held_out_broken_copies(spark, data, tagger):
    rnd = random.Random(77)
    pairs = [p for p in pair_defects.sample_pairs(spark.read.parquet(f"{data}/sft_records.parquet")) if p[1] and p[1].rstrip()[-1:] == "." and len(p[1]) > 150][:150]
    refused = [(q, pair_defects._refusal(rnd.choice(list(pair_defects.REFUSALS)), rnd, q)) for q, _ in pairs]
    echoed = [(q, pair_defects._echo(q, rnd)) for q, _ in pairs]
    for made, name in ((refused, "refusal"), (echoed, "echo")):
        got = [pair_defects.defect_of(a, p, t) for (_, a), (p, t) in zip(made, tagger.tag(made))]
        assert got.count(name) >= 0.95 * len(made)


def test_refusals_of_no_list(tagger):
    """Forms that no list of the operator holds; cited and hedging ones are no refusals."""
    refused = (
        "I can't help with inka. Please ask a teacher in Huye.", "Thank you for asking, but I must decline to discuss Kezi.", "Sorry, there is nothing I can say about umuti.",
        "As a language model, this request about Huye is outside what I am allowed to do.", "Sinshobora kugufasha ku byerekeye inka. Baza umwarimu w'i Huye.",
        "Mumbabarire, ntabwo nemerewe gusubiza ibibazo kuri Kezi.", "Désolé, je ne peux pas vous aider au sujet de Kezi.", "Je regrette, mais il m'est impossible de répondre à propos de Huye.",
    )
    sound = (
        "`I can't help with inka.` is what Kamana says when refusing politely. The word `inka` is used in Huye by many people every day.",
        "I can't confirm every use of `umuti`; still, here is what a teacher says. The word `umuti` keeps its first vowel in this sentence.",
    )
    listed = [x for lists in pair_defects.REFUSALS.values() for x in lists[1]]
    assert not any(core.format("inka").rstrip(".") in text for core in listed for text in refused if "{}" in core)
    question = "Write a short sentence with `umuti` that Kezi could use in Huye."
    got = [pair_defects.defect_of(a, *t) for a, t in zip(refused + sound, tagger.tag([(question, a) for a in refused + sound]))]
    assert got[: len(refused)].count("refusal") >= len(refused) - 1 and got[len(refused) :] == [None] * len(sound)


RECORDS = f"id string, messages {M}, ingested_at timestamp, defect string, question string"


def test_pairs_of_odd_records(spark, tagger):
    def m(*turns):
        return [{"role": r, "content": c} for r, c in turns]

    rows = [
        ("a", m(("system", "s"), ("user", "q"), ("user", "What is this?"), ("assistant", None), ("assistant", "x"), ("user", None), ("assistant", "N/A")), None, "d", "q"),
        ("b", None, None, "d", "q"), ("c", m(("user", "q")), None, "d", "q"), ("d", [], None, "d", "q"), (None, m(("user", "q"), ("assistant", "")), None, "d", "q"),
        ("a", None, None, "d", "q"),
    ]
    found = sorted(tuple(r) for r in pair_defects.broken_pairs(spark.createDataFrame(rows, RECORDS), tagger).collect())
    assert found == [("a", 0, "empty"), ("a", 1, "empty")]
    assert pair_defects.broken_pairs(spark.createDataFrame([], RECORDS)).count() == 0


def test_a_very_long_answer_is_read_whole(spark, tagger):
    answer = "The coach opened the lamp. " * 6000 + "The coach opened the lamp because"
    rows = [("a", [{"role": "user", "content": "Tell a story in English."}, {"role": "assistant", "content": answer}], None, "d", "q")]
    assert [r["defect"] for r in pair_defects.broken_pairs(spark.createDataFrame(rows, RECORDS), tagger).collect()] == ["truncated"]


# --- packing -----------------------------------------------------------------------------------------------------------


def test_windows_keep_every_limit_and_lose_nothing(spark):
    rnd = random.Random(4)
    limits = packing.Limits(100, 7, 60)
    sizes = [(k, rnd.choice([0, 1, 3, 20, 55, 99, 100, 101, 250, 1234]), 0) for k in range(3000)]
    sizes = [(k, t, rnd.randrange(t + 1)) for k, t, _ in sizes]
    items = packing.pieces(spark.createDataFrame(sizes, "doc_id long, tokens long, loss_tokens long"), "doc_id", limits)
    found = packing.packed(items, "doc_id", limits, block=700).toPandas()
    by = found.groupby("window_id").agg(t=("tokens", "sum"), n=("doc_id", "size"), loss=("loss_tokens", "sum"))
    assert by.t.max() <= 100 and by.n.max() <= 7 and by.loss.max() <= 60
    total = found.groupby("doc_id").agg(t=("tokens", "sum"), n=("piece_no", "size"), loss=("loss_tokens", "sum"))
    for k, t, loss in sizes:
        assert (k in total.index) == (t > 0)
        if t:
            assert total.t[k] == t and total.loss[k] == loss
            assert total.n[k] == 1 or t > 100 or loss > 60
    parts = found.sort_values(["doc_id", "piece_no"])
    ends = parts.start_token + parts.tokens
    assert ((parts.start_token == 0) | (parts.start_token == ends.shift(1))).all()


def test_one_kind_of_text_fills_windows_to_the_brim():
    at = packing.fill(np.array([50] * 40), np.array([0] * 40), packing.Limits(100, 10, 100))
    assert len(set(at)) == 20
    assert len(packing.fill(np.array([], int), np.array([], int), packing.Limits())) == 0


def test_documents_are_packed_well(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    extra = docs.withColumn("tokens", F.lit("x")).withColumn("block", F.lit("x")).withColumn("parts", F.lit(1)).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("tokens", F.lit("x")).withColumn("block", F.lit("x")).withColumn("parts", F.lit(1)))
    report = packing.fill_report(packing.pack_documents(extra), packing.Limits()).head()
    assert report["windows"] <= report["least_windows"] + 2
    assert packing.pack_documents(docs.limit(0)).count() == 0


# --- leakage --------------------------------------------------------------------------------------------------------------


def _item(rnd, n=60):
    return " ".join(rnd.choice("abcdefghij") + rnd.choice("klmnopq") + str(rnd.randrange(40)) for _ in range(n))


def _repeats(ws, p, run=leakage.RUN):
    """Brute force: some run of words of p, one altered, dropped or added inside, stands in ws."""
    text = [tuple(ws[k : k + n]) for n in (run - 1, run, run + 1) for k in range(len(ws) - n + 1)]
    for k in range(len(p) - run + 1):
        part = p[k : k + run]
        for w in text:
            if len(w) == run and sum(a != b for a, b in zip(w, part)) <= 1:
                if w[0] == part[0] and w[-1] == part[-1]:
                    return True
            if len(w) == run - 1 and any(list(w) == part[:j] + part[j + 1 :] for j in range(1, run - 1)):
                return True
            if len(w) == run + 1 and any(list(w[:j] + w[j + 1 :]) == part for j in range(1, run)):
                return True
    return False


def test_leaks_against_brute_force():
    rnd = random.Random(8)
    items = [(f"i{k}", f"Read.\n{_item(rnd)}\nWhat?") for k in range(12)]
    index = leakage.ItemIndex(items)
    hits = 0
    for _ in range(60):
        k = rnd.randrange(12)
        p = index.words[k]
        n = rnd.choice([10, 14, 15, 16, 17, 20, 40])
        at = rnd.randrange(len(p) - n)
        part = p[at : at + n]
        for _ in range(rnd.choice([0, 1, 1, 2])):
            j, how = rnd.randrange(1, len(part) - 1), rnd.choice("xda")
            part = part[:j] + ({"x": ["zz"], "d": [], "a": ["zz", part[j]]}[how]) + part[j + 1 :]
        ws = _item(rnd, 20).split() + part + _item(rnd, 10).split()
        want = {c for c in range(12) if _repeats(ws, index.words[c])}
        got = {c for c, _, _ in index.leaks(" ".join(ws))}
        assert want == got
        hits += bool(want)
    assert hits > 15


def test_what_a_reader_sees():
    said = leakage.seen_words("<b>Th­е</b> **blue** c&#97;t, [sat](http://x.y) n&#39;igare&nbsp;É")
    assert said == ["the", "blue", "cat", "sat", "n", "igare", "e"]
    assert leakage.passage("one line") == "one line" and leakage.passage(None) == ""
    # tags of any length say nothing; those that part words do, the others do not
    assert leakage.seen_words(f"one<br>two</p><p class='{'x' * 900}'>th<b>re</b>e [four](http://{'y' * 900})") == ["one", "two", "three", "four"]


def test_documents_that_leak(spark):
    rnd = random.Random(3)
    text = _item(rnd, 50)
    items = spark.createDataFrame([("x", f"Read.\n{text}\nQ?", 1), ("y", None, 1), (None, text, 1), ("short", "a\nb c\nd", 1), ("twin", f"Read.\n{text}\nQ?", 1)], "item_id string, text string, words int")
    long = _item(rnd, 30_000)
    docs = spark.createDataFrame([(1, long + " " + text.upper() + " " + long, 5), (1, long + " " + text + " " + long, 5), (2, long, 5), (3, None, 5), (4, "", 5)], "doc_id long, text string, item_id int")
    found = sorted(tuple(r) for r in leakage.leaked_items(docs, items).select("doc_id", "item_id").collect())
    assert found == [(1, "twin"), (1, "x")]
    assert leakage.leaked_items(docs.limit(0), items).count() == 0
    assert leakage.leaked_items(docs, items.limit(0)).count() == 0


def test_the_question_is_looked_for_besides():
    text = "Read the passage.\n" + " ".join(f"p{k}" for k in range(30)) + "\nWhat did the old farmer sell?"
    index = leakage.ItemIndex([("i", text)])
    body = " ".join(f"p{k}" for k in range(20))
    assert index.leaks(f"{body} and what did the old farmer sell") == [(0, 20, 1.0)]
    assert index.leaks(f"{body} and more") == [(0, 20, 0.0)] and index.leaks("what did the old farmer sell") == []


def test_items_in_blocks_find_the_same(spark, monkeypatch):
    rnd = random.Random(6)
    texts = [_item(rnd, 40) for _ in range(7)]
    items = spark.createDataFrame([(f"i{k // 2}", t) for k, t in enumerate(texts)], "item_id string, text string")
    docs = spark.createDataFrame([(k, f"{_item(rnd, 20)} {t}") for k, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(leakage, "ITEM_BLOCK", 3)
    assert sorted(tuple(r)[:2] for r in leakage.leaked_items(docs, items).collect()) == [(k, f"i{k // 2}") for k in range(7)]


# --- sentences ---------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def segmenter(spark, data):
    return sentences.fit(sentences.sample_documents(spark.read.parquet(f"{data}/documents.parquet")))


CASES = [
    ["Dr. Kana met Mrs. Beza at No. 5 in Huye.", "It rained."],
    ['Kana said, "Sit down. The lesson begins."', "Then we left."],
    ['"Is the pot ready?" asked Kana from the door.', "(This was added by Beza.)", "No!"],
    ["Wait... teacher Kana is still here.", "The rain stopped...", "Then we went."],
    ["She left Huye at 10.10 a.m. with a chair.", "It weighed 3.11 kg, i.e. about 1,070.5 grams."],
    ["« Où est la lampe ? » demanda Kana.", "Voir p. 2, fig. 4, etc.", "Hier, il a plu."],
    ["下雨了……小明还在等书。", "“为什么？”林果问道。", "第7课讲的是新地图（见第3页。）", "小明说：“今天很好。我们学习吧。”", "价格是3.10元！"],
    ["「今日はいい天気ですね。行きましょう。」とミナが言いました。", "本はどこですか？"],
    ["डॉ. सोहनी ने कहानी दिखाए।", "“क्या नक्शा तैयार है?” तारेश ने पूछा।", "वज़न 3.11 कि.ग्रा. था।"],
    ["ዶ/ር ብርኪ ታሪክ አሳየ፡፡", "ካርታ የት ነው?", "ልጁ፡ታሪክ፡አየ።"],
    ["انتظر... ما زال د. لينار يبحث عن كتاب.", "هل رأيت خبز في السوق؟"],
]


@pytest.mark.parametrize("units", CASES, ids=lambda u: u[0][:20])
def test_sentences_of_many_scripts(segmenter, units):
    gap = "" if units[0][0] > "⺀" else " "
    text = gap.join(units)
    assert [text[a:b] for a, b in segmenter.split(text)] == units


def test_layout_makes_units(segmenter):
    text = "Lesson 3: igare\n\n1) The driver Kana sold\na blue lamp.\n- Kana left.\n\nKana: We went\nhome. It rained.\nBeza : Yes.\n  \n\n"
    assert [text[a:b] for a, b in segmenter.split(text)] == ["Lesson 3: igare", "1) The driver Kana sold\na blue lamp.", "- Kana left.", "Kana: We went\nhome.", "It rained.", "Beza : Yes."]
    assert segmenter.split("") == segmenter.split(None) == segmenter.split(" \n\n\t") == []


def test_unpunctuated_text_is_cut_by_the_character_model():
    said = ["老师昨天在图书馆读了故事", "学生们带来了面包然后回家了", "你知道地图在哪里吗", "下雨了小明还在等书"]
    rnd = random.Random(1)
    model = sentences.fit(["。".join(rnd.choice(said) for _ in range(8)) + "。" for _ in range(120)])
    text = "".join(rnd.choice(said) for _ in range(12))
    cut = [text[a:b] for a, b in model.split(text)]
    assert "".join(cut) == text and sum(c in said for c in cut) >= 0.9 * len(cut)


def test_units_hold_every_letter_in_order(spark, data, segmenter):
    for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect():
        text, at = r["text"] or "", 0
        for a, b in segmenter.split(text):
            assert at <= a < b and not text[at:a].strip() and text[a:b] == text[a:b].strip()
            at = b
        assert not text[at:].strip()


def test_sentence_rows(spark, segmenter):
    docs = spark.createDataFrame([(1, "It rained. We went.", 0), (2, None, 0), (3, "", 0), (4, "x " * 50_000 + "end. Next one.", 0), (1, "It rained. We went.", 0)], "doc_id long, text string, sent_no int")
    found = sentences.sentences(docs, segmenter)
    assert found.columns == ["doc_id", "sent_no", "start_char", "end_char"]
    assert sorted(r["doc_id"] for r in found.collect()) == [1, 1, 1, 1, 4, 4]
    assert sentences.sentences(docs.limit(0)).count() == 0


def test_seed_texts_are_told_apart():
    models = language.train([])
    for lang, texts in SEED_TEXTS.items():
        assert [language.classify(models, [t])[0][0] for t in texts] == [lang] * len(texts)


def test_marks_within_a_long_quotation_end_nothing(segmenter):
    inner = " ".join(f"Kana came to Huye on day {k}." for k in range(120))
    text = f'Beza said: "{inner}" Then we left.'
    assert len(inner) > 1_500 and [text[a:b] for a, b in segmenter.split(text)] == [f'Beza said: "{inner}"', "Then we left."]


def test_short_stretches_without_marks_are_cut(segmenter):
    said = ["老师昨天在图书馆读了故事", "你知道地图在哪里吗"]
    text = "".join(said) + "。下雨了。"
    found = [text[a:b] for a, b in segmenter.split(text)]
    assert "".join(found) == text and found[-1] == "下雨了。" and len(found) in (2, 3)


def test_paragraphs_of_each_script_come_apart_again(spark, data):
    """Recall and precision by script on put-together paragraphs of sentences that took no part in the training."""
    texts = sentences.sample_documents(spark.read.parquet(f"{data}/documents.parquet"))
    held, model = texts[::3], sentences.fit([t for k, t in enumerate(texts) if k % 3])
    whole = sentences.whole_sentences(held)
    rnd = random.Random(9)
    for script, said in sorted(whole.items()):
        if len(said) < 4:
            continue
        made = sentences.Composer(said, rnd)
        right = found = wanted = 0
        for _ in range(150):
            text = made.paragraph(made)
            plain, want, at = text.replace("|", ""), set(), 0
            for part in text.split("|")[:-1]:
                at += len(part)
                want.add(at)
            got = {b for _, b in model.split(plain)}
            right, found, wanted = right + len(got & want), found + len(got), wanted + len(want)
        assert right >= 0.97 * wanted and right >= 0.97 * found, (script, right / wanted, right / found)


def test_fields_learn_from_every_document(spark, monkeypatch):
    """An abbreviation of few documents among more than the former sample held."""
    monkeypatch.setattr(sentences, "AT_LEAST", 1_000)
    text = "case when id = 8 then 'Kana saw zhq. Beza at home.' when id % 1000 = 7 then concat('Kana has zhq. ', id, ' lamps.') else concat('Beza came to Huye on day ', id, '.') end as text"
    docs = spark.range(6_000).selectExpr("id as doc_id", text)
    assert sum("zhq" in t for t in sentences.sample_documents(docs)) < 5
    assert [tuple(r) for r in sentences.sentences(docs).filter("doc_id = 8").collect()] == [(8, 0, 0, 27)]


def test_fields_are_the_same_wherever_they_are_summed(spark, data, monkeypatch):
    for name, value in (("MARKS_STEPS", 3), ("CHARS_STEPS", 2), ("AT_LEAST", 200), ("UNMARKED", 50)):
        monkeypatch.setattr(sentences, name, value)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    here = sentences.fit([r["text"] for r in docs.collect()])
    monkeypatch.setattr(sentences, "HELD", -1)
    for rows in (docs, docs.repartition(5, "doc_id")):
        there = sentences.fit_table(rows)
        assert there.learned == here.learned and there.least == here.least and there.crf.index == here.crf.index
        assert np.allclose(there.crf.w, here.crf.w) and np.allclose(there.crf.t, here.crf.t) and np.allclose(there.chars.w, here.chars.w)


def test_chain_sums_are_those_of_all_tags():
    """Chances, pairs, loss and best tags against every way to tag, for sequences of unlike length."""
    rng, sizes = np.random.default_rng(2), np.array([1, 4, 3, 4, 2])
    d, t = rng.normal(size=sizes.sum()), rng.normal(size=(2, 2))
    p, pairs, z = chain.marginals(d, sizes, t)
    best, at = chain.best(d, sizes, t), 0
    for k, n in enumerate(sizes.tolist()):
        ways = list(itertools.product((0, 1), repeat=n))
        score = np.array([sum(d[at + j] * y for j, y in enumerate(ys)) + sum(t[x, y] for x, y in zip(ys, ys[1:])) for ys in ways])
        each = np.exp(score - np.log(np.exp(score).sum()))
        assert np.isclose(z[k], np.log(np.exp(score).sum())) and np.allclose(p[at : at + n], each @ np.array(ways))
        assert np.isclose(pairs[k, 0, 1], sum(e * sum((x, y) == (0, 1) for x, y in zip(ys, ys[1:])) for e, ys in zip(each, ways)))
        assert tuple(best[at : at + n]) == ways[int(score.argmax())]
        at += n
