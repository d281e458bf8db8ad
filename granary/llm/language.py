"""Problem 2: the language of each document and of each of its stretches, by prediction by partial matching.

Sentences that hold seed words of one language only, from a bounded sample of rows, train one context tree for each
language; every sentence of every text is then scored by the exact code lengths under the frozen trees. Runs of
sentences of one language form a stretch. A quoted or cited piece does not take part in its sentence's score.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.ppm import PpmModels, folded
from granary.llm.sampling import bounded_sample
from granary.llm.seeds import LABELS, NO_LABEL, SEED_TEXTS, SEED_WORDS
from granary.functions.frames import emit
from granary.operators.keyed import first_delivery
from granary.session import enough_tasks

#: Bound of the training sample: texts taken, in the order of a hash of their content, and bytes for each language.
SAMPLE_TEXTS = 4_000
SAMPLE_BYTES = 250_000
#: Confidence from which a sentence trains the second, final trees.
SURE = 0.98

_CITED = re.compile(r"`[^`\n]*`|\"[^\"\n]*\"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|‹[^›\n]*›|<[^<>\n]{1,80}>|(?<![\w*])\*{1,2}[^*\s][^*\n]*\*{1,2}(?![\w*])")
_ADDRESS = re.compile(r"https?://\S+|\b[\w.+-]+@[\w.-]+|\b\w+(?:\.\w+)+/\S*")
_QUOTED1 = re.compile(r"(?<!\w)'[^'\n]{1,60}'(?!\w)|(?<!\w)‘[^’\n]{1,60}’(?!\w)")
_OPENS = re.compile(r"[`\"“„«‹<*]")
_LETTER = re.compile(r"[^\W\d_]")
_SEED = {lang: frozenset(words.split()) for lang, words in SEED_WORDS.items()}
_OWN = {lang: words - frozenset().union(*[w for k, w in _SEED.items() if k != lang]) for lang, words in _SEED.items()}
_WORD = re.compile(r"[^\W\d_]+")
_PIECE = re.compile(r"(?:\n+|(?<=[.!?…。！？])[\"'”’»)\]]*\s+|\s+[-–—•*|·]\s+)")


def uncited(text: str) -> str:
    """The text with every quoted or cited piece replaced by a blank; as it is where nothing else would be left."""
    out = text
    if _OPENS.search(out):
        out = _CITED.sub(" ", out)
    if "/" in out or "@" in out:
        out = _ADDRESS.sub(" ", out)
    if " '" in out or "‘" in out or out[:1] == "'":
        out = _QUOTED1.sub(" ", out)
    return out if out is text or _LETTER.search(out) else text


def cited(text: str) -> list[str]:
    """The quoted or cited pieces of at least three words."""
    return [m[0] for m in _CITED.finditer(text) if m[0].count(" ") > 1] if _OPENS.search(text) else []


def pieces(text: str) -> list[tuple[int, int]]:
    """Offsets of the sentence-like pieces of a message, cut after closing marks, at line breaks and list markers."""
    masked = _CITED.sub(lambda m: "x" * len(m[0]), text) if _OPENS.search(text) else text
    if "/" in masked:
        masked = _ADDRESS.sub(lambda m: "x" * len(m[0]), masked)
    out, start = [], 0
    for m in _PIECE.finditer(masked):
        if _LETTER.search(text, start, m.start()):
            out.append((start, m.start()))
            start = m.end()
    if _LETTER.search(text, start):
        out.append((start, len(text)))
    elif out:
        out[-1] = (out[-1][0], len(text))
    return out


def seed_language(sentence: str) -> str | None:
    """The language whose own seed words the sentence holds, at least two and none of another; else None."""
    words = _WORD.findall(uncited(sentence).casefold())
    hits = {lang: sum(w in own for w in words) for lang, own in _OWN.items()}
    best = max(hits, key=lambda k: hits[k])
    return best if hits[best] >= 2 and sum(hits.values()) == hits[best] else None


def train(texts: list[str], max_bytes: int = SAMPLE_BYTES) -> PpmModels:
    """Context trees from the sentences of the texts that seed words label, and the seed texts themselves."""
    said = list(dict.fromkeys(uncited(t[a:b]) for t in texts if t for a, b in pieces(t)))
    models = _fit([(s, lang) for s in said if (lang := seed_language(s))], max_bytes)
    langs, sure = classify(models, said)
    return _fit([(s, lang) for s, lang, p in zip(said, langs, sure) if p >= SURE], max_bytes)


def _fit(labelled: list[tuple[str, str]], max_bytes: int) -> PpmModels:
    own = {lang: list(SEED_TEXTS[lang]) * 3 for lang in _SEED}
    used = dict.fromkeys(own, 0)
    for said, lang in labelled:
        if used[lang] < max_bytes:
            own[lang].append(said)
            used[lang] += len(said.encode())
    return PpmModels(own)


def sample_texts(table: DataFrame, messages: str = "messages", n: int = SAMPLE_TEXTS) -> list[str]:
    """At most n message texts of a table, by a hash of their content, so that the same table gives the same sample."""
    texts = table.select(F.explode(messages).alias("m")).select(F.col("m.content").alias("t")).filter(F.length("t") > 0)
    return [r[0] for r in bounded_sample(texts, table.count(), n)]


def classify(models: PpmModels, sentences: list[str], prior_bits: float = 0.0) -> tuple[list[str], np.ndarray]:
    """Language and confidence of each sentence: the softmax of the negative code lengths, tempered by length."""
    coded = [folded(uncited(s)) for s in sentences]
    bits = models.bits(coded)
    best = bits.argmin(axis=1) if len(bits) else np.zeros(0, int)
    n = np.array([max(8, len(c)) for c in coded]).reshape(-1, 1)
    scaled = -(bits - bits.min(axis=1, keepdims=True)) / np.sqrt(n)
    p = np.exp2(scaled)
    return [models.langs[k] for k in best], (p / p.sum(axis=1, keepdims=True)).max(axis=1) if len(bits) else np.zeros(0)


def segments(messages: DataFrame, models: PpmModels, keys: list[str], text: str = "content") -> DataFrame:
    """One row per stretch of each text: keys, segment_no (from 0), lang, confidence, start_char, end_char.

    A stretch is a longest run of sentences in one language. Null, empty and letterless texts give no rows. Extra
    columns are left behind. Long texts are scored whole, sentence by sentence.
    """
    from pyspark.sql import types as T

    kept = messages.select(*keys, F.col(text).alias("__text")).filter(F.length("__text") > 0)
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("segment_no", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("start_char", T.LongType()), T.StructField("end_char", T.LongType())])
    held = messages.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        m = held.value
        for batch in batches:
            spans, owner, said = [], [], []
            for n, t in enumerate(batch["__text"]):
                for a, b in pieces(t):
                    spans.append((a, b))
                    owner.append(n)
                    said.append(t[a:b])
            langs, sure = classify(m, said)
            out: list[list] = []
            for n, (a, b), lang, p in zip(owner, spans, langs, sure):
                if out and out[-1][0] == n and out[-1][2] == lang:
                    out[-1][4] = b
                    out[-1][3].append((b - a, p))
                else:
                    out.append([n, out[-1][1] + 1 if out and out[-1][0] == n else 0, lang, [(b - a, p)], b, a])
            rows = batch.iloc[[r[0] for r in out]].drop(columns="__text").reset_index(drop=True)
            yield from emit(rows.assign(
                segment_no=pd.Series([r[1] for r in out], dtype="int64"),
                lang=pd.Series([r[2] for r in out], dtype="object"),
                confidence=pd.Series([sum(w * p for w, p in r[3]) / max(1, sum(w for w, _ in r[3])) for r in out], dtype="float64"),
                start_char=pd.Series([r[5] for r in out], dtype="int64"),
                end_char=pd.Series([r[4] for r in out], dtype="int64"),
            ))

    return kept.mapInPandas(run, schema)


def label_language(c: Column) -> Column:
    """The language a label names: rw, en, fr or sw, null where it names none, other for any other language."""
    said = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", ""))
    out = F.when(said.isin(*NO_LABEL), F.lit(None).cast("string"))
    for lang, names in LABELS.items():
        out = out.when(said.isin(*names), lang)
    return out.otherwise("other")


def user_messages(requests: DataFrame) -> DataFrame:
    """(request_id, language, message_no, content) of every user message; a request received twice counts once."""
    rows = requests.filter(F.col("request_id").isNotNull()).select("request_id", "language", "messages", "received_at")
    once = first_delivery(rows, "request_id", [F.col("received_at").isNull(), F.col("received_at"), F.xxhash64("messages")])
    flat = enough_tasks(once).select("request_id", "language", F.posexplode("messages").alias("message_no", "m"))
    return flat.filter(F.col("m.role") == "user").select("request_id", "language", F.col("message_no").cast("long").alias("message_no"), F.col("m.content").alias("content"))


def request_segments(requests: DataFrame, models: PpmModels | None = None) -> DataFrame:
    """(request_id, language, message_no, segment_no, lang, confidence, start_char, end_char) of every user message."""
    said = user_messages(requests)
    models = models or train(sample_texts(requests))
    return segments(said, models, ["request_id", "language", "message_no"])


def wrong_labels(requests: DataFrame, models: PpmModels | None = None) -> DataFrame:
    """The stretches of every request whose label is missing or names a language that no stretch is written in."""
    found = request_segments(requests, models)
    named = label_language(F.col("language"))
    hit = F.max((F.col("lang") == named).cast("int")).over(Window.partitionBy("request_id"))
    return found.withColumn("hit", hit).filter(F.coalesce("hit", F.lit(0)) == 0).select("request_id", "message_no", "segment_no", "lang")
