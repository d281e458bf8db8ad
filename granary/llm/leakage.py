"""Problem 7: evaluation texts leaking into training text, by a BM25 index of test items with block-max WAND.

The test items are indexed by the five-word shingles of their passages; every window of every training text is a query
against that index. Any repeat of RUN consecutive words with one word altered, dropped or added leaves a known least
number of shingles whole, so the score such a repeat must reach is known for each item: retrieval at that threshold
loses none. What is retrieved is then verified word by word, and the item's question is looked for besides. Items are
taken in blocks of bounded size, so an index that is broadcast never grows with the data; if there are several blocks, one
pass over all texts keeps those that may hold a shingle of any item, by bits of fixed size, and only those meet the blocks.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.frames import emit
from granary.functions.words import words
from granary.session import enough_tasks, written

#: Words in a row that make a leak, one of which may be altered, dropped or added.
RUN = 16
SHINGLE = 5
#: Items and characters in one index, a bound of what is broadcast.
ITEM_BLOCK, BLOCK_CHARS = 20_000, 40_000_000
#: Bits that tell which shingles the items hold.
SHINGLE_BITS = 1 << 26
#: Words of a query window, and the words that neighbouring windows share: never fewer than a repeat is long.
WINDOW, OVERLAP = 512, 64
K1, B = 1.2, 0.75
POSTING_BLOCK = 32

# Letters of other scripts that look like Latin ones, lower case.
_LOOKALIKE = str.maketrans(
    "авеорсхуіјѕһԁԛԝкмнтгпѵԍӏɡαβενορτυχικϲϳɑıℓ",
    "abeopcxyijshdqwkmhtrnvgigabevoptuxikcjail",
)
#: Tags that part words; others stand within a word.
_PARTING = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|img|li|main|nav|ol|option|p|pre|section|select|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^<>]*>", re.I)
_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", re.S)
_LINK = re.compile(r"!?\[([^\[\]]*)\]\([^()\s]*\)")
_INVISIBLE = regex.compile(r"[\p{Cf}͏ᅟᅠ឴឵ㅤ]+")
_RUNS = regex.compile(r"[\p{L}\p{N}]+")


def seen_words(text: str | None) -> list[str]:
    """The words a reader sees: without markup, invisible characters, case and accents, look-alike letters as Latin."""
    if not text:
        return []
    if "<" in text or "&" in text:
        text = html.unescape(_TAG.sub("", _PARTING.sub(" ", text)))
    if "](" in text:
        text = _LINK.sub(r"\1", text)
    if text.isascii():
        return words(text)
    text = unicodedata.normalize("NFKD", _INVISIBLE.sub("", text)).casefold()
    text = "".join(c for c in text if not unicodedata.combining(c)).translate(_LOOKALIKE)
    return _RUNS.findall(text)


def passage(text: str | None) -> str:
    """The passage of an item of three lines, instruction, passage and question; a text of other form as a whole."""
    lines = [x for x in (text or "").split("\n") if x.strip()]
    return "\n".join(lines[1:-1]) if len(lines) >= 3 else (text or "")


def question(text: str | None) -> str:
    """The question of an item of three lines; empty where it has another form."""
    lines = [x for x in (text or "").split("\n") if x.strip()]
    return lines[-1] if len(lines) >= 3 else ""


class ItemIndex:
    """BM25 postings of five-word shingles, in blocks with their largest weight."""

    def __init__(self, items: list[tuple[str, str]]):
        self.ids = [i for i, _ in items]
        self.words = [seen_words(passage(t)) for _, t in items]
        self.questions = [seen_words(question(t)) for _, t in items]
        shingles = [[" ".join(w[k : k + SHINGLE]) for k in range(len(w) - SHINGLE + 1)] for w in self.words]
        mean = sum(map(len, shingles)) / max(1, len(shingles)) or 1.0
        df = Counter(s for x in shingles for s in set(x))
        n = len(items)
        self.places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        self.least = [math.inf] * n
        for at, x in enumerate(shingles):
            tf = Counter(x)
            weight = {}
            for s, f in tf.items():
                idf = math.log(1 + (n - df[s] + 0.5) / (df[s] + 0.5))
                weight[s] = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * len(x) / mean))
                postings[s].append((at, weight[s]))
            for k, s in enumerate(x):
                self.places[s].append((at, k))
            self.least[at] = self._least(x, weight)
        self.postings = {s: [p[k : k + POSTING_BLOCK] for k in range(0, len(p), POSTING_BLOCK)] for s, p in postings.items()}
        self.tops = {s: [max(w for _, w in b) for b in blocks] for s, blocks in self.postings.items()}
        self.threshold = min(self.least, default=math.inf)

    def _least(self, shingles: list[str], weight: dict[str, float]) -> float:
        """The least score that a repeat of RUN words with one edit can have; endless where a passage is too short."""
        whole = RUN - SHINGLE + 1
        if len(shingles) < whole:
            return math.inf
        best = math.inf
        for k in range(len(shingles) - whole + 1):
            part = shingles[k : k + whole]
            for e in range(RUN):
                left = {s for j, s in enumerate(part) if not j <= e <= j + SHINGLE - 1}
                best = min(best, sum(weight[s] for s in left))
        return best - 1e-9

    def search(self, terms: list[str]) -> list[int]:
        """Items whose score for the query reaches what they need, by block-max WAND over the terms' postings."""
        lists = [(self.postings[t], self.tops[t]) for t in terms]
        cur = [[0, 0] for _ in lists]
        found = []
        live = list(range(len(lists)))
        upper = [max(t) for _, t in lists]
        while live:
            live = [k for k in live if cur[k][0] < len(lists[k][0])]
            live.sort(key=lambda k: lists[k][0][cur[k][0]][cur[k][1]][0])
            total, pivot = 0.0, None
            for n, k in enumerate(live):
                total += upper[k]
                if total >= self.threshold:
                    pivot = n
                    break
            if pivot is None:
                break
            item = lists[live[pivot]][0][cur[live[pivot]][0]][cur[live[pivot]][1]][0]
            while pivot + 1 < len(live) and self._at(lists[live[pivot + 1]], cur[live[pivot + 1]]) == item:
                pivot += 1
            bound = sum(self._block_top(lists[k], cur[k], item) for k in live[: pivot + 1])
            if bound >= self.threshold and self._at(lists[live[0]], cur[live[0]]) == item:
                score = 0.0
                for k in live[: pivot + 1]:
                    score += lists[k][0][cur[k][0]][cur[k][1]][1]
                if score >= self.least[item]:
                    found.append(item)
                target = item + 1
            elif bound >= self.threshold:
                target = item
            else:
                target = item + 1
            for k in live[: pivot + 1]:
                self._advance(lists[k], cur[k], target)
        return found

    @staticmethod
    def _at(entry, c) -> int:
        return entry[0][c[0]][c[1]][0]

    @staticmethod
    def _block_top(entry, c, item: int) -> float:
        blocks, tops = entry
        b = c[0]
        while b < len(blocks) and blocks[b][-1][0] < item:
            b += 1
        return tops[b] if b < len(blocks) else 0.0

    @staticmethod
    def _advance(entry, c, target: int) -> None:
        blocks = entry[0]
        while c[0] < len(blocks) and blocks[c[0]][-1][0] < target:
            c[0] += 1
            c[1] = 0
        while c[0] < len(blocks) and blocks[c[0]][c[1]][0] < target:
            c[1] += 1

    def leaks(self, text: str | None) -> list[tuple[int, int, float]]:
        """(item, words in a row, share of the question) of every item that a text gives away."""
        ws = seen_words(text)
        if len(ws) < RUN - 1:
            return []
        terms = [" ".join(ws[k : k + SHINGLE]) for k in range(len(ws) - SHINGLE + 1)]
        hits = [k for k, s in enumerate(terms) if s in self.postings]
        if not hits:
            return []
        wanted: set[int] = set()
        for start in range(0, max(1, len(ws) - OVERLAP), WINDOW - OVERLAP):
            query = list(dict.fromkeys(terms[k] for k in hits if start <= k <= start + WINDOW - SHINGLE))
            if query:
                wanted.update(self.search(query))
        out = []
        for item in sorted(wanted):
            if (n := self.longest(ws, terms, hits, item)) >= RUN:
                out.append((item, n, self.question_share(ws, item)))
        return out

    def question_share(self, ws: list[str], item: int) -> float:
        """The share of the question's words that stand in three words in a row, or all of a shorter one, which the text has too."""
        q = self.questions[item]
        if not q:
            return 0.0
        k = min(3, len(q))
        held = {tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)}
        there: set[int] = set()
        for j in range(len(q) - k + 1):
            if tuple(q[j : j + k]) in held:
                there.update(range(j, j + k))
        return len(there) / len(q)

    def longest(self, ws: list[str], terms: list[str], hits: list[int], item: int) -> int:
        """Most words of the passage in a row that the text repeats with at most one word altered, dropped or added."""
        p, best = self.words[item], 0
        done: set[tuple[int, int]] = set()
        for d in hits:
            for at, k in self.places[terms[d]]:
                if at != item:
                    continue
                a, b = d, k
                while a and b and ws[a - 1] == p[b - 1]:
                    a -= 1
                    b -= 1
                if (a, b) in done:
                    continue
                done.add((a, b))
                x, y = a, b
                while x < len(ws) and y < len(p) and ws[x] == p[y]:
                    x += 1
                    y += 1
                run = y - b
                best = max(best, run)
                # over one edit to the right, then to the left; the passage's words covered, an added word not counted
                for dx, dy in ((1, 1), (0, 1), (1, 0)):
                    u, v = x + dx, y + dy
                    while u < len(ws) and v < len(p) and ws[u] == p[v]:
                        u += 1
                        v += 1
                    if v > y + dy:
                        best = max(best, v - b)
                    u, v = a - dx, b - dy
                    while u > 0 and v > 0 and ws[u - 1] == p[v - 1]:
                        u -= 1
                        v -= 1
                    if 0 <= v < b - dy:
                        best = max(best, y - v)
        return best


def _shingle_places(ws: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(" ".join(ws[k : k + SHINGLE])) % SHINGLE_BITS for k in range(len(ws) - SHINGLE + 1)), np.int64, max(0, len(ws) - SHINGLE + 1))


def item_bits(items: DataFrame) -> np.ndarray:
    """A bit for the hash of each shingle of the items (i, t): SHINGLE_BITS bits, however many items there are."""

    def run(batches):
        for b in batches:
            bits = np.zeros(SHINGLE_BITS >> 6, np.uint64)
            for t in b["t"]:
                at = _shingle_places(seen_words(passage(t)))
                np.bitwise_or.at(bits, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
            word = np.flatnonzero(bits)
            yield from emit(pd.DataFrame({"word": word, "bits": bits[word].view(np.int64)}))

    found = items.mapInPandas(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(SHINGLE_BITS >> 6, np.uint64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return bits


def may_leak(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """The rows (key, text) that may hold a shingle of some item; never loses one that does."""
    held = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        bits = held.value
        for b in batches:
            keep = []
            for t in b["text"]:
                at = _shingle_places(seen_words(t))
                keep.append(bool((bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).any()))
            yield from emit(b[np.array(keep, bool)])

    return rows.mapInPandas(run, rows.schema)


def leaked_items(documents: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """(doc_id, item_id, words, question_share) of every document that repeats RUN words of an item's passage, one edit allowed.

    question_share is the share of the item's question that the document holds besides. Null and empty texts and items give
    nothing, items with fewer than RUN words of passage cannot leak, items with equal passages are each reported; repeated
    document rows give one row; texts are read whole, where they lie.
    """
    spark = documents.sparkSession
    kind = items.schema[item_key].dataType.simpleString()
    dkind = documents.schema[key].dataType.simpleString()
    rows = enough_tasks(documents.select(key, "text").filter(F.length("text") > 0))
    named = items.filter(F.col(item_key).isNotNull() & (F.length("text") > 0)).select(F.col(item_key).alias("i"), F.col("text").alias("t")).distinct()
    size = named.agg(F.count("*"), F.coalesce(F.sum(F.length("t")), F.lit(0))).head()
    blocks = max(1, -(-size[0] // ITEM_BLOCK), -(-size[1] // BLOCK_CHARS))
    if blocks > 1:
        named = written(named.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(blocks))))
        rows = written(may_leak(rows, item_bits(named.select("i", "t"))))
    out = None
    for n in range(blocks):
        taken = [(r[0], r[1]) for r in (named.filter(F.col("b") == n) if blocks > 1 else named).select("i", "t").collect()]
        held = spark.sparkContext.broadcast(ItemIndex(sorted(taken)))

        def run(batches, held=held):
            index = held.value
            for b in batches:
                found = [(d, index.ids[i], n, q) for d, t in zip(b[key], b["text"]) for i, n, q in index.leaks(t)]
                yield from emit(pd.DataFrame({key: pd.Series([f[0] for f in found], dtype=b[key].dtype), item_key: [f[1] for f in found], "words": pd.Series([f[2] for f in found], dtype="int64"), "question_share": pd.Series([f[3] for f in found], dtype="float64")}))

        part = rows.mapInPandas(run, f"{key} {dkind}, {item_key} {kind}, words long, question_share double")
        # a block's rows are written before the next index is made, so that one index at a time is held
        part = written(part) if blocks > 1 else part
        out = part if out is None else out.unionByName(part)
        if blocks > 1:
            held.destroy()
    return out.groupBy(key, item_key).agg(F.max("words").alias("words"), F.max("question_share").alias("question_share"))
