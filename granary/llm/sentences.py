"""Problem 8: sentence boundaries across languages and scripts, by a linear-chain model decoded with Viterbi.

Blank lines, list markers and speaker labels are certain boundaries and cut a text into blocks. In a block, the
characters after which a sentence may end, those within quotations and brackets too, are tagged boundary or inside by a
linear-chain field over what stands around them: the mark, the token before, the case of what follows, the spacing, the
script, and the quotations and brackets that are open. The field is trained on paragraphs whose boundaries are certain
because they are put together from whole sentences: every block of the table that holds one sentence, and the texts
below, in which bars stand for boundaries. Stretches of scripts without case that hold no mark are tagged character by
character by a second field, trained on all sentences of the table in such scripts, stripped of their marks; it cuts
where that scores better than leaving the stretch whole by more than it does on whole sentences.

Nothing is learned from a sample: the tasks count, put together and score what they read, only sums reach the driver, and
each script weighs alike however many sentences it has.
"""

from __future__ import annotations

import random
import re
import unicodedata
import zlib
from ast import literal_eval
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b
from itertools import batched

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.frames import emit
from granary.llm import chain
from granary.llm.crf import Crf
from granary.llm.sampling import bounded_sample
from granary.session import enough_tasks, written

#: Bound of sample_documents, by which texts are taken for trials on one machine; no query learns from it.
SAMPLE_DOCS = 1_500
#: Whole sentences of a script that are put together at least, those of a small table several times; and the same for the field of characters.
AT_LEAST, UNMARKED = 6_000, 300
#: What all scripts together weigh in training, each the same, and the part of that which the texts below have.
WEIGHT, SEED_SHARE = 5_000.0, 0.05
#: Weights of the field of characters: what stands around a character is told by a hash of so many bits.
SLOT_BITS = 20
#: Strength of the pull to zero of each field, what the scripts' characters weigh together, and the most steps of training.
MARKS_L2, CHARS_L2, CHARS_WEIGHT, MARKS_STEPS, CHARS_STEPS = 0.1, 0.2, 300.0, 60, 25
#: Bytes of training sequences up to which the driver sums over them, in place of tasks.
HELD = 1 << 21
#: Share of the whole sentences that the field of characters may cut, and the steps in which its margin is told.
CUT_WHOLE, MARGIN = 0.0005, 1 / 1024

# Abbreviations by what may follow them, without their last dot, in lower case.
TITLES = frozenset("mr mrs ms dr prof bw bi dkt m mm mme mlle mgr me sr st ste hon rev gen col capt lt sgt pst mwl mh jr".split())
NUMBERED = frozenset("no nos vol fig figs pp p pg rup uk ch chap v vs art sec sect s n nr num nº eq tab para vers".split())
INNER = frozenset("e.g i.e cf c.-à-d k.m esp pl urug ex ed eds al viz approx ca c.a.d p.ex par ex env av ex. t.d n.b nb incl excl dept est sing cng y.i mf".split())
CLOSING = frozenset("etc n.k nk n.k.w a.m p.m u.s u.k k.k s.l.p e.t.c".split())
_OPEN = {"“": "”", "«": "»", "„": "”", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》", "‹": "›", "‘": "’"}
_BRACKETS = "(（[【"
_ANY_SPAN = re.compile(r"[“«„「『(（\[【《‹‘\"`”»」』)）\]】》›’]")
_ANY_OPEN = re.compile(r"[“«„「『(（\[【《‹‘\"`]")
_CLOSERS = "\"”»」』)）]】》’'`*_›"
_STOPS = ".!?…。！？।॥።؟۔፧｡‼⁇⁈⁉"
_MARKS = re.compile(r"(?:[.!?…。！？।॥።؟۔፧｡‼⁇⁈⁉]|፡፡)(?:[.!?…。！？।॥።؟۔፧｡‼⁇⁈⁉]|፡፡|[   ](?=[!?]))*")
_LIST = re.compile(r"[ \t 　]*(?:[-–—*•·‣▪◦]|\(?\d{1,4}\s?[.)）、]|\(?[a-z]\))(?:[ \t 　]+|$)(?=\S|$)")
_LABEL = re.compile(r"[ \t 　]*([^\W\d_][\w'’.\-]{0,40}(?:[  ][^\W\d_a-z][\w'’.\-]{0,40})?)[ \t ]*[:：](?=[ \t ]|[^\W\d]|[\"“«「])")
_DASHED = re.compile(r"[ \t 　]*([^\W\d_a-z][\w'’.\-]{1,40})[ \t ]+[-–—][ \t ]+(?=\S)")
_LINE = re.compile(r"[^\n\r  \u0085]*")
_BREAK = re.compile(r"\r\n|[\n\r  \u0085\x0b\x0c]")


def _has_case(c: str) -> bool:
    return c.lower() != c.upper()


def blocks(text: str) -> list[tuple[int, int]]:
    """Offsets of the pieces between certain boundaries: blank lines, and breaks before list markers and labels."""
    lines, at = [], 0
    for m in _BREAK.finditer(text):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, len(text)))
    dashed = Counter(m[1] for a, b in lines if (m := _DASHED.match(text, a, b)))
    out: list[list[int]] = []
    fresh = True
    for a, b in lines:
        if not text[a:b].strip():
            fresh = True
            continue
        if not fresh:
            if _LIST.match(text, a, b):
                fresh = not (re.search(r"(?:^|\s)(?:no|ch|fig|p|pp|vol|rup|uk|v)\.\s*$", text[out[-1][0] : out[-1][1]], re.I) and text[a : a + 4].lstrip()[:1].isdigit())
            elif m := _LABEL.match(text, a, b):
                fresh = (m[1][:1].isupper() or not _has_case(m[1][0])) and len(m[1]) <= 40
            elif m := _DASHED.match(text, a, b):
                fresh = sum(dashed.values()) >= 2 and (dashed[m[1]] >= 2 or len(dashed) >= 2)
        if fresh:
            out.append([a, b])
        else:
            out[-1][1] = b
        fresh = False
    return [(a, b) for a, b in out]


def _body(text: str, a: int, b: int) -> tuple[int, bool]:
    """Where the words of a block start, after its list marker or label; and whether it is a list line."""
    if m := _LIST.match(text, a, b):
        if m.end() < b:
            return m.end(), True
    if m := _LABEL.match(text, a, b):
        return m.end(), False
    if (m := _DASHED.match(text, a, b)) and m[1][:1].isupper():
        return m.end(), False
    return a, False


def _spans(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Offsets of the quotations, brackets and code pieces of a block that are opened and closed in it, in order."""
    if not _ANY_OPEN.search(text, a, b):
        return []
    out, stack = [], []
    straight: dict[str, int] = {}
    for m in _ANY_SPAN.finditer(text, a, b):
        k, c = m.start(), m[0]
        if c in _OPEN and not (c == "‘" and k > a and text[k - 1].isalnum()):
            stack.append((_OPEN[c], k))
        elif c in "\"`":
            if c in straight:
                out.append((straight.pop(c), k))
            else:
                straight[c] = k
        else:
            for n in range(len(stack) - 1, -1, -1):
                if stack[n][0] == c:
                    if c == "’" and k + 1 < b and text[k + 1].isalnum():
                        break
                    out.append((stack[n][1], k))
                    del stack[n:]
                    break
    return sorted(out)


def candidates(text: str, a: int, b: int, learned: frozenset = frozenset()) -> list[tuple[int, tuple]]:
    """Places of text[a:b] after which a sentence may end, each with what stands around it."""
    start, is_list = _body(text, a, b)
    spans = _spans(text, a, b)
    closes = {y: x for x, y in spans}
    opens = {x for x, _ in spans}
    out: list[tuple[int, tuple]] = []
    for m in _MARKS.finditer(text, start, b):
        p, q = m.span()
        marks = m[0].strip(" \u00a0\u202f")
        end, opened = q, None
        while end < b:
            c = text[end]
            if c in _CLOSERS:
                own = closes.get(end)
                if own is not None and own < p:
                    opened = own if opened is None else min(own, opened)
                elif c in "\"`" and own is None or c in "'’" and end + 1 < b and text[end + 1].isalnum() or end in opens:
                    break
            elif not (c in " \u00a0\u202f" and end + 1 < b and text[end + 1] == "»"):
                break
            end += 1
        inside = next((x for x, y in spans if x < p and y >= end), None) if spans else None
        nxt = end
        while nxt < b and text[nxt].isspace():
            nxt += 1
        if nxt >= b:
            continue
        gap = "none" if nxt == end else "break" if _BREAK.search(text, end, nxt) else "space"
        lead = nxt
        while lead < b and not text[lead].isalnum() and not text[lead].isspace():
            lead += 1
        c = text[lead] if lead < b and text[lead].isalnum() else text[nxt]
        follow = "digit" if c.isdigit() else "upper" if c.isupper() or c.istitle() else "lower" if c.islower() else "caseless" if c.isalpha() else "mark"
        t = p
        while t > start and not text[t - 1].isspace():
            t -= 1
        token = text[t:p].lstrip("\"“«「『(（[`*_‘„—–-")
        if "." in token:  # without a blank after the sentence before, its last word is none of this token
            head, _, tail = token.rpartition(".")
            token = tail if len(head) > 2 and tail[:1].isupper() and tail[1:2].islower() else token
        last = token[-1:] if token[-1:].isalpha() else next((x for x in reversed(text[start:p]) if x.isalpha()), "")
        script = "cased" if not last or _has_case(last) else _script(last)
        dots = len(marks) > 1 and set(marks) <= {".", "…"} or "…" in marks
        mark = "dots" if dots else marks[-1:] if marks[-1:] in ".!?" else "stop" if marks[-1:] in "。।॥۔።፧｡" or marks[-1:] == "፡" else "ask"
        if inside is not None:
            case = "inside:bracket" if text[inside] in _BRACKETS else "inside:quote"
        elif opened is not None:
            k = opened
            while k > start and text[k - 1].isspace():
                k -= 1
            before = text[k - 1] if k > start else ""
            place = "start" if not before or before in _STOPS or before in _CLOSERS and k - 2 > start and text[k - 2] in _STOPS else "intro" if before in ":：,，、" else "mid"
            case = ("bracket:" if text[opened] in _BRACKETS else "quote:") + place
        else:
            case = "open"
        open_next = lead > nxt and any(x in _STARTS for x in text[nxt:lead])
        key = (mark, len(marks) > 1, gap, follow, open_next, _kind(unicodedata.normalize("NFKC", token).casefold(), token, learned) if mark == "." else "any", script, case, len(token) > 2 and token[-1:].isalpha() and not token[-1:].isupper())
        out.append((end, key))
    if is_list:
        line_end = _BREAK.search(text, a, b)
        stop = line_end.start() if line_end else b
        out = [c for c in out if c[0] >= stop]
    return out


_STARTS = "\"“«「『(（`‘„"
_SCRIPTS: dict[str, str] = {}


def _script(c: str) -> str:
    if c not in _SCRIPTS:
        _SCRIPTS[c] = unicodedata.name(c, "OTHER").split()[0]
    return _SCRIPTS[c]


def named(key: tuple) -> list[str]:
    """The features of a place, by name: each thing about it, and those that bear on each other together."""
    mark, many, gap, follow, opens, kind, script, case, word = key
    return [
        "bias", f"mark:{mark}:{many}", f"gap:{gap}", f"follow:{follow}:{opens}", f"kind:{kind}", f"script:{script}", f"case:{case}", f"mark+follow:{mark}:{follow}:{script}", f"kind+follow:{kind}:{follow}",
        f"case+follow:{case}:{follow}", f"case+mark:{case}:{mark}", f"case+mark+follow:{case}:{mark}:{follow}:{script}", f"mark+kind:{mark}:{kind}:{script}", f"gap+follow:{gap}:{follow}:{kind}:{word}", f"mark+gap:{mark}:{gap}:{script}", f"mark+kind+follow:{mark}:{kind}:{follow}:{gap}",
    ]


def _kind(low: str, token: str, learned: frozenset) -> str:
    if low in CLOSING:
        return "closing"
    if low in TITLES:
        return "title"
    if low in NUMBERED:
        return "numbered"
    if low in INNER or low in learned:
        return "inner"
    if len(token) == 1 and token.isalpha():
        return "initial"
    if "." in low.strip(".") and all(len(x) <= 2 for x in low.split(".")) and not any(x.isdigit() for x in low):
        return "dotted"
    if "/" in low or "@" in low or re.search(r"\w\.\w", low) and not low.replace(".", "").replace(",", "").isdigit():
        return "address"
    if low[-1:].isdigit():
        return "number"
    return "plain" if token else "none"


class Segmenter:
    """The trained fields; split gives the sentences of a text as offsets."""

    def __init__(self, crf: Crf, learned: frozenset, chars: CharField | None, least: float):
        self.crf, self.learned, self.chars, self.least = crf, learned, chars, least
        self.known: dict[tuple, list[int]] = {}

    def numbers(self, key: tuple) -> list[int]:
        """The numbers of the features of a place; looked up once for each different one."""
        ids = self.known.get(key)
        if ids is None:
            ids = self.known[key] = [self.crf.index[f] for f in named(key) if f in self.crf.index]
        return ids

    def split(self, text: str | None) -> list[tuple[int, int]]:
        return self.split_all([text])[0]

    def split_all(self, texts: list[str | None]) -> list[list[tuple[int, int]]]:
        """The sentences of each text; the places of all texts are scored together."""
        where, cuts = [], []
        for k, text in enumerate(texts):
            for a, b in blocks(text) if text else ():
                where.append((k, a, b))
                cuts.append(candidates(text, a, b, self.learned))
        tags = self.crf.tag_ids([self.numbers(key) for cut in cuts for _, key in cut], [len(cut) for cut in cuts])
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        marked = []
        for cut, tag in zip(cuts, tags):
            marked.append([e for (e, _), x in zip(cut, tag) if x == "end"])
        if self.chars is not None:
            self._with_unmarked(texts, where, marked)
        for (k, a, b), ends in zip(where, marked):
            text, at = texts[k], a
            for e in [*ends, b]:
                x, y = at, e
                while x < y and text[x].isspace():
                    x += 1
                while y > x and text[y - 1].isspace():
                    y -= 1
                if x < y:
                    out[k].append((x, y))
                at = e
        return out

    def _with_unmarked(self, texts: list[str | None], where: list[tuple[int, int, int]], marked: list[list[int]]) -> None:
        """Adds the ends in stretches without an end, where a script has no case; all stretches are scored together."""
        found = []
        for n, (k, a, b) in enumerate(where):
            if not _CASELESS.search(texts[k], a, b):
                continue
            start, _ = _body(texts[k], a, b)
            for x, y in zip([start, *marked[n]], [*marked[n], b]):
                if x < y and _CASELESS.search(texts[k], x, y):
                    at, said = _stripped(texts[k][x:y])
                    if _mostly_caseless(said):
                        found.append((n, x, texts[k][x:y], at, said))
        for (n, x, stretch, at, _), (cuts, gain) in zip(found, self.chars.cuts_all([f[-1] for f in found])):
            if gain > self.least:
                # between letters alone: a mark that is no sentence's end stands for no cut either
                more = [x + at[k] for k in cuts if all(c.isalnum() or c.isspace() for c in stretch[max(0, at[k] - 2) : at[k] + 2])]
                marked[n] = sorted({*marked[n], *more})


def _stripped(stretch: str) -> tuple[list[int], str]:
    """A stretch without its marks, and where its characters stand."""
    at = [k for k, c in enumerate(stretch) if c.isalnum() or c.isspace()]
    return at, "".join(stretch[k] for k in at).rstrip()


def _caseless(c: str) -> bool:
    return c > "\u0590" and c.isalpha() and not _has_case(c)


def _mostly_caseless(said: str) -> bool:
    return sum(map(_caseless, said)) >= 0.8 * sum(map(str.isalpha, said))


class CharField:
    """The field of characters: tags in and end over stripped text, from the characters around each place."""

    def __init__(self, w: np.ndarray, t: np.ndarray):
        self.w, self.t = w, t

    @staticmethod
    def keys(c: np.ndarray) -> np.ndarray:
        """For each code point numbers that tell those before and after it."""
        c = np.concatenate([np.zeros(3, np.uint64), c, np.zeros(3, np.uint64)]).astype(np.uint64)
        p = [c[3 + k : len(c) - 3 + k] * np.uint64(2 * k + 0x9E3779B97F4A7C1D) for k in (-2, -1, 0, 1, 2, 3)]
        p = [x ^ (x >> np.uint64(29)) for x in p]
        parts = ((2,), (3,), (2, 3), (1, 2), (0, 1, 2), (3, 4), (3, 4, 5), (1, 2, 3))
        out = [sum(p[k] for k in ks) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(n) for n, ks in enumerate(parts)]
        return np.stack([*out, np.full(len(c) - 6, 1, np.uint64)], 1)

    @classmethod
    def slots(cls, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts as code points, with bars after their ends: the numbers of the weights of each character, a row each; which end; and lengths."""
        # three zeros between: as far as is read beyond a character
        c = np.frombuffer((b"\0" * 12).join(texts), np.uint32)
        bar = c == ord("|")
        tags, of = np.append(bar[1:], False)[~bar], np.repeat(np.arange(len(texts)), [len(x) // 4 + 3 for x in texts])[: len(c)][~bar]
        c = c[~bar]
        own = c != 0
        slots = (cls.keys(c)[own] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)
        return slots.astype(np.int64), tags[own].astype(np.int64), np.bincount(of[own], minlength=len(texts))

    def cuts_all(self, texts: list[str]) -> list[tuple[list[int], float]]:
        """Where each text is best cut, and what each cut adds to the score of the whole on average."""
        out: list[tuple[list[int], float]] = []
        for part in batched(texts, 2_000):
            sizes = np.array([len(x) for x in part])
            if not sizes.sum():
                out += [([], 0.0)] * len(part)
                continue
            d = self.w[self.slots([x.encode("utf-32-le") for x in part])[0]].sum(axis=1, dtype=np.float64)
            tags = chain.best(d, sizes, self.t)
            t = self.t
            for a, n in zip(np.cumsum(sizes) - sizes, sizes):
                cuts = (np.flatnonzero(tags[a : a + n - 1]) + 1).tolist() if n > 1 else []
                gain = 0.0
                if cuts:
                    p = tags[a : a + n].copy()
                    p[-1] = 1
                    whole = (n - 2) * t[0, 0] + t[0, 1]
                    gain = float((d[a : a + n - 1] * p[:-1]).sum() + t[p[:-1], p[1:]].sum() - whole) / len(cuts)
                out.append((cuts, gain))
        return out


# Texts of several scripts and layouts with a bar at each boundary, so that a small sample lacks none of them.
SEED_TEXTS = (
    "Mrs. Reed met Dr. Hale at No. 9 today.| They spoke, e.g. about books, until 9 p.m. on Friday.| \"Is it late?\" asked Reed.| She said, \"Wait here. I will come.\"| Then he left.| (It was cold.)| Wait... the door is open...| Nobody came!| Why not?| The U.N. office is closed.",
    "M. Petit a vu Mme Roy au no. 3 de la rue.| « Où vas-tu ? » demanda Roy.| Il dit : « Restez ici. Je viens. »| Voir p. 8, fig. 2, etc.| Ensuite, il partit.| Attendez... la porte est ouverte.",
    "Bw. Kato na Dkt. Amani walikutana.| \"Uko wapi?\" aliuliza Kato.| Tazama uk. 3, k.m. mchoro.| Walinunua chai, sukari, n.k.| Kisha waliondoka!| Subiri... mlango uko wazi.",
    "Prof. Keza na Bw. Mugabo baganiriye.| \"Uri he?\" ni ko Keza yabajije.| Reba urug. ku rup. 5.| Baguze icyayi, isukari, n.k.| Hanyuma barataha.| Keza ati: \"Ngwino. Ndagutegereje.\"| Umwana arasinzira.",
    "今天下雨了。|他没有来！|“你去哪里？”王明问道。|李红说：“请坐。我们开始吧。”|门开了……他还在等。|这本书很好（见第9页。）|价格是2.5元。|你喜欢吗？|我们走了。",
    "今日は雨です。|彼は来ません。|「どこへ行きますか？」と田中が聞いた。|「座ってください。始めます。」と先生が言った。|本は机の上にあります！|これは何ですか？|値段は2.5円です。",
    "आज बारिश है।| वह नहीं आया।| “तुम कहाँ हो?” राम ने पूछा।| डॉ. शर्मा घर गए।| रुको... दरवाज़ा खुला है।| वज़न 2.5 कि.ग्रा. है॥| क्या हुआ?| हम चले गए।",
    "اليوم بارد.| لم يأت أحد.| هل جاء الرجل؟| قال سعيد: «اجلس هنا. سنبدأ الآن.»| ذهب د. سمير إلى البيت.| انتظر... الباب مفتوح.| الوزن 2.5 كغ.| ما هذا؟| خرج الناس!",
    "ዛሬ ዝናብ ነው።| እሱ አልመጣም፡፡| አበበ “የት ነህ?” ብሎ ጠየቀ።| ዶ/ር ከበደ ሄደ።| ዋጋው 2.5 ብር ነው።| ይህ ምንድን ነው?| ሰዎቹ ሄዱ።",
)
_CASELESS = re.compile(r"[\u0590-\u08ff\u0900-\u0dff\u0e00-\u0fff\u1200-\u137f\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]{2}")


def _ways(ends: Counter) -> tuple[str, str]:
    """What stands between a script's sentences and which mark mostly ends them, by how many have which last mark and a blank."""
    spaced = sum(n for (_, blank), n in ends.items() if blank)
    stops = Counter()
    for (mark, _), n in ends.items():
        stops[mark] += n * (mark not in "!?！？؟")
    stop = max(sorted(stops), key=stops.get) if stops.total() else "."
    return " " if spaced > 0.5 * ends.total() else "", stop


class Composer:
    """Paragraphs with a bar at each boundary, put together from the whole sentences of one script.

    How the script is written is told by the given sentences, unless the ways of all are known. Each of the sentences of a
    queue is taken once, before others are drawn.
    """

    def __init__(self, said: list[str], rnd: random.Random, ways: tuple[str, str] | None = None, rounds: int = 0):
        self.said, self.rnd = said, rnd
        self.queue = said * rounds
        rnd.shuffle(self.queue)
        self.space, self.stop = ways or _ways(Counter((x[-1], " " in x) for x in said))
        letter = next((c for x in said for c in x if c.isalpha()), "a")
        self.cased = _has_case(letter)
        wide = self.stop in "。｡"
        self.ask, self.shout = ("？", "！") if wide else ("؟", "!") if _script(letter) == "ARABIC" else ("?", "!")
        self.quotes = ["“”", "「」", "『』"] if wide else ["\"\"", "“”", "«»"]
        self.brackets = "（）" if wide else "()"
        self.names = [w for x in said[:500] for w in x.split()[1:] if w[:1].isupper() and w.isalpha()] or ["Keza"]

    def body(self) -> str:
        x = self.queue.pop() if self.queue else self.rnd.choice(self.said)
        return x.rstrip(_STOPS + " ")

    def lower(self, x: str) -> str:
        return x[:1].lower() + x[1:]

    def mark(self) -> str:
        return self.rnd.choice([self.stop] * 5 + [self.ask, self.shout, self.ask, self.ask + self.shout, self.shout * 2])

    def dots(self) -> str:
        return self.rnd.choice(["...", "…", "…", "....", "……"])

    def halves(self) -> tuple[str, str]:
        """A sentence in two, cut between words."""
        x = self.body()
        if not self.space:
            k = max(1, len(x) // 2)
            return x[:k], x[k:]
        ws = x.split(" ")
        k = self.rnd.randrange(1, len(ws)) if len(ws) > 1 else 1
        return " ".join(ws[:k]), " ".join(ws[k:]) or self.lower(self.body())

    def quoted(self, x: str) -> str:
        a, b = self.rnd.choice(self.quotes)
        pad = " " if a == "«" and self.cased and self.rnd.random() < 0.5 else ""
        return a + pad + x + pad + b

    def sentences_of(self) -> str:
        """One to three whole sentences without bars."""
        return self.space.join(self.body() + self.mark() for _ in range(self.rnd.randint(1, 3)))

    def unit(self) -> str:
        """One or more units of one kind, with bars."""
        r, s, kind = self.rnd, self.space, self.rnd.randrange(20)
        a, b = self.halves()
        if kind < 5:
            return self.body() + self.mark() + "|"
        if kind == 5:
            rest = self.lower(self.body()) if self.cased else self.body()
            return self.body() + self.dots() + s + rest + self.mark() + "|"
        if kind == 6 and self.cased:
            return self.body() + self.dots() + "|" + s + self.body() + self.mark() + "|"
        if kind == 7:
            if r.random() < 0.3:
                return f"{a}{s}{r.randrange(1, 200)}{self.mark()}|"
            number = f"{r.randrange(90)}{r.choice(['.', '.', ',', ':'])}{r.randrange(10, 99)}"
            return f"{a}{s}{number}{s}{b}{self.mark()}|"
        if kind == 8:
            said = self.body() + r.choice([":", ",", ":"] if s else ["：", "，"]) + s + self.quoted(self.sentences_of())
            return said + s + self.lower(self.body()) + self.mark() + "|" if self.cased and r.random() < 0.4 else said + "|"
        if kind == 9:
            rest = r.choice(["", r.choice(self.names) + " "]) * self.cased + (self.lower(self.body()) if self.cased else self.body())
            if self.cased and rest[:1].isupper():
                return self.quoted(self.body() + r.choice([self.ask, self.shout])) + s + rest + self.mark() + "|"
            return self.quoted(self.body() + r.choice([self.ask, self.shout, "," if self.cased else self.stop])) + s + rest + self.mark() + "|"
        if kind == 10 and self.cased:
            return self.quoted(self.body() + self.stop) + "|"
        if kind == 11:
            rest = self.lower(b) if self.cased else b
            return a + s + self.quoted(self.sentences_of()) + s + rest + self.mark() + "|"
        if kind == 12:
            return self.brackets[0] + self.sentences_of() + self.brackets[1] + "|"
        if kind == 13:
            rest = self.lower(b) if self.cased else b
            return a + s + self.brackets[0] + self.body() + r.choice([self.ask, self.shout, self.stop]) + self.brackets[1] + s + rest + self.mark() + "|" if self.cased else self.body() + self.brackets[0] + self.body() + self.stop + self.brackets[1] + "|"
        if kind == 14 and self.cased:
            return a + s + self.quoted(self.body() + self.mark()) + "|"
        if kind == 15 and s:
            return f"{a} {r.choice(['www.rugero.rw/a.html', 'a.b@rugero.rw', 'v2.1.3', 'rugero.org'])} {b}{self.mark()}|"
        if not self.cased:
            if not s or kind < 17:
                return self.body() + self.mark() + "|"
            # a dot after a short token, or where the script ends sentences by another mark
            word = r.choice(b.split())
            if r.random() < 0.3:
                a = self.body() + self.dots() + " " + a
            return f"{a} {word[:1] if self.stop == '.' else word[: r.randint(2, 4)]}. {b}{self.mark()}|"
        return self.abbreviated(a, b)

    def abbreviated(self, a: str, b: str) -> str:
        r, name = self.rnd, self.rnd.choice(self.names)
        kind, tail = r.randrange(9), self.mark() + "|"
        if kind == 0:
            return f"{a} {r.choice(_SOME['title']).capitalize()}. {name} {b}{tail}"
        if kind == 1:
            return f"{r.choice(_SOME['title']).capitalize()}. {name} {self.lower(b)}{tail}"
        if kind == 2:
            return f"{a} {r.choice(_SOME['numbered'])}. {r.randrange(1, 200)} {b}{tail}"
        if kind == 3:
            return f"{a}, {r.choice(_SOME['inner'])}. {r.choice([self.lower(b), name + ' ' + b])}{tail}"
        if kind == 4:
            return f"{a}, {r.choice(_SOME['closing'])}. {self.lower(b)}{tail}"
        if kind == 5:
            return f"{self.body()}, {r.choice(_SOME['closing'])}.|"
        if kind == 6:
            return f"{a} {r.choice('ABCDEJKMNPRST')}. {name} {b}{tail}"
        if kind == 7:
            return f"{a} {r.choice(_DOTTED)}. {self.lower(b)}{tail}"
        return f"{self.body()} {r.choice(_DOTTED)}.|"

    def paragraph(self, other: Composer) -> str:
        """Units of this script, at times with some of another."""
        r = self.rnd
        mixed = r.random() < 0.15
        units = [(other if mixed and r.random() < 0.5 else self).unit() for _ in range(r.randint(2, 6))]
        if mixed:
            return " ".join(units)
        kind = r.random()
        if kind < 0.06 and self.cased:  # in one case, as some texts are
            units = [self.body() + self.mark() + "|" for _ in units]
            return self.space.join(units).lower() if kind < 0.03 else self.space.join(units).upper()
        if kind < 0.1 and self.cased:  # a next sentence in lower case, or without a blank before it
            units = [self.body() + self.stop + "|" for _ in units]
            return " ".join([units[0], *[self.lower(u) for u in units[1:]]]) if kind < 0.08 else "".join(units)
        return (r.choice([self.space, self.space, self.space, "\n"]) or "").join(units)


_DOTTED = ["U.N", "R.D.C", "A.B.C", "E.U", "U.K.R", "U.S.A", "A.M.P", "K.K.S"]
_SOME = {"title": sorted(TITLES), "numbered": sorted(NUMBERED - {"no", "s", "n"}), "inner": sorted(x for x in INNER if not x.endswith(".")), "closing": sorted(CLOSING)}


def _marked(text: str, learned: frozenset) -> list[tuple[list[tuple], list[str]]]:
    """The places of each block of a text with bars, and whether a bar follows."""
    plain = text.replace("|", "")
    bars, at = set(), 0
    for part in text.split("|")[:-1]:
        at += len(part)
        bars.add(at)
    out = []
    for a, b in blocks(plain):
        cs = candidates(plain, a, b, learned)
        if cs:
            out.append(([key for _, key in cs], ["end" if e in bars else "in" for e, _ in cs]))
    return out


def _count_tokens(text: str, dotted: Counter, after: Counter, last: Counter, whole: Counter) -> None:
    """Short tokens with a dot and a word behind, those where that goes on in lower case, those that end a line, and those without a dot."""
    for m in _SHORT.finditer(text):
        w = m[1].casefold()
        if m[2]:
            dotted[w] += 1
            after[w] += m[2].islower() or m[2].isdigit() or not _has_case(m[2])
        else:
            last[w] += 1
    whole.update(_BARE.findall(text.casefold()))


def _is_learned(w: str, dotted: int, after: int, last: int, whole: int) -> bool:
    """An abbreviation of the table: a short token of any script that mostly has a dot, and is mostly followed by a lower letter or digit where the script has case; where it has none, one that hardly ever ends a line."""
    return len(w) <= 5 and dotted >= 5 and after >= 0.8 * dotted and dotted >= 3 * whole and (any(map(_has_case, w)) or 10 * last <= dotted)


_SHORT = re.compile(r"(?<![\w.])([^\W\d_][\w.'’-]{0,6})\.(?:(?=[  ]+(\S))|(?=\s*(?:[\n\r]|\Z)))")
_BARE = re.compile(r"(?<![^\W\d_])[^\W\d_]{1,5}(?![\w.])")


def whole_sentences(texts: list[str]) -> dict[str, list[str]]:
    """By script the blocks that are certain to be one sentence: their only mark is their end."""
    whole: dict[str, list[str]] = {}
    for t in texts:
        for a, b in blocks(t):
            x = t[_body(t, a, b)[0] : b].strip()
            if not (8 < len(x) < 300 and x[-1] in _STOPS and x[-1] != "…" and x[0].isalnum() and "\n" not in x):
                continue
            mark = _MARKS.search(x)
            if mark and mark.end() == len(x) and len(mark[0]) == 1:
                whole.setdefault(_group(x), []).append(x)
    return whole


class _Rows:
    """Rows held here and rows of a table; jobs run over both, and only what they sum up to comes back."""

    def __init__(self, here: list[tuple], there: DataFrame | None = None):
        self.here, self.there = here, there

    def _of(self, job: Callable[[Iterable[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
        names = [c.split()[0] for c in schema.split(", ")]

        def run(batches):
            rows = (r for b in batches for r in b.itertuples(index=False, name=None))
            for part in batched(job(rows), 5_000):
                yield from emit(pd.DataFrame(part, columns=names))

        return self.there.mapInPandas(run, schema)

    def run(self, job: Callable[[Iterable[tuple]], Iterable[tuple]], schema: str) -> _Rows:
        return _Rows(list(job(self.here)), None if self.there is None else written(self._of(job, schema)))

    def held(self) -> _Rows:
        """The same sequences, all of them here where they are few: their sums are whole numbers, the same wherever they are added."""
        if self.there is None or (self.there.agg(F.sum(F.length("seq"))).first()[0] or 0) > HELD:
            return self
        return _Rows(self.here + [tuple(r) for r in self.there.filter("seq is not null").orderBy("grp", "seq").collect()])

    def totals(self, job: Callable[[Iterable[tuple]], Iterable[tuple]], key: str = "string") -> Counter:
        """What a job's (key, number) rows add up to."""
        out = Counter()
        for k, v in job(self.here):
            out[k] += v
        if self.there is not None:
            added = self._of(job, f"k {key}, v long").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
            for k, v in zip(added["k"].tolist(), added["v"].tolist()):
                out[k] += v
        return out


_READ = "name string, dotted long, after long, last long, bare long, grp string, said array<string>"
_MADE = "grp string, seq binary, name string"
_SAID = "grp string, said array<string>"


def _read(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Of each text its certain sentences by script; of all texts the counts of short tokens."""
    counts = [Counter() for _ in range(4)]
    for (text,) in rows:
        _count_tokens(text, *counts)
        for group, said in sorted(whole_sentences([text]).items()):
            yield None, 0, 0, 0, 0, group, said
    for w in sorted(set().union(*counts)):
        if len(w) <= 5:
            yield w, *(c[w] for c in counts), None, None


def _learned(read: _Rows) -> frozenset:
    """The abbreviations by the counts of all texts; only tokens that may be some leave the table."""
    total: dict[str, list[int]] = {}
    add = [r[:5] for r in read.here if r[0] is not None]
    if read.there is not None:
        here = read.there.sparkSession.createDataFrame(add, "name string, dotted long, after long, last long, bare long")
        every = read.there.filter("name is not null").select(*here.columns).unionByName(here)
        sums = every.groupBy("name").agg(*[F.sum(c).alias(c) for c in here.columns[1:]])
        add = sums.filter("dotted >= 5 and 5 * after >= 4 * dotted and dotted >= 3 * bare").collect()
    for w, *n in add:
        total[w] = [a + b for a, b in zip(total.get(w, [0] * 4), n)]
    return frozenset(w for w, n in total.items() if _is_learned(w, *n))


def _compose(rows: Iterable[tuple], learned: frozenset, ways: dict, rounds: dict, own: dict[str, list[str]]) -> Iterator[tuple]:
    """Paragraphs of each text's own sentences as places with their tags, and the different places met."""
    codes: dict[tuple, int] = {}
    others = {g: Composer(said, random.Random(0), ways[g]) for g, said in own.items() if g in ways}
    for group, said in rows:
        if group not in ways:
            continue
        rnd = random.Random(_seed(said))
        made = Composer(list(said), rnd, ways[group], rounds[group])
        while made.queue:
            other = others.get(rnd.choice(sorted(ways)), made)
            other.rnd = rnd
            for keys, tags in _marked(made.paragraph(other), learned):
                yield group, _coded(keys, tags, codes), None
    for key in codes:
        yield None, None, repr(key)


def _coded(keys: list[tuple], tags: list[str], codes: dict[tuple, int]) -> bytes:
    for key in keys:
        if key not in codes:
            codes[key] = _code(repr(key))
    return np.array([codes[key] + (tag == "end") for key, tag in zip(keys, tags)], np.uint64).tobytes()


def _code(name: str) -> int:
    """A number for a place by what stands around it, even: one more says that it ends a sentence."""
    return int.from_bytes(blake2b(name.encode(), digest_size=8).digest(), "little") & ~1


def _bare(rows: Iterable[tuple], marked: Segmenter) -> Iterator[tuple]:
    """Of each text by script the sentences without case, as the field of marks finds them, stripped of their marks."""
    for part in batched((t for (t,) in rows if _CASELESS.search(t)), 500):
        for text, found in zip(part, marked.split_all(list(part))):
            by: dict[str, list[str]] = {}
            for x in (text[a:b] for a, b in found):
                said = _stripped(x)[1] if x[-1] in _STOPS else ""
                if len(said) > 3 and _mostly_caseless(said):
                    by.setdefault(_group(said), []).append(said)
            yield from sorted(by.items())


def _strung(rows: Iterable[tuple], rounds: dict) -> Iterator[tuple]:
    """Each text's sentences strung together by one to four, as often as asked; bars stand for their ends."""
    for group, said in rows:
        rnd = random.Random(_seed(said))
        gap = " " if any(" " in x for x in said) else ""
        for _ in range(rounds[group]):
            order, k = rnd.sample(list(said), len(said)), 0
            while k < len(order):
                n = rnd.randint(1, 4)
                yield group, "".join(f"{x}|{gap}" for x in order[k : k + n]).encode("utf-32-le"), None
                k += n


def _places(seqs: list[bytes], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The slots, tags and lengths of coded paragraphs."""
    flat = np.frombuffer(b"".join(seqs), np.uint64)
    return np.searchsorted(codes, flat & ~np.uint64(1))[:, None], (flat & np.uint64(1)).astype(np.int64), np.array([len(x) // 8 for x in seqs])


def _encoded(rows: Iterable[tuple], places: Callable, weights: dict) -> Iterator[tuple]:
    for part in batched(((g, seq) for g, seq, *_ in rows if seq is not None), 4_000):
        yield *places([seq for _, seq in part]), np.array([weights[g] for g, _ in part])


def _trained(data: _Rows, places: Callable, weights: dict, features: np.ndarray | None, size: int, l2: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """The weights of a field that make the tags of all sequences most likely: each step sums its slope over all of them.

    A slot's weight is that of its features together, where there are any.
    """
    data = data.held()
    here, there = list(_encoded(data.here, places, weights)), _Rows([], data.there)
    if features is None:  # the slots that are met, each by itself
        met = there.totals(lambda rows: ((k, 1) for part in _encoded(rows, places, weights) for k in np.unique(part[0]).tolist()), "long")
        met = np.unique(np.concatenate([np.fromiter(met, np.int64), *(part[0].ravel() for part in here)]))
        number = len(met)
    else:
        number = int(features.max()) + 1

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        t, w = x[-4:].reshape(2, 2), np.zeros(size)
        at, given = (met, x[:-4]) if features is None else (slice(None), x[:-4][features].sum(axis=1))
        w[at] = given

        def job(rows: Iterable[tuple]) -> Iterator[tuple[int, int]]:
            w = np.zeros(size)
            w[at] = given
            for part in _encoded(rows, places, weights):
                yield from chain.sums(*part, w, t)

        total = there.totals(job, "long")
        for part in here:
            for k, v in chain.sums(*part, w, t):
                total[k] += v
        k = np.fromiter((k for k in total if k >= 0), np.int64)
        g = np.zeros(size)
        g[k] = np.array([total[n] for n in k.tolist()]) * chain.UNIT
        g = g[met] if features is None else np.bincount(features.ravel(), np.repeat(g, features.shape[1]), number)
        slope = np.append(g, [total[-2 - n] * chain.UNIT for n in range(4)])
        return total[-1] * chain.UNIT + l2 / 2 * float(x @ x), slope + l2 * x

    x = chain.minimize(value, np.zeros(number + 4), steps)
    w = x[:-4]
    if features is None:
        w = np.zeros(size)
        w[met] = x[:-4]
    return w, x[-4:].reshape(2, 2)


def fit(texts: list[str]) -> Segmenter:
    """Both fields, trained on all of the given texts; the same texts give the same fields."""
    return _fit(_Rows([(t,) for t in texts if t]))


def fit_table(documents: DataFrame) -> Segmenter:
    """Both fields, trained on the texts of all rows."""
    return _fit(_Rows([], documents.select("text").filter(F.length("text") > 0)))


def _fit(texts: _Rows) -> Segmenter:
    seeds = [(x.replace("|", ""),) for x in SEED_TEXTS]
    own: dict[str, list[str]] = {}
    for x in (y.strip() for t in SEED_TEXTS for y in t.split("|")):
        if len(list(_MARKS.finditer(x))) == 1 and x[-1] in _STOPS:
            own.setdefault(_group(x), []).extend([x] * 3)
    read = texts.run(_read, _READ)
    read.here += [r for r in _read(seeds) if r[0] is not None]
    learned = _learned(read)

    # the certain sentences of all texts, and how each script is written by all of them
    said = _Rows([r[5:] for r in read.here if r[5] is not None], None if read.there is None else read.there.filter("grp is not null").select("grp", "said"))
    said.here += sorted(own.items())
    ends: dict[str, Counter] = {}
    for k, n in said.totals(lambda rows: Counter(f"{x[-1]}{' ' in x:d}{g}" for g, s in rows for x in s).items()).items():
        ends.setdefault(k[2:], Counter())[k[0], k[1] == "1"] += n
    ways = {g: _ways(c) for g, c in ends.items() if c.total() >= 4}
    rounds = {g: -(-AT_LEAST // ends[g].total()) for g in ways}

    made = said.run(lambda rows: _compose(rows, learned, ways, rounds, own), _MADE)
    codes: dict[tuple, int] = {}
    marked_seeds = [("", _coded(keys, tags, codes), None) for t in SEED_TEXTS for keys, tags in _marked(t, learned)]
    made.here += [*marked_seeds, *((None, None, repr(key)) for key in codes)]
    # of bounded number: what is told of a place are a few things of a few kinds each
    names = sorted(made.totals(lambda rows: ((k, 1) for k in {r[2] for r in rows if r[2] is not None})), key=_code)
    index: dict[str, int] = {}
    features = np.array([[index.setdefault(f, len(index)) for f in named(literal_eval(k))] for k in names])
    hashes = np.array([_code(k) for k in names], np.uint64)
    sequences = made.totals(lambda rows: Counter(r[0] for r in rows if r[1] is not None).items())
    weights = {g: WEIGHT * (1 - SEED_SHARE) / len(ways) / n for g, n in sequences.items()} | {"": WEIGHT * SEED_SHARE / len(marked_seeds)}
    crf = Crf(["in", "end"])
    w, crf.t = _trained(made, lambda seqs: _places(seqs, hashes), weights, features, len(names), MARKS_L2, MARKS_STEPS)
    crf.index, crf.w = index, np.stack([np.zeros(len(w)), w], 1)

    # whole sentences of scripts without case, as the field of marks finds them, stripped of their marks
    marked = Segmenter(crf, learned, None, 0.0)
    if texts.there is not None:
        texts = _Rows(texts.here, texts.there.filter(F.col("text").rlike(_CASELESS.pattern)))
    bare = _Rows([*texts.here, *seeds], texts.there).run(lambda rows: _bare(rows, marked), _SAID)
    chars = _char_field(bare)

    # the margin that the whole sentences stay under but for a small share, each judged by a field of the other half of the texts
    steps = Counter()
    for half in (0, 1):
        other = _char_field(bare, half)
        steps += bare.totals(lambda rows: _gains(_half(rows, 1 - half), other), "long")
    left, over, least = CUT_WHOLE * steps.total(), 0, 0.0
    for k in sorted(steps, reverse=True):
        over += steps[k]
        if over > left:
            least = k * MARGIN
            break
    # too few sentences cannot show so small a share: of n without a cut it may be 3 / n, and gains are logs of odds
    return Segmenter(crf, learned, chars, least + max(0.0, float(np.log(3 / left))))


def _char_field(bare: _Rows, half: int | None = None) -> CharField:
    """A field of characters trained on the sentences of all texts, or on those of a half."""
    number = bare.totals(lambda rows: ((g, len(s)) for g, s in _half(rows, half)))
    strung = bare.run(lambda rows: _strung(_half(rows, half), {g: -(-UNMARKED // n) for g, n in number.items()}), _MADE)
    sequences = strung.totals(lambda rows: Counter(r[0] for r in rows).items())
    w, t = _trained(strung, CharField.slots, {g: CHARS_WEIGHT / len(sequences) / n for g, n in sequences.items()}, None, 1 << SLOT_BITS, CHARS_L2, CHARS_STEPS)
    return CharField(w.astype(np.float32), t)


def _half(rows: Iterable[tuple], half: int | None) -> Iterator[tuple]:
    """The rows of a half of the texts by a hash of their sentences."""
    return ((g, said) for g, said in rows if half is None or _seed(said) & 1 == half)


def _seed(said: list[str]) -> int:
    """A number of the content alone, the same in whatever task."""
    return zlib.crc32("\n".join(said).encode())


def _gains(rows: Iterable[tuple], chars: CharField) -> Iterator[tuple[int, int]]:
    """How many whole sentences would be cut at which gain, in steps rounded up."""
    for part in batched((x for _, s in rows for x in s), 2_000):
        yield from Counter(max(0, int(np.ceil(gain / MARGIN))) if cuts else 0 for cuts, gain in chars.cuts_all(list(part))).items()


def _group(x: str) -> str:
    """The script of a sentence: what it can be put together with."""
    letter = next((c for c in x if c.isalpha()), "a")
    return "CASED" if _has_case(letter) else "HAN" if _script(letter) in ("CJK", "HIRAGANA", "KATAKANA") and not re.search(r"[\u3040-\u30ff]", x) else _script(letter) if _script(letter) != "CJK" else "KANA"


def sample_documents(documents: DataFrame, n: int = SAMPLE_DOCS) -> list[str]:
    """At most n texts, in the order of a hash of their content: for trials on one machine, no query learns from them."""
    rows = documents.select(F.col("text").alias("t")).filter(F.length("t") > 0)
    return [r[0] for r in bounded_sample(rows, documents.count(), n)]


def sentences(documents: DataFrame, segmenter: Segmenter | None = None, key: str = "doc_id") -> DataFrame:
    """(doc_id, sent_no, start_char, end_char) of every sentence, in order; offsets in code points of the stored text.

    Null, empty and blank texts have no sentences; repeated rows are split each; texts of any length are read whole;
    extra columns are left behind. An empty table gives no rows.
    """
    rows = enough_tasks(documents.select(key, "text").filter(F.length("text") > 0))
    segmenter = segmenter or fit_table(rows)
    held = documents.sparkSession.sparkContext.broadcast(segmenter)

    def run(batches):
        s = held.value
        for b in batches:
            ids, nos, starts, ends = [], [], [], []
            for d, found in zip(b[key], s.split_all(list(b["text"]))):
                for n, (x, y) in enumerate(found):
                    ids.append(d)
                    nos.append(n)
                    starts.append(x)
                    ends.append(y)
            yield from emit(pd.DataFrame({key: pd.Series(ids, dtype=b[key].dtype), "sent_no": pd.Series(nos, dtype="int64"), "start_char": pd.Series(starts, dtype="int64"), "end_char": pd.Series(ends, dtype="int64")}))

    return rows.mapInPandas(run, f"{key} {documents.schema[key].dataType.simpleString()}, sent_no long, start_char long, end_char long")
