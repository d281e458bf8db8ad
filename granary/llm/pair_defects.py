"""Problem 1: broken prompt and response pairs, by a conditional random field over the clauses of a response.

Each clause of an answer is tagged answer, refusal, echo, foreign or unfinished; the share of the answer that each tag
covers decides the defect of the pair. The field is trained here, on clauses of a bounded sample of the table and on
broken copies made from them: answers cut short, questions given back, clauses of other languages, and refusals put
together from the phrases below.
"""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.frames import emit
from granary.functions.words import words
from granary.llm.crf import Crf
from granary.llm.language import SAMPLE_TEXTS, cited, classify, pieces, train, uncited
from granary.llm.ppm import PpmModels, folded
from granary.llm.sampling import bounded_sample
from granary.llm.similar import small_or_shuffled
from granary.session import enough_tasks, written

#: Bound of the training sample of pairs, taken in the order of a hash of their content.
SAMPLE_PAIRS = 3_000
DEFECTS = ("empty", "truncated", "refusal", "echo", "wrong_language")

#: What stands in an answer's place, after case and all but letters and digits are removed.
PLACEHOLDERS = (
    "na", "todo", "null", "none", "nil", "nan", "tbd", "noresponse", "noanswer", "ntagisubizo", "assistant", "answer", "response",
    "igisubizo", "aucuneréponse", "pasderéponse", "réponse", "hakunajibu", "jibu", "empty", "blank", "placeholder", "undefined", "noreply",
    "nooutput", "missing", "notavailable", "sansréponse", "insertanswerhere", "youranswer", "ai", "bot", "user", "system", "unanswered", "void",
)
#: Labels that may lead a text and say nothing.
LABELS = frozenset("q a question answer response prompt user assistant ikibazo igisubizo swali jibu réponse réponds instruction input output you asked asked".split())

# Phrases that refusals are put together from, by language: openings, cores and what follows.
REFUSALS = {
    "en": (
        ["", "", "", "I'm sorry, but", "Sorry,", "My apologies,", "I apologize,", "Unfortunately,", "Regrettably,", "I'm afraid that", "As an assistant,", "Being a language model,", "Thanks for the question, but", "I regret it, but"],
        ["I cannot assist you with {}.", "I can't answer that.", "I can't help you here.", "I'm unable to help.", "I am not able to do this.", "I will not be able to give you {}.", "I have to decline.", "I am not able to answer.", "I must decline this one.", "I decline to talk about {}.", "I refuse to answer.", "I won't answer anything about {}.", "I won't provide that.", "I'm not allowed to say anything on {}.", "I am not allowed to help with it.", "there is nothing that I can say.", "I have nothing to say about {}.", "your request goes beyond what I am permitted to do.", "such a request is outside what I can do.", "that is outside my permissions.", "I cannot comply.", "I am not able to respond to questions on {}.", "answering questions like this is not permitted.", "I can't discuss it at all.", "I must say no to {}."],
        ["", "", "My rules forbid it.", "It is against my guidelines.", "Try another question.", "Ask someone who knows {}.", "A teacher could help you better.", "Do you need anything else?", "Contact {} about it.", "Perhaps someone else can help you.", "I hope you understand.", "Please talk to another teacher, {}.", "You can ask {} instead.", "You could try {} or another person.", "Please consult {}.", "Please ask a colleague of {}.", "Please ask another teacher.", "Can I do anything else for you?"],
    ),
    "fr": (
        ["", "", "Pardon,", "Je suis navré, mais", "Malheureusement,", "Je suis désolé,", "Désolée, mais", "Je le regrette,", "Hélas,", "Merci pour la question, mais"],
        ["je ne peux pas répondre.", "je ne peux rien dire sur {}.", "je ne peux pas vous aider.", "il m'est impossible de vous aider.", "il est impossible pour moi de parler de {}.", "je refuse de répondre.", "je ne suis pas autorisé à répondre à cela.", "je ne suis pas en mesure de le faire.", "je dois décliner cette demande.", "cela dépasse ce qui m'est permis.", "je ne saurais vous donner {}."],
        ["", "", "Demandez à quelqu'un d'autre.", "Un enseignant saura mieux.", "Avez-vous une autre question ?", "Mes règles l'interdisent.", "Contactez {}.", "Parlez-en plutôt à {}.", "Vous pouvez consulter {}.", "Voyez un autre enseignant, {}.", "Puis-je faire autre chose ?"],
    ),
    "rw": (
        ["", "", "", "Mbabarira,", "Mbabarira, ariko", "Munyihanganire,", "Ihangane cyane,", "Mumbabarire cyane,", "Ikibabaje,", "Birababaje kuko", "Ndababaye, ariko", "Ntibishoboka,", "Urakoze, ariko"],
        ["sinshobora kubigufashamo.", "sinshobora kuvuga ibya {}.", "sinshobora kugufasha.", "ndanze gusubiza.", "nanze kuvuga kuri {}.", "nanze icyo kibazo.", "ntabwo nemerewe kubivugaho.", "ntabwo nemerewe gusubiza.", "sinemerewe kuvuga kuri {}.", "ibi simbishoboye.", "ibya {} simbishoboye.", "kuri {} ibyo simbishoboye.", "ibyo byose simbishoboye.", "ntabwo mbishoboye.", "ntabwo nabigufashamo.", "ntacyo navuga kuri {}.", "singusubiza.", "icyo kibazo sinagisubiza.", "ngomba kubyanga.", "ibibazo nk'ibi simbisubiza."],
        ["", "", "Baza abandi.", "Baza umwarimu.", "Amategeko ntabyemera.", "Gerageza ikindi kibazo.", "Wabaza undi muntu.", "Hari ikindi ushaka?", "Wabaza {} cyangwa abandi.", "Wabaza mugenzi wawe {}.", "Baza umwarimu witwa {}.", "Umwarimu w'ishuri wamubaza.", "Baza {} na we.", "Shaka {} agufashe.", "Hari ikindi nakora?"],
    ),
    "sw": (
        ["", "", "Nisamehe,", "Samahani sana,", "Pole sana,", "Nasikitika,", "Kwa bahati mbaya,", "Naomba radhi,", "Asante, lakini"],
        ["siwezi kujibu.", "siwezi kusaidia katika hili.", "siwezi kukusaidia.", "siruhusiwi kusema lolote kuhusu {}.", "nakataa kujibu.", "lazima nikatae ombi hili.", "sina ruhusa ya kuzungumza juu ya {}.", "hilo siliwezi.", "sitaweza kutoa msaada.", "sitajibu swali hilo.", "hakuna la kusema kuhusu {}."],
        ["", "", "Muulize mtu mwingine.", "Mwalimu anaweza kusaidia.", "Kanuni haziruhusu.", "Uliza swali lingine.", "Una swali lingine?", "Mwulize {} badala yangu.", "Zungumza na mwalimu mwingine, {}.", "Unaweza kumtafuta {}."],
    ),
}
#: How a question may name a language that it asks for. To write an exchange between people is an exercise
#: in Kinyarwanda, whatever language it is set in.
ASKED = {"rw": re.compile(r"kinyarwanda|`|\b(?:exchange|dialogue|conversation)\s+between\b"), "en": re.compile(r"english|cyongereza|anglais|kiingereza"), "fr": re.compile(r"french|français|francais|gifaransa|kifaransa"), "sw": re.compile(r"swahili|giswahili|souahéli")}

_CLAUSE = re.compile(r"(?<=[.!?…。])[\"'”’»)\]`*]*\s+(?=\S)|\n+")
_PLAIN = re.compile(r"[^\w]|_")
_TOKEN = re.compile(r"`[^`\n]*`?|\d+|[^\W\d_]+(?:['’][^\W\d_]+)*")
_ENTRY = re.compile(r"\s*\S?[\w' ]{1,30}\S?\s[-–—]\s\w")
_ITEM = re.compile(r"\s*(?:[-–—*•·]|\(?\d{1,3}\s?[.);:])\s")


#: More letters or digits than any placeholder has.
_LONG = re.compile(rf"(?:[\W_]*[^\W_]){{{max(map(len, PLACEHOLDERS)) + 1}}}")


def is_empty(answer: str | None) -> bool:
    """Null, or only blanks, marks or a placeholder."""
    return answer is None or not _LONG.match(answer) and ((said := _PLAIN.sub("", answer).casefold()) == "" or said in PLACEHOLDERS)


def clauses(text: str) -> list[str]:
    """Clauses of an answer: its lines, cut again after closing marks; never inside a short quoted piece."""
    out: list[str] = []
    start, line = 0, True
    for m in [*_CLAUSE.finditer(text), None]:
        part = text[start : m.start() if m else len(text)]
        if part.strip():
            joins = out and (not line and out[-1].count("`") % 2 and "`" in part or not any(c.isalnum() for c in part) or _ITEM.fullmatch(out[-1] + " "))
            if joins:
                out[-1] += " " + part
            else:
                out.append(part)
        if m:
            start, line = m.end(), "\n" in m[0]
    return out


def _tokens(text: str) -> list[str]:
    """Words with quoted pieces, names and numbers as one sign each."""
    out = []
    for n, t in enumerate(_TOKEN.findall(text)):
        if t[0] == "`":
            out.append("<cited>")
        elif t[0].isdigit():
            out.append("<number>")
        elif n and t[0].isupper() and not t.isupper():
            out.append("<name>")
        else:
            out.append(t.casefold())
    return out


class EndModel:
    """How often a sentence ends after its last words, from whole sentences of the sample; and the words it knows."""

    def __init__(self, sentences: list[str]):
        self.ends, self.seen, self.known, self.starts = Counter(), Counter(), Counter(), set()
        for s in sentences:
            t = ["<s>", "<s>", *_tokens(s)]
            for n in range(2, len(t)):
                for ctx in ((t[n],), (t[n - 1], t[n]), (t[n - 2], t[n - 1], t[n])):
                    self.seen[ctx] += 1
                    if n == len(t) - 1:
                        self.ends[ctx] += 1
            for w in _TOKEN.findall(s):
                if w[0] != "`":
                    self.known[w.casefold()] += 1
        for w in self.known:
            self.starts.update(w[:k] for k in range(1, len(w)))

    def features(self, clause: str) -> list[str]:
        t = ["<s>", "<s>", *_tokens(clause)]
        raw = [w for w in _TOKEN.findall(clause) if w[0] != "`"]
        out = []
        for ctx in (tuple(t[-3:]), tuple(t[-2:]), tuple(t[-1:])):
            if n := self.seen[ctx]:
                p = (self.ends[ctx] + 0.1) / (n + 0.4)
                out.append(f"end{len(ctx)}:{'no' if p < 0.02 else 'low' if p < 0.15 else 'mid' if p < 0.5 else 'high'}:{'many' if n > 9 else 'few'}")
                break
        else:
            out.append("end:new")
        if raw and t[-1] != "<cited>":
            w = raw[-1].casefold()
            out.append("last:known" if self.known[w] > 1 else "last:once" if self.known[w] else "last:cut" if w in self.starts else "last:new")
            if w[-1] not in "aeiouyéàê":
                out.append(out[-1] + ":hard")
        return out


class PairTagger:
    """The trained field with what its features need."""

    def __init__(self, models: PpmModels, ends: EndModel, cues: frozenset):
        self.models, self.ends, self.cues = models, ends, cues
        self.crf: Crf | None = None
        self._cue_numbers: dict | None = None
        self._key_numbers: dict = {}

    def allowed(self, question: str, langs: list[str]) -> frozenset:
        """Languages that an answer may have: those the question uses, langs of its own and cited pieces, or asks for."""
        low = question.casefold()
        return frozenset(langs) | {k for k, r in ASKED.items() if r.search(low)}

    def features(self, question: str, parts: list[str], bare_parts: list[str], langs: list[str], margins: list[float], allowed: frozenset) -> list[tuple]:
        """For each clause what it is like, as a key of few different values, and the cues that it holds."""
        asked = LABELS.union(words(question))
        said = [words(p) for p in parts]
        known = [sum(map(asked.__contains__, ws)) for ws in said]
        whole = _share(sum(known), sum(map(len, said)))
        last, size = len(parts) - 1, min(len(parts), 3)
        out = []
        for j, (part, ws, bare_part, m) in enumerate(zip(parts, said, bare_parts, margins)):
            cites = bare_part is not part
            bare = words(bare_part) if cites else ws
            met = self.cues.intersection(bare)
            if len(met) > 1:
                met = met | self.cues.intersection(zip(bare, bare[1:]))
            key = (_share(known[j], len(ws)), whole, j == 0, size, cites and len(bare) < 0.6 * len(ws), langs[j] not in allowed, "sure" if m > 0.5 else "near" if m > 0.2 else "no")
            out.append((key + self._ending(part) if j == last else key, met))
        return out

    def _ending(self, part: str) -> tuple:
        end = part.rstrip()
        bare_end = end.rstrip("`\"'”’»)]*_")
        mark = bare_end[-1:] or end[-1:]
        shape = "stop" if mark in ".!?።।" and not bare_end.endswith("..") else "dots" if mark in "…." else "break" if mark in ",;:-–—(/" else "word"
        odd = end.count("`") % 2 == 1 or end.count("(") > end.count(")") or end.count("“") > end.count("”") or end.count("«") > end.count("»") or end.count('"') % 2 == 1
        about = () if shape == "stop" else tuple(self.ends.features(part)) + (("entry",) if _ENTRY.match(part) else ())
        return (shape, odd, bool(_ITEM.match(part)), about)

    @staticmethod
    def named(key: tuple) -> list[str]:
        """The features of a key of features(), by name."""
        inside, whole, first, size, cited_most, foreign, sure = key[:7]
        f = ["bias", f"in:{inside}", f"whole:{whole}", "first" if first else "later", f"parts:{size}", f"in+whole:in:{inside}:{whole}", f"foreign:{foreign}:{sure}"]
        if cited_most:
            f.append("mostly cited")
        if len(key) > 7:
            shape, odd, item, about = key[7:]
            f += [f"shape:{shape}", f"odd:{odd}", f"item:{item}:{shape}", *about, *[f"{shape}+{odd}+{x}" for x in about if x != "entry"]]
        return f

    def strings(self, sequence: list[tuple]) -> list[list[str]]:
        """The features of a sequence as strings, as the field is trained on them."""
        return [self.named(key) + [f"w:{w}" if isinstance(w, str) else f"b:{w[0]} {w[1]}" for w in sorted(met, key=str)] for key, met in sequence]

    def _numbers(self, sequences: list[list[tuple]]) -> list[list[int]]:
        """The numbers of the features of each clause; those of a key are looked up once."""
        index = self.crf.index
        if self._cue_numbers is None:
            names = {w: f"w:{w}" if isinstance(w, str) else f"b:{w[0]} {w[1]}" for w in self.cues}
            self._cue_numbers, self._key_numbers = {w: index[f] for w, f in names.items() if f in index}, {}
        cue, keys, out = self._cue_numbers.get, self._key_numbers, []
        for sequence in sequences:
            for key, met in sequence:
                ids = keys.get(key)
                if ids is None:
                    ids = keys[key] = [index[f] for f in self.named(key) if f in index]
                out.append(ids + [k for w in met if (k := cue(w)) is not None] if met else ids)
        return out

    def feature_rows(self, rows: list[tuple[str, list[str]]]) -> list[list[tuple]]:
        """Features of the clauses of each (question, clauses); the languages of all are found together.

        A question's language is looked for only where some clause has a language that the question does not name.
        """
        bare = [[uncited(p) for p in parts] for _, parts in rows]
        langs, margins = self._languages([p for ps in bare for p in ps])
        ends = np.cumsum([len(ps) for ps in bare]).tolist()
        said = [langs[e - len(ps) : e] for e, ps in zip(ends, bare)]
        may = [frozenset(k for k, r in ASKED.items() if r.search(low)) for low in (q.casefold() for q, _ in rows)]
        open_ = [n for n, ls in enumerate(said) if not may[n].issuperset(ls)]
        for n, (ls, _) in zip(open_, _piece_languages(self.models, [rows[n][0] for n in open_], True)):
            may[n] = self.allowed(rows[n][0], ls)
        return [self.features(q, parts, bs, ls, margins[e - len(parts) : e], m) for (q, parts), bs, ls, e, m in zip(rows, bare, said, ends, may)]

    def tag(self, pairs: list[tuple[str, str]]) -> list[tuple[list[str], list[str]]]:
        """Clauses and tags of the answer of each (question, answer)."""
        every = [clauses(a) for _, a in pairs]
        feats = self.feature_rows([(q, parts) for (q, _), parts in zip(pairs, every)])
        return list(zip(every, self.crf.tag_ids(self._numbers(feats), [len(x) for x in feats])))

    def _languages(self, texts: list[str]) -> tuple[list[str], list[float]]:
        coded = [folded(t) for t in texts]
        bits = self.models.bits(coded)
        if not len(bits):
            return [], []
        two = np.partition(bits, 1, axis=1)[:, :2]
        margins = (two[:, 1] - two[:, 0]) / np.array([len(c) for c in coded])
        return [self.models.langs[k] for k in bits.argmin(axis=1)], margins.tolist()


def _share(part: int, whole: int) -> str:
    if not whole:
        return "none"
    x = part / whole
    return "all" if x >= 0.999 else "most" if x >= 0.85 else "much" if x >= 0.6 else "some" if x >= 0.3 else "few"


def _covered(parts: list[str], tags: list[str]) -> Counter:
    """Characters, but for blanks, of the clauses of each tag."""
    size: Counter = Counter()
    for p, t in zip(parts, tags):
        size[t] += len(p) - p.count(" ")
    return size


def defect_of(answer: str | None, parts: list[str], tags: list[str]) -> str | None:
    """The defect of a pair from the share of its answer that each tag covers; None where it has none."""
    return "empty" if is_empty(answer) else _defect(tags, _covered(parts, tags))


def _defect(tags: list[str], size: Counter) -> str | None:
    whole = sum(size.values()) or 1
    if size["echo"] >= 0.9 * whole:
        return "echo"
    if size["refusal"] and size["answer"] + size["foreign"] + size["echo"] <= 0.1 * whole:
        return "refusal"
    if size["foreign"] >= 0.6 * whole:
        return "wrong_language"
    if tags and tags[-1] == "unfinished":
        return "truncated"
    return None


def fit(pairs: list[tuple[str, str]], seed: int = 11) -> PairTagger:
    """Train the field on a sample of (question, answer); the same sample gives the same field."""
    rnd = random.Random(seed)
    pairs = [(q, a) for q, a in pairs if q and not is_empty(a)]
    models = train([t for p in pairs[:SAMPLE_TEXTS] for t in p])
    made = {lang: [_refusal(lang, rnd) for _ in range(480)] for lang in REFUSALS}
    cue_counts = Counter()
    for texts in made.values():
        for t in texts:
            ws = words(t)
            cue_counts.update(set(ws) | set(zip(ws, ws[1:])))
    cues = frozenset(c for c, n in cue_counts.items() if n > 2)
    strong = re.compile(r"\b(?:decline|unable|refuse|can't help|cannot help|not able to|won't be able|sorry|apologi[sz]e|nanze|nemerewe|sinshobora|simbishoboye|birababaje|mumbabarire|ihangane|regrette|désolé|impossible|malheureusement|siwezi|samahani|nothing i can say|outside what)\b", re.I)
    whole = [c for _, a in pairs for c in clauses(a) if c.rstrip()[-1:] in ".!?"]
    lines = [x for _, a in pairs for x in a.split("\n")[:-1] if _ITEM.match(x) or _ENTRY.match(x)]
    tagger = PairTagger(models, EndModel([c.rstrip(" .!?") for c in [*whole, *lines]]), cues)
    asked_in, said_in = _piece_languages(models, [q for q, _ in pairs], True), _piece_languages(models, [a for _, a in pairs])
    fits = [not al or not own or _most(al) in tagger.allowed(q, ql) for (q, _), (ql, own), (al, _) in zip(pairs, asked_in, said_in)]
    by_lang: dict[str, list[str]] = {}
    langs, sure = classify(models, whole[:6000])
    for c, lang, p in zip(whole, langs, sure):
        if p > 0.95 and not strong.search(uncited(c)):
            by_lang.setdefault(lang, []).append(c)
    texts_of = {lang: by_lang.get(lang, []) for lang in REFUSALS}
    from granary.llm.seeds import SEED_TEXTS

    data: list[tuple[str, list[tuple[str, str]]]] = []
    for (q, a), (ql, _), fit_lang in zip(pairs, asked_in, fits):
        parts = clauses(a)
        asked = set(words(q))
        flat = words(a)
        if not fit_lang or strong.search(uncited(a)) or not parts or sum(w in asked for w in flat) > 0.8 * len(flat):
            continue
        good = [(p, "answer") for p in parts]
        kind = rnd.random()
        closed = parts[-1].rstrip()[-1:] in ".!?"
        if not closed and not (_ITEM.match(parts[-1]) or _ENTRY.match(parts[-1])):
            continue
        if rnd.random() < 0.4 and (cut := _cut(parts[-1], rnd)):
            data.append((q, [*good[:-1], (cut, "unfinished")]))
        if len(parts) > 1 and rnd.random() < 0.15:
            # the same sentences, told as one
            data.append((q, [("; ".join(p.rstrip(" .!?") for p in parts[:-1]) + "; " + parts[-1], "answer")]))
        if kind < 0.34:
            data.append((q, good))
        elif kind < 0.44:
            data.append((q, [*good[:-1], (parts[-1].rstrip(" .!?"), "answer")]))
        elif kind < 0.64:
            keep = good[: rnd.randrange(len(good))] if len(good) > 1 and rnd.random() < 0.5 else good[:-1]
            if cut := _cut(parts[len(keep)], rnd):
                data.append((q, [*keep, (cut, "unfinished")]))
        elif kind < 0.74:
            data.append((q, [(c, "echo") for c in clauses(_echo(q, rnd))]))
        elif kind < 0.77:
            data.append((q, [(c, "echo") for c in clauses(q)] + good))
        elif kind < 0.88:
            lang = rnd.choice(list(REFUSALS))
            data.append((q, [(c, "refusal") for c in clauses(_refusal(lang, rnd, q))]))
        elif kind < 0.92:
            data.append((q, [*[(c, "answer") for c in clauses(_hedge(q, rnd))], *good]))
        else:
            have = tagger.allowed(q, ql)
            other = rnd.choice([lang for lang in REFUSALS if lang not in have] or ["fr"])
            pool = texts_of[other] if len(texts_of[other]) >= 20 else texts_of[other] + [t for t in SEED_TEXTS[other]]
            data.append((q, [(rnd.choice(pool), "foreign") for _ in range(rnd.randint(1, 3))]))
    for texts in made.values():
        for t in texts[: max(60, len(pairs) // 7)] if pairs else []:
            data.append((rnd.choice(pairs)[0], [(c, "refusal") for c in clauses(t)]))
    data = [(q, tagged) for q, tagged in data if tagged]
    feats = [tagger.strings(x) for x in tagger.feature_rows([(q, [p for p, _ in tagged]) for q, tagged in data])]
    tagger.crf = Crf(["answer", "refusal", "echo", "foreign", "unfinished"]).fit([(f, [t for _, t in tagged]) for f, (_, tagged) in zip(feats, data)])
    return tagger


# What follows a cited refusal, and hedges with which an answer begins; none of them is a refusal.
_CITING = ("is one way to say no.", "was her reply yesterday.", "means that the speaker will not help.", "sounds harsh among friends.", "ni uko bamusubije.", "bivuga ko adashaka gufasha.", "ni ko yavuze ejo.", "se dit quand on refuse.", "ni jibu alilopewa jana.")
_HEDGING = (
    "I can't say whether {} is used everywhere, but this much is known.", "Sorry, I am no expert on {}, yet this is how it works.", "I am not certain about {}; nevertheless it is explained below.",
    "I cannot promise that this holds for {}, though most speakers agree.", "I don't know every form of {}, still the usual one is easy.", "Sinzi byose kuri {}, ariko dore uko bivugwa.",
    "Simbizi neza, icyakora {} ivugwa ityo.", "Sinahamya ibya {}, gusa benshi babivuga batyo.", "Je ne suis pas sûr pour {}, mais voici l'usage.", "Sina uhakika kuhusu {}, lakini hutumika hivi.",
)


def _hedge(question: str, rnd: random.Random) -> str:
    """A sentence that hedges, or cites a refusal with or without marks."""
    if rnd.random() < 0.5:
        said = _refusal(rnd.choice(list(REFUSALS)), rnd, question)
        return f"`{said}` {rnd.choice(_CITING)}" if rnd.random() < 0.6 else f"{said.rstrip('.!?')} {rnd.choice(_CITING)}"
    names = [t for t in _TOKEN.findall(question) if t[0] == "`" or t[0].isupper()] or ["`inka`"]
    return rnd.choice(_HEDGING).format(rnd.choice(names))


_FITTED: dict[int, PairTagger] = {}


def fitted(pairs: list[tuple[str, str]]) -> PairTagger:
    """The field of a sample, trained once in a driver: the same sample gives the same field."""
    key = hash(tuple(pairs))
    if key not in _FITTED:
        if len(_FITTED) >= 4:
            _FITTED.clear()
        _FITTED[key] = fit(pairs)
    return _FITTED[key]


def _most(langs: list[str]) -> str:
    return max(sorted(set(langs)), key=langs.count, default="")


def _piece_languages(models: PpmModels, texts: list[str], with_cited: bool = False) -> list[tuple[list[str], int]]:
    """Languages of the pieces of each text and their number, and with with_cited those of the pieces it cites after them."""
    own = [[uncited(t[a:b]) for a, b in pieces(t)] for t in texts]
    every = [ps + ([c.strip("`\"“”„«»*") for c in cited(t)] if with_cited else []) for ps, t in zip(own, texts)]
    bits = models.bits([folded(p) for ps in every for p in ps])
    langs = iter([models.langs[k] for k in bits.argmin(axis=1)] if len(bits) else [])
    return [([next(langs) for _ in ps], len(mine)) for ps, mine in zip(every, own)]


def _refusal(lang: str, rnd: random.Random, question: str = "") -> str:
    opening, core, after = (rnd.choice(x) for x in REFUSALS[lang])
    names = [t for t in _TOKEN.findall(question) if t[0].isupper()] or ["Kigali", "inka", "this question", "iki kibazo"]
    text = f"{opening} {core} {after}".strip().format(*[rnd.choice(names)] * 3)
    return text[:1].upper() + text[1:]


def _cut(clause: str, rnd: random.Random) -> str | None:
    clause = clause.rstrip(" .!?")
    if len(clause) < 12:
        return None
    at = rnd.randint(len(clause) // 5 + 1, len(clause) - 2)
    out = clause[:at].rstrip()
    if rnd.random() < 0.6 and " " in out:
        out = out.rsplit(" ", 1)[0]
    return out + rnd.choice(["", "", "", "", "…", "-", ",", " -", " and", " because", " so that", " kuko", " kugira ngo", " hanyuma", " the word", " which means that", ":", ";", *[f" {m}{w}" for m in "``“\"(" for w in (clause.split()[-1].strip("`.,"),)]])


def _echo(question: str, rnd: random.Random) -> str:
    quoted = re.findall(r"`([^`]{15,})`", question)
    base = rnd.choice(quoted) if quoted and rnd.random() < 0.4 else question
    ws = base.split()
    kind = rnd.random()
    if kind < 0.2 and len(ws) > 3:
        k = rnd.randrange(1, len(ws))
        base = " ".join(ws[k:] + ws[:k])
    elif kind < 0.35:
        base = base.lower() if rnd.random() < 0.5 else base.upper()
    elif kind < 0.45:
        base = " ".join(words(base))
    elif kind < 0.55:
        base = base + " " + base
    elif kind < 0.75:
        base = rnd.choice(["Q: ", "Question: ", "Ikibazo: ", "Q. ", "User: "]) + base
    return base


def repeated_deliveries(records: DataFrame) -> DataFrame:
    """(id, best) of the ids that were delivered more than once: what tells the first delivery that has messages.

    Found by keys, times and a hash of the messages alone; the messages themselves are not moved.
    """
    order = F.struct(F.col("messages").isNull().alias("none"), F.col("ingested_at").isNull().alias("undated"), F.col("ingested_at").alias("at"), F.xxhash64("messages").alias("h"))
    by = records.filter(F.col("id").isNotNull()).select("id", order.alias("o")).groupBy("id").agg(F.min("o").alias("best"), F.count("*").alias("c"))
    return written(by.filter("c > 1").select("id", F.col("best.at").alias("best_at"), F.col("best.h").alias("best_h")))


def of_first_delivery(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """Rows (with id, at, h of their delivery) of the first delivery of each id."""
    joined = rows.join(small_or_shuffled(repeated), "id", "left")
    return joined.filter(F.col("best_h").isNull() | (F.col("h") == F.col("best_h")) & F.col("at").eqNullSafe(F.col("best_at"))).drop("best_at", "best_h", "at", "h")


def message_pairs(records: DataFrame) -> DataFrame:
    """(id, at, h, pair_no, question, answer) of every user message directly followed by an assistant message."""
    n = F.size("messages")
    at = F.filter(F.sequence(F.lit(0), n - 2), lambda k: (F.get("messages", k).getField("role") == "user") & (F.get("messages", k + 1).getField("role") == "assistant"))
    rows = enough_tasks(records.filter(F.col("id").isNotNull() & (n >= 2)).select("id", "messages", F.col("ingested_at").alias("at")))
    flat = rows.select("id", "at", F.xxhash64("messages").alias("h"), "messages", F.posexplode(at).alias("pair_no", "k"))
    return flat.select("id", "at", "h", F.col("pair_no").cast("long").alias("pair_no"), F.get("messages", F.col("k")).getField("content").alias("question"), F.get("messages", F.col("k") + 1).getField("content").alias("answer"))


def sample_pairs(records: DataFrame, n: int = SAMPLE_PAIRS) -> list[tuple[str, str]]:
    """First pair of at most n records, in the order of a hash of the content: a bounded training sample."""
    pair = F.filter(F.transform("messages", lambda m, k: F.struct(m["role"].alias("role"), m["content"].alias("q"), F.get("messages", k + 1).getField("role").alias("next"), F.get("messages", k + 1).getField("content").alias("a"))), lambda p: (p["role"] == "user") & (p["next"] == "assistant"))
    rows = records.filter(F.size("messages") >= 2).select(F.explode(pair).alias("p")).select("p.q", "p.a").filter("q is not null and a is not null")
    return [(r[0], r[1]) for r in bounded_sample(rows, records.count(), n)]


def tagged_pairs(records: DataFrame, tagger: PairTagger | None = None, only_broken: bool = False) -> DataFrame:
    """(id, pair_no, defect, answer_share, refusal_share, echo_share, foreign_share, unfinished_share) of every pair.

    The defect is null for a sound pair. Null or empty answers are empty, null questions are empty texts; repeated
    deliveries of an id are one record; whole texts are read, however long. An empty table gives no rows.
    """
    tagger = tagger or fitted(sample_pairs(records))
    held = records.sparkSession.sparkContext.broadcast(tagger)
    names = ("answer", "refusal", "echo", "foreign", "unfinished")

    def run(batches):
        t = held.value
        for b in batches:
            questions = [q if isinstance(q, str) else "" for q in b["question"]]
            answers = [a if isinstance(a, str) else None for a in b["answer"]]
            live = [n for n, a in enumerate(answers) if not is_empty(a)]
            tags = dict(zip(live, t.tag([(questions[n], answers[n]) for n in live])))
            defects, shares = [], []
            for n in range(len(answers)):
                parts, tg = tags.get(n, ([], []))
                size = _covered(parts, tg)
                defects.append(_defect(tg, size) if n in tags else "empty")
                whole = sum(size.values()) or 1
                shares.append([size[k] / whole for k in names])
            out = pd.DataFrame({"id": b["id"], "at": b["at"], "h": b["h"], "pair_no": b["pair_no"], "defect": pd.Series(defects, dtype="object", index=b.index)})
            for k, name in enumerate(names):
                out[f"{name}_share"] = [s[k] for s in shares]
            yield from emit(out)

    schema = "id string, at timestamp, h long, pair_no long, defect string, " + ", ".join(f"{k}_share double" for k in names)
    found = message_pairs(records).mapInPandas(run, schema)
    if only_broken:
        found = found.filter(F.col("defect").isNotNull())
    # deliveries that agree in everything, their time included, remain and are one
    return of_first_delivery(found, repeated_deliveries(records)).dropDuplicates(["id", "pair_no"])


def broken_pairs(records: DataFrame, tagger: PairTagger | None = None) -> DataFrame:
    """(id, pair_no, defect) of every defective pair."""
    return tagged_pairs(records, tagger, only_broken=True).select("id", "pair_no", "defect")
