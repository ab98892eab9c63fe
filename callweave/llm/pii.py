"""Personal information inside free text: find it and replace it with typed placeholders.

Method: a semi-Markov conditional random field. Candidate segments of bounded length are proposed for every type; whole-
span features (form, digit groups, lexicon, case, the words around it) score them, and dynamic programming over the
text chooses boundaries and types jointly. The weights are trained here on texts made up by a grammar (pii_training) by
the log likelihood of the whole segmentation (forward-backward); nothing of the corpus is labelled. How often a word occurs in the corpus is a
feature: it removes no candidate. Nor does the list of given names: every word, and every two or three words side by side,
may be a person.

Distribution: map only; the weights (some thousand numbers) go with the task. A worker remembers the last texts it has
seen, so that texts sent again are decoded once.

Nulls: null and empty texts hold nothing and stay as they are. Texts of any length are decoded whole. A piece is reported once per row and surface form; repeated rows are reported each.
"""

from __future__ import annotations

import math
import random
import re
from collections import ChainMap
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.pii_training import GIVEN, PARTICLES, company_words, frame_words, training_texts

PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "identity_number": "[ID]", "address": "[ADDRESS]", "person": "[NAME]"}
#: Shares of all texts at which a word's grade of frequency rises, the grade from which it is of class k, and the texts that it must occur in at least.
SHARES, COMMON_GRADE, LEAST_TEXTS = (0.0001, 0.0005, 0.002, 0.01), 3, 3
#: In training, the share of other words whose frequency is taken as unknown; the share of texts whose names are of persons named often, and the share of names' words that are then, and else, taken as frequent.
UNKNOWN, NAMED_OFTEN, FREQUENT = 0.05, 0.5, (0.8, 0.1)
#: The share of training texts of which the words around candidates are hidden, so that their own form must tell.
BLIND = 0.3
AROUND = re.compile(r"\|(?:l1|l2|near|r1|r2)=| l1=|\|l=")
TRAINING_TEXTS, EPOCHS = 5_000, 5

# Words for spoken digits, streets, units and titles.
ONES = "zero oh one two three four five six seven eight nine".split()
TEENS = "ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
STREETS = set("street st avenue ave road rd lane ln drive court ct close way place pl boulevard blvd terrace square crescent parkway highway".split())
TITLES = set("dr mr mrs ms miss prof doctor mister".split())
MONTHS_DAYS = set("monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december".split())

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
EMAIL = re.compile(r"[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|[A-Za-z0-9][\w.+-]* ?[(\[] ?at ?[)\]] ?[A-Za-z0-9-]+(?:(?: ?[(\[] ?dot ?[)\]] ?|\.)[A-Za-z0-9-]+)+", re.I)
NUMBER = re.compile(r"(?<![\w.])(?:[A-Z]{1,4}-?)?[+(]?(?:\(?\d+\)?)(?:[ .-]\(?\d+\)?|-\d+)*(?![\w])")
EXTENSION = re.compile(r",? ?(?:ext\.?|extension|x) ?\d{1,6}\b", re.I)
_NAME = r"[^\W\d_][^\W\d_'’-]*(?:[-'’][^\W\d_]+)?"
ADDRESS = re.compile(
    rf"""(?:(?P<flat>(?:Flat|Apt|Apartment|Unit|Suite)\ \d+\w?,\ )?\d{{1,5}}\w?\ (?:[NSEW]\.?\ )?(?:{_NAME}\ ){{1,3}}?(?:Street|St\.?|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Court|Ct|Close|Way|Place|Pl|Boulevard|Blvd|Terrace|Square|Crescent|Parkway|Highway)\b(?:(?<=\bSt)\.)?(?:\.(?=,))?
    |\d{{1,4}}(?:\ ?bis|\ ?ter)?,?\ (?:rue|avenue|boulevard|place|chemin|all[ée]e|quai)\ (?:de\ la\ |de\ l['’]|des\ |du\ |de\ |d['’])?{_NAME}
    |(?:Calle|Avenida|Via|Plaza|Paseo|Rua|ul\.|ulica)\ (?:de\ |del\ |la\ )?{_NAME}(?:\ {_NAME})?\ \d{{1,4}}
    |{_NAME}(?:stra(?:ß|ss)e|str\.|weg|platz|gasse|allee)\ \d{{1,4}}\w?)
    (?:,?\ (?:Unit|Apt|Apartment|Flat|Suite|Ste|No)\.?\ ?\#?\d+\w?)?(?:,\ \d{{1,2}}\s?º\s?\w\b)?(?P<town>,\ (?:\d{{4,5}}\ )?[^\W\d_][^\W\d_'’-]+)?(?P<zip>,\ (?:[A-Z]{{2}}\ )?\d{{4,5}}|\ [A-Z]{{2}}\ \d{{5}})?""",
    re.X,
)
STREET_LAST = re.compile(r"\b(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Court|Ct|Close|Way|Place|Pl|Boulevard|Blvd|Terrace|Square|Crescent|Parkway|Highway)\b")
SENTENCE_END = ".?!;:\n]"


@cache
def _classes() -> dict[str, str]:
    out = {w: "z" for w in ONES} | {w: "t" for w in TEENS} | {w: "y" for w in TENS} | {"double": "b", "triple": "b"}
    out |= {w: "S" for w in STREETS} | {w: "u" for w in ("unit", "apartment", "apt", "flat", "suite")} | {w: "T" for w in TITLES}
    out |= {w: "v" for w in PARTICLES}
    out |= {"at": "a", "dot": "o", "underscore": "_", "dash": "-", "hyphen": "-", "plus": "+"}
    return out


SPOKEN_NUMBER = re.compile(r"i{0,2}(?:[ztyb]){3,}")
SPOKEN_ADDRESS = re.compile(r"(?:n|[zty]{1,4})[wGCUkv]{1,2}[ST](?:u(?:n|[zty]{1,2}))?")
SPOKEN_DOMAIN = re.compile(r"a([wGkCUi]{1,2}(?:-[wGkCUi])*(?:o[wGkCUi])+)")
SPOKEN_LOCAL = [("pair", re.compile(r"[wGCUk][o_\-+][wGCUk]$")), ("chain", re.compile(r"[wGCUki](?:[o_\-+][wGCUki]){2,3}$")), ("initial", re.compile(r"i[wGCUk](?:[ztyn]{1,3})?$")), ("word", re.compile(r"[wGCUk](?:[ztyn]{1,3})?$"))]


class Text:
    """Tokens of a text with classes: z t y b spoken numbers, n digits, i single letter, G given name, C capitalised, U upper case, k common word, v particle of a name, w other word."""

    def __init__(self, text: str, common: dict[str, int]):
        self.text = text
        self.spans = [m.span() for m in TOKEN.finditer(text)]
        self.words = [text[a:b] for a, b in self.spans]
        self.low = [w.lower() for w in self.words]
        known, given = _classes(), _given()
        self.grade = [common.get(l, 0) for l in self.low]
        cls = []
        for w, l, g in zip(self.words, self.low, self.grade):
            if not w[0].isalnum():
                cls.append("'" if w == "’" else w if w in ",.()-#:;/'@" else "~")
            elif w[0].isdigit():
                cls.append("n")
            elif l in known:
                cls.append(known[l])
            elif len(w) == 1:
                cls.append("i")
            elif l in given:
                cls.append("G")
            elif g >= COMMON_GRADE or l in MONTHS_DAYS or l[:-1] in MONTHS_DAYS:
                cls.append("k")
            elif w.isupper():
                cls.append("U")
            elif w[0].isupper():
                cls.append("C")
            else:
                cls.append("w")
        self.cls = "".join(cls)
        self.at = {a: i for i, (a, _) in enumerate(self.spans)}

    def token_after(self, pos: int) -> int:
        """Index of the first token that begins at or after a position."""
        lo, hi = 0, len(self.spans)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.spans[mid][0] < pos:
                lo = mid + 1
            else:
                hi = mid
        return lo


@cache
def _given() -> frozenset[str]:
    return frozenset(GIVEN)


def _digits_said(cls: str, low: list[str]) -> int:
    n, i = 0, 0
    while i < len(cls):
        if cls[i] == "b":
            n += 2 if low[i] == "double" else 3
            i += 2
        elif cls[i] == "y":
            n += 2
            i += 2 if i + 1 < len(cls) and cls[i + 1] == "z" and low[i + 1] not in ("zero", "oh") else 1
        else:
            n += 2 if cls[i] == "t" else 1
            i += 1
    return n


def digits_of(t: Text, i: int, j: int) -> str:
    """The digits of tokens i..j-1, written or said."""
    out, k = "", i
    while k < j:
        c, w = t.cls[k], t.low[k]
        if c == "n":
            out += w
        elif c == "z":
            out += "0" if w == "oh" else str(ONES.index(w) - (ONES.index(w) > 1))
        elif c == "t":
            out += str(10 + TEENS.index(w))
        elif c == "y":
            ten = 2 + TENS.index(w)
            one = k + 1 < j and t.cls[k + 1] == "z" and t.low[k + 1] not in ("zero", "oh")
            out += str(ten) + (str(ONES.index(t.low[k + 1]) - 1) if one else "0")
            k += one
        elif c == "b" and k + 1 < j and t.cls[k + 1] == "z":
            w2 = t.low[k + 1]
            out += ("0" if w2 == "oh" else str(ONES.index(w2) - (ONES.index(w2) > 1))) * (2 if w == "double" else 3)
            k += 1
        k += 1
    return out


def candidates(t: Text) -> list[tuple[int, int, str, str]]:
    """(start, end, type, form) of possible pieces."""
    text, cls, spans, low = t.text, t.cls, t.spans, t.low
    out: set[tuple[int, int, str, str]] = set()
    if "@" in text or "at" in low:
        for m in EMAIL.finditer(text):
            out.add((m.start(), m.end(), "email", "@" if "@" in m[0] else "(at)"))
        for m in SPOKEN_DOMAIN.finditer(cls):
            for name, pattern in SPOKEN_LOCAL:
                for k in range(1, 8):
                    if m.start() - k < 0:
                        break
                    if pattern.fullmatch(cls, m.start() - k, m.start()):
                        ends = {m.end()} | {j for j in range(m.start() + 4, m.end()) if cls[j - 2] == "o"}
                        out.update((spans[m.start() - k][0], spans[e - 1][1], "email", f"said {name}{'' if e == m.end() else ' cut'}") for e in ends)
    for m in NUMBER.finditer(text):
        a, b = m.span()
        while text[b - 1] in " .-(":
            b -= 1
        first = re.match(r"\d{1,3} (?=[\d(+])", text[a:b])  # a short number before may belong to something else
        for x, y in [(a, b), *([(a + first.end(), b)] if first else [])]:
            if text[x] == "(" and (text[y - 1] == ")" or ")" not in text[x:y]):  # the bracket stands around the number
                x, y = x + 1, y - (text[y - 1] == ")")
            elif text[y - 1] == ")" and text.count("(", x, y) < text.count(")", x, y):
                y -= 1
            shape = _shape(text[x:y])
            if sum(c.isdigit() for c in text[x:y]) >= 6:
                out.add((x, y, "identity_number", shape))
                if not text[x].isalpha():
                    out.add((x, y, "phone", shape))
                    e = EXTENSION.match(text, y)
                    if e:
                        out.add((x, e.end(), "phone", shape + " ext"))
    if any(c in cls for c in "zyt"):
        for m in SPOKEN_NUMBER.finditer(cls):
            i, j = m.span()
            first = i
            while cls[first] == "i":
                first += 1
            ends = [x for x in range(first + 1, j) if cls[x - 1] != "b" and _digits_said(cls[first:x], low[first:x]) in (9, 10)] if _digits_said(cls[first:j], low[first:j]) > 14 else []
            # a last digit may belong to what follows ("... seven one moment please")
            short = [(first, j - 1)] if j - first > 3 and cls[j - 1] == "z" and cls[j - 2] != "b" and j < len(cls) else []
            for f, e in [(first, j), *short, *((first, x) for x in ends), *((x, j) for x in ends)]:
                n = _digits_said(cls[f:e], low[f:e])
                for s in range(i, f + 1) if f == first else [f]:
                    out.add((spans[s][0], spans[e - 1][1], "identity_number", f"said {f - s}+{n}"))
                out.add((spans[f][0], spans[e - 1][1], "phone", f"said {n}"))
    if "S" in cls or "T" in cls or any(c.isdigit() for c in text):
        for m in ADDRESS.finditer(text):
            a, b = m.span()
            kind = "flat" if m["flat"] else "before" if not text[a].isdigit() else "after" if STREET_LAST.search(m[0]) else "rue"
            town = "" if not m["town"] else " town" if m["town"].split()[-1][0].isupper() else " word"
            out.add((a, b, "address", f"{kind}{town}{' zip' if m['zip'] else ''}"))
            if m["town"] and not m["zip"]:
                out.add((a, m.start("town"), "address", f"{kind} cut"))
        for m in SPOKEN_ADDRESS.finditer(cls):
            i, j = m.span()
            while cls[i] != "n" and i and cls[i - 1] in "zty":
                i -= 1
            if not all(w.islower() or w.isdigit() for w in t.words[i:j]) or any("\n" in text[spans[x][1] : spans[x + 1][0]] or text[spans[x][1] : spans[x + 1][0]] == "" for x in range(i, j - 1)):
                continue
            out.add((spans[i][0], spans[j - 1][1], "address", "said"))
            if j < len(cls) and cls[j] in "wGk" and text[spans[j - 1][1] : spans[j][0]] == " ":
                out.add((spans[i][0], spans[j][1], "address", "said town"))
    for i, c in enumerate(cls):
        # persons are any word, any two or three side by side, and the forms with initials, commas and dashes
        after_title = i > 0 and (cls[i - 1] == "T" or cls[i - 1] == "." and i > 1 and cls[i - 2] == "T")
        if c in "GCUwk":
            p = spans[i][0]
            out.add((p, spans[i][1], "person", f"{c}{' title' if after_title else ''}"))
            for name, pattern in PERSON:
                m = pattern.match(cls, i)
                if m and _tight(text, spans, i, m.end()) and not (name == "middle" and t.words[i + 1] in ("i", "a")):  # words of their own
                    out.add((p, spans[m.end() - 1][1], "person", f"{name} {m[0]}{' title' if after_title else ''}"))
        elif c in "iv" and (c == "i" or after_title):
            for pattern in FAMILY:
                m = pattern.match(cls, i)
                if m and _tight(text, spans, i, m.end()):
                    out.add((spans[i][0], spans[m.end() - 1][1], "person", f"family {m[0]}{' title' if after_title else ''}"))
        if c == "i" and t.words[i].isupper():
            for pattern in INITIAL:
                m = pattern.match(cls, i)
                if m and _tight(text, spans, i, m.end()):
                    out.add((spans[i][0], spans[m.end() - 1][1], "person", f"initial {m[0]}"))
    return sorted(out, key=lambda x: (x[1], x[0]))


PERSON = [("two", re.compile(r"[GCUwk]{2}")), ("three", re.compile(r"[GCUwk]{3}")), ("middle", re.compile(r"[GCUwk]i\.?[GCUwk]")), ("last first", re.compile(r"[GCUwk],[GCUwk]")), ("two last first", re.compile(r"[GCUwk]{2},[GCUwk]")), ("dashed", re.compile(r"[GCUwk]-[GCUwk]")), ("dashed given", re.compile(r"[GCUwk]{2}-[GCUwk]")), ("dashed first", re.compile(r"[GCUwk]-[GCUwk]{2}")), ("apostrophe", re.compile(r"[GCUwk]i['’][GCUwk]")), ("particle", re.compile(r"[GCUwk]v{1,2}[GCUwk]"))]
INITIAL = [re.compile(r"i\.(?:i\.)?[GCUwk]"), re.compile(r"i\.(?:i\.)?[GCUwk]{2}"), re.compile(r"i\.i['’][GCUwk]")]
#: Family names by themselves that begin with a letter and an apostrophe or with particles.
FAMILY = [re.compile(r"i['’][GCUwk]"), re.compile(r"v{1,2}[GCUwk]")]


def _tight(text: str, spans: list[tuple[int, int]], i: int, j: int) -> bool:
    """Whether the tokens i..j-1 stand side by side with at most one blank between them."""
    return all(spans[x + 1][0] - spans[x][1] <= 1 and text[spans[x][1] : spans[x + 1][0]] in ("", " ") for x in range(i, j - 1))


def _shape(s: str) -> str:
    return re.sub(r"[A-Za-z]+", lambda m: f"A{len(m[0])}", re.sub(r"\d+", lambda m: str(len(m[0])), s))


def _left(t: Text, kind: str, i: int) -> list[str]:
    """Features of what stands before a candidate."""
    a, b, c = ["<s>", "<s>", "<s>", *t.low[max(0, i - 3) : i]][-3:]
    return [f"{kind}|bias", f"{kind}|l1={c}", f"{kind}|l2={b} {c}", *(f"{kind}|near={w}" for w in {a, b, c})]


def _right(t: Text, kind: str, j: int) -> list[str]:
    """Features of what follows a candidate."""
    a, b = [*t.low[j : j + 2], "</s>", "</s>"][:2]
    return [f"{kind}|r1={a}", f"{kind}|r2={a} {b}"]


def _span(t: Text, i: int, j: int, kind: str, form: str) -> list[str]:
    """Features of a candidate itself, also together with its neighbours."""
    low, cls = t.low, t.cls
    left, right = low[i - 1] if i else "<s>", low[j] if j < len(low) else "</s>"
    lc, rc = cls[i - 1] if i else "^", cls[j : j + 1] or "$"
    k = f"{kind}|"
    out = [k + form, f"{k}l={left} r={right}"]
    if kind == "person":
        given = cls.count("G", i, j)
        grades = [g for g, w in zip(t.grade[i:j], low[i:j]) if len(w) > 1]
        starts = i == 0 or t.words[i - 1] in SENTENCE_END
        out += [f"{k}given={min(2, given)}", f"{k}len={j - i}", f"{k}start={starts} {form}", f"{k}rc={rc} {form}", f"{k}lc={lc} {form}"]
        out += [f"{k}first={grades[0]} {cls[i]} {j - i}", f"{k}last={grades[-1]} {cls[j - 1]} {j - i}", f"{k}grades={min(grades)} {max(grades)} {given > 0}", f"{k}{form} l1={left}"]
        firm = company_words()
        out.append(f"{k}firm={sum(w in firm for w in low[i:j])} {right in firm} {j - i}")
        around = [left, *low[i:j], right]
        if any(x == y for x, y in zip(around, around[1:])):  # a word said again and again
            out += [f"{k}again", f"{k}again {form}"]
        if given and j - i <= 2:
            out.append(f"{k}word={low[i]} case={t.words[i][0].isupper()} {cls[i:j]}")
    elif kind == "address":
        out += [f"{k}n={min(8, j - i)}", f"{k}rc={rc}", f"{k}next={cls[j : j + 2]}", f"{k}{form} next={cls[j : j + 2]}"]
        if form.startswith("said"):
            out.append(f"{k}street={max((g for g, c in zip(t.grade[i:j], cls[i:j]) if c in 'wGCUk'), default=0)}")
        if form == "said town":
            out += [f"{k}town={low[j - 1][-4:]}", f"{k}town={t.grade[j - 1]}"]
    else:
        out += [f"{k}{form} l1={left}", f"{k}lc={lc}"]
        if kind in ("phone", "identity_number"):
            d = digits_of(t, i, j)
            n, exchange = min(len(d), 14), "555" in d[3:6]  # 555 is the exchange of numbers that belong to nobody
            out += [f"{k}{form} starts={low[i]}"] if low[i].isalpha() else []
            out += [f"{k}n={n} {exchange}", f"{k}n={n} letters={any(x.isalpha() and len(x) == 1 for x in low[i:j])}", f"{k}n={n} first={d[:1]}"]
        if kind == "email":
            out.append(f"{k}{form} first={cls[i]}{t.grade[i]}")
            if form.startswith("said"):
                domain = [g for g, w in zip(t.grade[i:j], low[i:j])][low[i:j].index("at") + 1 :: 2]
                out += [f"{k}domain={max(domain[:1], default=0)}", f"{k}top={low[j - 1]}"]
    return out


def features(t: Text, cand: tuple[int, int, str, str]) -> list[str]:
    """Whole-span features of a candidate."""
    a, b, kind, form = cand
    i, j = t.token_after(a), t.token_after(b)
    return _left(t, kind, i) + _right(t, kind, j) + _span(t, i, j, kind, form)


class SemiMarkov:
    """Weights of features; scoring, decoding and training over the lattice of candidates."""

    def __init__(self, weights: dict[str, float], common: dict[str, int]):
        self.weights, self.common = weights, common

    def _lattice(self, cands: list[tuple[int, int, str, str]]) -> tuple[list[int], list[int], list[int]]:
        """Border positions, and the borders' numbers of the candidates' starts and ends."""
        borders = sorted({p for c in cands for p in c[:2]})
        at = {p: i for i, p in enumerate(borders)}
        return borders, [at[c[0]] for c in cands], [at[c[1]] for c in cands]

    def decode(self, text: str) -> list[tuple[int, int, str]]:
        """The best segmentation's pieces in order."""
        t = Text(text, self.common)
        cands = candidates(t)
        if not cands:
            return []
        w = self.weights.get
        # what stands before and after is scored once per token and type
        total = lambda fs: sum([w(f, 0.0) for f in fs])
        first, after = {a: i for i, (a, _) in enumerate(t.spans)}, {b: i + 1 for i, (_, b) in enumerate(t.spans)}
        ahead: dict[tuple[str, int], float] = {}
        behind: dict[tuple[str, int], float] = {}
        scored = []
        for c in cands:
            a, b, kind, form = c
            i, j = first[a] if a in first else t.token_after(a), after[b] if b in after else t.token_after(b)
            if (kind, i) not in ahead:
                ahead[kind, i] = total(_left(t, kind, i))
            if (kind, j) not in behind:
                behind[kind, j] = total(_right(t, kind, j))
            if (s := ahead[kind, i] + behind[kind, j] + total(_span(t, i, j, kind, form))) > 0:
                scored.append((c, s))
        if not scored:
            return []
        _, starts, ends = self._lattice([c for c, _ in scored])
        n = max(ends) + 1
        best, back = [0.0] * n, [-1] * n
        by_end: dict[int, list[int]] = {}
        for k, e in enumerate(ends):
            by_end.setdefault(e, []).append(k)
        for p in range(n):
            if p:
                best[p] = best[p - 1]
            for k in by_end.get(p, ()):
                s = best[starts[k]] + scored[k][1]
                if s > best[p]:
                    best[p], back[p] = s, k
        out, p = [], n - 1
        while p > 0:
            k = back[p]
            if k >= 0:
                out.append(scored[k][0][:3])
                p = starts[k]
            else:
                p -= 1
        return out[::-1]

    @classmethod
    def train(cls, common: dict[str, int] | None = None, n: int = TRAINING_TEXTS, epochs: int = EPOCHS, seed: int = 11) -> SemiMarkov:
        """Stochastic gradient ascent (AdaGrad) on the conditional log likelihood of the segmentations. Some words' frequencies are changed by chance, so that context decides where frequency misleads."""
        common = dict.fromkeys(frame_words() - _given(), COMMON_GRADE) | (common or {})
        model, rows, number, r = cls({}, common), [], {}, random.Random(seed)
        for pieces in training_texts(n, seed):
            text, gold, changed = "", set(), {}
            frequent = FREQUENT[0] if r.random() < NAMED_OFTEN else FREQUENT[1]
            for piece, kind in pieces:
                if kind:
                    gold.add((len(text), len(text) + len(piece), kind))
                for w in re.findall(r"[^\W\d_]+", piece.lower()):
                    if w not in changed and r.random() < (frequent if kind else UNKNOWN):
                        changed[w] = r.choice((1, 1, 2, 2, 3)) if kind else 0
                text += piece
            t = Text(text, ChainMap(changed, common))
            cands = candidates(t)
            if cands:
                blind = r.random() < BLIND
                feats = [[number.setdefault(f, len(number)) for f in features(t, c) if not (blind and AROUND.search(f))] for c in cands]
                sizes = [len(f) for f in feats]
                rows.append((model._lattice(cands), np.concatenate([np.array(f) for f in feats]), np.cumsum([0, *sizes[:-1]]), np.array(sizes), np.array([(c[0], c[1], c[2]) in gold for c in cands], float)))
        w, sq = np.zeros(len(number)), np.ones(len(number))
        for _ in range(epochs):
            for (borders, starts, ends), flat, at, sizes, is_gold in rows:
                scores = np.add.reduceat(w[flat], at).tolist()
                n_pos = len(borders)
                ahead, behind = [0.0] * n_pos, [0.0] * n_pos
                by_end: list[list[int]] = [[] for _ in borders]
                by_start: list[list[int]] = [[] for _ in borders]
                for k, (s, e) in enumerate(zip(starts, ends)):
                    by_end[e].append(k)
                    by_start[s].append(k)
                for p in range(1, n_pos):
                    ahead[p] = _log_sum([ahead[p - 1], *(ahead[starts[k]] + scores[k] for k in by_end[p])])
                for p in range(n_pos - 2, -1, -1):
                    behind[p] = _log_sum([behind[p + 1], *(behind[ends[k]] + scores[k] for k in by_start[p])])
                expected = np.exp(np.minimum(0.0, [ahead[s] + x + behind[e] - ahead[-1] for s, e, x in zip(starts, ends, scores)]))
                g = is_gold - expected
                g[np.abs(g) < 1e-3] = 0.0
                if g.any():
                    used, where = np.unique(flat, return_inverse=True)
                    each = np.repeat(g, sizes)
                    step, square = np.bincount(where, each), np.bincount(where, each * each)
                    sq[used] += square
                    w[used] = w[used] * np.where(square > 0, 0.9995, 1.0) + 0.5 * step / np.sqrt(sq[used])
        model.weights = {f: float(w[i]) for f, i in number.items() if abs(w[i]) > 1e-2}
        return model


def _log_sum(xs: list[float]) -> float:
    m = max(xs)
    return m + math.log(sum(math.exp(x - m) for x in xs))


def common_words(texts: list[DataFrame]) -> dict[str, int]:
    """Grades of frequency (1 .. len(SHARES)) of the words that occur, not capitalised, in at least SHARES[0] of all texts, each counted whole. At most the words of a text / SHARES[0] rows reach the driver."""
    rows = reduce(DataFrame.unionByName, [df.select(F.col(df.columns[0]).alias("t")) for df in texts]).filter("t != ''")
    words = rows.select(F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(r"(\p{L}{2,})")))).alias("w")).filter("w = lower(w)")
    n = rows.count()
    got = words.groupBy("w").count().filter(F.col("count") >= max(LEAST_TEXTS, SHARES[0] * n)).collect()
    return {r["w"]: sum(r["count"] >= x * n for x in SHARES) for r in got}


class Remembering:
    """A model with the results of the last texts."""

    def __init__(self, model: SemiMarkov, most: int = 100_000):
        self.model, self.most, self.seen = model, most, {}

    def __call__(self, text: str | None) -> list[tuple[int, int, str]]:
        if not text:
            return []
        got = self.seen.get(text)
        if got is None:
            got = self.model.decode(text)
            if len(text) <= 2_000:
                if len(self.seen) >= self.most:
                    self.seen.clear()
                self.seen[text] = got
        return got


_WORKER: dict[str, Remembering] = {}


def _worker(key: str, model: SemiMarkov) -> Remembering:
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Remembering(model)
    return _WORKER[key]


def _key(model: SemiMarkov) -> str:
    return str(hash((len(model.weights), round(sum(model.weights.values()), 9), len(model.common))))


def redact(text: str | None, pieces: list[tuple[int, int, str]]) -> str | None:
    """The text with the pieces replaced by their placeholders."""
    if not pieces:
        return text
    out, at = [], 0
    for a, b, kind in pieces:
        out += [text[at:a], PLACEHOLDERS[kind]]
        at = b
    return "".join(out) + text[at:]


def find_personal(rows: DataFrame, model: SemiMarkov) -> DataFrame:
    """rows: (source_table, row_id, text) to (source_table, row_id, pii_type, pii_text), once per row and surface form."""
    key = _key(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = _worker(key, model)
        for batch in batches:
            out = []
            for table, row, text in zip(batch["source_table"], batch["row_id"], batch["text"]):
                if text:
                    for kind, piece in dict.fromkeys((kind, text[a:b]) for a, b, kind in find(text)):
                        out.append((table, row, kind, piece))
            yield pd.DataFrame(out, columns=["source_table", "row_id", "pii_type", "pii_text"])

    return rows.filter(F.col("text") != "").mapInPandas(run, "source_table string, row_id bigint, pii_type string, pii_text string")


def redact_rows(rows: DataFrame, model: SemiMarkov) -> DataFrame:
    """rows: (source_table, row_id, text) to the same with pieces replaced by placeholders."""
    key = _key(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = _worker(key, model)
        for batch in batches:
            yield batch.assign(text=[redact(t, find(t)) for t in batch["text"]])

    return rows.select("source_table", "row_id", "text").mapInPandas(run, "source_table string, row_id bigint, text string")


def text_rows(gold_turns: DataFrame, semantic_obs: DataFrame, labeler_segments: DataFrame) -> DataFrame:
    """The three tables' texts as (source_table, row_id, text)."""
    pick = lambda df, name, key, text: df.select(F.lit(name).alias("source_table"), F.col(key).cast("bigint").alias("row_id"), F.col(text).alias("text"))
    return pick(gold_turns, "gold_turns", "turn_id", "text").unionByName(pick(semantic_obs, "semantic_obs", "obs_id", "text")).unionByName(pick(labeler_segments, "labeler_segments", "seg_id", "evidence"))


def fit_model(texts: list[DataFrame]) -> SemiMarkov:
    return SemiMarkov.train(common_words(texts))
