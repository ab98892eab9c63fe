"""Text that was decoded with a wrong character encoding: find the affected records and restore what can be restored.

Method: a multinomial classifier over hashed byte bigrams is trained on clean segments of the corpus and on the same
segments garbled through every encoding chain of CHAINS. It predicts the exact chain of a segment (a line or sentence
with a non-ASCII character); the chain is inverted and must be strictly decodable and more plausible as clean text than
what stood there. Replacement characters mark text whose loss cannot be undone: found, not restored.

Every chain within MARGIN of clean text is tried. What a segment as a whole does not explain is tried word by word, with
every chain and the same strict check, so a garbled word among clean ones is found as well.

Distribution: one pass over all texts, whole, counts the character pairs of all clean segments (a table of 2 ** PAIR_BITS
cells, summed before and after the shuffle) and takes the sample on which the classifier is trained: the SEGMENTS distinct
segments of smallest hash, of which every task sends at most SEGMENTS. The model has 2 ** HASH_BITS weights per chain
and 2 ** PAIR_BITS for pairs (about 6 MB) and goes to the workers with the task. A second pass scans; it is map only.

Nulls: null and empty texts and pure ASCII texts are no cases and are not sent to Python. Texts of any length are read
whole. Repeated rows are judged each by itself. With no usable training text nothing but replacement characters is found.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.session import cut

HASH_BITS = 14
#: Distinct clean segments (apart from digits) that are garbled for training, at most.
SEGMENTS = 5_000
PAIR_BITS = 18
#: Chains whose log likelihood is at most this far below clean text are still tried; the strict check decides.
MARGIN = 5.0
#: Plausibility (nats) that a restored segment must gain: per character pair and altogether; of chains from UTF-8 the least.
GAIN_EACH, GAIN, GAIN_UTF8 = 1.0, 4.0, -0.5
#: What a word by itself must gain altogether, of chains between encodings of one byte and of chains from UTF-8.
GAIN_WORD, GAIN_WORD_UTF8 = 9.0, 0.0
#: Segments and words that a worker remembers.
REMEMBERED = 100_000
NON_ASCII = r"[^\x00-\x7f]"

# Fixed values: (encoding the text was in, encoding it was read as), one pair per step.
CHAINS: tuple[tuple[tuple[str, str], ...], ...] = (
    *((("utf-8", x),) for x in ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "cp866", "mac_roman", "koi8-r", "iso8859-2", "cp1254")),
    *((("utf-8", x), ("utf-8", y)) for x, y in (("cp1252", "cp1252"), ("latin-1", "cp1252"), ("cp1252", "latin-1"), ("latin-1", "latin-1"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1251", "cp1251"))),
    (("utf-8", "cp1252"), ("utf-8", "cp1252"), ("utf-8", "cp1252")),
    *((("cp1252", x),) for x in ("mac_roman", "cp850", "cp437", "cp1250", "cp1251", "koi8-r")),
    *((("mac_roman", x),) for x in ("cp1252", "latin-1")),
    *((("cp850", x),) for x in ("cp1252", "latin-1")),
    *((("cp437", x),) for x in ("cp1252", "latin-1")),
    *((("cp1250", x),) for x in ("cp1252", "latin-1", "iso8859-2", "cp852", "cp1251")),
    *((("iso8859-2", x),) for x in ("cp1250", "cp1252", "latin-1")),
    (("cp852", "cp1250"),), (("cp852", "cp1252"),),
    *((("cp1251", x),) for x in ("cp1252", "latin-1", "koi8-r", "cp866", "mac_cyrillic")),
    *((("koi8-r", x),) for x in ("cp1251", "cp1252", "latin-1", "cp866")),
    *((("cp866", x),) for x in ("cp1251", "cp1252", "latin-1")),
)

SEGMENT = re.compile(r"[^\n]*?(?:[.!?…](?=\s)|\n|$)\s*")
HIGH = re.compile(NON_ASCII)
WORD = re.compile(r"(\s+)")
CONTROL = re.compile("[\x80-\x9f]")
#: A non-ASCII character by itself: UTF-8 read as anything else never leaves one, for its characters have two bytes or more.
ALONE = re.compile(r"(?<![^\x00-\x7f])[^\x00-\x7f](?![^\x00-\x7f])")
FROM_UTF8 = [chain[-1][0] == "utf-8" for chain in CHAINS]
DIGIT = re.compile("[0-9]")


@cache
def _tables(codec: str) -> tuple[tuple[str, ...], dict[str, int]]:
    """Characters of the 256 bytes of a single-byte encoding (undefined bytes are read as control characters), and the inverse."""
    chars = tuple(bytes([b]).decode(codec, "ignore") or chr(b) for b in range(256))
    back: dict[str, int] = {}
    for b, c in enumerate(chars):
        back.setdefault(c, b)
    return chars, back


def to_bytes(text: str, codec: str) -> bytes | None:
    """Strict encoding, None where the text does not fit."""
    try:
        if codec == "utf-8":
            return text.encode("utf-8")
        try:
            return text.encode(codec)
        except UnicodeEncodeError:
            # bytes that the encoding leaves undefined stand as control characters
            return bytes(map(_tables(codec)[1].__getitem__, text)) if CONTROL.search(text) else None
    except (KeyError, UnicodeEncodeError):
        return None


def from_bytes(data: bytes, codec: str) -> str | None:
    """Strict decoding, None where the bytes do not fit."""
    try:
        return data.decode(codec)
    except UnicodeDecodeError:
        return None if codec == "utf-8" else "".join(map(_tables(codec)[0].__getitem__, data))


def garble(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The text after the chain, None where it does not fit the first encoding."""
    for right, wrong in chain:
        data = to_bytes(text, right)
        if data is None:
            return None
        text = from_bytes(data, wrong)
    return text


def restore(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The text before the chain, None unless every step decodes strictly."""
    for right, wrong in reversed(chain):
        data = to_bytes(text, wrong)
        text = None if data is None else from_bytes(data, right)
        if text is None:
            return None
    return text


def segments(text: str) -> list[str]:
    """Lines and sentences that together make the text."""
    return [s for s in SEGMENT.findall(text) if s]


def _bigrams(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the byte bigrams that touch a non-ASCII byte, and the number of the part of each; parts begin and end with a blank byte."""
    data = np.frombuffer(b" " + b" ".join(p.encode("utf-8", "surrogatepass") for p in parts) + b" ", np.uint8).astype(np.int64)
    sizes = np.array([len(p.encode("utf-8", "surrogatepass")) + 1 for p in parts])
    owner = np.repeat(np.arange(len(parts)), sizes)
    a, b = data[:-1], data[1:]
    # digits are one class: which digit stands beside a character says nothing
    fold = lambda x: np.where((x >= 48) & (x <= 57), 48, x)
    near = (a > 127) | (b > 127)
    # the byte before joins the hash where it is part of the same character, so a bigram of trailing bytes knows its script
    before = np.r_[0, data[:-2]]
    lead = np.where((a >= 128) & (a < 192) & (before > 127), before, 0)
    code = (fold(a) * 256 + fold(b)) * 257 + lead
    return (code[near] * 2654435761 >> 7) & ((1 << HASH_BITS) - 1), owner[near]


def _pairs(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the pairs of neighbouring characters with a non-ASCII one, case folded and digits as one, and the number of the part of each."""
    folded = [p.lower() for p in parts]
    data = np.frombuffer((" " + " ".join(folded) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(parts)), [len(p) + 1 for p in folded])
    data = np.where((data >= 48) & (data <= 57), 48, data)
    a, b = data[:-1], data[1:]
    near = (a > 127) | (b > 127)
    return ((a * 1114111 + b)[near] * 2654435761 >> 9) & ((1 << PAIR_BITS) - 1), owner[near]


class ChainClassifier:
    """Class 0 is clean text, class i + 1 is CHAINS[i]. Plausibility is judged by pairs of neighbouring characters of clean text, case folded."""

    def __init__(self, logs: np.ndarray, pairs: np.ndarray):
        self.logs, self.pairs = logs, pairs
        # what was found before: of segments, and of words
        self.segments: dict[str, Found] = {}
        self.words: dict[str, tuple[int, str] | None] = {}

    @classmethod
    def fit(cls, seen: dict[str, int], pairs: dict[int, int] | None = None) -> ChainClassifier | None:
        """seen: clean segments (digits made one) with how often they occur; pairs: counts of character pairs of all clean text by cell, of seen if they are not given."""
        if not seen:
            return None
        parts, weights = list(seen), np.array(list(seen.values()), float)

        def count(texts: list[str], weights: np.ndarray) -> np.ndarray:
            code, owner = _bigrams(texts)
            return np.bincount(code, weights[owner], 1 << HASH_BITS)

        counts = np.zeros((len(CHAINS) + 1, 1 << HASH_BITS))
        counts[0] = count(parts, weights)
        for i, chain in enumerate(CHAINS):
            made = [(g, w) for s, w in zip(parts, weights) if (g := garble(s, chain)) is not None and g != s]
            if made:
                counts[i + 1] = count([g for g, _ in made], np.array([w for _, w in made]))
        share = counts / np.maximum(counts.sum(1, keepdims=True), 1)
        n = np.zeros(1 << PAIR_BITS)
        if pairs is None:
            code, owner = _pairs(parts)
            n += np.bincount(code, weights[owner], 1 << PAIR_BITS)
        else:
            n[list(pairs)] = list(pairs.values())
        return cls(np.log(share + 1e-6).astype(np.float32), np.log((n + 0.02) / (n.sum() + 1)).astype(np.float32))

    def scores(self, parts: list[str]) -> np.ndarray:
        """Log likelihoods (parts, classes)."""
        code, owner = _bigrams(parts)
        out = np.zeros((len(parts), self.logs.shape[0]), np.float32)
        if len(code):
            at = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            out[owner[at]] = np.add.reduceat(self.logs.T[code], at, axis=0)
        return out

    def plausible(self, parts: list[str]) -> np.ndarray:
        """Mean log frequency of the character pairs that hold a non-ASCII character; 0 for parts without any."""
        code, owner = _pairs(parts)
        n = np.bincount(owner, minlength=len(parts))
        return np.bincount(owner, self.pairs[code], len(parts)) / np.maximum(n, 1)


def decodes(text: str, chain: tuple[tuple[str, str], ...]) -> bool:
    got = restore(text, chain)
    return got is not None and got != text


def _tried(parts: list[str], model: ChainClassifier) -> list[tuple[int, int, str, float]]:
    """(part, chain, restored text, gain in plausibility) of every chain that is likely enough and inverts strictly."""
    scores, before = model.scores([p.strip() for p in parts]), model.plausible([p.strip() for p in parts])
    i, k = np.nonzero(scores[:, 1:] > scores[:, :1] - MARGIN)
    alone = [ALONE.search(p) is not None for p in parts]
    todo = [(i, k, got) for i, k in zip(i.tolist(), k.tolist()) if not (FROM_UTF8[k] and alone[i]) and (got := restore(parts[i], CHAINS[k])) is not None and got != parts[i]]
    after = model.plausible([t.strip() for _, _, t in todo]) if todo else []
    return [(i, k, text, float(now - before[i])) for (i, k, text), now in zip(todo, after)]


def _best(parts: list[str], tried: list[tuple[int, int, str, float]], least: float, least_utf8: float) -> dict[int, tuple[int, str]]:
    """Of what was tried on each part, the chain that gains most and enough; least: the gain needed altogether, of chains from UTF-8 per pair."""
    gains: dict[int, float] = {}
    out: dict[int, tuple[int, str]] = {}
    for i, k, text, gain in tried:
        # a strict decoding of UTF-8 is strong evidence by itself; one byte fits any other
        enough = gain > least_utf8 if CHAINS[k][0][0] == "utf-8" else gain >= GAIN_EACH and gain * len(HIGH.findall(parts[i])) >= least
        if enough and gain > gains.get(i, -1e9) + 1e-6:
            gains[i], out[i] = gain, (k, text)
    return out


Found = tuple[list[int], str] | None


def repair(parts: list[str], model: ChainClassifier) -> list[Found]:
    """For segments: the numbers of the chains and the restored segment, None for clean ones. A segment that no chain explains as a whole is repaired word by word. Segments and words that were seen before are remembered by the model."""
    known, fixed = model.segments, model.words
    new = [p for p in dict.fromkeys(parts) if p not in known]
    whole = _best(new, _tried(new, model), GAIN, GAIN_UTF8) if new else {}
    # a segment of one word was tried already
    split = {i: ws for i, p in enumerate(new) if i not in whole and (ws := [w for w in p.split() if not w.isascii()]) and ws != [p.strip()]}
    words = [w for w in dict.fromkeys(w for ws in split.values() for w in ws) if w not in fixed]
    if words:
        best = _best(words, _tried(words, model), GAIN_WORD, GAIN_WORD_UTF8)
        fixed.update((w, best.get(j)) for j, w in enumerate(words))
    for i, p in enumerate(new):
        found = [] if i in whole else [f for w in split.get(i, ()) if (f := fixed[w])]
        if i in whole:
            known[p] = ([whole[i][0]], whole[i][1])
        elif found:
            known[p] = (sorted({k for k, _ in found}), "".join(f[1] if (f := fixed.get(w)) else w for w in WORD.split(p)))
        else:
            known[p] = None
    out = [known[p] for p in parts]
    for memory in (known, fixed):
        if len(memory) > REMEMBERED:
            memory.clear()
    return out


def scan(texts: list[str], model: ChainClassifier | None) -> list[tuple[bool, bool, str, str]]:
    """Per text: garbled, restorable (nothing lost), the chains found, the text with garbled segments restored."""
    pieces = [segments(t) if t and not t.isascii() else [] for t in texts]
    flat = [(i, j) for i, parts in enumerate(pieces) for j, s in enumerate(parts) if not s.isascii()]
    found = repair([pieces[i][j] for i, j in flat], model) if model and flat else [None] * len(flat)
    chains: list[set[int]] = [set() for _ in texts]
    for (i, j), got in zip(flat, found):
        if got is not None:
            chains[i].update(got[0])
            pieces[i][j] = got[1]
    out = []
    for t, parts, ks in zip(texts, pieces, chains):
        lost = bool(t) and "�" in t
        names = sorted(" ".join(f"{a}>{b}" for a, b in CHAINS[k]) for k in ks) + ["lost"] * lost
        out.append((bool(ks) or lost, bool(ks) and not lost, ", ".join(names), "".join(parts) if ks else t))
    return out


_UTF8 = [c for c in CHAINS if len(c) == 1 and c[0][0] == "utf-8"]


def clean(segment: str) -> bool:
    """Whether a segment may be trained on: nothing lost, no control characters, no UTF-8 read as something else."""
    return "\ufffd" not in segment and not CONTROL.search(segment) and (ALONE.search(segment) is not None or not any(decodes(segment, c) for c in _UTF8))


def key_of(segment: str) -> int:
    return int.from_bytes(hashlib.blake2b(segment.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


class Survey:
    """What a task learns of clean text: counts of the character pairs of all segments, and the distinct segments of smallest key with their counts."""

    def __init__(self, most: int = SEGMENTS):
        self.most, self.pairs = most, np.zeros(1 << PAIR_BITS, np.int64)
        self.kept: dict[str, tuple[int, int]] = {}
        self.limit = 1 << 63
        self.verdicts: dict[str, bool] = {}

    def add(self, texts: list[str | None]) -> None:
        found = Counter(DIGIT.sub("0", s.strip()) for t, m in Counter(t for t in texts if t).items() for s in segments(t) * m if not s.isascii())
        good = {s: n for s, n in found.items() if self.judged(s)}
        if not good:
            return
        code, owner = _pairs(list(good))
        self.pairs += np.bincount(code, np.array(list(good.values()), float)[owner], 1 << PAIR_BITS).astype(np.int64)
        for s, n in good.items():
            key, before = self.kept.get(s) or (key_of(s), 0)
            if key < self.limit:
                self.kept[s] = (key, before + n)
        if len(self.kept) > 2 * self.most:
            self.shrink()

    def judged(self, segment: str) -> bool:
        got = self.verdicts.get(segment)
        if got is None:
            if len(self.verdicts) >= REMEMBERED:
                self.verdicts.clear()
            got = self.verdicts[segment] = clean(segment)
        return got

    def shrink(self) -> None:
        """Keep the smallest keys. What is left out has a larger key than all that is kept, so counts of what is kept are whole."""
        self.kept = dict(sorted(self.kept.items(), key=lambda x: (x[1][0], x[0]))[: self.most])
        if len(self.kept) == self.most:
            self.limit = max(k for k, _ in self.kept.values())

    def rows(self) -> pd.DataFrame:
        self.shrink()
        cells = np.flatnonzero(self.pairs)
        keys, counts = [k for k, _ in self.kept.values()], [n for _, n in self.kept.values()]
        return pd.DataFrame({"cell": [*cells, *[-1] * len(keys)], "key": [*[0] * len(cells), *keys], "segment": [*[""] * len(cells), *self.kept], "n": [*self.pairs[cells], *counts]})


def fit_model(documents: DataFrame, text: str = "text", most: int = SEGMENTS) -> ChainClassifier | None:
    """The classifier, trained on at most `most` distinct segments, with the pair counts of all clean text. At most 2 ** PAIR_BITS cells and `most` segments reach the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        survey = Survey(most)
        for batch in batches:
            survey.add(batch["t"].tolist())
        yield survey.rows()

    rows = documents.filter(F.col(text).rlike(NON_ASCII)).select(F.col(text).alias("t")).mapInPandas(run, "cell bigint, key bigint, segment string, n bigint")
    got = cut(rows.groupBy("cell", "key", "segment").agg(F.sum("n").alias("n")))
    pairs = {r["cell"]: r["n"] for r in got.filter("cell >= 0").select("cell", "n").collect()}
    seen = {r["segment"]: r["n"] for r in got.filter("cell < 0").orderBy("key", "segment").limit(most).collect()}
    return ChainClassifier.fit(seen, pairs)


def restore_encoding(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = SEGMENTS) -> DataFrame:
    """(doc_id, garbled, restorable, chains, restored) for every document with a non-ASCII character; the others cannot be garbled."""
    model = fit_model(documents, text, most)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                got = scan(part["text"].tolist(), model)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), **{n: [g[k] for g in got] for k, n in enumerate(("garbled", "restorable", "chains", "restored"))}})

    rows = documents.filter(F.col(text).rlike(NON_ASCII)).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, "doc_id bigint, garbled boolean, restorable boolean, chains string, restored string")


def garbled_documents(documents: DataFrame) -> DataFrame:
    """p10_found: (doc_id) of every garbled document, once; only the ids of garbled documents are shuffled."""
    return restore_encoding(documents).filter("garbled").select("doc_id").distinct()
