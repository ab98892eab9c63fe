"""Encoding a corpus with a public byte-level BPE tokenizer.

Method: prefix-sharing trie traversal. The distinct words of a batch are inserted into a trie of bytes; in depth-first
order every node gets the last token of the encoding of its prefix, found from the state of the node that many bytes
above, so encodings of shared prefixes are computed once. A word's ids are read off by following last tokens upwards.

Two tokens may stand next to each other if byte-pair merging of their joined bytes would not cross the border between
them; an encoding is right exactly when all its neighbours may.

Distribution: map only, no shuffle; each worker keeps its trie and its dictionary of words between batches, up to a
bound after which they start anew.

Nulls: null and empty texts give an empty list. What looks like a special token is plain text. Texts of any length are
encoded whole. Repeated rows are encoded as often as they occur.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the public tokenizer cuts text into words before merging.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MOST_WORDS, MOST_NODES = 200_000, 400_000


class TrieEncoder:
    """Encodes words over a vocabulary of ranks (a token's id is its rank; lower ranks merge first)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = ranks
        self.longest = max(map(len, ranks), default=1)
        self.size = {i: len(b) for b, i in ranks.items()}
        self.halves = self._halves(ranks)
        self.joined = {pair: i for i, pair in self.halves.items() if pair}
        self._fits: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self._clear_trie()

    @classmethod
    def from_file(cls, path: str) -> TrieEncoder:
        lines = Path(path).read_bytes().splitlines()
        return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())})

    @staticmethod
    def _halves(ranks: dict[bytes, int]) -> dict[int, tuple[int, int] | None]:
        """The two tokens each token is merged from: what merging its bytes with lower ranks only leaves."""
        out: dict[int, tuple[int, int] | None] = {}
        for token, rank in ranks.items():
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
                if ranks.get(parts[best] + parts[best + 1], 1 << 60) >= rank:
                    break
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            out[rank] = (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else None
        return out

    def _clear_trie(self) -> None:
        self._child: dict[int, int] = {}
        self._last: list[int] = [-1]

    def fit(self, left: int, right: int) -> bool:
        """Whether left and right stay two tokens: no merge across their border comes before the merges that made them."""
        got = self._fits.get((left, right))
        if got is None:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            got = self._fits[left, right] = self._stay(left, right)
        return got

    def _stay(self, left: int, right: int) -> bool:
        # walk back in time: undo the later of the two merges and look whether the border pair would have merged before it
        before = 1 << 60
        while True:
            across = self.joined.get((left, right))
            if across is not None and across < before:
                return False
            a, b = self.halves[left], self.halves[right]
            # of equal ranks (one token twice) the merge on the left is done first, so the right one is undone first
            if a is not None and (b is None or left > right):
                before, left = left, a[1]
            elif b is not None:
                # a border merge of the right token's own rank would have come first, being further left
                before, right = right + 1, b[0]
            else:
                return True

    def _insert(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of words in sorted order: a depth-first walk that keeps the path of nodes shared with the word before."""
        child, last, ids, size = self._child, self._last, self.ids, self.size
        path, before, out = [0], b"", []
        for word in words:
            n, shared = len(word), 0
            for shared in range(min(n, len(before)) + 1):
                if shared == min(n, len(before)) or word[shared] != before[shared]:
                    break
            del path[shared + 1 :]
            for d in range(shared, n):
                key = path[d] << 8 | word[d]
                node = child.get(key)
                if node is None:
                    node = child[key] = len(last)
                    end = d + 1
                    for start in range(max(0, end - self.longest), end):
                        token = ids.get(word[start:end])
                        if token is not None and (start == 0 or self.fit(last[path[start]], token)):
                            last.append(token)
                            break
                path.append(node)
            got, d = [], n
            while d:
                token = last[path[d]]
                got.append(token)
                d -= size[token]
            out.append(tuple(reversed(got)))
            before = word
        return out

    def learn(self, words: set[str]) -> None:
        """Make sure that self.words holds all of words."""
        if len(self.words) + len(words) > MOST_WORDS:
            self.words.clear()
        new = [w for w in words if w not in self.words]
        if not new:
            return
        if len(self._last) > MOST_NODES:
            self._clear_trie()
        coded = sorted((w.encode("utf-8"), w) for w in new)
        for (_, w), got in zip(coded, self._insert([b for b, _ in coded])):
            self.words[w] = got

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of texts."""
        import regex

        cut = regex.compile(WORDS).findall
        out: list[list[int]] = []
        for at in range(0, len(texts), 256):
            split = [cut(t) if t else [] for t in texts[at : at + 256]]
            self.learn(set().union(*map(set, split)))
            words = self.words
            out.extend(list(chain.from_iterable(map(words.__getitem__, s))) for s in split)
        return out


_ENCODERS: dict[str, TrieEncoder] = {}


def worker_encoder(path: str) -> TrieEncoder:
    """The worker's encoder for a vocabulary file, kept between batches and tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieEncoder.from_file(path)
    return _ENCODERS[path]


def encode_corpus(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): the token ids of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary)
        for batch in batches:
            # small slices bound the memory that very long texts take
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids = encoder.encode_batch(part.column(1).to_pylist())
                offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "ids"])

    return documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def count_tokens(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens): sizes only, so that no ids leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                n = [len(x) for x in encoder.encode_batch(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, n_tokens bigint")
