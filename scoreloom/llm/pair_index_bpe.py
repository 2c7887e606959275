"""BPE encoding over a pair occurrence index, and decoding.

The distinct words of a batch that the worker has not met yet lie end to end in one array. Each pair
of neighbours maps to all its positions there; active ranks are applied in ascending order, each to
all its positions at once, and the lists of the pairs that a merge makes are extended.

Defined cases: a null text counts as empty (no tokens); special tokens' strings in a text become
their ids, as in the tokenizers library; repeated rows, null doc_ids and extra columns are carried
or ignored row by row; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.residual_packing import byte_alphabet

#: Remembered words of a worker process, in each of two generations.
REMEMBERED = 150_000
#: Characters that are split and encoded together.
SLICE_CHARS = 4_000_000


class PairIndex:
    """The merges of a BPE model as arrays, applied to many words together."""

    def __init__(self, merges: list[tuple[str, str]], vocab: dict[str, int]) -> None:
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.left, self.right, self.made = left, right, made

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of each pair; -1 if it never merges."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def merge(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words that begin at starts, merged; their ids and the words' new starts."""
        n = len(symbols)
        symbols = np.append(symbols, -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        word = np.zeros(n + 1, np.int64)
        word[starts[1:]] = 1
        word = np.cumsum(word)
        word[n] = -1
        alive = np.ones(n + 1, bool)
        where: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def extend(at: np.ndarray) -> None:
            """Adds pairs that begin at these positions to their lists."""
            to = after[at]
            at = at[(to < n) & (word[np.minimum(to, n)] == word[at])]
            rank = self.rank(symbols[at], symbols[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.append(0, cuts)].tolist(), np.split(at, cuts)):
                if r not in where:
                    where[r] = []
                    heapq.heappush(ranks, r)
                where[r].append(part)

        extend(np.arange(n))
        while ranks:
            r = heapq.heappop(ranks)
            at = np.unique(np.concatenate(where.pop(r)))
            a, b = self.left[r], self.right[r]
            to = after[at]
            at = at[alive[at] & (symbols[at] == a) & (to < n) & (symbols[np.minimum(to, n)] == b)]
            at = at[word[after[at]] == word[at]]
            if a == b and len(at) > 1:
                # Of overlapping pairs the leftmost merges.
                taken, keep = -1, []
                for p in at.tolist():
                    if p != taken:
                        keep.append(p)
                        taken = int(after[p])
                at = np.array(keep, np.int64)
            if not len(at):
                continue
            gone = after[at]
            symbols[at] = self.made[r]
            alive[gone] = False
            after[at] = after[gone]
            inside = at[after[at] <= n]
            before[after[inside]] = inside
            left = before[at]
            extend(np.unique(np.concatenate([at, left[left >= 0]])))
        alive[n] = False
        kept = np.flatnonzero(alive)
        return symbols[kept], np.searchsorted(kept, starts)


class WordTokenizer:
    """A BPE file with word ends and a byte-level alphabet: ids of whole texts and back."""

    #: Characters on which this class normalizes and splits as the library does.
    PLAIN = re.compile(r"[^\t\n\v\f\r\x20-\x7e¡-©«-±´-¸»¿-įĲ-ňŊ-ž]")
    WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        model = json.loads(self.whole.to_str())["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        self.index = PairIndex([tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]], vocab)
        self.special = {t.content: k for k, t in self.whole.get_added_tokens_decoder().items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        token = {k: t for t, k in (vocab | self.special).items()}
        self.token = [token.get(k, "") for k in range(max(token) + 1)]
        chars = {b: c for c, b in byte_alphabet().items()}
        self.inner = np.array([vocab.get(chars[b], -1) for b in range(256)], np.int64)
        self.last = np.array([vocab.get(chars[b] + self.suffix, -1) for b in range(256)], np.int64)
        self.chars = chars
        self.ids: dict[str, bytes] = {}
        self.texts: dict[str, bytes] = {}
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        for s, k in self.special.items():
            self._special(s, k)

    def _special(self, s: str, k: int) -> None:
        self.ids["\0" + s], self.texts["\0" + s] = np.array([k], "<u4").tobytes(), s.encode()

    def split(self, text: str) -> list[str]:
        """The words of a text; a special token's string is marked by a leading NUL."""
        if self.at_special and any(s in text for s in self.special):
            return [w for k, part in enumerate(self.at_special.split(text)) for w in (["\0" + part] if k % 2 else self._split(part))]
        return self._split(text)

    def _split(self, text: str) -> list[str]:
        if not self.PLAIN.search(text):
            return self.WORDS.findall(text.lower())
        back = byte_alphabet()
        text = self.whole.normalizer.normalize_str(text)
        return [bytes(back[c] for c in w).decode("utf-8", "surrogatepass") for w, _ in self.whole.pre_tokenizer.pre_tokenize_str(text)]

    def learn(self, words: set[str]) -> None:
        """Encodes words that are not remembered, all through one index."""
        missing = []
        for w in words:
            if w not in self.ids:
                if w in self.older[0]:
                    self.ids[w], self.texts[w] = self.older[0][w], self.older[1][w]
                else:
                    missing.append(w)
        if not missing:
            return
        raw = [w.encode("utf-8", "surrogatepass") for w in missing]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(lengths)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        symbols[ends - 1] = self.last[data[ends - 1]]
        ids, starts = self.index.merge(symbols, ends - lengths)
        packed = ids.astype("<u4").tobytes()
        token = self.token
        bounds = [*starts.tolist(), len(ids)]
        tokens = [token[k] for k in ids.tolist()]
        for w, a, b in zip(missing, bounds, bounds[1:]):
            self.ids[w] = packed[4 * a : 4 * b]
            self.texts[w] = " ".join(tokens[a:b]).encode("utf-8", "surrogatepass")

    def encode_many(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids as little-endian unsigned 32-bit integers, and the UTF-8 text that they decode to."""
        if len(self.ids) > REMEMBERED:
            self.older, self.ids, self.texts = (self.ids, self.texts), {}, {}
            for s, k in self.special.items():
                self._special(s, k)
        split = [self.split(t) for t in texts]
        self.learn(set().union(*split) if split else set())
        get, say = self.ids.__getitem__, self.texts.__getitem__
        return [(b"".join(map(get, words)), b" ".join(map(say, words))) for words in split]


@lru_cache(2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def slices(batch: pa.RecordBatch, text: int = 1, limit: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of a batch in turn, null as empty, so that one slice holds few characters."""
    held: list[str] = []
    chars, at = 0, 0
    for k, x in enumerate(batch.column(text)):
        held.append(x.as_py() or "")
        chars += len(held[-1])
        if chars >= limit:
            yield at, held
            held, chars, at = [], 0, k + 1
    if held:
        yield at, held


def op9(docs: DataFrame, path: str) -> DataFrame:
    """The contract's rows: doc_id, n_tokens and digests of the ids and of the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        for batch in batches:
            for at, texts in slices(batch):
                found = tokenizer.encode_many(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        pa.array([len(ids) // 4 for ids, _ in found], pa.int64()),
                        pa.array([hashlib.sha256(ids).hexdigest() for ids, _ in found], pa.string()),
                        pa.array([hashlib.sha256(text).hexdigest() for _, text in found], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
