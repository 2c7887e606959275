"""Brown class n-gram scoring: exchange clustering, class transitions, word emissions.

The corpus is tokenized once into stored blocks: each holds the distinct words of some documents,
their training counts, and the documents as codes into those words. All later passes read blocks. A block
is one row of megabytes; rows are written, read and handed to Python one at a time, however many a file or task has.

* Exchange clustering: the CORE most frequent words move, round by round, each to the class that
  raises the class bigrams' likelihood most, from bigram counts over the whole training text. These are
  counted once, into a row for each range of words; a round reads them and no block, and a range is decided
  by its own row. Half of the words may move in a round, so that neighbours do not swap; a round that
  loses is taken back, and from then on half as many move at a time. Rounds go on until two of them
  gain less than CONVERGED of all that was gained so far, or none of a whole turn gains anything.
* Which words are the most frequent ones is exact: no word outside the blocks' own tops and above a
  block's share of the least such sum can be one, and the candidates left are counted in full.
* Every other training word goes to the class that its contexts favour: one shuffle brings each
  word's rows from all blocks together, and its contexts and counts are summed over all of them. A
  word has one row for each block at most, of which twelve bytes are held at a time.
* Scoring: each block gets the classes and counts of its words back, and then its transitions; the
  model is P(c | c') P(w | c), interpolated with P(c) by Witten-Bell weights, with
  the share of once-seen words kept for the one unknown word.

Tokens are the words of a text and one end; the context of the first word is the end. The model sums
to 1 over the vocabulary and one unknown word.

Defined cases: a null or empty text is one end token; a null doc_id falls into the fold of the empty
id; repeated rows are counted and scored row by row; with no training text every token is unknown;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm.common import discard, fold, small_batches, store

FOLDS = 7
HELD_OUT = 2
#: Classes of words; one more holds the end token.
CLASSES = 64
#: Words that exchange clustering moves, the most frequent ones; it bounds what is broadcast.
CORE = 8192
#: Exchange ends when two rounds gain less than this share of all that was gained.
CONVERGED = 0.01
#: A bound for the exchange's rounds that no corpus should meet; it raises beyond.
MOST_ROUNDS = 200
#: Words whose neighbours are one row, and whose moves are decided together; it bounds a row, not the result.
RANGE = 64
#: Tokens of a block, about.
BLOCK_TOKENS = 1_250_000
BLOCK_CHARS = 1_000_000

BLOCK = "block long, doc_ids array<long>, held array<boolean>, lengths array<int>, words array<string>, counts array<long>, codes binary"


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _unpack(b: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def blocks(docs: DataFrame) -> DataFrame:
    """Documents as codes into each block's own words; the end token has no code and no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list = []
        held: list = []
        texts: list[pa.Array] = []
        lengths: list[np.ndarray] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, tokens
            coded = pa.concat_arrays(texts).dictionary_encode()
            codes, words = coded.indices.to_numpy(), coded.dictionary
            sizes = np.concatenate(lengths)
            train = np.repeat(~np.array(held, bool), sizes)
            counts = np.bincount(codes[train], minlength=len(words)).astype(np.int64)
            row = [
                pa.array([number], pa.int64()),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([held], pa.list_(pa.bool_())),
                pa.array([sizes.astype(np.int32)], pa.list_(pa.int32())),
                pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
                pa.array([counts], pa.list_(pa.int64())),
                pa.array([_pack(codes.astype(np.int32))], pa.binary()),
            ]
            number += 1
            tokens = 0
            for x in (ids, held, texts, lengths):
                x.clear()
            pa.default_memory_pool().release_unused()
            return pa.RecordBatch.from_arrays(row, [f.split()[0] for f in BLOCK.split(", ")])

        for batch in batches:
            chars = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
            at = 0
            while at < batch.num_rows:
                # As many rows as hold BLOCK_CHARS, one at least.
                n = max(1, int(np.searchsorted(np.cumsum(chars[at:]), BLOCK_CHARS)))
                part = batch.slice(at, n)
                split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(part.column(2), "")))
                offsets = split.offsets.to_numpy()
                flat = split.flatten()
                some = pc.not_equal(flat, "")
                kept = np.append(0, np.cumsum(some.to_numpy(zero_copy_only=False)))
                base = offsets - offsets[0]
                lengths.append(np.diff(kept[base]))
                texts.append(flat.filter(some))
                ids += part.column(0).to_pylist()
                held += part.column(1).to_pylist()
                tokens += int(lengths[-1].sum()) + n
                at += n
                if tokens >= BLOCK_TOKENS:
                    yield flush()
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "text")
    return rows.mapInArrow(run, BLOCK)


class Block:
    """One stored block; sequences put the end (a given code) before each document and after the last."""

    def __init__(self, row: dict) -> None:
        self.number = row["block"]
        self.doc_ids = row["doc_ids"]
        self.held = np.array(row["held"], bool)
        self.lengths = np.array(row["lengths"], np.int64)
        self.words = row.get("words")
        self.counts = row.get("counts")
        self.codes = _unpack(row["codes"], np.int32)

    def sequence(self, of_words: np.ndarray, end: int, train: bool) -> np.ndarray:
        """What of_words gives for each token, documents one after another, with ends around them."""
        sizes = self.lengths
        chosen = of_words[self.codes]
        if train:
            chosen = chosen[np.repeat(~self.held, sizes)]
            sizes = sizes[~self.held]
        out = np.full(len(chosen) + len(sizes) + 1, end, of_words.dtype)
        out[np.arange(len(chosen)) + 1 + np.repeat(np.arange(len(sizes)), sizes)] = chosen
        return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for k in range(batch.num_rows):
            one = batch.slice(k, 1)
            row = {n: one.column(n)[0] for n in one.schema.names}
            made = {"block": row["block"].as_py(), "doc_ids": row["doc_ids"].values, "held": row["held"].as_py(), "lengths": row["lengths"].values.to_numpy(), "codes": row["codes"].as_py()}
            if "words" in row:
                made |= {"words": row["words"].values, "counts": row["counts"].values.to_numpy()}
            yield Block(made)
            # Else what a block took stays with the worker beside the next one's.
            del made, row, one
            pa.default_memory_pool().release_unused()


@dataclass(frozen=True)
class Core:
    """The words that exchange clustering moves, their counts and classes."""

    words: pa.Array
    counts: np.ndarray
    classes: np.ndarray

    def codes_of(self, words: pa.Array) -> np.ndarray:
        """Position of each word here, or the number of words here."""
        at = pc.index_in(words, value_set=self.words)
        return pc.fill_null(at, len(self.words)).to_numpy(zero_copy_only=False).astype(np.int32)

    def class_of(self, words: pa.Array) -> np.ndarray:
        """Class of each word here; CLASSES + 1 for others."""
        return np.append(self.classes, CLASSES + 1).astype(np.uint8)[self.codes_of(words)]


def _pair_row(r: int, share: int, cells: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    steps = np.diff(cells, prepend=0).astype(np.int32)
    columns = [pa.array([r], pa.int32()), pa.array([share], pa.int32()), pa.array([_pack(steps)], pa.binary()), pa.array([_pack(n)], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["range", "share", "cells", "n"])


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for batch in batches:
        for k in range(batch.num_rows):
            r, share, cells, n = (batch.column(x)[k].as_py() for x in range(4))
            yield r, share, np.cumsum(_unpack(cells, np.int32)), _unpack(n, np.int64)


def neighbours(stored: DataFrame, core: Core) -> DataFrame:
    """(range, share, cells, n): how often each two core words, ends or other words meet in training text, a row for each range of words.

    A core word's code is its place; the end and any other word have the next two. A cell is (2 * place in the
    range + side) * codes + the neighbour's code, where side is 0 for the neighbour before and 1 for that after.
    """
    width = len(core.words) + 2
    end, other, ranges = width - 2, width - 1, -(-width // RANGE)
    shared = stored.sparkSession.sparkContext.broadcast(core)
    kinds = "range int, share int, cells binary, n binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block's pairs, under their first words."""
        share = TaskContext.get().partitionId() // 256
        for b in _read(batches):
            at = shared.value.codes_of(b.words)
            code = b.sequence(np.where(at == end, other, at), end, True).astype(np.int64)
            pairs, n = np.unique(code[:-1] * width + code[1:], return_counts=True)
            edges = np.searchsorted(pairs, np.arange(ranges + 1) * (RANGE * width))
            for r in np.flatnonzero(np.diff(edges)).tolist():
                part = pairs[edges[r] : edges[r + 1]] - r * RANGE * width
                yield _pair_row(r, share, part + (part // width + 1) * width, n[edges[r] : edges[r + 1]])

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows under first words, and their pairs again under the second words."""
        for r, _, cells, n in _pair_rows(batches):
            yield _pair_row(r, 0, cells, n)
            line, second = np.divmod(cells, width)
            pairs = second * width + r * RANGE + line // 2
            order = np.argsort(pairs)
            pairs, n = pairs[order], n[order]
            edges = np.searchsorted(pairs, np.arange(ranges + 1) * (RANGE * width))
            for to in np.flatnonzero(np.diff(edges)).tolist():
                part = pairs[edges[to] : edges[to + 1]] - to * RANGE * width
                yield _pair_row(to, 0, part + part // width * width, n[edges[to] : edges[to + 1]])

    def add(batches: Iterator[pa.RecordBatch], by_share: bool = True) -> Iterator[pa.RecordBatch]:
        """One row for all of a range (and share) that follow each other; one table of a range is held at a time."""
        key, total = None, np.zeros(2 * RANGE * width, np.int64)

        def summed() -> pa.RecordBatch:
            at = np.flatnonzero(total)
            row = _pair_row(*key, at, total[at])
            total[at] = 0
            return row

        for r, share, cells, n in _pair_rows(batches):
            share = share if by_share else 0
            if key and key != (r, share):
                yield summed()
            key = (r, share)
            total[cells] += n
        if key:
            yield summed()

    # Blocks' rows are added in shares of at most 256 tasks, then the shares.
    shares = stored.mapInArrow(send, kinds).repartition("range", "share").sortWithinPartitions("range", "share").mapInArrow(add, kinds)
    # One function for adding and turning: two in a row would take two Python workers for each core.
    both = shares.repartition("range").sortWithinPartitions("range").mapInArrow(lambda batches: turn(add(batches, False)), kinds)
    return both.repartition(min(16, ranges), "range").sortWithinPartitions("range").mapInArrow(add, kinds)


def _contexts(batches: Iterator[pa.RecordBatch], classes: np.ndarray, size: int, wide: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each range of so many words and its counts by place in it, side and the neighbour's class, the last two of which are for ends and other words."""
    kind = np.append(classes, [wide - 2, wide - 1])
    for r, _, cells, n in _pair_rows(batches):
        line, near = np.divmod(cells, len(kind))
        # Sums of whole numbers below 2 ** 53 are exact as doubles.
        yield r, np.bincount(line * wide + kind[near], weights=n, minlength=2 * size * wide).astype(np.int64).reshape(-1, 2, wide)


def best_moves(left: np.ndarray, right: np.ndarray, own: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The class that each word fits best, given class bigram counts without its own part.

    left and right: words by classes, counts of the classes before and after; own: present classes.
    The gain of class c is that in the sum of n log n over bigrams less that over both margins.
    """
    wide = pairs.shape[0]
    out = own.copy()
    f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)
    rows, columns = pairs.sum(axis=1), pairs.sum(axis=0)
    for w in range(len(own)):
        a = own[w]
        l, r = left[w], right[w]
        if not l.any() and not r.any():
            continue
        base = pairs.astype(np.float64).copy()
        base[:, a] -= l
        base[a, :] -= r
        np.maximum(base, 0, out=base)
        nr, nc = rows.astype(np.float64).copy(), columns.astype(np.float64).copy()
        nr[a] = max(0.0, nr[a] - r.sum())
        nc[a] = max(0.0, nc[a] - l.sum())
        some_l, some_r = np.flatnonzero(l), np.flatnonzero(r)
        gain = (f(base[some_l, :] + l[some_l, None]) - f(base[some_l, :])).sum(axis=0)
        gain += (f(base[:, some_r] + r[None, some_r]) - f(base[:, some_r])).sum(axis=1)
        gain -= f(nr + r.sum()) - f(nr) + f(nc + l.sum()) - f(nc)
        k = int(np.argmax(gain[:CLASSES]))
        if gain[k] > gain[a] + 1e-9:
            out[w] = k
    return out


def likelihood(pairs: np.ndarray) -> float:
    """What the classes add to the log-likelihood of class bigrams with these counts."""
    f = lambda x: float((x[x > 0] * np.log(x[x > 0])).sum())
    return f(pairs.astype(np.float64)) - f(pairs.sum(axis=0).astype(np.float64)) - f(pairs.sum(axis=1).astype(np.float64))


def exchange(stored: DataFrame, core: Core, converged: float = CONVERGED, gains: list[float] | None = None, met: DataFrame | None = None) -> Core:
    """Core after exchange to convergence; each round's likelihood is added to gains. met: neighbours() of this core, if they are stored."""
    spark = stored.sparkSession
    wide = CLASSES + 2
    if not len(core.words):
        return core
    pairs_met = store(neighbours(stored, core), "neighbours", large_rows=True) if met is None else met
    try:
        return _exchanged(spark, pairs_met, core, converged, [] if gains is None else gains, wide)
    finally:
        if met is None:
            discard(pairs_met)


def _exchanged(spark: SparkSession, met: DataFrame, core: Core, converged: float, seen: list[float], wide: int) -> Core:
    kept, parts, turn, since = core, min(2, len(core.words)), 0, 0
    for _ in range(MOST_ROUNDS):
        shared = spark.sparkContext.broadcast(core.classes)

        def partial(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            """Class bigrams (class of a core word, class after it) and (class before, ...) of a task's ranges."""
            classes = shared.value
            pairs = np.zeros((2, wide, wide), np.int64)
            for r, t in _contexts(batches, classes, RANGE, wide):
                own = classes[r * RANGE : (r + 1) * RANGE]
                np.add.at(pairs[0].T, own, t[: len(own), 0])
                np.add.at(pairs[1], own, t[: len(own), 1])
            yield pa.RecordBatch.from_arrays([pa.array([_pack(pairs)], pa.binary())], ["pairs"])

        both = sum((_unpack(r["pairs"], np.int64).reshape(2, wide, wide) for r in met.mapInArrow(partial, "pairs binary").collect()), np.zeros((2, wide, wide), np.int64))
        # Bigrams between core words are in both; those with an end or another word in one.
        pairs = both[1].copy()
        pairs[CLASSES:, :] = both[0][CLASSES:, :]
        now = likelihood(pairs)
        if seen and now < seen[-1] - 1e-12 * abs(now) and parts < len(core.words):
            core, parts, since = kept, min(2 * parts, len(core.words)), 0
            turn += 1
            seen.pop()
            shared.unpersist()
            continue
        seen.append(now)
        since += 1
        slow = len(seen) > 2 and now - seen[-3] < converged * (now - seen[0])
        if slow or (since > parts and now <= seen[-1 - parts]):
            shared.unpersist()
            return core
        kept = core
        whole = spark.sparkContext.broadcast(pairs)

        def decide(batches: Iterator[pa.RecordBatch], shared=shared, whole=whole, turn=turn, parts=parts) -> Iterator[pa.RecordBatch]:
            classes = shared.value
            for r, t in _contexts(batches, classes, RANGE, wide):
                first = r * RANGE
                own = classes[first : first + RANGE]
                t = t[: len(own)]
                moving = (np.arange(first, first + len(own)) + turn) % parts == 0
                to = own.copy()
                to[moving] = best_moves(t[moving, 0], t[moving, 1], own[moving], whole.value)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(own))), pa.array(to.astype(np.int64))], ["word", "class"])

        classes = core.classes.copy()
        # One small row for each of at most CORE words.
        for r in met.mapInArrow(decide, "word long, class long").collect():
            classes[r["word"]] = r["class"]
        core = Core(core.words, core.counts, classes)
        turn += 1
        for x in (shared, whole):
            x.unpersist()
    raise RuntimeError("exchange did not converge")


def _counted(stored: DataFrame, chosen: Callable[[Block], np.ndarray]) -> DataFrame:
    """(word, n, blocks) over what is chosen of each block's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _read(batches):
            at = chosen(b)
            at = at[b.counts[at] > 0]
            yield pa.RecordBatch.from_arrays([b.words.take(pa.array(at)), pa.array(b.counts[at])], ["word", "n"])

    counted = stored.mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("blocks"))


def _first_core(stored: DataFrame, size: int) -> Core:
    """The most frequent training words, dealt over the classes by rank (ties by the word)."""
    tops = _counted(stored, lambda b: np.argsort(-b.counts, kind="stable")[:size])
    least = tops.orderBy(F.desc("n"), "word").limit(size).agg(F.min("n")).first()[0]
    blocks = stored.count()
    if not least:
        return Core(pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64))
    # A word of at least this sum has at least its share of it in some block.
    share = max(1, -(-least // blocks))
    some = _counted(stored, lambda b: np.flatnonzero(b.counts >= share))
    may = some.filter(F.col("n") + (blocks - F.col("blocks")) * (share - 1) >= least).select("word")
    # Candidates are few more than size; were they many, they would be counted by a shuffle of all words.
    held = may.limit(8 * size + 1).collect()
    if len(held) <= 8 * size:
        shared = stored.sparkSession.sparkContext.broadcast(pa.array(sorted(r["word"] for r in held), pa.string()))
        exact = _counted(stored, lambda b: np.flatnonzero(pc.is_in(b.words, value_set=shared.value).to_numpy(zero_copy_only=False)))
    else:
        exact = _counted(stored, lambda b: np.arange(len(b.counts)))
    top = exact.orderBy(F.desc("n"), "word").limit(size).collect()
    return Core(pa.array([r["word"] for r in top], pa.string()), np.array([r["n"] for r in top], np.int64), np.arange(len(top)) % CLASSES)


def _sparse_sum(pairs: DataFrame) -> np.ndarray:
    """A table of class bigram counts from (pair, n); at most one row for each pair of classes is sent."""
    wide = CLASSES + 2
    out = np.zeros(wide * wide, np.int64)
    for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r["pair"]] = r["n"]
    return out.reshape(wide, wide)


def _affinity(stored: DataFrame, core: Core, met: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray]:
    """By class before (or after) and own class: log of how much likelier than by chance they meet."""
    wide = CLASSES + 2
    shared = stored.sparkSession.sparkContext.broadcast(core.classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((wide, wide), np.int64)
        kind = np.append(shared.value, [CLASSES, CLASSES + 1])
        for r, t in _contexts(batches, shared.value, RANGE, wide):
            own = kind[r * RANGE : (r + 1) * RANGE]
            np.add.at(total, own, t[: len(own), 1])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["pair", "n"])

    met = neighbours(stored, core) if met is None else met
    n = _sparse_sum(met.mapInArrow(run, "pair long, n long")) + 0.5
    chance = n.sum(axis=1)[:, None] * n.sum(axis=0)[None, :] / n.sum()
    meet = np.log(n / chance)
    meet[CLASSES + 1, :] = 0
    meet[:, CLASSES + 1] = 0
    return meet[:, :CLASSES], meet.T[:, :CLASSES]


def lookups(stored: DataFrame, core: Core, met: DataFrame | None = None) -> DataFrame:
    """(block, at, class, n, first): what each block's words are in the whole training text.

    The class of a word outside the core is the one that all its contexts together favour; first marks one row of each such word.
    """
    before, after = _affinity(stored, core, met)
    shared = stored.sparkSession.sparkContext.broadcast(core)
    wide = CLASSES + 2

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _read(batches):
            known = shared.value.class_of(b.words)
            kind = b.sequence(known, CLASSES, True)
            code = b.sequence(np.arange(len(b.words), dtype=np.int32), -1, True)
            at = np.flatnonzero(kind == CLASSES + 1)
            at = at[np.argsort(code[at], kind="stable")]
            # A byte for the class before and one for that after each token, word by word.
            around = np.stack([kind[at - 1], kind[at + 1]], axis=1).astype(np.uint8).tobytes()
            sizes = np.bincount(code[at], minlength=len(b.words)) if len(at) else np.zeros(len(b.words), np.int64)
            own = np.flatnonzero(known == CLASSES + 1)
            ends = 2 * np.cumsum(sizes[own])
            for k in range(0, len(own), 50_000):
                n = len(own[k : k + 50_000])
                offsets = np.append(ends[k - 1] if k else 0, ends[k : k + n])
                contexts = pa.Array.from_buffers(
                    pa.binary(), n, [None, pa.py_buffer((offsets - offsets[0]).astype(np.int32).tobytes()), pa.py_buffer(around[offsets[0] : offsets[-1]])]
                )
                part = own[k : k + n]
                columns = [pa.array(np.full(n, b.number)), pa.array(part.astype(np.int32)), b.words.take(pa.array(part)), pa.array(b.counts[part]), contexts]
                yield pa.RecordBatch.from_arrays(columns, ["block", "at", "word", "n", "contexts"])

    def core_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _read(batches):
            c = shared.value
            of = c.codes_of(b.words)
            at = np.flatnonzero(of < len(c.words))
            columns = [np.full(len(at), b.number), at.astype(np.int32), c.classes[of[at]].astype(np.int32), c.counts[of[at]], np.zeros(len(at), bool)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["block", "at", "class", "n", "first"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, total, evidence = None, 0, np.zeros(CLASSES)
        rows: list[tuple[np.ndarray, np.ndarray]] = []

        def emit(block: np.ndarray, at: np.ndarray, kind: np.ndarray, n: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
            first = np.zeros(len(block), bool)
            first[np.cumsum(sizes) - sizes] = True
            columns = [block, at, np.repeat(kind, sizes).astype(np.int32), np.repeat(n, sizes), first]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", "at", "class", "n", "first"])

        def finished() -> pa.RecordBatch:
            block, at = (np.concatenate(x) for x in zip(*rows))
            return emit(block, at, np.array([evidence.argmax()]), np.array([total]), np.array([len(block)]))

        for batch in batches:
            if not batch.num_rows:
                continue
            words, contexts = batch.column(2), batch.column(4)
            starts = np.append(0, np.flatnonzero(pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False)) + 1)
            sizes = np.diff(np.append(starts, len(words)))
            n = np.add.reduceat(batch.column(3).to_numpy(), starts)
            lengths = pc.binary_length(contexts).to_numpy() // 2
            around = np.frombuffer(b"".join(contexts.to_pylist()), np.uint8).reshape(-1, 2).astype(np.int64)
            group = np.repeat(np.repeat(np.arange(len(starts)), sizes), lengths) * wide
            seen = [np.bincount(group + around[:, k], minlength=len(starts) * wide).reshape(-1, wide) for k in (0, 1)]
            favour = seen[0] @ before + seen[1] @ after
            block, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lo = 0
            if words[0].as_py() == word:
                # The word goes on from the batch before.
                rows.append((block[: sizes[0]], at[: sizes[0]]))
                total, evidence, lo = total + n[0], evidence + favour[0], 1
                if len(starts) == 1:
                    continue
            if rows:
                yield finished()
            last = len(starts) - 1
            if last > lo:
                inner = slice(starts[lo], starts[last])
                yield emit(block[inner], at[inner], favour[lo:last].argmax(axis=1), n[lo:last], sizes[lo:last])
            word, total, evidence = words[len(words) - 1].as_py(), n[last], favour[last]
            rows = [(block[starts[last] :], at[starts[last] :])]
        if rows:
            yield finished()

    sent = stored.mapInArrow(send, "block long, at int, word string, n long, contexts binary")
    kinds = "block long, at int, class int, n long, first boolean"
    return sent.repartition("word").sortWithinPartitions("word").mapInArrow(decide, kinds).unionByName(stored.mapInArrow(core_rows, kinds))


@dataclass(frozen=True)
class Totals:
    #: Training tokens, distinct ones, documents' ends, words seen once, and tokens of each class.
    tokens: int
    types: int
    ends: int
    once: int
    of_class: np.ndarray

    @property
    def unknown(self) -> float:
        """The probability of the unknown word."""
        return max(self.once, 1) / (self.tokens + 1 + (self.once == 0)) if self.tokens else 1.0


def _coded(stored: DataFrame, looked: DataFrame, totals: Totals) -> DataFrame:
    """Blocks with each token's class in place of its word, and what documents score by words alone."""
    found = looked.select(F.col("block").alias("of_block"), "at", "class", "n")
    n, v, of_class, p_unknown = totals.tokens, totals.types, totals.of_class, totals.unknown
    ends = totals.ends

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        b = next(_read(iter(left.combine_chunks().to_batches())))
        at = right["at"].to_numpy()
        kind, count = np.full(len(at), CLASSES + 1, np.int64), np.zeros(len(at), np.int64)
        kind[at], count[at] = right["class"].to_numpy(), right["n"].to_numpy()
        kind[count == 0] = CLASSES + 1
        with np.errstate(divide="ignore"):
            base = np.log10((count + 1) / (n + v + 1))
            emit = np.where(count > 0, np.log10(np.maximum(count, 1)) - np.log10(np.maximum(of_class[np.minimum(kind, CLASSES)], 1)) + np.log10(1 - p_unknown if p_unknown < 1 else 1.0), np.log10(p_unknown))
        document = np.repeat(np.arange(len(b.lengths)), b.lengths)
        sums = [np.bincount(document, weights=x[b.codes], minlength=len(b.lengths)) for x in (base, emit, (count > 0).astype(np.float64))]
        base_end = np.log10((ends + 1) / (n + v + 1))
        emit_end = np.log10(1 - p_unknown) if ends else np.log10(p_unknown)
        return pa.table(
            {
                "block": pa.array([b.number], pa.int64()),
                "doc_ids": pa.array([b.doc_ids.to_pylist()], pa.list_(pa.int64())),
                "held": pa.array([b.held.tolist()], pa.list_(pa.bool_())),
                "lengths": pa.array([b.lengths.astype(np.int32)], pa.list_(pa.int32())),
                "base": pa.array([sums[0] + base_end], pa.list_(pa.float64())),
                "emit": pa.array([sums[1] + emit_end], pa.list_(pa.float64())),
                "known": pa.array([np.rint(sums[2]).astype(np.int64) + (ends > 0)], pa.list_(pa.int64())),
                "kinds": pa.array([_pack(kind[b.codes].astype(np.uint8))], pa.binary()),
            }
        )

    schema = "block long, doc_ids array<long>, held array<boolean>, lengths array<int>, base array<double>, emit array<double>, known array<long>, kinds binary"
    return stored.drop("words", "counts").groupBy("block").cogroup(found.groupBy("of_block")).applyInArrow(run, schema)


def _kinds(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of a coded block with ends around documents, lengths, and held-out marks."""
    lengths = row["lengths"].values.to_numpy().astype(np.int64)
    flat = _unpack(row["kinds"].as_py(), np.uint8).astype(np.int64)
    out = np.full(len(flat) + len(lengths) + 1, CLASSES, np.int64)
    out[np.arange(len(flat)) + 1 + np.repeat(np.arange(len(lengths)), lengths)] = flat
    return out, lengths, np.array(row["held"].as_py(), bool)


def _transitions(coded: DataFrame) -> np.ndarray:
    """Class bigram counts of training text; each task sends one table of fixed size."""
    wide = CLASSES + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(wide * wide, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k] for n in batch.schema.names}
                kind, lengths, held = _kinds(row)
                # A document's transitions end at its own tokens and its end.
                train = np.repeat(~held, lengths + 1)
                total += np.bincount((kind[:-1] * wide + kind[1:])[train], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])

    return _sparse_sum(coded.mapInArrow(run, "pair long, n long"))


def log_transitions(pairs: np.ndarray) -> np.ndarray:
    """log10 P(class | class before), by Witten-Bell with the classes' own shares; 0 to an unknown word."""
    pairs = pairs[:, : CLASSES + 1].astype(np.float64)
    unigram = pairs.sum(axis=0)
    unigram = unigram / unigram.sum() if unigram.sum() else np.full(CLASSES + 1, 1 / (CLASSES + 1))
    seen, kinds = pairs.sum(axis=1, keepdims=True), (pairs > 0).sum(axis=1, keepdims=True)
    seen[CLASSES + 1], kinds[CLASSES + 1] = 0, 1
    own = np.where(seen > 0, seen / np.maximum(seen + kinds, 1), 0.0)
    p = own * np.divide(pairs, np.maximum(seen, 1)) + (1 - own) * unigram
    out = np.zeros((CLASSES + 2, CLASSES + 2))
    out[:, : CLASSES + 1] = np.log10(np.maximum(p, 1e-300))
    return out


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def _scored(coded: DataFrame, totals: Totals, steps: np.ndarray) -> DataFrame:
    shared = coded.sparkSession.sparkContext.broadcast(steps)
    tokens, ends = totals.tokens, totals.ends

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = shared.value.copy()
        if not ends:
            step[:, CLASSES] = 0
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k] for n in batch.schema.names}
                kind, lengths, held = _kinds(row)
                document = np.repeat(np.arange(len(lengths)), lengths + 1)
                score = row["emit"].values.to_numpy() + np.bincount(document, weights=step[kind[:-1], kind[1:]], minlength=len(lengths))
                columns = [
                    row["doc_ids"].values,
                    pa.array(held),
                    pa.array(lengths + 1),
                    row["known"].values,
                    pa.array(np.full(len(held), tokens)),
                    row["base"].values,
                    pa.array(score),
                    pa.array(10 ** np.minimum(300.0, -score / (lengths + 1))),
                ]
                whole = pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in RESULT.split(", ")])
                for a in range(0, whole.num_rows, 10_000):
                    yield whole.slice(a, 10_000)

    return coded.mapInArrow(run, RESULT)


def score(docs: DataFrame, core_words: int = CORE, converged: float = CONVERGED) -> DataFrame:
    """Both scores of every row of docs(doc_id, text), learned from the rows that are not held out."""
    with small_batches(docs.sparkSession):
        return _learned(docs, core_words, converged)


def _learned(docs: DataFrame, core_words: int, converged: float) -> DataFrame:
    stored = store(blocks(docs), "blocks", large_rows=True)
    core = _first_core(stored, core_words)
    met = store(neighbours(stored, core), "neighbours", large_rows=True)
    core = exchange(stored, core, converged, met=met)
    looked = store(lookups(stored, core, met), "lookups")
    discard(met)
    trained = F.filter(F.arrays_zip("held", "lengths"), lambda x: ~x["held"])
    ends = stored.agg(F.sum(F.size(trained))).first()[0] or 0
    words = looked.filter(F.col("first") & (F.col("n") > 0)).groupBy("class")
    rest = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("once")).collect()
    of_class = np.bincount(core.classes, weights=core.counts, minlength=CLASSES + 1).astype(np.float64)
    for r in rest:
        of_class[r["class"]] += r["n"]
    of_class[CLASSES] = ends
    types = len(core.words) + sum(r["v"] for r in rest) + (ends > 0)
    once = int((core.counts == 1).sum()) + sum(r["once"] for r in rest) + (ends == 1)
    totals = Totals(int(core.counts.sum()) + sum(r["n"] for r in rest) + ends, types, ends, once, of_class)
    coded = store(_coded(stored, looked, totals), "coded", large_rows=True)
    discard(stored)
    discard(looked)
    # Stored here, while batches are small; whoever reads the result reads small rows.
    scores = store(_scored(coded, totals, log_transitions(_transitions(coded))), "scores")
    discard(coded)
    return scores


def op1(docs: DataFrame) -> DataFrame:
    return score(docs)
