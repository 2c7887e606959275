"""Hierarchical residual packing of tokenized documents into fixed-length sequences.

Every task packs its pieces best-fit (largest first, into the tightest bin that still holds them).
Nearly full bins are final. Underfull bins become items of the next round, in fewer and fewer tasks
(a tree), where they are packed best-fit again, until one task holds them all or a round no longer
saves bins. Only underfull bins move between rounds, as (id, size).

Defined cases: a null or empty text is the one token that ends a document; null and repeated doc_ids
are packed row by row; an empty table gives an empty result; extra columns are ignored; a text that
holds a special token's string is encoded as the tokenizers library does it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import discard, store

CAPACITY = 2048
END_ID = 0
#: A bin with at most so many free places is final.
NEARLY_FULL = 4
#: Items that a task holds at once.
TASK_ITEMS = 400_000
#: Rounds stop when one saves less than this share of the bins that went into it.
LEAST_GAIN = 0.002
#: Remembered pre-tokens of a worker process, in each of two generations.
REMEMBERED = 250_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, item long"


class Remembered(dict):
    """Ids of pre-tokens, as little-endian bytes; two generations bound what it holds."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


class ByteTokenizer:
    """A byte-level BPE file's ids of whole texts, word by word where that gives the library's ids."""

    #: Characters on which this pattern splits as the library's does.
    PLAIN = re.compile(r"[^\t\n\v\f\r\x20-\x7e¡-©«-±´-¸»¿-ɏ]")
    WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.words = Remembered(self._word())

    def _word(self):
        """The encoder of one pre-token: by ranks if ids follow the merges' order, else the library."""
        import json

        import tiktoken

        model = json.loads(self.whole.to_str())["model"]
        bytes_of = byte_alphabet()
        ranks = {}
        for token, k in model["vocab"].items():
            if token not in self.specials:
                ranks[bytes(bytes_of[c] for c in token)] = k
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        in_order = all(model["vocab"].get(t) == 256 + k for k, t in enumerate(merged)) and sorted(ranks.values()) == list(range(len(ranks)))
        if not in_order:
            return lambda w: np.array(self.whole.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        core = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        return lambda w: np.array(core.encode_single_piece(w.encode("utf-8")), "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.PLAIN.search(text) or any(s in text for s in self.specials):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.words.__getitem__, self.WORDS.findall(text)))


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(moved)}


@lru_cache(2)
def byte_tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than capacity."""
    first = length % capacity or min(length, capacity)
    starts = [0, *range(first, length, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], length])]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece of each document; item is unique once the result is stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = byte_tokenizer(path)
        end = np.array([END_ID], "<u4").tobytes()
        item = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows: list[list[int | None]] = [[] for _ in range(6)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = memoryview(tokenizer.ids(text.as_py() or "") + end)
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    for column, x in zip(rows, (doc_id, k, start, length, crc, item)):
                        column.append(x)
                    item += 1
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], [f.split()[0] for f in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the bins' sizes: largest items first, each into the tightest bin."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    filled: list[int] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r is set if a bin has r free places
    for at, size in zip(order.tolist(), sizes[order].tolist()):
        fits = some >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                some &= ~(1 << room)
        else:
            b, room = len(filled), capacity
            filled.append(0)
        bins[at], offsets[at] = b, filled[b]
        filled[b] += size
        if room > size:
            free[room - size].append(b)
            some |= 1 << (room - size)
    return bins, offsets, np.array(filled, np.int64)


def _pack(rows: DataFrame, level: int, capacity: int, schema: str) -> DataFrame:
    """Adds bin, place and bin_size to rows with item and length, packed within each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = (level << 58) + (TaskContext.get().partitionId() << 34)
        held: list[pa.RecordBatch] = []

        def flush() -> pa.Table:
            nonlocal made
            t = pa.Table.from_batches(held)
            bins, places, filled = best_fit(t["length"].to_numpy(), capacity)
            out = t.append_column("bin", pa.array(bins + made)).append_column("place", pa.array(places)).append_column("bin_size", pa.array(filled[bins]))
            made += len(filled)
            held.clear()
            return out

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= TASK_ITEMS:
                yield from flush().to_batches(10_000)
        if held:
            yield from flush().to_batches(10_000)

    return rows.mapInArrow(run, f"{schema}, bin long, place long, bin_size long")


def pack(items: DataFrame, capacity: int = CAPACITY, nearly_full: int = NEARLY_FULL) -> DataFrame:
    """Adds sequence_id and offset to stored pieces, all of them of at most capacity places."""
    spark = items.sparkSession
    first = store(_pack(items, 0, capacity, PIECES), "bins")
    moved = None  # (from_bin, sequence_id, shift) of bins that later rounds have packed
    open_bins = first.groupBy("bin").agg(F.max("bin_size").alias("length")).filter(F.col("length") < capacity - nearly_full)
    open_bins = store(open_bins.select(F.col("bin").alias("item"), "length"), "open-bins")
    n = open_bins.count()
    level, tasks = 1, max(1, -(-n // TASK_ITEMS) * 8)
    while n > 1:
        tasks = max(1, tasks // 8, -(-n // TASK_ITEMS))
        packed = store(_pack(open_bins.coalesce(1) if tasks == 1 else open_bins.repartition(tasks, "item"), level, capacity, "item long, length long"), "merged")
        step = packed.select(F.col("item").alias("from_bin"), F.col("bin").alias("sequence_id"), F.col("place").alias("shift"))
        if moved is None:
            moved = step
        else:
            later = step.select(F.col("from_bin").alias("sequence_id"), F.col("sequence_id").alias("then"), F.col("shift").alias("more"))
            moved = store(
                moved.join(later, "sequence_id", "left").select(
                    "from_bin", F.coalesce("then", "sequence_id").alias("sequence_id"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")
                ),
                "moved",
            )
        left = packed.groupBy("bin").agg(F.max("bin_size").alias("length"))
        bins = left.count()
        discard(open_bins)
        open_bins = store(left.filter(F.col("length") < capacity - nearly_full).select(F.col("bin").alias("item"), "length"), "open-bins")
        gain, n = 1 - bins / n, open_bins.count()
        if tasks == 1 or gain < LEAST_GAIN:
            break
        level += 1
    out = first.withColumnRenamed("bin", "from_bin")
    if moved is None:
        moved = spark.createDataFrame([], "from_bin long, sequence_id long, shift long")
    return out.join(moved, "from_bin", "left").select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.coalesce("sequence_id", "from_bin").alias("sequence_id"),
        (F.col("place") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )


def op8(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """The contract's rows: a piece of a document and its place in a sequence."""
    return pack(store(pieces(docs, path, capacity), "pieces"), capacity)
