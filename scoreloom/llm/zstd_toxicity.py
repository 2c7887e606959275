"""Toxicity by compression distance: windows of running text under a toxic and an ordinary dictionary.

A text's bytes (A-Z lower-cased) are cut into overlapping windows. zstandard trains a background
dictionary on windows of ordinary documents, and, separately, a toxic dictionary on windows of toxic
documents and an ordinary one on windows of ordinary documents. A window's margin is its compressed
length with the ordinary dictionary less that with the toxic one, the background being in front of
both, so that what the two classes share costs the same on either side.

A class's dictionary is first trained on any of its windows, then in ROUNDS on those that tell it
apart: the toxic and the ordinary documents are dealt into two halves, and the windows of each half
with the greatest margins under the other half's dictionaries (the best share of every document) are
what the next dictionaries of that half are trained on. On the ordinary side these are the windows
that look toxic by mistake. The last pairs of both halves are kept; margins are summed over them.

Thresholds are calibrated on labelled documents that trained no dictionary: margins that given shares
of ordinary windows stay below, for single windows and for runs of three. How many of a document's
windows pass each of them becomes a probability by a logistic fit on the same documents.

Labels come from a sample of at most SAMPLE_TOXIC + SAMPLE_ORDINARY labelled documents, the first by
hash, of which at most LEARNED_WINDOWS windows each, evenly spread, train dictionaries; near copies
among them count once. Scoring reads whole texts.

Defined cases: a null text counts as empty and gets the calibrated score of no windows; with too few
toxic or ordinary labels to learn from the score is 0; a document labelled twice counts once, by its
highest label, and one that is there twice by its least text; a null doc_id is never learned from;
repeated rows are scored row by row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import discard, fold, store
from scoreloom.llm.pair_index_bpe import slices

FOLDS = 5
HELD_OUT = 0
#: Labelled documents that are learned from, at most, and windows of each that train dictionaries.
SAMPLE_TOXIC = 4000
SAMPLE_ORDINARY = 8000
LEARNED_WINDOWS = 2048
#: Bytes of a window and from one window to the next.
WINDOW = 32
STRIDE = 8
#: Bytes of the background and of each class's dictionary.
BACKGROUND_BYTES = 110_000
CLASS_BYTES = 8192
#: Bytes of toxic windows that each byte of a class's dictionary takes, at least.
BYTES_PER_BYTE = 12
#: The trainer's lengths of a segment and of the strings that it counts.
SEGMENT, COUNTED = 16, 8
ROUNDS = 4
#: Share of a toxic or an ordinary document's windows that the next dictionaries are trained on.
BEST_TOXIC = 0.04
BEST_ORDINARY = 0.08
#: Shares of ordinary windows that stay below the thresholds.
QUANTILES = (0.98, 0.99, 0.995, 0.998, 0.999, 0.9997)
#: Margins (bytes) are counted from -LOW on; single windows and runs of three.
LOW = (40, 80)
SPAN = (128, 320)
#: Windows that are compressed at a time, and bytes of the samples of one training.
PART = 20_000
TRAINING_BYTES = 12_000_000
#: Least documents of each class that dictionaries are trained on.
LEAST_DOCUMENTS = 8


def _parameters() -> zstandard.ZstdCompressionParameters:
    return zstandard.ZstdCompressionParameters(
        window_log=18,
        hash_log=16,
        chain_log=16,
        search_log=3,
        min_match=4,
        target_length=8,
        strategy=zstandard.STRATEGY_DFAST,
        write_content_size=0,
        write_checksum=0,
        write_dict_id=0,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )


#: The predefined distributions of RFC 8878, 3.1.1.3.2.2 with their accuracy: offsets, match lengths, literal lengths.
PREDEFINED = (
    (5, [1] * 6 + [2] * 3 + [1] * 15 + [-1] * 5),
    (6, [1, 4, 3] + [2] * 6 + [1] * 37 + [-1] * 7),
    (6, [4, 3] + [2] * 11 + [1] * 3 + [2] * 9 + [3, 2] + [1] * 5 + [-1] * 4),
)


def _table(accuracy: int, shares: list[int]) -> bytes:
    """An FSE table description as in RFC 8878, 4.1.1, of shares without a zero."""
    bits, at = accuracy - 5, 4
    left, threshold, width = (1 << accuracy) + 1, 1 << accuracy, accuracy + 1
    for share in shares:
        short = 2 * threshold - 1 - left
        left -= abs(share)
        value = share + 1 + (short if share + 1 >= threshold else 0)
        bits |= value << at
        at += width - (value < short)
        while left < threshold:
            threshold >>= 1
            width -= 1
    return bits.to_bytes(-(-at // 8), "little")


def formatted(content: bytes) -> bytes:
    """Content as a dictionary in the format of RFC 8878, 5, under which a window is as long as under the raw content.

    Its tables are the predefined ones, which a frame after raw content uses as well but makes anew each time, at
    nearly half of a window's cost. Its Huffman table knows two bytes only, and literals of a window are too few for any.
    """
    tables = b"".join(_table(*x) for x in PREDEFINED)
    offsets = b"".join(x.to_bytes(4, "little") for x in (1, 4, 8))
    return b"\x37\xa4\x30\xec" + (1).to_bytes(4, "little") + b"\x80\x10" + tables + offsets + content


def prepared(text: str | None) -> bytes:
    """What windows are cut from: the whole text in UTF-8, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def window_starts(size: int) -> np.ndarray:
    """Where the windows of so many bytes begin; the last may be shorter, a text of some bytes has one."""
    return np.arange(0, max(size - WINDOW, 0) + (STRIDE if size > WINDOW else min(size, 1)), STRIDE)


@dataclass(frozen=True)
class Pair:
    toxic: bytes
    ordinary: bytes


class Margins:
    """Windows' margins, summed over pairs of dictionaries behind one background."""

    def __init__(self, background: bytes, pairs: tuple[Pair, ...]) -> None:
        parameters = _parameters()

        def compressor(content: bytes) -> zstandard.ZstdCompressor:
            d = zstandard.ZstdCompressionDict(formatted(background + content), dict_type=zstandard.DICT_TYPE_FULLDICT)
            d.precompute_compress(compression_params=parameters)
            return zstandard.ZstdCompressor(dict_data=d, compression_params=parameters)

        self.sides = [(compressor(p.ordinary), compressor(p.toxic)) for p in pairs]

    @staticmethod
    def _lengths(side: zstandard.ZstdCompressor, parts: zstandard.BufferWithSegments) -> np.ndarray:
        if len(parts) < 2:
            return np.array([len(side.compress(parts[k])) for k in range(len(parts))], np.int32)
        return np.fromiter(map(len, side.multi_compress_to_buffer(parts, threads=0)), np.int32, len(parts))

    def _between(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts), np.int32)
        for at in range(0, len(starts), PART):
            start, end = starts[at : at + PART], ends[at : at + PART]
            parts = zstandard.BufferWithSegments(data, np.stack([start, end - start], axis=1).astype(np.uint64).tobytes())
            for ordinary, toxic in self.sides:
                out[at : at + PART] += self._lengths(ordinary, parts) - self._lengths(toxic, parts)
        return out

    def of(self, data: bytes, starts: np.ndarray) -> np.ndarray:
        return self._between(data, starts, np.minimum(starts + WINDOW, len(data)))

    def of_texts(self, texts: list[bytes]) -> list[np.ndarray]:
        """The margins of all windows of each text; the texts go to zstandard together."""
        starts = [window_starts(len(x)) for x in texts]
        sizes = np.array([len(x) for x in starts])
        until = np.cumsum([len(x) for x in texts])
        first = np.concatenate([x + (end - len(t)) for x, t, end in zip(starts, texts, until)])
        found = self._between(b"".join(texts), first, np.minimum(first + WINDOW, np.repeat(until, sizes)))
        return np.split(found, np.cumsum(sizes)[:-1])


def histograms(margins: np.ndarray) -> np.ndarray:
    """How often each margin of single windows and of runs of three occurs, one after another."""
    runs = np.convolve(margins, np.ones(3, np.int32), "valid") if len(margins) >= 3 else margins.sum(keepdims=True)[: len(margins)]
    return np.concatenate([np.bincount(np.clip(m + low, 0, span - 1), minlength=span) for m, low, span in zip((margins, runs), LOW, SPAN)])


def thresholds(histogram: np.ndarray) -> tuple[int, ...]:
    """For both kinds of margin, the least that QUANTILES of a histogram stay below."""
    out: list[int] = []
    at = 0
    for span in SPAN:
        seen = np.cumsum(histogram[at : at + span])
        out += [min(span - 1, int(np.searchsorted(seen, q * seen[-1], side="left")) + 1) for q in QUANTILES]
        at += span
    return tuple(out)


def measures(histogram: np.ndarray, cuts: tuple[int, ...]) -> np.ndarray:
    """What the fit sees of a document: its windows, and how many and what share pass each threshold."""
    single, runs = histogram[: SPAN[0]], histogram[SPAN[0] :]
    n = len(QUANTILES)
    hits = [single[c:].sum() for c in cuts[:n]] + [runs[c:].sum() for c in cuts[n:]]
    total = single.sum()
    return np.array([*np.log1p(hits), *(h / max(1, total) for h in hits), np.log1p(total)])


@dataclass(frozen=True)
class Model:
    background: bytes
    pairs: tuple[Pair, ...]
    cuts: tuple[int, ...] = ()
    #: Standardized logistic fit over measures().
    mean: tuple[float, ...] = ()
    spread: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model, self.margins = model, Margins(model.background, model.pairs)

    def histogram(self, text: str | None) -> np.ndarray:
        return histograms(self.margins.of_texts([prepared(text)])[0])

    def scores(self, texts: list[str | None]) -> list[float]:
        """The scores of one text or more."""
        m = self.model
        mean, spread, weights = (np.array(x) for x in (m.mean, m.spread, m.weights))
        out = []
        for margins in self.margins.of_texts([prepared(x) for x in texts]):
            z = np.append((measures(histograms(margins), m.cuts) - mean) / spread, 1.0) @ weights
            out.append(float(1 / (1 + np.exp(-np.clip(z, -500, 500)))))
        return out


def _signature(text: str | None) -> list[int]:
    found = set(prepared(text).split())
    h = np.fromiter((zlib.crc32(w) for w in found), np.uint64, len(found)) if found else np.zeros(1, np.uint64)
    return [int(((h * np.uint64(m) + np.uint64(m >> 7)) % np.uint64(4294967291)).min()) for m in (2654435761, 2246822519, 3266489917, 668265263)]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.c_[(x - mean) / spread, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    ridge = np.eye(len(w))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (weight * (p - y)) + ridge @ w)
        w = w - np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return mean, spread, w


def _trained(samples: list[bytes], size: int) -> bytes | None:
    """zstandard's dictionary of about so many bytes; None if there is too little to train on."""
    samples = [x for x in samples if len(x) >= COUNTED]
    most = TRAINING_BYTES // WINDOW
    if len(samples) > most:
        samples = [samples[int(k)] for k in np.linspace(0, len(samples) - 1, most)]
    size = min(size, sum(map(len, samples)))
    if size < 256:
        return None
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=COUNTED).as_bytes()
    except zstandard.ZstdError:
        return None


def _spread(starts: np.ndarray, most: int) -> np.ndarray:
    return starts if len(starts) <= most else starts[np.linspace(0, len(starts) - 1, most).astype(np.int64)]


PICKED = "doc_id long, toxic int, part int, windows array<binary>"


def _sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]] | None:
    """The stored sample with parts (0, 1: halves that train, 2: calibration), and all labels by class."""
    marks = labels.filter("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").cast("long"), "toxic")
    marks = marks.filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None
    by_hash = lambda side, n: marks.filter(F.col("toxic") == side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = by_hash(1, SAMPLE_TOXIC).unionByName(by_hash(0, SAMPLE_ORDINARY))
    text = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null")
    # At most SAMPLE_TOXIC + SAMPLE_ORDINARY ids are broadcast.
    found = text.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    sampled = store(found.repartition(32, "doc_id"), "toxic-sample")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = pa.array([_signature(x.as_py()) for x in batch.column(1)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), signed], ["doc_id", "signature"])

    kept: list[int] = []
    seen: set = set()
    for r in sampled.select("doc_id", "text").mapInArrow(sign, "doc_id long, signature array<long>").orderBy("doc_id").collect():
        keys = {(0, *r["signature"][:2]), (1, *r["signature"][2:])}
        if not keys & seen:
            kept.append(r["doc_id"])
        seen |= keys
    # One row for each kept document of the bounded sample.
    ids = docs.sparkSession.createDataFrame([(i, zlib.crc32(f"part {i}".encode()) % 3) for i in kept], "doc_id long, part int")
    parted = store(sampled.join(F.broadcast(ids), "doc_id").select("doc_id", "toxic", "text", "part").repartition(32, "doc_id"), "toxic-parts")
    discard(sampled)
    return parted, sizes


def _picked(train: DataFrame, most: dict[int, int], background: bytes | None, pairs: list[Pair] | None) -> dict[tuple[int, int], list[bytes]]:
    """By (toxic, half): windows from all over each document, or those with its greatest margins under the other half's pair."""
    shared = train.sparkSession.sparkContext.broadcast((background, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        background, pairs = shared.value
        judges = [Margins(background, (p,)) for p in pairs] if pairs else []
        for batch in batches:
            chosen = []
            for toxic, text, part in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                data = prepared(text)
                starts = window_starts(len(data))
                if judges:
                    starts = _spread(starts, LEARNED_WINDOWS)
                    m = judges[1 - part].of(data, starts)
                    best = np.argsort(-m, kind="stable")[: max(1, round((BEST_TOXIC if toxic else BEST_ORDINARY) * len(m)))]
                    # Of an ordinary document the likest to toxic ones, however far from it they are.
                    starts = starts[np.sort(best[m[best] > 0] if toxic else best)]
                else:
                    starts = _spread(starts, most[toxic])
                chosen.append([data[k : k + WINDOW] for k in starts.tolist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(chosen, pa.list_(pa.binary()))], ["doc_id", "toxic", "part", "windows"])

    out: dict[tuple[int, int], list[bytes]] = {(t, h): [] for t in (0, 1) for h in (0, 1)}
    # At most TRAINING_BYTES of each class come here, or LEARNED_WINDOWS * BEST_ORDINARY windows of each sampled document.
    for r in sorted(train.mapInArrow(run, PICKED).collect(), key=lambda r: r["doc_id"]):
        out[r["toxic"], r["part"]] += [bytes(w) for w in r["windows"]]
    return out


def _dictionaries(train: DataFrame, documents: dict[int, int]) -> tuple[bytes, list[Pair]] | None:
    most = {t: min(LEARNED_WINDOWS, max(1, TRAINING_BYTES // (WINDOW * n))) for t, n in documents.items()}
    picked = _picked(train, most, None, None)
    background = _trained(picked[0, 0] + picked[0, 1], BACKGROUND_BYTES)
    pairs: list[Pair] = []
    for turn in range(ROUNDS + 1):
        sizes = [min(CLASS_BYTES, sum(map(len, picked[1, h])) // BYTES_PER_BYTE) for h in (0, 1)]
        made = [(_trained(picked[1, h], n), _trained(picked[0, h], n)) for h, n in enumerate(sizes)]
        # Once nothing is left that the classes differ by, the dictionaries before stay.
        if background is None or any(x is None for two in made for x in two):
            break
        pairs = [Pair(*two) for two in made]
        if turn < ROUNDS:
            picked = _picked(train, most, background, pairs)
    return (background, pairs) if pairs else None


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """From the labels of documents that are not held out; None without enough of both kinds of label."""
    found = _sample(docs, labels)
    if found is None:
        return None
    sampled, sizes = found
    model = _fitted(sampled, sizes)
    discard(sampled)
    return model


def _fitted(sampled: DataFrame, sizes: dict[int, int]) -> Model | None:
    n = {(r["toxic"], r["part"]): r["n"] for r in sampled.groupBy("toxic", "part").agg(F.count(F.lit(1)).alias("n")).collect()}
    if min(n.get((t, h), 0) for t in (0, 1) for h in (0, 1)) < LEAST_DOCUMENTS / 2:
        return None
    made = _dictionaries(sampled.filter("part < 2"), {t: n[t, 0] + n[t, 1] for t in (0, 1)})
    if made is None:
        return None
    background, pairs = made
    shared = sampled.sparkSession.sparkContext.broadcast(Model(background, tuple(pairs)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            rows = [scorer.histogram(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], ["toxic", "counts"])

    # A histogram of fixed size for each calibration document of the bounded sample.
    rows = sampled.filter("part = 2").select("toxic", "text").mapInArrow(count, "toxic int, counts array<long>").collect()
    y = np.array([r["toxic"] for r in rows], float)
    if len(set(y.tolist())) < 2:
        return None
    counts = [np.array(r["counts"], np.int64) for r in rows]
    cuts = thresholds(sum(c for c, t in zip(counts, y) if not t))
    x = np.array([measures(c, cuts) for c in counts])
    share = np.where(y == 1, sizes[1] / y.sum(), sizes[0] / (1 - y).sum())
    mean, spread, weights = _logistic(x, y, share * len(y) / share.sum())
    return Model(background, tuple(pairs), cuts, tuple(mean), tuple(spread), tuple(weights))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs(doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long"), (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "text")
    if model is None:
        scored = rows.select("doc_id", "held_out", F.lit(0.0).alias("score"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(shared.value)
            for batch in batches:
                for at, texts in slices(batch, 2):
                    found = pa.array(scorer.scores(texts), pa.float64())
                    part = batch.slice(at, len(texts))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), found], ["doc_id", "held_out", "score"])

        scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, learn(docs, labels))
