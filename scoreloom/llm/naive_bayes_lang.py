"""Language identification: multinomial naive Bayes over hashed character n-grams.

Every text is lower-cased and its overlapping runs of 1 to 3 code points are hashed into buckets.
Training counts are gathered from all training documents as (lang, bucket, n). The log-probability
matrix is broadcast in blocks of at most BLOCK_LANGS languages, one after another: memory does not grow
with the languages. A batch of documents is a sparse matrix, a row of bucket counts for each, and is
scored by one product with a block; best score and sum of odds are carried from block to block.

A language's odds are its share of training documents times its likelihood to the power of EVIDENCE,
as overlapping n-grams are no independent ones.

Defined cases: `und` with score 0 for a text that is null or has no letter (Unicode category L; digits,
numerals and fractions are none), and for every text if nothing could be learned; a tie goes to the
language that sorts first; any number of languages is learned, each spelling as its own; repeated rows
and null doc_ids (fold of the empty id) are scored row by row; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import fold, store
from scoreloom.llm.pair_index_bpe import slices

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
#: Languages of a block; with BUCKETS it bounds the broadcast matrix to 32 MB.
BLOCK_LANGS = 256
FOLDS = 5
HELD_OUT = 0
UNDETERMINED = "und"
#: The posterior is that of n-grams whose evidence counts as this share of independent ones.
EVIDENCE = 0.2

#: Entries of rows times languages that one product works on.
PRODUCT = 1 << 22
#: Code points of a text that are hashed together.
PART = 1 << 20


def has_letter(text: str) -> bool:
    """If a character of the text is in category L, which is what isalpha() asks."""
    return any(map(str.isalpha, text))


def features(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of all n-grams of a text, in parts."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    over = max(ORDERS) - 1
    for at in range(0, len(points), PART):
        part = points[at : at + PART + over]
        for n in ORDERS:
            # An n-gram belongs to the part in which it begins.
            last = min(len(part) - n + 1, PART)
            if last <= 0:
                continue
            h = np.full(last, n, np.uint64)
            for k in range(n):
                h = (h ^ part[k : k + last]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            yield (h % np.uint64(BUCKETS)).astype(np.int32)


def _count(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over docs(lang, text), summed within each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, n in totals.items():
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(n[some])], ["lang", "bucket", "n"]
                )
            totals.clear()

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for at, texts in slices(batch):
                for lang, text in zip(langs[at : at + len(texts)], texts):
                    if lang not in totals:
                        if len(totals) == BLOCK_LANGS:
                            yield from flush()
                        totals[lang] = np.zeros(BUCKETS, np.int64)
                    for f in features(text):
                        if len(f) > BUCKETS:
                            totals[lang] += np.bincount(f, minlength=BUCKETS)
                        else:
                            np.add.at(totals[lang], f, 1)
        yield from flush()

    return docs.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Block:
    """Some of the languages, in order; given is BUCKETS by languages."""

    langs: tuple[str, ...]
    given: np.ndarray
    prior: np.ndarray


@dataclass(frozen=True)
class Model:
    #: Languages with their training documents, sorted, and the stored counts.
    sizes: tuple[tuple[str, int], ...]
    counts: DataFrame

    def blocks(self) -> Iterator[Block]:
        total = sum(n for _, n in self.sizes)
        for at in range(0, len(self.sizes), BLOCK_LANGS):
            part = self.sizes[at : at + BLOCK_LANGS]
            langs = tuple(x for x, _ in part)
            column = {x: k for k, x in enumerate(langs)}
            # At most BUCKETS rows for each of at most BLOCK_LANGS languages.
            found = self.counts.filter(F.col("lang").between(langs[0], langs[-1])).toArrow()
            counts = np.zeros((BUCKETS, len(langs)))
            where = np.fromiter((column[x] for x in found["lang"].to_pylist()), np.int64, found.num_rows)
            counts[found["bucket"].to_numpy(), where] = found["n"].to_numpy()
            given = np.log((counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * BUCKETS))
            yield Block(langs, given.astype(np.float32), np.log(np.array([n for _, n in part]) / total))


def learn(docs: DataFrame) -> Model | None:
    """From docs(text, lang); rows with a null lang teach nothing; None if no row does."""
    known = docs.filter(F.col("lang").isNotNull())
    rows = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    # Sorted as Spark compares strings, by their bytes.
    sizes = tuple(sorted(((r["lang"], r["n"]) for r in rows), key=lambda x: x[0].encode()))
    return Model(sizes, store(_count(known), "language-counts")) if sizes else None


def sparse_rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, counts and row starts of texts that each have a feature, as one sparse matrix."""
    buckets, counts = [], []
    for text in texts:
        n = np.zeros(BUCKETS, np.int64)
        for f in features(text):
            n += np.bincount(f, minlength=BUCKETS)
        buckets.append(np.flatnonzero(n))
        counts.append(n[buckets[-1]])
    sizes = np.fromiter(map(len, buckets), np.int64, len(buckets))
    return np.concatenate(buckets), np.concatenate(counts), np.cumsum(sizes) - sizes


def likelihoods(texts: list[str], given: np.ndarray) -> np.ndarray:
    """Texts by languages: the sparse matrix of texts times a block's log-probabilities."""
    buckets, counts, starts = sparse_rows(texts)
    out = np.zeros((len(texts), given.shape[1]))
    ends = np.append(starts[1:], len(buckets))
    step = max(1, PRODUCT // given.shape[1])
    row = 0
    while row < len(texts):
        # As many rows as fit; a row alone has at most BUCKETS entries.
        last = max(row + 1, int(np.searchsorted(ends, starts[row] + step, side="right")))
        inner = slice(starts[row], ends[last - 1])
        products = given[buckets[inner]].astype(np.float64) * counts[inner, None]
        out[row:last] = np.add.reduceat(products, starts[row:last] - starts[row], axis=0)
        row = last
    return out


STATE = ("__best", "__log_odds", "__lang")


def predict(docs: DataFrame, model: Model | None, added: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds the predicted language and its probability to docs, which has a text column; other columns are carried."""
    names = docs.columns
    if model is None:
        return docs.withColumns({added[0]: F.lit(UNDETERMINED), added[1]: F.lit(0.0)})
    text = names.index("text")
    kinds = ", ".join(f"`{n}` {k}" for n, k in docs.dtypes) + f", {STATE[0]} double, {STATE[1]} double, {STATE[2]} string"
    out = docs
    for k, block in enumerate(model.blocks()):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=k == 0) -> Iterator[pa.RecordBatch]:
            held = shared.value
            for batch in batches:
                for at, texts in slices(batch, text):
                    part = batch.slice(at, len(texts))
                    best, odds, lang = (np.full(len(texts), -np.inf), np.full(len(texts), -np.inf), [None] * len(texts)) if first else (
                        part.column(len(names)).to_numpy(), part.column(len(names) + 1).to_numpy(), part.column(len(names) + 2).to_pylist()
                    )
                    told = [i for i, t in enumerate(texts) if has_letter(t)]
                    if told:
                        score = held.prior + EVIDENCE * likelihoods([texts[i] for i in told], held.given)
                        top, best, odds = score.argmax(axis=1), best.copy(), odds.copy()
                        for row, i in enumerate(told):
                            odds[i] = np.logaddexp(odds[i], np.logaddexp.reduce(score[row]))
                            if score[row, top[row]] > best[i]:
                                best[i], lang[i] = score[row, top[row]], held.langs[top[row]]
                    columns = [*part.columns[: len(names)], pa.array(best), pa.array(odds), pa.array(lang, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, [*names, *STATE])

        out = out.mapInArrow(run, kinds)
    found = F.col(STATE[2]).isNotNull()
    shown = {
        added[0]: F.when(found, F.col(STATE[2])).otherwise(UNDETERMINED),
        added[1]: F.when(found, F.least(F.lit(1.0), F.exp(F.col(STATE[0]) - F.col(STATE[1])))).otherwise(0.0),
    }
    return out.select(*names, *[c.alias(n) for n, c in shown.items()])


def held_out(doc_id: Column) -> Column:
    return fold(doc_id, FOLDS) == HELD_OUT


def train_on(docs: DataFrame) -> Model | None:
    """Learns from the documents that are not held out."""
    return learn(docs.filter(~held_out(F.col("doc_id"))).select("text", "lang"))


#: A document stays if its language is as likely as this, at least.
LEAST_SCORE = 0.5


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language can be told, with their own columns."""
    named = predict(docs, train_on(docs), ("__lang_pred", "__lang_score"))
    return named.filter((F.col("__lang_pred") != UNDETERMINED) & (F.col("__lang_score") >= LEAST_SCORE)).select(*docs.columns)


def op3(docs: DataFrame) -> DataFrame:
    model = train_on(docs)
    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")
