"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are sorted by length and cut into buckets of near lengths. A query's running k-th score over
its own length and a bucket's largest length is the bucket's local cosine threshold. Above 1 the
bucket is skipped; when it is high, candidates must lie in the feasible range of the query's largest
coordinates (coordinate pruning); when it is low, only vectors long enough are taken (length
pruning). What is left is verified by exact products.

Queries go through in blocks of bounded size, each broadcast against all buckets; a task keeps a
running top k over its buckets, longest vectors first, and the tasks' lists are merged by rank.

Defined cases: vectors that are null or hold null or non-finite components, and rows with a null
vec_id, take no part; of unequal lengths the shorter vector counts as padded with zeros; all rows
with the query's vec_id are its own; a repeated query row is answered once for each distinct vector;
repeated candidate rows each count; scores beyond a long are held at its ends; empty tables give
empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm.common import store

K = 10
SCALE = 1024.0
BUCKET_ROWS = 2048
QUERY_ROWS = 2048
#: Vectors that a partition of the bucketing sort is meant to hold.
SORT_ROWS = 8192
#: Query blocks whose results are searched for in one plan before they are written.
PLAN_BLOCKS = 8
#: Local cosine thresholds from which coordinates prune.
HIGH_COSINE = 0.8
FOCUS = 3

BUCKET = "longest double, dim int, ids binary, matrix binary"


def _usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, norm): scaled whole numbers, held as doubles, of the vectors that take part."""
    e = F.transform("embedding", lambda x: F.floor(F.lit(SCALE) * x.cast("double")))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    scaled = F.transform("embedding", lambda x: F.lit(SCALE) * x.cast("double"))
    small = F.forall(scaled, lambda x: F.abs(x) < 2.0**62)
    whole = F.when(small, F.transform(e, lambda x: x.cast("double"))).otherwise(scaled)
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    rows = rows.filter(finite).select("vec_id", whole.alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Sorted rows in blocks: each the vectors of one stretch of a partition, as one matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        vectors: list[np.ndarray] = []
        norms: list[float] = []

        def flush() -> pa.RecordBatch:
            dim = max(map(len, vectors))
            m = np.zeros((len(vectors), dim))
            for k, v in enumerate(vectors):
                m[k, : len(v)] = v
            columns = [[max(norms)], [dim], [np.array(ids, np.int64).tobytes()], [m.tobytes()]]
            ids.clear(), vectors.clear(), norms.clear()
            kinds = (pa.float64(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["longest", "dim", "ids", "matrix"])

        for batch in batches:
            for i, v, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                ids.append(i), vectors.append(np.array(v.as_py(), np.float64)), norms.append(n)
                if len(ids) == size:
                    yield flush()
        if ids:
            yield flush()

    return rows.select("vec_id", "v", "norm").mapInArrow(run, BUCKET)


def unpack(ids: bytes, matrix: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(matrix, np.float64).reshape(len(i), dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, as longs."""
    dim = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, dim - x.shape[1]))) for x in (a, b))
    if dim * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 2.0**53:
        return np.rint(a @ b.T).astype(np.int64)
    ints = [[[int(x) for x in row] for row in m] for m in (a, b)]
    top = (1 << 63) - 1
    return np.array([[max(-top - 1, min(top, sum(x * y for x, y in zip(q, p)))) for p in ints[1]] for q in ints[0]], np.int64).reshape(len(a), len(b))


class TopK:
    """Running best k candidates of each query of a block: highest score, then smallest id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        self.norms = np.sqrt((vectors**2).sum(axis=1))
        self.limit = np.full(len(ids), -np.inf)
        self.q = np.zeros(0, np.int64)
        self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        unit = vectors / np.where(self.norms > 0, self.norms, 1)[:, None]
        f = min(FOCUS, vectors.shape[1])
        self.focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :f]
        self.unit = np.take_along_axis(unit, self.focus, axis=1)

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        q, ids, scores = np.append(self.q, q), np.append(self.id, ids), np.append(self.score, scores)
        # ~score sorts as -score does, and does not overflow.
        order = np.lexsort((ids, ~scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.q, self.id, self.score = q[keep], ids[keep], scores[keep]
        full = rank[keep] == self.k - 1
        self.limit[self.q[full]] = self.score[full]

    def search(self, ids: np.ndarray, vectors: np.ndarray) -> dict[str, int]:
        """Takes in a bucket whose vectors are sorted, longest first; counts queries by what pruned."""
        lengths = np.sqrt((vectors**2).sum(axis=1))
        longest = lengths.max(initial=0.0)
        # Room for rounding, so that no vector that could tie is lost.
        limit = np.where(self.limit > 0, self.limit * (1 - 1e-9), self.limit)
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(self.norms * longest > 0, limit / (self.norms * longest), np.where(limit > 0, np.inf, -np.inf))
        by_length = np.flatnonzero(cosine < HIGH_COSINE)
        by_coordinate = np.flatnonzero((cosine >= HIGH_COSINE) & (cosine <= 1))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(by_length):
            need = np.where(limit[by_length] > 0, limit[by_length] / np.maximum(self.norms[by_length], 1e-300), -1.0)
            most = int((lengths >= need.min()).sum())
            s = products(self.vectors[by_length], vectors[:most])
            hit, at = np.nonzero((s >= self.limit[by_length, None]) & (ids[None, :most] != self.ids[by_length, None]))
            found.append((by_length[hit], ids[at], s[hit, at]))
        if len(by_coordinate):
            unit = vectors / np.where(lengths > 0, lengths, 1)[:, None]
            for q in by_coordinate.tolist():
                t = cosine[q]
                ok = (lengths >= limit[q] / self.norms[q]) & (ids != self.ids[q])
                for f, x in zip(self.focus[q], self.unit[q]):
                    if f < unit.shape[1]:
                        room = np.sqrt(max(0.0, (1 - t * t) * (1 - x * x))) + 1e-9
                        # With the query at angle a from the axis and candidates within b of the query.
                        low = x * t - room if x > -t else -1.0
                        high = x * t + room if x < t else 1.0
                        ok &= (unit[:, f] >= low - 1e-9) & (unit[:, f] <= high + 1e-9)
                at = np.flatnonzero(ok)
                if len(at):
                    s = products(self.vectors[q : q + 1], vectors[at])[0]
                    keep = s >= self.limit[q]
                    found.append((np.full(keep.sum(), q), ids[at[keep]], s[keep]))
        if found:
            self.add(*(np.concatenate(x) for x in zip(*found)))
        return {"length": len(by_length), "coordinate": len(by_coordinate), "skipped": len(self.ids) - len(by_length) - len(by_coordinate)}


def top_k(vectors: DataFrame, k: int = K, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best, over vectors(vec_id, embedding)."""
    spark = vectors.sparkSession
    usable = store(_usable(vectors), "vectors")
    parts = max(1, -(-usable.count() // SORT_ROWS))
    sorted_rows = usable.repartitionByRange(parts, F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
    buckets = store(_blocks(sorted_rows, BUCKET_ROWS), "buckets")
    asked = usable.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"])
    asked = asked.repartitionByRange(max(1, parts // every), "norm", "vec_id").sortWithinPartitions("norm", "vec_id")
    queries = store(_blocks(asked, QUERY_ROWS), "queries")
    first = buckets.orderBy(F.desc("longest")).limit(1).collect()
    results: list[DataFrame] = []
    pending: list[DataFrame] = []
    # A block of at most QUERY_ROWS queries is on the driver and broadcast at a time.
    for row in queries.toLocalIterator():
        seed = TopK(*unpack(row["ids"], row["matrix"], row["dim"]), k)
        for b in first:
            seed.search(*unpack(b["ids"], b["matrix"], b["dim"]))
        shared = spark.sparkContext.broadcast((seed.ids, seed.vectors, seed.limit))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, matrix, limit = shared.value
            best = TopK(ids, matrix, k)
            best.limit = limit.copy()
            for batch in batches:
                for dim, i, m in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
                    best.search(*unpack(i, m, dim))
            part = np.arange(len(ids))[best.q]
            yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(part), pa.array(best.id), pa.array(best.score)], ["query_id", "part", "vec_id", "score"])

        # Buckets too short for every query of the block are not read.
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(seed.limit > 0, seed.limit / seed.norms, -1.0)
        wanted = buckets.filter(F.col("longest") >= float(need.min()) * (1 - 1e-9)) if need.min() > 0 else buckets
        pending.append(wanted.mapInArrow(run, "query_id long, part long, vec_id long, score long"))
        if len(pending) == PLAN_BLOCKS:
            results.append(store(_best(pending, k), "found"))
            pending = []
    if pending or not results:
        results.append(_best(pending or [spark.createDataFrame([], "query_id long, part long, vec_id long, score long")], k))
    # Blocks hold different queries, so their results need no further ranking.
    return reduce(DataFrame.unionByName, results)


def _best(found: list[DataFrame], k: int) -> DataFrame:
    """The tasks' lists of some query blocks, merged by rank."""
    tagged = [df.withColumn("block", F.lit(n)) for n, df in enumerate(found)]
    order = Window.partitionBy("block", "query_id", "part").orderBy(F.desc("score"), "vec_id")
    ranked = reduce(DataFrame.unionByName, tagged).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


#: The same by brute force over finite vectors.
ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
