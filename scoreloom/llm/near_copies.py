"""One document of each group of near copies: SimHash at a Jaccard similarity of 0.8 or more.

This is the operator of simhash_bktree for a wide radius. At five-word Jaccard 0.8 fingerprints differ
in about 15 of 100 bits, so that fingerprints of BITS bits are linked within RADIUS of them. No dealing
by equal bit blocks is left at such a radius, so shards are dealt by bands of min-hashes. A task builds the
BK-tree of its shard and searches it for each of its rows along the edges within the radius; what hangs below a
node and is of one root already is not searched for that root. A large shard is cut, and every two cuts meet in a
task of their own.

Two passes find the links. The first emits a forest of each shard that links every document to its nearest
neighbours, and confirms its links by the exact Jaccard similarity of whole shingle sets; that joins nearly all
copies while shards hold fingerprints only. As a link that fails may stand for one that holds, the second pass
takes the documents that still have a neighbour within the radius under another root, brings their
shingle sets to their shards, and tests every such pair there, so that no untried pair is left. Neither pass
emits a shard's pairs.

Equal sets are one from the start. A pair at exactly 0.8 shares no band with probability
(1 - 0.8 ** 6) ** 27 < 0.0003 and lies beyond the radius with less than 0.0005, a closer one more rarely.

Defined cases: a null text counts as empty; texts without words are copies of each other; a text of
less than five words is one shingle; a null doc_id is kept only where its group has no other; repeated
rows are copies; an empty table gives an empty result; extra columns are carried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import discard, store
from scoreloom.llm.simhash_bktree import SEED, connected, shingle_hashes

WORDS = 5
#: Least similarity, as a fraction.
NEAR = (4, 5)
BANDS, ROWS = 27, 6
#: Bits of a fingerprint, in words of 64, and of them those in which linked documents may differ.
BITS = 256
RADIUS = 58
#: Documents of a shard that one task scans against each other, and hashes of their sets where it holds those as well.
SHARD = 4096
HASHES = 1 << 21
#: Pairs of a row and a node that a search holds at a time, about.
PAIRS = 1 << 18
#: Shingles that documents of a task share, up to which they are bits.
TERMS = 1 << 14
#: Pairs of one document beyond which its set is dealt to several tasks.
SPLIT = 512

_random = np.random.default_rng(SEED)
_FACTORS = _random.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_TERMS = _random.integers(0, 1 << 32, BANDS * ROWS, np.uint32)


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(shingle_hashes(text, WORDS, SEED))


def bands(hashes: np.ndarray) -> list[int]:
    """A number for each band of the set's min-hashes."""
    if not len(hashes):
        return [0] * BANDS
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 1024):
        np.minimum(least, (_FACTORS[:, None] * low[None, at : at + 1024] + _TERMS[:, None]).min(axis=1), out=least)
    data, size = least.tobytes(), 4 * ROWS
    return [xxhash.xxh64_intdigest(data[k * size : (k + 1) * size], k) for k in range(BANDS)]


def fingerprint(hashes: np.ndarray) -> bytes:
    """The SimHash of BITS bits of a shingle set; each word of 64 bits mixes the hashes in its own way."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 16384):
        part = hashes[at : at + 16384, None] * np.array([(2 * k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1 for k in range(BITS // 64)], np.uint64)
        part = (part ^ (part >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        part ^= part >> np.uint64(32)
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def near(a: np.ndarray, b: np.ndarray) -> bool:
    """If the sets' exact Jaccard similarity is NEAR or more."""
    part, whole = NEAR
    if whole * min(len(a), len(b)) < part * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return whole * both >= part * (len(a) + len(b) - both)


def _signatures(keyed: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            equal, fps, found = [], [], []
            for x in batch.column(1):
                hashes = shingle_set(x.as_py())
                equal.append(xxhash.xxh128_digest(hashes.tobytes(), SEED))
                fps.append(fingerprint(hashes))
                found.append(bands(hashes))
            flat = pa.array(np.array(found, np.uint64).view(np.int64).reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * BANDS), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(equal, pa.binary()), pa.array(fps, pa.binary()), lists], ["key", "equal", "fp", "bands"])

    return keyed.mapInArrow(run, "key long, equal binary, fp binary, bands array<long>")


def _sets(keyed: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = [shingle_set(x.as_py()).view(np.int64) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["key", "hashes"])

    return keyed.mapInArrow(run, "key long, hashes array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are near."""
    out = pairs
    for side, other, name in (("a", "b", "left"), ("b", "a", "right")):
        # A document of many pairs, as a hub is, would else be one task's.
        heavy = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SPLIT).select(side, F.ceil(F.col("n") / SPLIT).cast("int").alias("parts"))
        parts = F.coalesce("parts", F.lit(1))
        needed = pairs.select(side).distinct().join(F.broadcast(heavy), side, "left").select(side, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        held = needed.join(sets.select(F.col("key").alias(side), F.col("hashes").alias(name)), side)
        dealt = out.join(F.broadcast(heavy), side, "left").withColumn("part", F.pmod(F.xxhash64(other), parts).cast("int")).drop("parts")
        out = dealt.join(held, [side, "part"]).drop("part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            kept = [near(left[k].values.to_numpy(), right[k].values.to_numpy()) for k in range(batch.num_rows)]
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    return out.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    bits = np.bitwise_count(a ^ b)
    out = bits[:, 0].astype(np.int64)
    for k in range(1, bits.shape[1]):
        out += bits[:, k]
    return out


def _runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ..., n[k] numbers for each k."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


class BKTree:
    """Rows of fingerprints under Hamming distance; children are keyed by their distance to the parent.

    It is built a level at a time and is the tree that adding the rows in order gives. Rows equal to a node are its
    members, no children, so that copies do not make it deep.
    """

    def __init__(self, fps: np.ndarray, label: np.ndarray) -> None:
        self.fps = fps
        #: For each level its nodes by (place of the parent in the level above, distance to it), as one number, the
        #: rows that they are and whether rows below them differ in label.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        #: Rows that searches have been compared with.
        self.compared = 0
        home = np.arange(len(fps))
        rows, keys = home.copy(), np.zeros(len(fps), np.int64)
        while len(rows):
            found, first, group = np.unique(keys, return_index=True, return_inverse=True)
            top = rows[first][group]
            mixed = np.zeros(len(found), bool)
            mixed[group[label[rows] != label[top]]] = True
            self.levels.append((found, rows[first], mixed))
            d = _distances(fps[rows], fps[top])
            below = d > 0
            home[rows[~below]] = top[~below]
            keys = group[below] * (BITS + 1) + d[below]
            order = np.argsort(keys, kind="stable")
            rows, keys = rows[below][order], keys[order]
        self.members = np.argsort(home, kind="stable")
        self.first = np.searchsorted(home[self.members], np.arange(len(fps) + 1))

    def within(self, asked: np.ndarray, own: np.ndarray, ends: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(k, row, distance): the rows before ends[k] within the radius of asked[k] and of another label than own[k].

        Labels may have been joined since the tree was built, not parted.
        """
        k, node = np.arange(len(asked)), np.zeros(len(asked), np.int64)
        hits = [(k[:0], k[:0], k[:0])]
        for level, (_, nodes, mixed) in enumerate(self.levels):
            # A node comes before all rows below it.
            go = (nodes[node] < ends[k]) & (mixed[node] | (label[nodes[node]] != own[k]))
            k, node = k[go], node[go]
            self.compared += len(k)
            d = _distances(self.fps[nodes[node]], asked[k])
            near = d <= RADIUS
            hits.append((k[near], nodes[node[near]], d[near]))
            if level + 1 == len(self.levels) or not len(k):
                break
            keys = self.levels[level + 1][0]
            inner = np.zeros(len(nodes), bool)
            inner[keys // (BITS + 1)] = True
            inner = inner[node]
            k, node, d = k[inner], node[inner], d[inner]
            first = np.searchsorted(keys, node * (BITS + 1) + np.maximum(d - RADIUS, 0))
            n = np.searchsorted(keys, node * (BITS + 1) + np.minimum(d + RADIUS, BITS), "right") - first
            k, node = np.repeat(k, n), _runs(first, n)
        k, node, d = (np.concatenate(x) for x in zip(*hits))
        n = self.first[node + 1] - self.first[node]
        k, d, rows = np.repeat(k, n), np.repeat(d, n), self.members[_runs(self.first[node], n)]
        kept = (rows < ends[k]) & (label[rows] != own[k])
        return k[kept], rows[kept], d[kept]


def _beside(fps: np.ndarray, label: np.ndarray, left: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows in turn, as in scan(), with the places within the radius and of another label now, nearest first; none for most without."""
    tree = BKTree(fps[: left or len(fps)], label)
    step = max(1, PAIRS // len(fps))
    for at in range(max(left, 1), len(fps), step):
        part = np.arange(at, min(at + step, len(fps)))
        k, rows, d = tree.within(fps[part], label[part], np.minimum(part, left or len(fps)), label)
        # By k, then distance, then place.
        order = np.sort((k * (BITS + 1) + d) * len(fps) + rows)
        n = np.bincount(k, minlength=len(part))
        for i, near in zip(part[n > 0].tolist(), np.split(order % len(fps), np.cumsum(n[n > 0])[:-1])):
            yield i, near[label[near] != label[i]]


def scan(fps: np.ndarray, roots: np.ndarray, left: int, holds: Callable[[int, np.ndarray], np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Places of a forest of links within the radius between rows of different roots, nearest first for each row.

    fps has BITS // 64 words for each row. Rows before `left` are compared with all after them from `left` on; if left
    is 0, every row is compared with those before it. holds(i, places), if given, tells which links count.
    """
    label = np.unique(roots, return_inverse=True)[1]
    edges = []
    for i, near in _beside(fps, label, left):
        if holds and len(near):
            near = near[holds(i, near)]
        # Of the rows of one root the nearest stands for all.
        for j in near[np.sort(np.unique(label[near], return_index=True)[1])].tolist():
            edges.append((i, j))
            label[label == label[j]] = label[i]
    return edges


def open_rows(fps: np.ndarray, roots: np.ndarray, left: int) -> np.ndarray:
    """Places of the rows that have a row of another root within the radius, of rows as in scan()."""
    found = np.zeros(len(fps), bool)
    for i, near in _beside(fps, roots, left):
        found[near] = True
        found[i] |= len(near) > 0
    return np.flatnonzero(found)


def similarity_test(sets: list[np.ndarray]) -> Callable[[int, np.ndarray], np.ndarray]:
    """holds(i, places): which of these sets are at NEAR or more to set i, exactly."""
    n = np.array([len(x) for x in sets], np.int64)
    _, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # A hash of one set only is in no intersection.
    shared = counts > 1
    names = np.cumsum(shared) - 1
    terms = int(shared.sum())
    coded = [names[c[shared[c]]] for c in np.split(codes, np.cumsum(n)[:-1])]
    mark = np.zeros(terms + -terms % 64, bool)
    bits = None
    if terms <= TERMS:
        bits = np.zeros((len(sets), len(mark) // 64), np.uint64)
        for k, c in enumerate(coded):
            mark[c] = True
            bits[k] = np.packbits(mark, bitorder="little").view(np.uint64)
            mark[c] = False
    part, whole = NEAR

    def holds(i: int, places: np.ndarray) -> np.ndarray:
        out = whole * np.minimum(n[places], n[i]) >= part * np.maximum(n[places], n[i])
        alike = places[out]
        if bits is not None:
            both = np.bitwise_count(bits[alike] & bits[i]).sum(axis=1, dtype=np.int64)
        else:
            mark[coded[i]] = True
            both = np.array([np.count_nonzero(mark[coded[j]]) for j in alike.tolist()], np.int64)
            mark[coded[i]] = False
        out[out] = whole * both >= part * (n[alike] + n[i] - both)
        return out

    return holds


def _dealt(members: DataFrame, weight: Column, limit: int, sets: DataFrame | None = None) -> DataFrame:
    """members(bucket, key, fp, root) with (bucket, low, high, own) in front; the rows of two cuts, or of a shard that is not cut, together in a partition.

    The hashes of sets(key, hashes), if given, come last; they are moved once, to where their rows are dealt.
    """
    sizes = members.groupBy("bucket").agg(F.ceil(F.sum(weight) / limit).cast("int").alias("cuts")).filter("cuts > 1")
    cuts = F.coalesce("cuts", F.lit(1))
    own = F.pmod(F.xxhash64("key"), cuts).cast("int")
    rest = ["key", "fp", "root"]
    # Every row of a shard that is cut goes to a task for each cut.
    cut = members.join(sizes, "bucket", "left").withColumn("own", own)
    dealt = cut.select("*", F.explode(F.sequence(F.lit(0), cuts - 1)).alias("other"))
    placed = dealt.select("bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", *rest)
    if sets is not None:
        placed = placed.join(sets, "key").select(*placed.columns, "hashes")
    return placed.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "own", F.xxhash64("key"))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, list, int]]:
    """(bucket, keys, fps, roots, sets, left) of each shard or pair of cuts that has rows to compare; sets are empty without a fifth column."""

    def packed() -> Iterator[tuple]:
        left = sum(r[0] == shard[1] for r in rows) if shard[1] != shard[2] else 0
        if len(rows) > 1 and (shard[1] == shard[2] or 0 < left < len(rows)):
            fps = np.frombuffer(b"".join(r[2] for r in rows), np.uint64).reshape(-1, BITS // 64)
            yield shard[0], np.array([r[1] for r in rows], np.int64), fps, np.array([r[3] for r in rows], np.int64), [r[4] for r in rows], left

    shard, rows = None, []
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(7)]
        sets = [x.values.to_numpy() for x in batch.column(7)] if batch.num_columns > 7 else [None] * batch.num_rows
        for bucket, low, high, *row in zip(*columns, sets):
            if (bucket, low, high) != shard:
                if rows:
                    yield from packed()
                shard, rows = (bucket, low, high), []
            rows.append(row)
    if rows:
        yield from packed()


def _forests(members: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """(a, b): for each shard a forest of links between documents of different roots; members(bucket, key, fp, root).

    With their shingle sets(key, hashes) the links are those at NEAR or more, and no others stand for them.
    """
    exact = sets is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, keys, fps, roots, sets, left in _shards(batches):
            edges = scan(fps, roots, left, similarity_test(sets) if exact else None)
            pair = np.sort(keys[np.array(edges, np.int64).reshape(-1, 2)], axis=1)
            if len(pair):
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    if exact:
        members = members.join(sets.select("key", F.size("hashes").alias("n")), "key")
    weight, limit = (F.col("n"), HASHES) if exact else (F.lit(1), SHARD)
    return _dealt(members, weight, limit, sets).mapInArrow(run, "a long, b long").distinct()


def _open(members: DataFrame) -> DataFrame:
    """The rows of members(bucket, key, fp, root) that have a row of another root within the radius in their shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, keys, fps, roots, _, left in _shards(batches):
            at = open_rows(fps, roots, left)
            if len(at):
                columns = [np.full(len(at), bucket, np.int64), keys[at], [fps[k].tobytes() for k in at], roots[at]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["bucket", "key", "fp", "root"])

    return _dealt(members, F.lit(1), SHARD).mapInArrow(run, "bucket long, key long, fp binary, root long").distinct()


def groups(keyed: DataFrame) -> DataFrame:
    """(key, group) for every row of keyed(key, text), whose keys are distinct."""
    signed = store(_signatures(keyed.select("key", "text")), "signatures")
    firsts = store(signed.groupBy("equal").agg(F.min("key").alias("key")), "equal-sets")
    alone = signed.join(firsts.select("key"), "key", "left_semi").select("key", F.explode("bands").alias("bucket"))
    sizes = alone.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    # Most bands are one document's, so fingerprints only join those that are not.
    dealt = alone.join(sizes, "bucket", "left_semi")
    shared = store(dealt.join(signed.select("key", "fp"), "key").select("bucket", "key", "fp"), "shards")
    pairs = store(_forests(shared.withColumn("root", F.col("key"))), "candidates")
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    # Every document with another within the radius in a shard is in a forest, so these sets are the second pass's too.
    sets = store(_sets(keyed.select("key", "text").join(keys, "key", "left_semi")), "sets")
    edges = store(_confirmed(pairs, sets), "confirmed")
    discard(pairs)
    roots = connected(edges)
    rooted = shared.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    apart = rooted.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("bucket")
    left = store(_open(rooted.join(apart, "bucket", "left_semi").select("bucket", "key", "fp", "root")), "open")
    more = store(_forests(left, sets), "links")
    discard(left)
    discard(sets)
    if not more.isEmpty():
        roots = connected(edges.unionByName(more))
    named = firsts.join(roots.withColumnRenamed("node", "key"), "key", "left").select("equal", F.coalesce("root", "key").alias("group"))
    return signed.select("key", "equal").join(named, "equal").select("key", "group")


def keep_one_each(docs: DataFrame) -> DataFrame:
    """One row of docs of each group, that of the least doc_id (null last), with its own columns."""
    keyed = store(docs.withColumn("__key", F.monotonically_increasing_id()), "keyed")
    found = groups(keyed.select(F.col("__key").alias("key"), "text")).select(F.col("key").alias("__key"), F.col("group").alias("__group"))
    ids = keyed.select("__key", F.col("doc_id").cast("long").alias("__id")).join(found, "__key")
    first = F.min(F.struct(F.col("__id").isNull(), F.col("__id"), F.col("__key").alias("key"))).alias("first")
    kept = ids.groupBy("__group").agg(first).select(F.col("first.key").alias("__key"))
    # The rows that go are few; stored, their size is known, so that texts are not shuffled where Spark can broadcast them.
    gone = store(ids.select("__key").join(kept, "__key", "left_anti"), "gone")
    return keyed.join(gone, "__key", "left_anti").select(*docs.columns)
