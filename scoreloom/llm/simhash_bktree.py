"""SimHash fingerprints linked through BK-trees into near-duplicate components.

Distinct fingerprints are sharded so that any two within the radius meet in a shard: of radius + 1
disjoint bit blocks at least one is equal in both. A shard that is still large is dealt again by the
bits left over, and what stays large after that is cut into sub-shards of which every pair meets.
Each task builds the BK-tree of its shard (children keyed by their integer Hamming distance to the
parent) and follows only the edges within the radius. A shard emits a spanning forest of its links,
never its pairs.

Defined cases: a null text counts as empty; a text without words has fingerprint zero and links like
any other; repeated rows each come back; a null doc_id comes back and never names a component that
has another id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import discard, store

SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
#: Fingerprints in a shard beyond which it is dealt again.
SHARD_ROWS = 1024
#: How often large shards are dealt again before they are cut into sub-shards.
DEALS = 3


def shingle_hashes(text: str | None, words: int, seed: int = SEED) -> np.ndarray:
    """The hash of each lower-cased (A-Z) word shingle of a whole text, repeats included."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends + 1 - lengths)[: len(parts) - words + 1]
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist())),
        np.uint64,
        len(starts),
    )


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The 64-bit fingerprint of the lower-cased (A-Z) word shingles of a whole text, repeats included."""
    hashes = shingle_hashes(text, words, seed)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py(), words, seed) for x in batch.column(1)]
            fp = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Integers under Hamming distance; children are keyed by their distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at = len(self.values)
        self.values.append(value)
        self.children.append({})
        node = 0
        while node != at:
            d = (value ^ self.values[node]).bit_count()
            node = self.children[node].setdefault(d, at)

    def within(self, value: int, radius: int) -> list[int]:
        """Positions of the values at most radius away, found along edges d - radius to d + radius."""
        if not self.values:
            return []
        found, stack = [], [0]
        values, children = self.values, self.children
        while stack:
            node = stack.pop()
            d = (value ^ values[node]).bit_count()
            if d <= radius:
                found.append(node)
            below = children[node]
            if len(below) > 2 * radius + 1:
                stack.extend(below[e] for e in range(d - radius, d + radius + 1) if e in below)
            else:
                stack.extend(n for e, n in below.items() if d - radius <= e <= d + radius)
        return found


def shard_forest(tree_side: list[int], query_side: list[int] | None, radius: int, joined: dict[int, int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links inside tree_side, or between it and query_side, nearest links first for each value.

    joined gives values that are in one component already the same mark.
    """
    tree = BKTree()
    root: dict[int, int] = {}
    firsts: dict[int, int] = {}
    for value, mark in (joined or {}).items():
        root[value] = firsts.setdefault(mark, value)

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    edges = []

    def link(x: int) -> None:
        for y in sorted((tree.values[n] for n in tree.within(x, radius)), key=lambda y: (x ^ y).bit_count()):
            a, b = top(x), top(y)
            if a != b:
                root[max(a, b)] = min(a, b)
                edges.append((x, y))

    if query_side is None:
        for x in tree_side:
            link(x)
            tree.add(x)
    else:
        for x in tree_side:
            tree.add(x)
        for x in query_side:
            link(x)
    return edges


def _blocks(bits: list[int], parts: int) -> list[list[int]]:
    size, more = divmod(len(bits), parts)
    out, at = [], 0
    for k in range(parts):
        n = size + (k < more)
        out.append(bits[at : at + n])
        at += n
    return out


def _gather(fp: Column, bits: list[int]) -> Column:
    """The named bits of fp, which are contiguous runs, packed into a long."""
    out, at, k = F.lit(0).cast("long"), 0, 0
    while k < len(bits):
        n = 1
        while k + n < len(bits) and bits[k + n] == bits[k] + n:
            n += 1
        part = F.shiftrightunsigned(fp, bits[k]).bitwiseAND(F.lit((1 << n) - 1).cast("long"))
        out = out.bitwiseOR(F.shiftleft(part, at))
        at, k = at + n, k + n
    return out


def shards(fps: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, deals: int = DEALS) -> DataFrame:
    """(shard, low, high, fp, left): every pair within the radius shares a (shard, low, high).

    Rows with left = true are the tree's, the others the queries'; low = high marks a shard that is
    searched within itself.
    """
    parts = radius + 1
    whole = list(range(64))
    # Each path of block choices fixes some bits; `rest` are those that are left to deal by.
    paths: dict[str, list[int]] = {"": whole}
    open_rows = fps.select("fp", F.lit("").alias("path"), F.lit("").alias("shard"))
    done = None
    for deal in range(deals):
        dealt = {p: _blocks(rest, parts) for p, rest in paths.items()}
        options = None
        for path, blocks in dealt.items():
            each = F.array(
                *[
                    F.struct(
                        F.lit(f"{path}{k}").alias("path"),
                        F.concat_ws(".", F.col("shard"), F.lit(str(k)), F.hex(_gather(F.col("fp"), b))).alias("shard"),
                    )
                    for k, b in enumerate(blocks)
                ]
            )
            options = F.when(F.col("path") == path, each) if options is None else options.when(F.col("path") == path, each)
        rows = open_rows.select("fp", F.explode(options).alias("o")).select("fp", "o.path", "o.shard")
        sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        rows = rows.join(sizes, "shard")
        if deal == deals - 1:
            done = rows if done is None else done.unionByName(rows)
        else:
            # Small shards are searched as they are; the others are dealt by the bits left over.
            stored = store(rows, "shards")
            small = stored.filter(F.col("n") <= shard_rows)
            done = small if done is None else done.unionByName(small)
            open_rows = stored.filter(F.col("n") > shard_rows).select("fp", "path", "shard")
            if open_rows.isEmpty():
                break
            paths = {f"{p}{k}": [x for x in paths[p] if x not in b] for p, bs in dealt.items() for k, b in enumerate(bs)}
    cuts = F.ceil(F.col("n") / shard_rows).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / shard_rows)).cast("int")
    return (
        done.select("shard", "fp", own.alias("own"), cuts.alias("cuts"))
        .select("shard", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other"))
        .select(
            "shard",
            F.least("own", "other").alias("low"),
            F.greatest("own", "other").alias("high"),
            "fp",
            (F.col("own") <= F.col("other")).alias("left"),
        )
    )


def links(fps: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b): links that connect exactly what pairs within the radius connect; fps has distinct fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, left, right = None, [], []

        def finish() -> list[tuple[int, int]]:
            return shard_forest(left, None if key[1] == key[2] else right, radius)

        def packed(edges: list[tuple[int, int]]) -> pa.RecordBatch:
            pair = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

        edges: list[tuple[int, int]] = []
        for batch in batches:
            fp = batch.column(3).to_numpy().view(np.uint64).tolist()
            for s, lo, hi, x, is_left in zip(*(batch.column(k).to_pylist() for k in range(3)), fp, batch.column(4).to_pylist()):
                if (s, lo, hi) != key:
                    if key and len(left) + len(right) > 1:
                        edges += finish()
                    key, left, right = (s, lo, hi), [], []
                (left if is_left else right).append(x)
            if len(edges) > 10_000:
                yield packed(edges)
                edges = []
        if key and len(left) + len(right) > 1:
            edges += finish()
        if edges:
            yield packed(edges)

    dealt = shards(fps, radius, shard_rows).repartition("shard", "low", "high").sortWithinPartitions("shard", "low", "high", "fp")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): root is the least node that edges (a, b) reach; only nodes with an edge appear.

    Alternates stars over larger and smaller neighbours until the edges stop changing; each round's
    edges are written to the shared folder.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:
            both = both.filter("b < a")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(least, "a")
        if large:
            out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return out.filter("a != b").distinct()

    current = store(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        after = store(star(star(current, True), False), "edges")
        mark = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(current)
        current = after
        if tuple(mark) == before:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = tuple(mark)
    raise RuntimeError("the components did not settle")


def components(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE_WORDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs(doc_id, text)."""
    marked = store(fingerprints(docs, words), "fingerprints")
    fps = store(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct-fingerprints")
    roots = connected(links(fps.select("fp"), radius, shard_rows))
    named = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_fp = named.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def op10(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, fingerprint (16 hex digits), component_id."""
    return components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
