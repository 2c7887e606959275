from __future__ import annotations

import random
import re

import cases
import xxhash

from scoreloom.llm import simhash_bktree as s


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius=3):
    root = list(range(len(fps)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                root[top(a)] = top(b)
    least = {}
    for i, x in zip(ids, range(len(fps))):
        if i is not None:
            least[top(x)] = min(i, least.get(top(x), i))
    return [least.get(top(x)) for x in range(len(fps))]


def test_rows_match_brute_force(spark, sf):
    docs = cases.ODD + cases.real(sf, "documents", "doc_id, text")
    fps = [brute_fingerprint(t) for _, t in docs]
    want = zip((i for i, _ in docs), (f"{f:016x}" for f in fps), brute_components([i for i, _ in docs], fps))
    got = s.op10(cases.with_clashes(spark, docs)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert s.op10(cases.with_clashes(spark, [])).count() == 0


def near_family(rng, n, spread):
    base = rng.getrandbits(64)
    out = {base}
    while len(out) < n:
        x = rng.choice(sorted(out)[:50])
        for _ in range(rng.randint(1, spread)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return out


def test_large_shards_are_dealt_again_and_cut(spark):
    rng = random.Random(3)
    fps = sorted({rng.getrandbits(64) for _ in range(300)} | near_family(rng, 400, 3) | near_family(rng, 150, 5) | {rng.getrandbits(12) for _ in range(300)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = brute_components(signed, fps)
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    for shard_rows in (4, 32, 10_000):
        pairs = s.connected(s.links(table, 3, shard_rows)).collect()
        root = {r["node"]: r["root"] for r in pairs}
        groups, expected = {}, {}
        for f, w in zip(signed, want):
            groups.setdefault(root.get(f, f), set()).add(f)
            expected.setdefault(w, set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_tree_finds_what_a_scan_finds():
    rng = random.Random(4)
    values = [rng.getrandbits(10) for _ in range(300)]
    tree = s.BKTree()
    for v in values:
        tree.add(v)
    for q in range(0, 1024, 37):
        for radius in (0, 2, 3):
            assert sorted(tree.values[k] for k in tree.within(q, radius)) == sorted(v for v in values if (v ^ q).bit_count() <= radius)


def test_long_chains_settle(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(120)] + [(5, 5)], "a long, b long")
    assert {r["root"] for r in s.connected(edges).collect()} == {0}
