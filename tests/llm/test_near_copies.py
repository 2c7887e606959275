from __future__ import annotations

import random
import re
from collections import Counter

import cases
import corpus_pipeline
import numpy as np
import pytest

from scoreloom.llm import near_copies


def brute_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_kept(rows):
    """The rows that stay: of each component at Jaccard 0.8 the least id, null last."""
    sets, root = [brute_set(t) for _, t in rows], list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            whole = sets[a] | sets[b]
            if 5 * len(sets[a] & sets[b]) >= 4 * len(whole):
                root[top(a)] = top(b)
    kept = {}
    for k, (i, _) in enumerate(rows):
        kept[top(k)] = min(kept.get(top(k), (True, 0)), (i is None, i or 0))
    return sorted(str(None if none else i) for none, i in kept.values())


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.getrandbits(32)}"
    return " ".join(out)


def families():
    rng = random.Random(8)
    rows = []
    for f in range(12):
        words = [f"w{rng.randrange(3000)}" for _ in range(150)]
        # Two edits leave a similarity near 0.87, three near 0.82, twelve less than 0.5.
        rows += [(100 * f + k, edited(rng, words, n)) for k, n in enumerate((0, 2, 3, 12, 12))]
    words = [f"w{rng.randrange(3000)}" for _ in range(400)]
    return rows + [(5000 + k, edited(rng, words, 6)) for k in range(120)]


@pytest.mark.parametrize("shard", [40, 4096])
def test_stage_keeps_what_brute_force_jaccard_keeps(spark, sf, monkeypatch, shard):
    monkeypatch.setattr(near_copies, "SPLIT", 8)
    monkeypatch.setattr(near_copies, "SHARD", shard)
    monkeypatch.setattr(near_copies, "HASHES", 300 * shard)
    rows = cases.ODD + families() + [(None if i is None else i + 10**6, t) for i, t in cases.real(sf, "documents", "doc_id, text")]
    docs = cases.with_clashes(spark, rows)
    got = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert got.columns == docs.columns
    # Some ids are there twice.
    assert Counter(str(r["doc_id"]) for r in got.collect()) == Counter(brute_kept(rows))


def test_nothing_to_compare(spark, sf):
    assert corpus_pipeline.near_duplicates(spark, cases.with_clashes(spark, []), sf).count() == 0


def test_a_scan_spans_what_is_within_the_radius():
    rng = np.random.default_rng(3)
    words = near_copies.BITS // 64
    base = rng.integers(0, 1 << 63, (5, words), np.uint64)
    fps = base[rng.integers(0, 5, 300)]
    for k in range(300):
        for bit in rng.integers(0, near_copies.BITS, 30):
            fps[k, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    near = np.array([[int(np.bitwise_count(a ^ b).sum()) <= near_copies.RADIUS for b in fps] for a in fps])

    def parts(edges, n):
        root = list(range(n))
        for a, b in edges:
            x, y = root[a], root[b]
            root = [x if r == y else r for r in root]
        return [root.index(r) for r in root]

    for left in (0, 120):
        pairs = [(i, j) for i in range(300) for j in range(300) if j < i and near[i, j] and (not left or j < left <= i)]
        edges = near_copies.scan(fps, np.arange(300), left)
        assert set(edges) <= set(pairs) and parts(edges, 300) == parts(pairs, 300)
        assert len(edges) < 300
    assert near_copies.scan(fps, np.zeros(300, int), 0) == []


@pytest.mark.parametrize("terms", [0, 1 << 14])
def test_sets_in_a_task_are_compared_exactly(monkeypatch, terms):
    monkeypatch.setattr(near_copies, "TERMS", terms)
    rng = np.random.default_rng(5)
    pool = rng.integers(-(1 << 63), 1 << 63, 130)
    sets = [np.unique(rng.choice(pool[: rng.integers(1, 130)], rng.integers(1, 120))) for _ in range(150)]
    sets += [np.array([7], np.int64), np.array([], np.int64), pool[:100], pool[:80], pool[:79]]
    holds = near_copies.similarity_test(sets)
    for i in range(len(sets)):
        places = np.array([j for j in range(len(sets)) if j != i])
        want = [5 * len(set(sets[i]) & set(sets[j])) >= 4 * len(set(sets[i]) | set(sets[j])) for j in places.tolist()]
        assert holds(i, places).tolist() == want


def test_open_rows_are_those_with_another_root_within_the_radius():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, (3, near_copies.BITS // 64), np.uint64)
    which, roots = rng.integers(0, 3, 90), rng.integers(0, 2, 90)
    fps = base[which]
    roots[which == 2] = 1
    assert near_copies.open_rows(fps, roots, 0).tolist() == np.flatnonzero(which != 2).tolist()
    crossing = [i for i in range(90) if any(which[i] == which[j] and roots[i] != roots[j] and (i < 40) != (j < 40) for j in range(90))]
    assert near_copies.open_rows(fps, roots, 40).tolist() == crossing


def family_fps(rng, n, families, flips):
    fps = rng.integers(0, 1 << 63, (families, near_copies.BITS // 64), np.uint64)[np.arange(n) % families]
    for k in range(n):
        for bit in rng.integers(0, near_copies.BITS, flips):
            fps[k, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    return fps


@pytest.mark.parametrize("families,flips", [(1, 20), (1, 1), (1, 0), (12, 25), (300, 0)])
def test_a_tree_finds_what_is_within_the_radius(families, flips):
    rng = np.random.default_rng(7)
    fps, label = family_fps(rng, 300, families, flips), rng.integers(0, 4, 300)
    fps[299] = ~fps[0]
    tree = near_copies.BKTree(fps[:200], label)
    for asked, ends in ((np.arange(300), np.full(300, 200)), (np.arange(200), np.arange(200)), (np.arange(0), np.arange(0))):
        k, rows, d = tree.within(fps[asked], label[asked], ends, label)
        want = {}
        for n, (i, end) in enumerate(zip(asked.tolist(), ends.tolist())):
            for j in range(end):
                bits = int(np.bitwise_count(fps[i] ^ fps[j]).sum())
                if bits <= near_copies.RADIUS and label[i] != label[j]:
                    want[n, j] = bits
        assert len(k) == len(want) and dict(zip(zip(k.tolist(), rows.tolist()), d.tolist())) == want


def test_a_tree_is_searched_along_edges_within_the_radius():
    fps, own = family_fps(np.random.default_rng(8), 1200, 12, 8), np.arange(1200)
    tree = near_copies.BKTree(fps, own)
    # Children are keyed by their distance to their parent.
    for (_, nodes, _), (keys, below, _) in zip(tree.levels, tree.levels[1:]):
        apart = np.bitwise_count(fps[below] ^ fps[nodes[keys // (near_copies.BITS + 1)]]).sum(axis=1)
        assert (apart == keys % (near_copies.BITS + 1)).all() and len(set(keys.tolist())) == len(keys)
    tree.within(fps, own, np.full(1200, 1200), own)
    assert tree.compared < 0.7 * 1200**2
    # Of one root: nothing is searched; copies of one value: one comparison each.
    tree = near_copies.BKTree(fps, np.zeros(1200, int))
    assert len(tree.within(fps, np.zeros(1200, int), np.full(1200, 1200), np.zeros(1200, int))[0]) == 0 and tree.compared == 0
    tree = near_copies.BKTree(fps[:1].repeat(500, 0), np.arange(500))
    assert len(tree.within(fps[:1], np.array([-1]), np.array([500]), np.arange(500))[0]) == 500 and tree.compared == 1


def test_texts_sets_and_fingerprints_are_moved_once(spark, sf, monkeypatch):
    plans, made = {}, []
    store, sets = near_copies.store, near_copies._sets

    def stored(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return store(df, name)

    monkeypatch.setattr(near_copies, "store", stored)
    monkeypatch.setattr(near_copies, "_sets", lambda keyed: made.append(1) or sets(keyed))
    docs = cases.with_clashes(spark, families())
    kept = near_copies.keep_one_each(docs)
    assert Counter(str(r["doc_id"]) for r in kept.collect()) == Counter(brute_kept(families()))
    # Texts stay where they are if the rows that go are few.
    assert "BroadcastHashJoin" in kept._jdf.queryExecution().sparkPlan().toString()
    # Sets join what is dealt already: only the two sides of that join and the dealing move them.
    assert plans["links"].index("RepartitionByExpression") < plans["links"].index("Join Inner") < plans["links"].index("Generate explode(sequence")
    assert len(made) == 1
    # What every band is dealt with is its document's key.
    dealt = re.findall(r"Generate explode\(bands#\d+\).*\n.*Project \[(.*)\]", plans["shards"])
    assert dealt and not any("fp#" in columns for columns in dealt)
