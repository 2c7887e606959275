from __future__ import annotations

import math
import random
import re
import zlib

import cases
import numpy as np
import pytest

from scoreloom.llm import brown_lm as lm


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def brute_base(rows):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    count = {}
    for (_, t), h in zip(rows, held):
        for w in tokens(t) if not h else ():
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    return sorted(
        (str(i), h, len(tokens(t)), sum(w in count for w in tokens(t)), n, round(sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in tokens(t)), 6))
        for (i, t), h in zip(rows, held)
    )


@pytest.mark.parametrize("block", [500, 2_500_000])
def test_base_matches_brute_force_and_classes_do_better(spark, sf, monkeypatch, block):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", block)
    monkeypatch.setattr(lm, "BLOCK_CHARS", 4 * block)
    rows = cases.ODD + cases.real(sf, "documents", "doc_id, text")
    got = lm.op1(cases.with_clashes(spark, rows).repartition(3)).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == brute_base(rows)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_probabilities_sum_to_one(spark):
    rng = random.Random(0)
    nouns, verbs = [f"n{k}" for k in range(12)], [f"v{k}" for k in range(12)]
    text = lambda: " ".join(x for _ in range(20) for x in (rng.choice(nouns), rng.choice(verbs)))
    rows = [(k, text()) for k in range(120)]
    train = [t for k, t in rows if zlib.crc32(str(k).encode()) % 7 != 2]
    # A held-out document of each word after n3, so that scores differ by the last word's probability.
    free = [k for k in range(1000, 2000) if zlib.crc32(str(k).encode()) % 7 == 2]
    vocab = sorted({w for t in train for w in t.split()})
    probes = [(k, f"n3 {w}") for k, w in zip(free, [*vocab, "unseen"])] + [(free[60], "n3")]
    docs = spark.createDataFrame(rows + probes, "doc_id long, text string")
    stored = lm.store(lm.blocks(docs), "t")
    core = lm.exchange(stored, lm._first_core(stored, 100))
    of = dict(zip(core.words.to_pylist(), core.classes.tolist()))
    assert not {of[w] for w in nouns} & {of[w] for w in verbs}
    # The end's own probability after each word is left out by comparing transitions directly.
    pairs = np.zeros((lm.CLASSES + 2, lm.CLASSES + 2), np.int64)
    for t in train:
        kinds = [lm.CLASSES, *[of[w] for w in t.split()], lm.CLASSES]
        for a, b in zip(kinds, kinds[1:]):
            pairs[a, b] += 1
    p = 10 ** lm.log_transitions(pairs)
    assert np.allclose(p[:, : lm.CLASSES + 1].sum(axis=1), 1)
    got = {r["doc_id"]: r for r in lm.op1(docs).collect()}
    assert all(r["score"] <= 0 and r["perplexity"] >= 1 for r in got.values())
    known = [r for r in got.values() if r["held_out"] and r["doc_id"] < 120]
    assert all(r["score"] > r["base_score"] for r in known)


def test_nothing_to_learn(spark):
    held = [k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2]
    rows = [(held[0], "a b"), (held[1], None)]
    got = sorted(map(tuple, lm.op1(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert [g[:6] for g in got] == [(held[0], True, 3, 0, 0, 0.0), (held[1], True, 1, 0, 0, 0.0)]
    assert lm.op1(cases.with_clashes(spark, [])).count() == 0


def gain(pairs):
    f = lambda x: sum(v * math.log(v) for v in x.values() if v > 0)
    left, right = {}, {}
    for (a, b), n in pairs.items():
        left[a] = left.get(a, 0) + n
        right[b] = right.get(b, 0) + n
    return f(pairs) - f(left) - f(right)


def class_pairs(texts, of):
    out = {}
    for words in texts:
        kinds = ["end", *[of[w] for w in words], "end"]
        for a, b in zip(kinds, kinds[1:]):
            out[a, b] = out.get((a, b), 0) + 1
    return out


@pytest.fixture(scope="module")
def small():
    """Two kinds of alternating words, some of them rare, in documents of several lengths."""
    rng = random.Random(4)
    left, right = [f"l{k}" for k in range(8)], [f"r{k}" for k in range(8)]
    rows = []
    for k in range(90):
        words = [x for _ in range(rng.randint(1, 9)) for x in (rng.choice(left), rng.choice(right))]
        rows.append((k, " ".join(words + [f"once{k}"] * (k % 3 == 0))))
    train = [t.split() for k, t in rows if zlib.crc32(str(k).encode()) % 7 != 2]
    return rows, train


def test_exchange_ends_where_no_move_gains(spark, small, monkeypatch):
    monkeypatch.setattr(lm, "CLASSES", 4)
    rows, train = small
    stored = lm.store(lm.blocks(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)), "t")
    core = lm._first_core(stored, 1000)
    n = {}
    for t in train:
        for w in t:
            n[w] = n.get(w, 0) + 1
    assert dict(zip(core.words.to_pylist(), core.counts.tolist())) == n
    assert lm._first_core(stored, 5).words.to_pylist() == sorted(n, key=lambda w: (-n[w], w))[:5]
    gains = []
    core = lm.exchange(stored, lm._first_core(stored, 6), 0.0, gains)
    of = dict.fromkeys(n, "rest") | dict(zip(core.words.to_pylist(), core.classes.tolist()))
    # Pairs without a word that moves are not counted; they change nothing.
    counted = lambda of: gain({k: v for k, v in class_pairs(train, of).items() if not set(k) <= {"rest", "end"}})
    best = counted(of)
    assert best == pytest.approx(gains[-1]) and gains == sorted(gains) and gains[-1] > gains[0]
    for w in core.words.to_pylist():
        for c in range(4):
            assert counted(of | {w: c}) <= best + 1e-6


def test_scores_match_the_model_written_out(spark, small, monkeypatch):
    end = lm.CLASSES
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 60)
    rows, train = small
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    stored = lm.store(lm.blocks(docs), "t")
    # All but eight words are classed by what their contexts favour.
    core = lm.exchange(stored, lm._first_core(stored, 8))
    of = dict(zip(core.words.to_pylist(), core.classes.tolist()))
    before, after = lm._affinity(stored, core)
    favour, n = {}, {}
    for t in train:
        kinds = [end, *[of.get(w, end + 1) for w in t], end]
        for k, w in enumerate(t):
            n[w] = n.get(w, 0) + 1
            favour[w] = favour.get(w, 0) + before[kinds[k]] + after[kinds[k + 2]]
    of |= {w: int(np.argmax(f)) for w, f in favour.items() if w not in of}
    blocks = {r["block"]: r["words"] for r in stored.collect()}
    looked = {(blocks[r["block"]][r["at"]], r["class"], r["n"]) for r in lm.lookups(stored, core).collect() if r["n"]}
    assert looked == {(w, of[w], n[w]) for w in n}
    pairs = np.zeros((end + 2, end + 2), np.int64)
    for a, b in ((a, b) for t in train for k in [[end, *[of[w] for w in t], end]] for a, b in zip(k, k[1:])):
        pairs[a, b] += 1
    step = 10 ** lm.log_transitions(pairs)
    unknown = sum(v == 1 for v in n.values()) / (sum(n.values()) + len(train) + 1)
    in_class = {c: sum(v for w, v in n.items() if of[w] == c) for c in range(end)}

    def p(word, last):
        """P(word, or the end) after a class."""
        if word is None:
            return step[last, end] * (1 - unknown)
        return step[last, of[word]] * (1 - unknown) * n[word] / in_class[of[word]] if word in n else unknown

    for last in range(end + 1):
        assert sum(p(w, last) for w in n) + p(None, last) + p("unseen", last) == pytest.approx(1)
    got = {r["doc_id"]: r for r in lm.score(docs, 8).collect()}
    for k, t in rows:
        want, last = 0.0, end
        for w in [*t.split(), None]:
            want += math.log10(p(w, last))
            last = end if w is None else of.get(w, end + 1)
        assert got[k]["score"] == pytest.approx(want)


def test_large_rows_go_one_at_a_time(spark):
    """However many rows of megabytes a file or task has, a writer, a reader and a Python worker hold one."""
    import glob

    import pyarrow as pa
    import pyarrow.parquet as pq

    from scoreloom.llm import common

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    wide = common.store(spark.range(12).repartition(1).selectExpr("id", "repeat('x', 5000000) as text"), "t", large_rows=True)
    (file,) = glob.glob(wide._stored_at.removeprefix("file:") + "/*.parquet")
    assert pq.ParquetFile(file).metadata.num_row_groups == 12

    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    with common.small_batches(spark), common.small_batches(spark):
        assert [r["n"] for r in wide.mapInArrow(rows, "n long").collect()] == [1] * 12
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
    common.discard(wide)


def test_rounds_read_pairs_counted_once_and_no_block(spark, small, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 60)
    monkeypatch.setattr(lm, "BLOCK_CHARS", 200)
    monkeypatch.setattr(lm, "RANGE", 3)
    rows, train = small
    stored = lm.store(lm.blocks(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), "t", large_rows=True)
    assert stored.count() > 3
    first = lm._first_core(stored, 10)
    met = lm.store(lm.neighbours(stored, first), "t", large_rows=True)
    width = 12
    code = {w: k for k, w in enumerate(first.words.to_pylist())}
    want = {}
    for t in train:
        codes = [10, *[code.get(w, 11) for w in t], 10]
        for a, b in zip(codes, codes[1:]):
            for cell in ((a, 1, b), (b, 0, a)):
                want[cell] = want.get(cell, 0) + 1
    got, ranges = {}, []
    for r, _, cells, n in lm._pair_rows(met.toArrow().to_batches()):
        ranges.append(r)
        for c, x in zip(cells.tolist(), n.tolist()):
            got[3 * r + c // width // 2, c // width % 2, c % width] = x
    assert sorted(ranges) == [0, 1, 2, 3]
    assert got == want
    core = lm.exchange(stored, first, met=met)
    near = lm._affinity(stored, core)
    lm.discard(stored)
    again = lm.exchange(stored, first, met=met)
    assert again.classes.tolist() == core.classes.tolist()
    assert all(np.array_equal(a, b) for a, b in zip(near, lm._affinity(stored, core, met)))
