from __future__ import annotations

import hashlib
import random
import zlib

import cases
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from scoreloom.llm import pair_index_bpe, residual_packing

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def texts(sf):
    rng = random.Random(1)
    made = ["".join(rng.choice("ab c'sdtrevml ÀéñÖß01._-!\n\t²½ªÿŠžİ") for _ in range(60)) for _ in range(200)]
    made += ["".join(chr(rng.randrange(32, 0x3000)) for _ in range(40)) for _ in range(100)]
    return [t or "" for _, t in cases.ODD] + [t for (t,) in cases.real(sf, "documents", "text")] + made + ["aaaaaaaaaaaaaaaa" * 50]


def test_pair_index_matches_the_library(texts):
    library, own = Tokenizer.from_file(WORD), pair_index_bpe.WordTokenizer(WORD)
    for text, (ids, said) in zip(texts, own.encode_many(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert said.decode() == library.decode(want, skip_special_tokens=False)


def test_remembering_in_generations_changes_nothing(texts, monkeypatch):
    monkeypatch.setattr(pair_index_bpe, "REMEMBERED", 50)
    monkeypatch.setattr(residual_packing, "REMEMBERED", 50)
    few, many = pair_index_bpe.WordTokenizer(WORD), pair_index_bpe.WordTokenizer(WORD)
    want = many.encode_many(texts)
    assert [few.encode_many([t])[0] for t in texts] == want
    library, own = Tokenizer.from_file(BYTE), residual_packing.ByteTokenizer(BYTE)
    for text in texts:
        assert np.frombuffer(own.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_op9_rows(spark):
    library = Tokenizer.from_file(WORD)
    got = pair_index_bpe.op9(cases.with_clashes(spark, cases.ODD), WORD).collect()
    want = []
    for i, t in cases.ODD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)
    assert pair_index_bpe.op9(cases.with_clashes(spark, []), WORD).count() == 0


def check_packing(rows, docs, capacity):
    library = Tokenizer.from_file(BYTE)
    want = []
    for i, t in docs:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, (a, n) in enumerate(residual_packing.cut(len(ids), capacity)):
            assert n == capacity or k == 0
            want.append((str(i), k, a, n, zlib.crc32(ids[a : a + n].tobytes())))
        assert sum(n for _, n in residual_packing.cut(len(ids), capacity)) == len(ids)
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        end = 0
        for a, n in sorted(places):
            assert a == end
            end += n
        assert end <= capacity
    return len(bins), -(-sum(r["length"] for r in rows) // capacity)


@pytest.mark.parametrize("tasks,limit", [(1, 400_000), (3, 400_000), (3, 40)])
def test_packing_is_whole_and_tight(spark, sf, monkeypatch, tasks, limit):
    monkeypatch.setattr(residual_packing, "TASK_ITEMS", limit)
    docs = cases.ODD + cases.real(sf, "documents", "doc_id, text")
    rows = residual_packing.op8(cases.with_clashes(spark, docs).repartition(tasks), BYTE).collect()
    bins, least = check_packing(rows, docs, residual_packing.CAPACITY)
    assert bins <= 1.06 * least + 2


def test_packing_of_nothing(spark):
    assert residual_packing.op8(cases.with_clashes(spark, []), BYTE).count() == 0


def test_best_fit_picks_the_tightest_bin():
    bins, places, filled = residual_packing.best_fit(np.array([5, 4, 6, 3, 2]), 10)
    assert sorted(filled.tolist()) == [10, 10] and len(set(bins.tolist())) == 2
    assert residual_packing.best_fit(np.array([], np.int64), 10)[2].tolist() == []
