from __future__ import annotations

import math
import random
import unicodedata
import zlib

import cases
import numpy as np
import pytest

from scoreloom.llm import naive_bayes_lang as nb


def test_held_out_accuracy_and_defined_cases(spark, sf):
    rows = [(i, t, l) for i, t, l in cases.real(sf, "documents", "doc_id, text, lang")]
    odd = [(i, t, None if k % 2 else "en") for k, (i, t) in enumerate(cases.ODD)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    got = nb.op3(docs).collect()
    assert len(got) == len(rows) + len(odd)
    lang = {i: l for i, _, l in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] in lang]
    assert held and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.9 * len(held)
    for r in got:
        assert 0 <= r["score"] <= 1
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["held_out"] == (zlib.crc32(key.encode()) % 5 == 0)
    letter = lambda t: any(unicodedata.category(c)[0] == "L" for c in t or "")
    assert sorted(r["lang_pred"] == "und" for r in got) == sorted(not letter(t) for _, t, *_ in rows + odd)


def test_numerals_are_no_letters(spark):
    texts = ["²½ Ⅷ", "〇 ①", "１２ ३४", "", None, "_-_", "ª", "x½", "一"]
    rows = [(k, t, None) for k, t in enumerate(texts)] + [(100 + k, "some plain words", "en") for k in range(20)]
    got = {r["doc_id"]: r for r in nb.op3(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[k]["lang_pred"] for k in range(9)] == ["und"] * 6 + ["en"] * 3
    assert all(got[k]["score"] == 0 for k in range(6)) and all(0 < got[k]["score"] <= 1 for k in range(6, 9))


def plain_posterior(text, train):
    """The model written out over dictionaries."""
    count, size = {}, {}
    for lang, t in train:
        size[lang] = size.get(lang, 0) + 1
        for f in nb.features(t):
            for x in f.tolist():
                count.setdefault(lang, {})[x] = count.setdefault(lang, {}).get(x, 0) + 1
    score = {}
    for lang in sorted(size):
        c = count.get(lang, {})
        score[lang] = math.log(size[lang] / len(train)) + nb.EVIDENCE * sum(
            math.log((c.get(x, 0) + nb.SMOOTHING) / (sum(c.values()) + nb.SMOOTHING * nb.BUCKETS)) for f in nb.features(text) for x in f.tolist()
        )
    top = max(score.values())
    best = min(x for x, s in score.items() if s > top - 1e-9)
    return best, 1 / sum(math.exp(s - top) for s in score.values())


def test_scores_match_the_model_written_out_over_many_languages(spark):
    rng = random.Random(1)
    langs = [f"x{k:03d}" for k in range(300)]
    train = [(lang, " ".join(rng.choice([f"{lang[1:]}a", "common", f"b{lang[2:]}"]) for _ in range(12))) for lang in langs for _ in range(2)]
    # A tie between two languages that were taught the same.
    train += [("tie-a", "the very same"), ("tie-b", "the very same")]
    rows = [(k, t, lang) for k, (lang, t) in enumerate(train)]
    probes = [(10_000 + k, t, None) for k, t in enumerate([f"{x[1:]}a common" for x in langs[::25]] + ["the very same"])]
    docs = spark.createDataFrame(rows + probes, "doc_id long, text string, lang string")
    model = nb.learn(docs.filter("lang is not null").select("text", "lang"))
    assert len(list(model.blocks())) == 2
    got = {r["doc_id"]: r for r in nb.predict(docs, model).filter("doc_id >= 10000").collect()}
    for i, t, _ in probes:
        lang, score = plain_posterior(t, train)
        assert got[i]["lang_pred"] == lang and got[i]["score"] == pytest.approx(score, abs=1e-4)


def test_clashing_columns_and_long_texts(spark, sf):
    rows = cases.ODD + [(9000, "plain words of some length " * 200_000)]
    docs = cases.with_clashes(spark, rows)
    got = nb.predict(docs, nb.train_on(docs))
    assert got.columns == [*docs.columns, "lang_pred", "score"] and got.count() == len(rows)
    assert nb.keep_identified(docs).columns == docs.columns


def test_counts_match_brute_force(spark, monkeypatch):
    rows = [("a", "xyz xyz"), ("b", "zyx"), ("a", "é"), ("b", "")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    want = {}
    for lang, text in rows:
        for f in nb.features(text):
            for x in f.tolist():
                want[lang, x] = want.get((lang, x), 0) + 1
    assert {(r["lang"], r["bucket"]): r["n"] for r in nb._count(docs).collect()} == want
    whole = np.sort(np.concatenate(list(nb.features("some long text " * 9))))
    monkeypatch.setattr(nb, "PART", 7)
    assert (np.sort(np.concatenate(list(nb.features("some long text " * 9)))) == whole).all()


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert nb.op3(docs.filter("doc_id = 1")).first()["lang_pred"] == "und"
    assert nb.op3(docs.filter("false")).count() == 0
