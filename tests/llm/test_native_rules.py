from __future__ import annotations

import hashlib
import re

import cases
from pyspark.sql import functions as F

from scoreloom.llm import decision_list, expressions, randomness_secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = {}
    for x in windows:
        n[x] = n.get(x, 0) + 1
    inside = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))


def brute_spans(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append(("assign", m.start(), m.end()))
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[1], randomness_secrets.KINDS.index(x[0])))


def rows_of(spark, sf):
    return cases.ODD + cases.real(sf, "documents", "doc_id, text")


def test_counts_match_brute_force(spark, sf):
    rows = rows_of(spark, sf)
    got = decision_list.counts(cases.with_clashes(spark, rows)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted((str(r["doc_id"]), *[r[n] for n in names]) for r in got) == sorted((str(i), *brute_counts(t)) for i, t in rows)


def test_running_starts_cross_blocks(spark):
    sizes = list(range(1, 1000))
    got = spark.range(1).select(expressions.running_starts(F.array(*[F.lit(x).cast("long") for x in sizes])).alias("s")).first()["s"]
    assert got == [sum(sizes[:k]) for k in range(len(sizes))]


def test_base_spans_match_brute_force(spark, sf):
    rows = rows_of(spark, sf) + [(99, "token=abcdef1 " * 700)]
    got = randomness_secrets.op5(cases.with_clashes(spark, rows)).collect()
    want = []
    for i, t in rows:
        s = brute_spans(t)
        n = [sum(k == x[0] for x in s) for k in ("assign", "access", "hex")]
        want.append((str(i), *n, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == sorted(want)
    for r in got:
        base = [x for x in r["spans"].split(",") if x and not x.startswith("random")]
        assert len(base) == r["n_assign"] + r["n_access"] + r["n_hex"]


def test_random_strings_are_found_and_words_are_not(spark):
    import random

    rng = random.Random(5)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    syllables = ["ther", "ing", "ation", "ment", "ous", "ly", "pre", "con", "dis", "er"]
    text = lambda: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(2, 6))) for _ in range(60))
    rows = [(k, text() + " " + "".join(rng.choice(alphabet) for _ in range(44)) + " " + text()) for k in range(50)]
    rows += [(100 + k, text() + " path/to/chapter2/section3/chapter2-" + "ation" * 4 + "3 ") for k in range(50)]
    got = {r["doc_id"]: r["spans"] for r in randomness_secrets.op5(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum("random" in got[k] for k in range(50)) >= 45
    assert sum("random" in got[100 + k] for k in range(50)) <= 2


def test_empty_tables(spark):
    docs = cases.with_clashes(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert decision_list.op2(docs, labels).count() == 0
    assert randomness_secrets.op5(docs).count() == 0


def test_rules_learn_thresholds(spark):
    rows = [(k, ("bad ### words $$$ here " if k % 3 == 0 else "good plain words here now ") * (3 + k % 5) + str(k)) for k in range(600)]
    rows = [(k, " ".join(f"{w}{k * 7 + n}" if n % 2 else w for n, w in enumerate(t.split()))) for k, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 != 0), None) for k in range(600)] + [(None, 0, 0), (7, None, 1)], "doc_id long, quality int, toxic int")
    got = decision_list.judge(docs, labels).collect()
    assert all((r["rule"] == 0) == (r["doc_id"] % 3 != 0) for r in got)
    assert all(r["kept"] == (r["rule"] == 0 and not r["base_failed"]) for r in got)
    none = decision_list.op2(docs, labels.filter("false"))
    assert none.filter("rule != 0").count() == 0
