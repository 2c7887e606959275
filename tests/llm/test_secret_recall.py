from __future__ import annotations

import random
import uuid

import cases
import pytest

from scoreloom.llm import randomness_secrets as rs

ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/",
}
LENGTHS = (20, 24, 32, 40, 64)
EACH = 40


def ordinary(rng, words):
    """Things that are long and mixed, but no secrets."""
    pick = lambda n: [rng.choice(words).lower() for _ in range(n)]
    return rng.choice(
        [
            lambda: "-".join(pick(5)) + f"-{rng.randrange(100)}",
            lambda: "".join(w.capitalize() for w in pick(4)) + f"V{rng.randrange(10)}",
            lambda: "_".join(pick(4)) + f"_{rng.randrange(1000)}_test",
            lambda: str(uuid.UUID(int=rng.getrandbits(128))),
            lambda: "/" + "/".join(pick(4)) + f"/{rng.choice(words).lower()}{rng.randrange(10)}",
            lambda: f"{rng.randrange(2000, 2030)}-{rng.randrange(10, 13)}-{rng.randrange(10, 29)}T{rng.randrange(10, 24)}-{rng.randrange(10, 60)}-{rng.randrange(10**6)}",
        ]
    )()


def planted(rng, texts, per_cell):
    """Documents with one secret or one ordinary thing each, and what every document holds."""
    words = [w for t in texts for w in t.split() if w.isascii() and w.isalpha() and 3 <= len(w) <= 8]
    rows, truth = [], {}
    for name, alphabet in ALPHABETS.items():
        for n in LENGTHS:
            for _ in range(per_cell):
                truth[len(rows)] = (name, n)
                rows.append("".join(rng.choice(alphabet) for _ in range(n)))
    for _ in range(6 * EACH):
        truth[len(rows)] = ("ordinary", 0)
        rows.append(ordinary(rng, words))
    out = []
    for k, x in enumerate(rows):
        t = rng.choice(texts)
        out.append((k, f"{t[:200]} {x} {t[200:400]}", len(t[:200]) + 1, len(x)))
    return out, truth


@pytest.fixture(scope="module")
def found(spark, sf):
    rng = random.Random(11)
    texts = [t for _, t in cases.real(sf, "documents", "doc_id, text") if t and len(t) > 500]
    rows, truth = planted(rng, texts, EACH)
    plain = [(10_000 + k, t, 0, 0) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + plain, "doc_id long, text string, at long, n long")
    spans = {r["doc_id"]: [tuple(x.split(":")) for x in r["spans"].split(",") if x] for r in rs.op5(docs).collect()}
    return rows, truth, spans


@pytest.mark.parametrize("name", ALPHABETS)
@pytest.mark.parametrize("n", LENGTHS)
def test_recall_by_alphabet_and_length(found, name, n):
    rows, truth, spans = found
    hit = [any(int(a) < at + size and int(b) > at for _, a, b in spans[k]) for k, _, at, size in rows if truth[k] == (name, n)]
    assert len(hit) == EACH and sum(hit) >= 0.9 * EACH


def test_ordinary_identifiers_are_left_alone(found):
    rows, truth, spans = found
    flagged = [(t, spans[k]) for k, t, *_ in rows if truth[k][0] == "ordinary" and any(x[0] == "random" for x in spans[k])]
    assert len(flagged) <= 0.02 * 6 * EACH, flagged[:5]


def test_long_runs_and_little_to_compare_with(spark, sf):
    rng = random.Random(3)
    texts = [t for _, t in cases.real(sf, "documents", "doc_id, text") if t and len(t) > 500]
    noise = "".join(rng.choices(ALPHABETS["base62"], k=300_000))
    same = "abcDEF123" * 30_000
    rows = [(k, t) for k, t in enumerate(texts)] + [(5000, f"x {noise} y"), (5001, f"x {same} y")]
    got = {r["doc_id"]: r["spans"] for r in rs.op5(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[5000] == "random:2:300002" and got[5001] == ""
    alone = rs.op5(spark.createDataFrame([(1, "a few words " + noise[:40])], "doc_id long, text string")).first()
    assert alone["spans"] == ""
