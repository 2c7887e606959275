from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from scoreloom.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, tokens string, idx long, a long, depth int, words string"


def token(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, token(role or "", text or ""), role or "", text or ""))
    convs = {c: [(r, x) for *_, r, x in sorted(t)] for c, t in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(convs.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + own[h:])
    members = {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
    kids = {}
    for k in members:
        if k:
            kids[k[:-1]] = kids.get(k[:-1], 0) + 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for k, m in members.items():
        mine = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += mine
            leaves[k[:d]] += k not in kids
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if built[c] == k)
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids.get(k, 0), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows):
    return sorted((tuple(r) for r in pt.op11(spark.createDataFrame([(*r, "t", 1, 2, 3, "w") for r in rows], SCHEMA)).collect()), key=repr)


@pytest.mark.parametrize("seed,block", [(1, 3), (2, 7), (3, 256), (4, 1)])
def test_matches_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(pt, "LEAST_BLOCK", block)
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-60, 400), 150):
        for t in range(rng.choice([1, 2, 3, 5, 8])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "a", "a b", "a  b c\n"])))
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_odd_conversations(spark, monkeypatch):
    monkeypatch.setattr(pt, "LEAST_BLOCK", 16)
    same = [(c, t, "user", f"turn {t}") for c in range(1000, 1200) for t in range(3)]
    long = [(7, t, "user", "word " * (t % 5)) for t in range(200)] + [(8, t, "user", "word " * (t % 5)) for t in range(120)]
    odd = [(None, 1, "user", "x"), (40, None, None, None), (40, None, "user", "late"), (40, 3, "user", None), (40, 3, "user", None), (41, 1, "", ""), (1201, 0, "user", "x" * 2_000_000), (-25, 0, "u", "b"), (-20, 0, "u", "lent"), (3, 5, "user:", "a"), (4, 5, "user", ":a")]
    assert run(spark, same + long + odd) == brute(same + long + odd)
    assert run(spark, [(5, 0, "u", "x")]) == brute([(5, 0, "u", "x")])
    # Conversation 21 lends all of its turns away and has no lender: it is turnless.
    turnless = [(c, 0, "u", "x") for c in range(21, 40)]
    got = run(spark, turnless)
    assert got == brute(turnless) and any(r[1] == 0 and r[-1] != hashlib.sha256(b"").hexdigest() for r in got)
    assert run(spark, []) == []


def test_nearest_smaller_values():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50):
        v = rng.integers(0, 5, n)
        left, right = pt.nearest_smaller(v)
        for i in range(n):
            assert left[i] == max((j for j in range(i) if v[j] < v[i]), default=-1)
            assert right[i] == min((j for j in range(i + 1, n) if v[j] < v[i]), default=n)
        least = pt.Least(v)
        assert all(least.of(i, j) == min(v[i:j], default=pt.NONE) for i in range(n) for j in range(i, n + 1))


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{sf}/conversations.parquet')")
    got = pt.op11(spark.read.parquet(f"{sf}/conversations.parquet")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(con.execute(pt.ORACLE).fetchall(), key=repr)
