from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import pytest

from scoreloom.llm import merkle_manifest as mm

from cases import ODD

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, tree string, idx long, n long, digest string, level int, found string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """All levels above nodes, they included."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def way(levels, at):
    """(left, right) siblings at each level."""
    out = []
    for level in levels[:-1]:
        run = at // 16 * 16
        out.append((level[run:at], level[at + 1 : run + 16]))
        at //= 16
    return out


def brute(rows):
    by = {}
    for doc_id, text, source, lang, n_chars in rows:
        by.setdefault(source, []).append((doc_id, text, lang, n_chars, leaf(doc_id, source, lang, n_chars, text)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[4]))
        trees[s] = climb([r[4] for r in by[s]])
    top = climb([trees[s][-1][0] for s in order])
    out = []
    for rank, s in enumerate(order):
        for at, (doc_id, text, lang, n_chars, own) in enumerate(by[s]):
            steps = way(trees[s], at) + way(top, rank)
            proof = h(*(x for l, r in steps for x in l + r))
            low = text if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            x = leaf(doc_id, s, lang, n_chars, low) if zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 0 else own
            for l, r in steps:
                x = h(*l, x, *r)
            out.append((doc_id, own, trees[s][-1][0], top[-1][0], proof, x, x == top[-1][0]))
    return out


def run(spark, rows):
    return [tuple(r) for r in mm.op13(spark.createDataFrame([(*r, "t", 1, 2, "d", 3, "f") for r in rows], SCHEMA)).collect()]


def key(r):
    return repr(r)


@pytest.mark.parametrize("sizes", [[1], [2], [16], [17], [1, 1], [300, 1, 16, 257, 33], [3] * 20, [4200, 5]])
def test_matches_brute_force(spark, sizes):
    rng = random.Random(len(sizes))
    rows = [(rng.randrange(-50, 10**6), "Some Text %d" % k, f"s{i}", "en", k) for i, n in enumerate(sizes) for k in range(n)]
    got, want = run(spark, rows), brute(rows)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {r[-1] for r in got} <= {True, False} and all(r[5] == r[3] for r in got if r[-1])


def test_odd_rows(spark):
    rows = [(i, t, s, lang, n) for i, t in ODD for s in (None, "", "é", "Z", "a") for lang, n in (("en", None), (None, -7))]
    rows += [(13, "X" * 3_000_000, "big", "en", 1), (20, "lower only", "é", "en", 1), (20, "lower only", "é", "en", 1)]
    assert sorted(run(spark, rows), key=key) == sorted(brute(rows), key=key)
    assert run(spark, []) == []


def test_a_proof_stands_for_its_leaf_alone(spark):
    rows = [(k, f"Text {k}", "s%d" % (k % 3), "en", 1) for k in range(200)]
    leaves = mm.document_leaves(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long"))
    m = mm.manifest(leaves, "doc_id")
    proofs = mm.proofs(m).collect()
    for p in proofs:
        x = p["digest"]
        for s in p["steps"]:
            x = h(s["left"], x, s["right"])
        assert x == m.root
        assert "".join(p["siblings"]) == "".join(s["left"] + s["right"] for s in p["steps"])
    other = proofs[1]["digest"]
    for s in proofs[0]["steps"]:
        other = h(s["left"], other, s["right"])
    assert other != m.root


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    got = mm.op13(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(mm.ORACLE).fetchall())
