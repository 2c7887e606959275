from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest

from scoreloom.llm import norm_buckets as nb

SCHEMA = "vec_id long, embedding array<float>, label int, v string, norm string, ids string"


def brute(rows, k=10):
    usable = [(i, [math.floor(1024 * float(np.float32(x))) for x in e]) for i, e, *_ in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for q, a in {(i, tuple(v)) for i, v in usable if i % 100 == 0}:
        s = sorted((-sum(x * y for x, y in zip(a, v)), i) for i, v in usable if i != q)[:k]
        out += [(q, r, i, -m) for r, (m, i) in enumerate(s, 1)]
    return sorted(out)


def rows(rng, n, spread, dim=6):
    out = []
    for i in range(n):
        size = rng.choice([0.1, 1, 3]) if spread else 1
        v = [rng.gauss(0, 1) for _ in range(dim)]
        m = math.sqrt(sum(x * x for x in v))
        out.append((i, [size * x / m for x in v]))
    return out


@pytest.mark.parametrize("seed,spread,bucket", [(1, True, 64), (2, False, 64), (3, True, 2048)])
def test_matches_brute_force(spark, monkeypatch, seed, spread, bucket):
    monkeypatch.setattr(nb, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(nb, "SORT_ROWS", 300)
    monkeypatch.setattr(nb, "QUERY_ROWS", 4)
    monkeypatch.setattr(nb, "PLAN_BLOCKS", 2)
    rng = random.Random(seed)
    data = rows(rng, 900, spread)
    hot = data[5][1]
    data += [(1000 + k, hot) for k in range(250)]
    data += [(2000, None), (2100, [1.0, None]), (2200, [float("nan")] * 6), (2300, [float("inf")] * 6), (None, hot), (2400, []), (2500, [0.0] * 6), (2600, [1.0, 2.0]), (300, data[7][1]), (300, data[300][1]), (2700, [5.0] * 9)]
    got = nb.top_k(spark.createDataFrame([(*r, 1, "a", "b", "c") for r in data], SCHEMA)).collect()
    assert sorted(map(tuple, got)) == brute(data)


def test_each_kind_of_pruning_happens_and_keeps_results():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 8))
    near = np.rint(1024 * (base[rng.integers(0, 40, 3000)] + 0.05 * rng.normal(size=(3000, 8))))
    short = np.rint(0.01 * near)
    queries = np.rint(1024 * base)
    best = nb.TopK(np.arange(40) - 100, queries, 10)
    used = {}
    for block in (near[:1000], near[1000:], short):
        order = np.argsort(-(block**2).sum(axis=1), kind="stable")
        ids = np.arange(len(block)) + 10_000 * len(used)
        for name, n in best.search(ids, block[order]).items():
            used[name] = used.get(name, 0) + n
    assert all(used.values())
    whole = nb.products(queries, np.vstack([near, short]))
    for q in range(40):
        assert best.score[best.q == q].tolist() == sorted(whole[q].tolist(), reverse=True)[:10]


def test_huge_components_are_held_in_a_long():
    big = np.array([[2.0**40, 1.0]])
    assert nb.products(big, big)[0, 0] == (1 << 63) - 1
    assert nb.products(np.array([[2.0**30, 3.0]]), np.array([[2.0**30, 1.0]]))[0, 0] == 2**60 + 3


def test_sql_and_empty(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{sf}/embeddings.parquet')")
    assert sorted(map(tuple, nb.top_k(vectors).collect())) == sorted(con.execute(nb.ORACLE).fetchall())
    assert nb.top_k(vectors.filter("false")).count() == 0
    assert nb.top_k(vectors.filter("vec_id = 0")).count() == 0
