from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest

from scoreloom.llm import cover_tree as ct

SCHEMA = "vec_id long, embedding array<double>, label int, cell string, node long, weight long, root long, unit string"


def brute(rows):
    out, n = [], len(rows)
    vectors = []
    for _, e, label in rows:
        ok = label is not None and e is not None and len(e) and all(x is not None and math.isfinite(x) for x in e) and any(e)
        vectors.append(np.array(e) / np.abs(e).max() if ok else None)
    near = [[] for _ in rows]
    for i in range(n):
        for j in range(i):
            a, b = vectors[i], vectors[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.98:
                near[i].append(j)
                near[j].append(i)
    seen = {}
    for i in range(n):
        if i not in seen:
            group, stack = {i}, [i]
            while stack:
                for j in near[stack.pop()]:
                    if j not in group:
                        group.add(j)
                        stack.append(j)
            least = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
            seen |= dict.fromkeys(group, least)
        out.append((rows[i][0], len(near[i]), seen[i], rows[i][0] is not None and rows[i][0] == seen[i]))
    return sorted(out, key=repr)


def run(spark, rows):
    return sorted((tuple(r) for r in ct.op12(spark.createDataFrame([(*r, "c", 1, 2, 3, "u") for r in rows], SCHEMA)).collect()), key=repr)


def family(rng, centre, n, noise):
    return centre + noise * rng.normal(size=(n, len(centre)))


@pytest.mark.parametrize("seed,shard", [(1, 16), (2, 40), (3, 1024)])
def test_matches_brute_force(spark, monkeypatch, seed, shard):
    monkeypatch.setattr(ct, "SHARD", shard)
    monkeypatch.setattr(ct, "CENTRES", 6)
    rng = np.random.default_rng(seed)
    points = [rng.normal(size=(120, 6))]
    for noise, n in ((0.002, 90), (0.05, 60), (0.11, 80), (0.3, 40)):
        points.append(family(rng, rng.normal(size=6), n, noise))
    x = np.vstack(points)
    x = np.vstack([x, 3.5 * x[100:140], x[130:180], x[-30:]])
    rng.shuffle(x)
    rows = [(int(i), [float(v) for v in p], int(i) % 2 if i % 5 else 0) for i, p in enumerate(x)]
    assert run(spark, rows) == brute(rows)


def test_odd_vectors(spark):
    a, nan, inf = [1.0, 2.0, 3.0], float("nan"), float("inf")
    rows = [(1, a, 1), (1, a, 1), (2, a, None), (3, a, 2), (None, a, 1), (None, None, None), (4, None, 1), (5, [], 1), (6, [0.0, 0.0, 0.0], 1), (7, [1.0, None, 3.0], 1), (8, [1.0, nan, 3.0], 1), (9, [inf, 1.0, 1.0], 1), (10, [1.0, 2.0], 1), (11, [2.0, 4.0], 1), (-5, [1e-300, 2e-300, 3e-300], 1), (12, [1e300, 2e300, 3e300], 1), (13, [-1.0, -2.0, -3.0], 1), (14, [0.0, -0.0, 1.0], 3), (15, [-0.0, 0.0, 1.0], 3)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_cells_that_cannot_be_divided_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ct, "SHARD", 12)
    monkeypatch.setattr(ct, "ROUNDS", 0)
    rng = np.random.default_rng(5)
    rows = [(k, [float(v) for v in p], 1) for k, p in enumerate(family(rng, np.ones(5), 90, 0.12))]
    assert run(spark, rows) == brute(rows)


def test_outliers_do_not_hold_up_the_division(spark, monkeypatch):
    monkeypatch.setattr(ct, "SHARD", 20)
    monkeypatch.setattr(ct, "CANDIDATES", 8)
    rng = np.random.default_rng(6)
    x = np.vstack([family(rng, np.ones(6), 200, 0.001), rng.normal(size=(3, 6))])
    rows = [(k, [float(v) for v in p], 1) for k, p in enumerate(x)]
    points = ct.unit_bytes(spark.createDataFrame([("c", k, 1, v) for k, v, _ in rows], "cell string, node long, weight long, embedding array<double>"))
    cells = {r["cell"]: r["tight"] for r in ct.shards(points).select("cell", "tight", "members").collect()}
    assert any(cells.values()) and max(len(c.split(".")) for c in cells) <= 4
    assert run(spark, rows) == brute(rows)


def pairs(x, cosine=0.98):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= cosine
    np.fill_diagonal(near, False)
    return u, near


def test_dual_traversal_prunes_and_counts_groups_whole():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 16))
    x = np.vstack([family(rng, c, 50, 0.01) for c in centres])
    u, near = pairs(x)
    tree = ct.CoverTree(u)
    assert sorted(tree.order.tolist()) == list(range(2000))
    for node, (a, b) in enumerate(tree.kids):
        inside = tree.points[tree.start[node] : tree.end[node]]
        assert ct.distance(inside @ tree.points[tree.centre[node]]).max() <= tree.radius[node] + ct.SLACK
        if b > a:
            assert tree.start[a] == tree.start[node] and tree.end[b - 1] == tree.end[node]
    links = ct.Links(np.ones(2000, np.int64))
    work = ct.traverse(tree, tree, 0, 0, links)
    count, _ = links.found()
    back = np.empty(2000, np.int64)
    back[tree.order] = count
    assert back.tolist() == near.sum(axis=1).tolist()
    assert work < 2000 * 2000 / 10


def test_shards_of_one_label_keep_every_link():
    rng = np.random.default_rng(8)
    x = np.vstack([family(rng, rng.normal(size=8), 60, s) for s in (0.01, 0.08, 0.15, 0.5)])
    u, near = pairs(x)
    n = 130
    count, top = ct.shard_links(u[:n], np.full(n, 2), u[n:], np.full(len(u) - n, 3), True)
    assert count[:n].tolist() == (2 * near[:n, :n].sum(axis=1) + 3 * near[:n, n:].sum(axis=1)).tolist()
    assert count[n:].tolist() == (2 * near[n:, :n].sum(axis=1)).tolist()
    alone, _ = ct.shard_links(u[:n], np.ones(n, int), u[n:], np.ones(len(u) - n, int), False)
    assert alone[:n].tolist() == near[:n, n:].sum(axis=1).tolist()


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{sf}/embeddings.parquet')")
    got = ct.op12(spark.read.parquet(f"{sf}/embeddings.parquet")).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(ct.ORACLE).fetchall())


def test_points_that_cover_no_others_are_compared_in_stretches():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 64))
    x[1500:1520] = x[:20] + 0.01 * rng.normal(size=(20, 64))
    u, near = pairs(x)
    tree = ct.CoverTree(u)
    # One node for some hundred points, not one for each.
    assert len(tree.start) < 20 and max(tree.end[a] - tree.start[a] for a in range(len(tree.start)) if tree.kids[a] == (0, 0)) <= 512
    links = ct.Links(np.ones(3000, np.int64))
    ct.traverse(tree, tree, 0, 0, links)
    back = np.empty(3000, np.int64)
    back[tree.order] = links.found()[0]
    assert back.tolist() == near.sum(axis=1).tolist() and back.sum() == 40
