"""Embedding near-duplicates: exact cosine links by cover trees, two of them traversed at a time.

Vectors of a label are points on the unit sphere, where a cosine is a distance. The upper levels of the
cover tree are made by rounds over the whole table: a cell that is still large gets centres that cover a
sample of it at a halving radius, each point goes to its nearest centre's cell, and, as a visitor, to those
cells in front of it that may hold a point within reach of it. What ends up small enough is a shard: its
task builds the lower levels (nested nets of halving radii) and traverses its members' tree with itself and
with its visitors' tree. A pair of nodes is dropped when the distance of their centres less both
covering radii is out of reach, is linked as a whole when that distance plus both radii is within reach, and
else is split; points are compared one by one at the end. So tight groups are counted, not listed, and a
task returns for each point how many it found and the first of its connected points, never pairs.

Equal vectors are one point with a weight. A cell within half the reach of its centre is tight: all its
points link, and it is not divided further. Cells only decide where pairs meet: sampled centres
change no result. Where points lie far apart in every direction, as random ones of many dimensions do, the
bounds drop little above the last level, and the work grows with the square of a label's points.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and those without a label, link
with nothing; vectors of different length do not link; repeated rows and ids are vectors of their own;
a null vec_id links as any other, names no component that has another id, and is not kept; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm.common import discard, store
from scoreloom.llm.simhash_bktree import connected

LEAST_COSINE = 0.98
#: Points of a cell up to which one task takes it as it is, and visitors that it takes at a time.
SHARD = 16384
#: Points that a cell's centres are chosen from, and centres at most.
CANDIDATES, CENTRES = 256, 64
#: Rounds of division, after which a cell is dealt out in parts that all meet.
ROUNDS = 12
#: Points up to which a node is not divided, and what bounds give away to rounding: a distance near 0 is off by up to 4e-8.
BUCKET, SLACK = 8, 1e-6
#: Points by which it is tried if a radius covers any others, parts of a node at most, and points of the stretches that the rest is dealt into.
TRIED, PARTS, STRETCH = 128, 256, 512


def reach(cosine: float) -> float:
    """The distance of unit vectors at a cosine."""
    return math.sqrt(2 - 2 * cosine)


def distance(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * cosines))


class CoverTree:
    """Points in an order in which each node's are a stretch; a node's children cover it at half its level's radius or less."""

    def __init__(self, points: np.ndarray) -> None:
        self.order = np.arange(len(points))
        self.start, self.end, self.centre, self.radius = [0], [len(points)], [0], [0.0]
        self.kids: list[tuple[int, int]] = [(0, 0)]
        d = distance(points @ points[0])
        self.radius[0] = float(d.max())
        level = [(0, 2.0)]
        for node, r in level:
            self._divide(points, node, r, level)
        self.points = points[self.order]
        place = np.empty(len(points), np.int64)
        place[self.order] = np.arange(len(points))
        self.centre = place[np.array(self.centre)]
        self.start, self.end, self.radius = np.array(self.start), np.array(self.end), np.array(self.radius)

    def _divide(self, points: np.ndarray, node: int, r: float, level: list[tuple[int, float]]) -> None:
        a, b = self.start[node], self.end[node]
        if b - a <= BUCKET:
            return
        # Levels at which the centre covers all are passed over.
        while r >= self.radius[node] and r >= SLACK:
            r /= 2
        if r < SLACK:
            return
        left, centre, parts = self.order[a:b], self.centre[node], []
        # Where points lie too far apart to cover each other, a net would be all of them; they are compared in stretches.
        few = left[:: max(1, len(left) // TRIED)]
        flat = 2 * _covering(points[few], r, len(few) // 2 + 1) > len(few)
        if flat and len(left) <= STRETCH:
            return
        while len(left) and len(parts) < PARTS and not flat:
            d = distance(points[left] @ points[centre])
            near = d <= r
            near |= left == centre
            parts.append((left[near], centre, float(d[near].max())))
            left = left[~near]
            centre = left[0] if len(left) else -1
        divided = len(parts)
        for k in range(0, len(left), STRETCH):
            members = left[k : k + STRETCH]
            parts.append((members, members[0], float(distance(points[members] @ points[members[0]]).max())))
        self.kids[node] = (len(self.start), len(self.start) + len(parts))
        at = a
        for k, (members, c, far) in enumerate(parts):
            self.order[at : at + len(members)] = members
            self.start.append(at)
            self.end.append(at := at + len(members))
            self.centre.append(c)
            self.radius.append(far)
            self.kids.append((0, 0))
            if k < divided:
                level.append((len(self.start) - 1, r))


def _covering(points: np.ndarray, r: float, most: int) -> int:
    """How many balls of radius r around points cover all, or `most` if more than that."""
    found = 0
    while len(points) and found < most:
        points, found = points[distance(points @ points[0]) > r], found + 1
    return found


class Links:
    """Weighted link counts and connected points of two sides, whose points are numbered one after the other."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weight = np.concatenate([[0], np.cumsum(weights)])
        self.added = np.zeros(len(weights) + 1, np.int64)
        self.up = np.arange(len(weights))
        self.whole: set[tuple[int, int]] = set()

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Connects a[k] with b[k]."""
        while len(a):
            self.up = self._tops()
            x, y = self.up[a], self.up[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.up, np.maximum(x, y), np.minimum(x, y))

    def _tops(self) -> np.ndarray:
        up = self.up
        while True:
            over = up[up]
            if np.array_equal(over, up):
                return up
            up = over

    def link(self, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> None:
        """Every point of each stretch a to a_end with every one of b to b_end."""
        for s, e, t, u in ((a, a_end, b, b_end), (b, b_end, a, a_end)):
            mass = self.weight[u] - self.weight[t]
            np.add.at(self.added, s, mass)
            np.add.at(self.added, e, -mass)
        stretches = np.concatenate([np.stack([x, y], 1)[y - x > 1] for x, y in ((a, a_end), (b, b_end))])
        for s, e in map(tuple, np.unique(stretches, axis=0).tolist()):
            if (s, e) not in self.whole:
                self.whole.add((s, e))
                self.join(np.arange(s + 1, e), np.full(e - s - 1, s))
        self.join(a, b)

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        """(links, first connected point) of each point."""
        return np.cumsum(self.added)[:-1], self._tops()


def traverse(p: CoverTree, q: CoverTree, p_at: int, q_at: int, links: Links, cosine: float = LEAST_COSINE) -> int:
    """Links all points of p and q within reach; p is q for the pairs inside one tree. Returns the cosines computed."""
    far, same, work = reach(cosine), p is q, 0
    stack = [(0, 0)]

    def parts(t: CoverTree, node: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(name, centre, radius, start, end) of a node's children, or of its points; a point is named by a negative number."""
        a, b = t.kids[node] if node >= 0 else (0, 0)
        if b > a:
            return np.arange(a, b), t.centre[a:b], t.radius[a:b], t.start[a:b], t.end[a:b]
        at = np.arange(t.start[node], t.end[node]) if node >= 0 else np.array([-1 - node])
        return -1 - at, at, np.zeros(len(at)), at, at + 1

    while stack:
        x, y = stack.pop()
        xs, ys = parts(p, x), parts(q, y)
        c = p.points[xs[1]] @ q.points[ys[1]].T
        work += c.size
        if not len(xs[0]) or not len(ys[0]):
            continue
        if xs[0][0] < 0 and ys[0][0] < 0:
            # Points with points: nothing is left open.
            linked = c >= cosine
            if same and x == y:
                linked = np.triu(linked, 1)
            i, j = np.nonzero(linked)
            if len(i):
                links.link(p_at + xs[3][i], p_at + xs[4][i], q_at + ys[3][j], q_at + ys[4][j])
            continue
        single = ((xs[4] - xs[3])[:, None] == 1) & ((ys[4] - ys[3])[None, :] == 1)
        d, spread = distance(c), xs[2][:, None] + ys[2][None, :]
        linked = np.where(single, c >= cosine, d + spread <= far - SLACK)
        open_ = ~single & ~linked & (d - spread <= far + SLACK)
        if same and x == y:
            linked &= np.triu(np.ones(linked.shape, bool), 1)
            # A node with itself is split until its points are met one by one.
            open_ = (open_ | np.diag(xs[4] - xs[3] > 1)) & np.triu(np.ones(open_.shape, bool))
        i, j = np.nonzero(linked)
        if len(i):
            links.link(p_at + xs[3][i], p_at + xs[4][i], q_at + ys[3][j], q_at + ys[4][j])
        i, j = np.nonzero(open_)
        stack.extend(zip(xs[0][i].tolist(), ys[0][j].tolist()))
    return work


def shard_links(members: np.ndarray, weights: np.ndarray, visitors: np.ndarray, visitor_weights: np.ndarray, inside: bool, cosine: float = LEAST_COSINE) -> tuple[np.ndarray, np.ndarray]:
    """(links, first connected point) of members, then visitors; visitors meet members only, members each other if inside."""
    n = len(members)
    p = CoverTree(members)
    q = CoverTree(visitors) if len(visitors) else None
    order = np.concatenate([p.order, n + q.order]) if q else p.order
    links = Links(np.concatenate([weights, visitor_weights])[order])
    if inside:
        traverse(p, p, 0, 0, links, cosine)
    if q:
        traverse(p, q, 0, n, links, cosine)
    counts, tops = links.found()
    count, top = np.empty_like(counts), np.empty_like(tops)
    count[order], top[order] = counts, order[tops]
    return count, top


def unit_bytes(points: DataFrame) -> DataFrame:
    """points with unit, the embedding at length 1 as bytes of doubles, in place of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column("embedding").to_numpy(zero_copy_only=False):
                v = np.asarray(x, np.float64)
                top = np.abs(v).max()
                if not 1e-100 < top < 1e100:
                    v = v / top
                out.append((v / math.sqrt(float(v @ v))).tobytes())
            kept = batch.drop_columns(["embedding"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(out, pa.binary())], [*kept.schema.names, "unit"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields if f.name != "embedding")
    return points.mapInArrow(run, f"{fields}, unit binary")


def matrix(units) -> np.ndarray:
    return np.frombuffer(b"".join(units), np.float64).reshape(len(units), -1)


def _net(points: np.ndarray, most: int, near: float) -> np.ndarray:
    """Places of centres that cover points at the largest halved radius that takes `most` of them, or leaves none uncovered at `near`."""
    radius, found = 2.0, [0]
    while len(found) < most and radius > near:
        radius /= 2
        found, nearest = [0], distance(points @ points[0])
        while len(found) < most and nearest.max() > radius:
            found.append(int(np.argmax(nearest > radius)))
            nearest = np.minimum(nearest, distance(points @ points[found[-1]]))
    return np.array(found)


CELL = "cell string, node long, home boolean, weight long, unit binary, far double"


def _divided(rows: DataFrame, k: int, cosine: float) -> DataFrame:
    """rows of large cells (with members and present) in the cells of their centres, and as visitors."""
    far = reach(cosine)
    shard, most, some = SHARD, CENTRES, CANDIDATES
    first = Window.partitionBy("cell").orderBy(F.xxhash64("node", F.lit(k)), "node")
    ranked = lambda df, most: df.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= most)
    # A sample may miss what makes a cell wide, so its outermost point is always there.
    outermost = ranked(rows.filter("home and far = radius"), 1).withColumn("rank", F.lit(some + 1))
    sample = ranked(rows.filter("home"), some).unionByName(outermost)

    def centres(frame: pd.DataFrame) -> pd.DataFrame:
        points = matrix(frame.sort_values("rank")["unit"].tolist())
        wanted = min(most, max(2, 2 * -(-int(frame["members"].iloc[0]) // shard)))
        chosen = points[_net(points, wanted, far / 16)]
        return pd.DataFrame({"cell": frame["cell"].iloc[:1], "present": frame["present"].iloc[:1], "centres": [chosen.tobytes()]})

    table = sample.groupBy("cell").applyInPandas(centres, "cell string, present long, centres binary")
    parts = lambda c: F.ceil(F.col(c) / (4 * shard)).cast("int")
    dealt = table.select("cell", "centres", F.explode(F.sequence(F.lit(0), parts("present") - 1)).alias("part"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), parts("present")).cast("int"))

    def assign(frame: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame(columns=["cell", "node", "home", "weight", "unit", "far"])
        points = matrix(frame["unit"].tolist())
        centre = matrix([given["centres"].iloc[0]]).reshape(-1, points.shape[1])
        d = distance(points @ centre.T)
        best = d.argmin(axis=1)
        home = frame["home"].to_numpy(bool)
        # A visitor goes wherever a point within reach may be; a member only to cells in front of its own.
        # Such a point lies on the other side of the plane halfway between the two centres, which must be within reach.
        apart = distance(centre @ centre.T)[best]
        visits = d**2 <= d.min(axis=1)[:, None] ** 2 + 2 * far * apart + SLACK
        visits &= ~home[:, None] | (np.arange(d.shape[1])[None, :] < best[:, None])
        i, j = np.nonzero(visits)
        at = np.concatenate([np.flatnonzero(home), i])
        to = np.concatenate([best[home], j])
        cell = frame["cell"].iloc[0]
        return pd.DataFrame(
            {"cell": [f"{cell}.{c}" for c in to.tolist()], "node": frame["node"].to_numpy()[at], "home": np.arange(len(at)) < home.sum(), "weight": frame["weight"].to_numpy()[at], "unit": frame["unit"].to_numpy()[at], "far": d[at, to]}
        )

    return rows.groupBy("cell", "part").cogroup(dealt.groupBy("cell", "part")).applyInPandas(lambda a, b: assign(a, b), CELL)


def _told(rows: DataFrame, figures: DataFrame) -> DataFrame:
    """rows with the figures of their cell; cells are one for some thousand points, so that rows stay where they are."""
    return rows.join(F.broadcast(figures), "cell")


def shards(points: DataFrame, cosine: float = LEAST_COSINE) -> DataFrame:
    """Rows of cells that are small, tight or were divided often enough, with members, visitors and tight of their cell."""
    far = reach(cosine)
    rows = points.select("cell", "node", F.lit(True).alias("home"), "weight", "unit", F.lit(None).cast("double").alias("far"))
    done = None
    for k in range(ROUNDS + 1):
        stats = rows.groupBy("cell").agg(F.count_if("home").alias("members"), F.max(F.when(F.col("home"), F.col("far"))).alias("radius"))
        # A visitor out of reach of all members leaves; a cell without members has no pairs.
        met = _told(rows, stats.filter("members > 0")).filter(F.col("home") | (F.col("far") <= F.col("radius") + far + SLACK))
        present = met.groupBy("cell").agg(F.count(F.lit(1)).alias("present"))
        tight = F.coalesce(2 * F.col("radius") <= far - SLACK, F.lit(False))
        met = store(_told(met, present).withColumn("tight", tight), "met")
        large = (F.col("members") > SHARD) & ~F.col("tight") if k < ROUNDS else F.lit(False)
        small = met.filter(~large)
        done = small if done is None else done.unionByName(small)
        if k:
            discard(rows)
        if k == ROUNDS or met.filter(large).isEmpty():
            return done
        rows = store(_divided(met.filter(large).select("cell", "node", "home", "weight", "unit", "far", "radius", "members", "present"), k, cosine), f"cells-{k + 1}")


def links(points: DataFrame, cosine: float = LEAST_COSINE) -> DataFrame:
    """(node, links, root): from each task the weight of a point's links and the first point that they connect it with.

    points(cell, node, weight, unit) link only within their cell.
    """
    placed = shards(points, cosine)
    mark = lambda c, n: F.pmod(F.xxhash64(c, F.lit(7)), n).cast("int")
    cuts, turns = F.ceil(F.col("members") / SHARD).cast("int"), F.greatest(F.lit(1), F.ceil((F.col("present") - F.col("members")) / SHARD)).cast("int")
    rows = placed.withColumns({"cuts": cuts, "turns": turns, "mine": mark("node", cuts), "turn": mark("node", turns)})
    base = ["cell", "node", "weight", "unit"]
    # Members are there for each lot of visitors, and pair up among themselves with the first.
    members = rows.filter("home").select(*base, F.col("mine").alias("cut"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), F.lit(True).alias("home"), "tight")
    visitors = rows.filter("not home").select(*base, F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), "turn", F.lit(False).alias("home"), "tight")
    # Of a cell in several cuts each cut's members also visit those in front of it.
    across = rows.filter("home and not tight and mine > 0").select(*base, F.explode(F.sequence(F.lit(0), F.col("mine") - 1)).alias("cut"), "turn", F.lit(False).alias("home"), "tight")
    met = members.unionByName(visitors).unionByName(across)

    def search(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["home", "node"], ascending=[False, True])
        home = frame["home"].to_numpy(bool)
        inside = int(key[2]) == 0 and not bool(frame["tight"].iloc[0])
        if not home.any() or not (inside or not home.all()):
            return pd.DataFrame(columns=["node", "links", "root"])
        points, weight, node = matrix(frame["unit"].tolist()), frame["weight"].to_numpy(np.int64), frame["node"].to_numpy(np.int64)
        n = int(home.sum())
        count, top = shard_links(points[:n], weight[:n], points[n:], weight[n:], inside, cosine)
        some = count > 0
        return pd.DataFrame({"node": node[some], "links": count[some], "root": node[top[some]]})

    found = met.groupBy("cell", "cut", "turn").applyInPandas(search, "node long, links long, root long")
    # In a tight cell all points link.
    tight = rows.filter("home and tight")
    whole = tight.groupBy("cell").agg(F.sum("weight").alias("mass"), F.min("node").alias("root"))
    return found.unionByName(_told(tight, whole).select("node", (F.col("mass") - F.col("weight")).alias("links"), "root").filter("links > 0"))


def near_duplicates(vectors: DataFrame, cosine: float = LEAST_COSINE) -> DataFrame:
    """(vec_id, n_links, component_id) for every row of vectors(vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(F.col("label").isNotNull() & sound, F.lit(False))
    # Equal vectors of a label are one point.
    counted = rows.filter(usable).groupBy("label", "embedding").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("weight"))
    points = store(counted.withColumn("node", F.monotonically_increasing_id()), "points")
    cells = points.select(F.concat_ws("/", F.col("label").cast("string"), F.size("embedding").cast("string")).alias("cell"), "node", "weight", "embedding")
    found = store(links(unit_bytes(cells), cosine), "links")
    totals = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected(found.filter("root != node").select(F.col("node").alias("a"), F.col("root").alias("b")))
    # The vectors themselves come in last, so that they are shuffled once.
    named = points.select("node", "least_id", "weight").join(totals, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    told = named.join(ids, "root").select("node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    known = points.select("label", "embedding", "node").join(told, "node").drop("node")
    linked = rows.filter(usable).join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    return linked.unionByName(rows.filter(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))


def op12(vectors: DataFrame) -> DataFrame:
    """The contract's rows: vec_id, n_links, component_id, kept."""
    return near_duplicates(vectors).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS k, CAST(vec_id AS BIGINT) AS vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), u AS (
  SELECT *, sqrt(list_dot_product(e, e)) AS size FROM v
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.k AS x, b.k AS y FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.k <> b.k WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.98
), near AS (
  SELECT k AS x, k AS y FROM v UNION SELECT n.x, l.y FROM near n JOIN link l ON n.y = l.x
), component AS (
  SELECT x AS k, min(vec_id) AS component_id FROM near JOIN v ON v.k = near.y GROUP BY 1
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM v JOIN component USING (k) LEFT JOIN (SELECT x AS k, count(*) AS n FROM link GROUP BY 1) c USING (k)
"""
