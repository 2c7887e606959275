"""Partitions as rows and p-values against the driver's search, and the search against a brute-force walk."""

from __future__ import annotations

import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from scoreloom.functions.special import erfc, two_proportion_p, two_proportion_z
from scoreloom.operators import candidates
from scoreloom.plans import search as s
from scoreloom.plans.model_queries import MODEL_SETTINGS, NAMED, SEARCH, model_bins
from scoreloom.plans.pipeline import search_many, search_states
from scoreloom.plans.queries import POLICY, run_of
from scoreloom.settings import Floors, Limits, Policy, Search, Settings

SF = "/root/testdata/sf0.01"
LOW = Search(high_is_bad=False, floors=Floors(mature=60, extreme_mature=30, bad=3, worst_bad=2, good=30, best_good=20), best_bins=2, protect_jumps=3, tolerance=0.001)


@pytest.fixture(scope="module")
def bins(spark):
    return spark.createDataFrame(model_bins(spark, SF).collect(), model_bins(spark, SF).schema)


def by_model(bins):
    out = {}
    for r in bins.orderBy("segment", "bin_order").collect():
        out.setdefault(r["segment"], []).append(r.asDict())
    return out


def close(a, b):
    return (a is None and b is None) or (a is not None and b is not None and a == pytest.approx(b, rel=1e-9, abs=1e-9))


# Functions ---------------------------------------------------------------------------------------


def test_erfc_is_within_1e_12(spark):
    points = [k / 97 for k in range(-700, 2700)] + [0.0, -0.0, 1e-300, 26.9, 27.5, 1e308, -1e308]
    df = spark.createDataFrame([(x,) for x in [*points, None]], "x double")
    got = df.select("x", erfc("x").alias("y")).collect()
    assert all(r["y"] is None if r["x"] is None else abs(r["y"] - math.erfc(r["x"])) < 1e-12 for r in got)
    assert df.filter("x = 0").select(erfc("x")).first()[0] == 1.0


def test_p_values_are_those_of_the_search(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(0, m + 1), m, rng.randrange(0, n + 1), n) for m in (1, 7, 300, 10**6) for n in (1, 40, 10**5) for _ in range(20)]
    rows += [(0, 0, 1, 5), (1, 5, 0, 0), (0, 5, 0, 9), (5, 5, 9, 9), (50, 100, 50, 100), (0, 5, 5, 5)]
    df = spark.createDataFrame(rows, "a long, m long, b long, n long")
    for a, m, b, n, p, z in df.select("*", two_proportion_p("a", "m", "b", "n"), two_proportion_z("a", "m", "b", "n")).collect():
        want = s.p_value(a, m, b, n)
        assert (p is None) == (want is None) and (p is None or abs(p - want) < 1e-12)
        if z is not None:
            assert math.erfc(z / math.sqrt(2)) == pytest.approx(want, abs=1e-12)


# Against the driver's search ---------------------------------------------------------------------


@pytest.mark.parametrize("search", [SEARCH, LOW, replace(SEARCH, protect_extremes=False), replace(SEARCH, best_bins=3, worst_bins=0)])
def test_scores_are_those_of_the_search(spark, bins, search):
    states = search_states(bins, ["segment"], Settings(policy=POLICY, search=search)).withColumn("candidate", F.col("ranges"))
    states = spark.createDataFrame(states.collect(), states.schema)
    got = {(r["segment"], r["candidate"]): r for r in candidates.scored(bins, candidates.parsed(states, ["segment", "candidate"]), ["segment"], search).collect()}
    want = states.collect()
    assert len(got) == len(want)
    chosen = {}
    for w in want:
        g = got[w["segment"], w["ranges"]]
        for c in ("hard_constraints_ok", "primary_inversion_cnt", "all_inversion_cnt", "constraint_violation_cnt", "extreme_cut_violation_cnt"):
            assert g[c] == w[c], (c, g, w)
        for c in ("primary_iv_retention", "least_adjacent_rate_diff", "candidate_score"):
            assert close(g[c], w[c]), (c, g, w)
        chosen[w["segment"], w["ranges"]] = (g["selected"], w["selected"])
    assert all(a == b for a, b in chosen.values())


@pytest.mark.parametrize("search", [SEARCH, LOW])
def test_cuts_constraints_and_costs_are_those_of_the_search(spark, bins, search):
    cuts = {}
    for r in candidates.protected_cuts(bins, ["segment"], search, POLICY).collect():
        cuts.setdefault(r["segment"], set()).add(r["cut"])
    parts = candidates.partitions(spark, NAMED)
    bands = {(r["segment"], r["candidate"], r["band_order"]): r for r in candidates.constrained(candidates.band_sums(bins, parts, ["segment"]), search).collect()}
    pairs = {(r["segment"], r["candidate"], r["pair_index"]): r for r in candidates.pair_costs(bins, parts, ["segment"], search, POLICY).collect()}
    for segment, rows in by_model(bins).items():
        table = s.Table(rows, search)
        assert cuts[segment] == table.protected(POLICY)
        for name, ranges in NAMED:
            walk = s.Walk(table, POLICY)
            walk.cuts = s.cuts_of(ranges)
            short = table.shortages(walk.cuts)
            for k, (ok, lack) in enumerate(short, 1):
                b = bands[segment, name, k]
                assert b["all_constraints_ok"] == ok and close(b["violation_severity"], lack)
                assert b["extreme_role"] == s.role(*ranges[k - 1], 20, search)
            for k in range(1, len(ranges)):
                step, p = walk.weigh(k - 1, False), pairs[segment, name, k]
                assert (p["cut"], p["is_protected"], p["is_extreme"]) == (step.cut, step.protected, step.extreme)
                assert all(close(p[a], b) for a, b in (("rate_gap", step.gap), ("p_value", step.p), ("iv_loss", step.iv_loss), ("merge_cost", step.cost), ("left_rate", step.left_rate)))
            best = walk.cheapest(range(len(walk.cuts)), False)
            marked = [k for (g, n, k), p in pairs.items() if (g, n) == (segment, name) and p["cheapest_open"]]
            assert marked == ([] if best is None else [walk.cuts.index(best.cut) + 1])


def test_partitions_of_other_bins_and_models(spark, bins):
    parts = candidates.partitions(spark, [("short", ((1, 5), (6, 15))), ("right", ((1, 5), (6, 20)))])
    assert {r["candidate"] for r in candidates.band_sums(bins, parts, ["segment"]).collect()} == {"right"}
    own = parts.withColumn("segment", F.lit("1-URGENT"))
    assert {r["segment"] for r in candidates.scored(bins, own, ["segment"], SEARCH).collect()} == {"1-URGENT"}
    text = spark.createDataFrame([("a", "[(1,2), (3, 20)]")], "candidate string, ranges string")
    assert [tuple(r) for r in candidates.parsed(text, ["candidate"]).collect()] == [("a", 1, 1, 2), ("a", 2, 3, 20)]
    assert candidates.scored(bins.filter("false"), parts, ["segment"], SEARCH).count() == 0


def test_edges_and_bins_of_each_model(spark):
    rows = [("a", float(k)) for k in range(40)] + [("b", 1.0)] * 5 + [("b", None), (None, 3.0), ("a", float("inf")), ("a", float("-inf"))]
    df = spark.createDataFrame(rows, "m string, score_mlt double")
    edges = candidates.edges_by(df.filter("score_mlt < 1e9 and score_mlt > -1e9"), ["m"], bins=4)
    got = candidates.binned_by(df, edges, ["m"]).collect()
    assert sorted((r["bin_order"] for r in got if r["m"] == "a")) == sorted([1] * 10 + [2] * 10 + [3] * 10 + [4] * 10 + [1, 4])
    assert [r["bin_order"] for r in got if r["m"] == "b"] == [1] * 5 + [None]
    assert [r["bin_order"] for r in got if r["m"] is None] == [None]


# The search, replayed ----------------------------------------------------------------------------


class Replay:
    """The greedy search once more, from plain sums over bins and with nothing of the engine's search."""

    def __init__(self, rows, policy, conf):
        self.rows, self.conf, self.policy, self.k = rows, conf, policy, len(rows)
        self.sign = 1 if conf.high_is_bad else -1

    def total(self, r, c):
        return sum(self.rows[i - 1][c] for i in range(r[0], r[1] + 1))

    def rate(self, r, m):
        bottom = self.total(r, m + ("_mature" if "cnt" in m else "_exposure"))
        return self.total(r, m + "_bad") / bottom if bottom else None

    def drop(self, a, b, m):
        x, y = self.rate(a, m), self.rate(b, m)
        return None if x is None or y is None else self.sign * (y - x)

    def iv(self, ranges):
        bad = [self.total(r, "m3_cnt_bad") for r in ranges]
        good = [self.total(r, "m3_cnt_mature") - b for r, b in zip(ranges, bad)]
        if not sum(bad) or not sum(good):
            return None
        out = 0
        for b, g in zip(bad, good):
            x, y = (b + 0.5) / (sum(bad) + 0.5 * len(bad)), (g + 0.5) / (sum(good) + 0.5 * len(bad))
            out += (x - y) * math.log(x / y)
        return out

    def ends(self):
        best, worst = self.conf.best_bins, self.conf.worst_bins
        if self.conf.high_is_bad:
            return {"best": (1, best), "worst": (self.k - worst + 1, self.k)}
        return {"worst": (1, worst), "best": (self.k - best + 1, self.k)}

    def extreme(self):
        return {b if a == 1 else a - 1 for a, b in self.ends().values()} & set(range(1, self.k))

    def protected(self):
        out = self.extreme()
        one = [(i, i) for i in range(1, self.k + 1)]
        for _, limits in self.policy.groups:
            got = [i for i in range(1, self.k + 1) if (r := self.rate((1, i), "m3_cnt")) is not None and r <= limits.get("cum_m3_cnt_bad_rate")]
            out |= {max(got)} if got else set()
            got = [i for i in range(1, self.k + 1) if (r := self.rate((i, i), "m3_cnt")) is not None and r > limits.get("marginal_m3_cnt_bad_rate")]
            out |= {min(got) - 1} if got else set()
        jumps = {i: d for i, (a, b) in enumerate(zip(one, one[1:]), 1) if (d := self.drop(a, b, "m3_cnt")) is not None}
        for _ in range(self.conf.protect_jumps):
            if jumps:
                top = max(jumps, key=lambda i: (jumps[i], -i))
                out.add(top)
                del jumps[top]
        return out & set(range(1, self.k))

    def violations(self, ranges):
        f, out = self.conf.floors, []
        for i, r in enumerate(ranges):
            role = next((name for name, span in self.ends().items() if span == r), None)
            need = [f.tail_share if i in (0, len(ranges) - 1) else f.middle_share]
            need += {"best": [f.extreme_mature, f.best_bad, f.best_good], "worst": [f.extreme_mature, f.worst_bad, f.worst_good]}.get(role, [f.mature, f.bad, f.good])
            bad, mature = self.total(r, "m3_cnt_bad"), self.total(r, "m3_cnt_mature")
            have = [self.total(r, "n") / self.total((1, self.k), "n"), mature, bad, mature - bad]
            if any(h < n for h, n in zip(have, need)):
                out.append((sum(max(0, 1 - h / n) for h, n in zip(have, need) if n > 0), i))
        return out

    def inversions(self, ranges, names):
        return [(i, m) for m in names for i in range(len(ranges) - 1) if (d := self.drop(ranges[i], ranges[i + 1], m)) is not None and d < -self.conf.tolerance]

    def cost(self, ranges, i, free):
        a, b = ranges[i], ranges[i + 1]
        gap = max([abs(d) for m in ("m1_cnt", "m3_cnt") if (d := self.drop(a, b, m)) is not None] or [0])
        ba, na, bb, nb = (self.total(r, c) for r in (a, b) for c in ("m3_cnt_bad", "m3_cnt_mature"))
        p = None
        if na > 0 and nb > 0:
            q = (ba + bb) / (na + nb)
            v = q * (1 - q) * (1 / na + 1 / nb)
            p = math.erfc(abs(ba / na - bb / nb) / math.sqrt(v) / math.sqrt(2)) if v > 0 else float(math.isclose(ba / na, bb / nb))
        now, then = self.iv(ranges), self.iv([*ranges[:i], (a[0], b[1]), *ranges[i + 2 :]])
        loss = max(0, now - then) if now is not None and then is not None else 0
        price = 0 if free else 100 * (a[1] in self.protected()) + 10000 * (a[1] in self.extreme())
        return 100 * gap + 1 - (p or 0) + 10 * loss + price, gap, p

    def run(self):
        ranges, steps = [(i, i) for i in range(1, self.k + 1)], []
        states = [list(ranges)]

        def merge(options, free, stage, rule=None):
            open_ = [i for i in options if ranges[i][1] not in self.extreme()]
            if not open_:
                return False
            costs = {i: self.cost(ranges, i, free) for i in open_}
            if rule:
                costs = {i: c for i, c in costs.items() if rule(c)} or costs
            least = min(c[0] for c in costs.values())
            i = min(i for i, c in costs.items() if c[0] <= least + 1e-12)
            steps.append((stage, ranges[i][1]))
            ranges[i : i + 2] = [(ranges[i][0], ranges[i + 1][1])]
            states.append(list(ranges))
            return True

        while len(ranges) > 6 and (v := self.violations(ranges)):
            most = max(x for x, _ in v)
            at = min(i for x, i in v if x >= most - 1e-12)
            if not merge([i for i in (at - 1, at) if 0 <= i < len(ranges) - 1], True, "small_bands"):
                break
        while len(ranges) > 6 and (v := self.inversions(ranges, ("m1_cnt", "m3_cnt"))):
            deep = min(((min(d for m in ("m1_cnt", "m3_cnt") if (d := self.drop(ranges[i], ranges[i + 1], m)) is not None)), i) for i in {i for i, _ in v})[1]
            if not merge([deep], True, "monotone"):
                break
        while len(ranges) > 8 and merge(range(len(ranges) - 1), False, "compress"):
            pass
        while len(ranges) > 6 and merge(range(len(ranges) - 1), False, "reduce", lambda c: (c[2] is not None and c[2] >= 0.10) or c[1] <= 0.003):
            pass
        return states, steps, self.best(states)

    def best(self, states):
        def key(ranges):
            primary, every, bad = len(self.inversions(ranges, ("m1_cnt", "m3_cnt"))), len(self.inversions(ranges, ("m1_cnt", "m3_cnt", "m1_amt", "m3_amt"))), len(self.violations(ranges))
            crossed = len(self.extreme() - {r[1] for r in ranges[:-1]})
            iv, first = self.iv(ranges), self.iv([(i, i) for i in range(1, self.k + 1)])
            kept = iv / first if iv is not None and first else None
            apart = min([d for m in ("m1_cnt", "m3_cnt") for a, b in zip(ranges, ranges[1:]) if (d := self.drop(a, b, m)) is not None] or [0])
            hard = 6 <= len(ranges) <= 8 and not primary and not bad and not crossed
            score = 100 * hard - 30 * primary - 4 * every - 15 * bad + 12 * min(max(kept or 0, 0), 1.5) + 100 * max(apart, 0) - 1.5 * abs(len(ranges) - 7) - 50 * crossed
            return (not 6 <= len(ranges) <= 8, not hard, primary, bad, every, -round(score, 9), -round(kept if kept is not None else -1e9, 9), abs(len(ranges) - 7))

        return min(states, key=key)


def made_up(rng, k):
    rows = []
    for i in range(k):
        n = rng.choice([30, 200, 1000, 1200])
        mature = rng.randrange(n // 2, n + 1)
        bad = sum(rng.random() < 0.02 + 0.012 * i * rng.random() for _ in range(mature))
        early = min(mature, n)
        rows.append({"n": n, "m3_cnt_mature": mature, "m3_cnt_bad": bad, "m1_cnt_mature": early, "m1_cnt_bad": bad // 3, "m1_amt_exposure": 100.0 * n, "m1_amt_bad": 20.0 * bad, "m3_amt_exposure": 90.0 * n, "m3_amt_bad": 37.0 * bad + rng.randrange(50)})
    return rows


@pytest.mark.parametrize("seed", range(12))
def test_the_search_is_the_brute_force_walk(seed):
    rng = random.Random(seed)
    rows = made_up(rng, rng.choice([7, 12, 20]))
    floors = Floors(middle_share=0.03, tail_share=0.02, mature=300, extreme_mature=100, bad=4, worst_bad=2, good=50, best_good=20)
    conf = Search(floors=floors, high_is_bad=seed % 3 > 0, protect_jumps=1 + seed % 2, best_bins=1 + seed % 2)
    policy = Policy(auto=Limits((("cum_m3_cnt_bad_rate", 0.04), ("marginal_m3_cnt_bad_rate", 0.06))), accept=Limits((("cum_m3_cnt_bad_rate", 0.08), ("marginal_m3_cnt_bad_rate", 0.12))))
    found = s.search(rows, policy, conf)
    states, steps, best = Replay(rows, policy, conf).run()
    assert [(x.stage, x.cut) for x in found.steps] == steps
    assert {s.text_of(x) for x in states} == {s.text_of(c.ranges) for c in found.candidates}
    assert found.ranges == best


def test_search_by_model_is_replayed(spark, bins):
    got = {r["segment"]: r["ranges"] for r in search_many(bins, "segment", MODEL_SETTINGS).collect()}
    models = by_model(bins)
    assert len(got) == len(models) == 5
    for segment, rows in models.items():
        assert s.read_text(got[segment]) == Replay(rows, POLICY, SEARCH).run()[2]


def test_merge_steps_are_replayed(spark):
    run = run_of(spark, SF, fixed=False)
    rows = [r.asDict() for r in run.train_sums.orderBy("bin_order").collect()]
    states, steps, best = Replay(rows, run.settings.policy, run.settings.search).run()
    assert [(r["stage"], r["cut"]) for r in run.steps().orderBy("step_no").collect()] == steps
    assert run.ranges == best
    assert {r["ranges"] for r in run.candidates().collect()} == {s.text_of(x) for x in states}
