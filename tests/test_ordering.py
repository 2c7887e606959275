"""What turns with the risky end of the score, seen against the same scores negated; and joins that state their rows."""

from __future__ import annotations

import math
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from scoreloom.functions import contracts
from scoreloom.functions.ordering import RISING, Ordering
from scoreloom.operators import bands, policy
from scoreloom.plans.pipeline import HEADLINE, Run, headline
from scoreloom.plans.queries import PERIODS, POLICY, RANGES, SETTINGS, run_of
from scoreloom.plans.turned_queries import LOW_IS_BAD, TURNED, turned
from scoreloom.sources import loans
from scoreloom.streaming import monitor

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def up(spark):
    return run_of(spark, SF)


@pytest.fixture(scope="module")
def down(spark):
    return turned(spark, SF)


def near(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == pytest.approx(b, rel=1e-9, abs=1e-12)
    return a == b


def same(left, right, key, skip=()):
    a, b = ({tuple(r[k] for k in key): r.asDict() for r in df.collect()} for df in (left, right))
    assert a.keys() == b.keys() and len(a)
    for k in a:
        for c in a[k]:
            assert c in skip or near(a[k][c], b[k][c]), (k, c, a[k][c], b[k][c])


def test_closure_turns_with_the_end(spark):
    edges = (-math.inf, 1.0, 2.0, math.inf)
    rows = [(1.0,), (1.5,), (2.0,), (3.0,), (0.0,), (math.inf,), (-math.inf,), (None,)]
    df = spark.createDataFrame(rows, "s double")
    got = df.select("s", RISING.bucket("s", edges).alias("up"), LOW_IS_BAD.bucket("s", edges).alias("down"), LOW_IS_BAD.bucket(-F.col("s"), tuple(-e for e in reversed(edges))).alias("negated")).collect()
    assert [r["up"] for r in got] == [1, 2, 2, 3, 1, 3, 1, None]
    assert [r["down"] for r in got] == [2, 2, 3, 3, 1, 3, 1, None]
    assert all(r["up"] is None or r["negated"] == 4 - r["up"] for r in got)


def test_policy_is_the_one_of_the_negated_scores(up, down):
    same(up.plan, down.plan, ["status"], {"auto_pass_threshold", "reject_threshold", "auto_pass_band", "manual_review_upper_band"})
    a, b = up.plan.first(), down.plan.first()
    assert near(a["auto_pass_threshold"], -b["auto_pass_threshold"]) and near(a["reject_threshold"], -b["reject_threshold"])
    flow = lambda run: policy.flow(run.scored, run.plan, ordering=run.ordering)
    same(flow(up), flow(down), ["sample_group"], {"auto_pass_threshold", "total_accept_threshold"})
    same(policy.sensitivity(up.curve, up.plan), policy.sensitivity(down.curve, down.plan), ["threshold_type", "scenario"], {"threshold", "band"})
    names = ("threshold", "prev_threshold", "band", "band_order", "merged_from")
    same(policy.selection(up.curve, up.plan, POLICY), policy.selection(down.curve, down.plan, POLICY), ["threshold_order"], names)


def test_reports_of_bands_are_those_of_the_negated_scores(up, down):
    mirrored = down.band_report().withColumn("band_order", 8 - F.col("band_order"))
    skip = {"band", "score_left", "score_right", "score_min", "score_max", "score_mean", "merged_from"}
    same(up.band_report(), mirrored, ["sample_group", "band_order"], skip)
    steps = lambda run: bands.process_table(bands.dense_bin_stats(run.binned.filter("sample_group = 'train'"), run.edges, run.ordering), run.ranges, run.settings.search)
    flipped = steps(down).withColumn("bin_order", 21 - F.col("bin_order"))
    same(steps(up), flipped, ["bin_order"], skip | {"bin", "band_order"})


def test_search_and_bands_agree_on_the_end(spark):
    view = loans.loan_view(spark, SF).withColumn("score_mlt", -F.col("score_mlt"))
    low = Run(view, replace(SETTINGS, search=replace(SETTINGS.search, high_is_bad=False)))
    high = run_of(spark, SF, fixed=False)
    assert [(21 - b, 21 - a) for a, b in reversed(low.ranges)] == high.ranges
    assert TURNED == tuple((21 - b, 21 - a) for a, b in reversed(RANGES)) and PERIODS == SETTINGS.periods


def test_the_riskiest_threshold_is_one_of_the_sample(down):
    curve = down.curve.orderBy("threshold_order").collect()
    thresholds = [r["threshold"] for r in curve]
    assert thresholds == sorted(thresholds, reverse=True)
    assert thresholds[-1] == down.train.agg(F.min("score_mlt")).first()[0]
    assert curve[-1]["cum_pass_rate"] == 1.0 and curve[0]["prev_threshold"] is None


def test_live_counts_close_bands_like_the_others(spark):
    df = spark.createDataFrame([("2024-01-01 10:00:00", 1.0), ("2024-01-01 11:00:00", 2.0)], "ts string, score_mlt double").withColumn("ts", F.to_timestamp("ts"))
    edges, ranges = (-math.inf, 1.0, 2.0, math.inf), ((1, 1), (2, 2), (3, 3))
    assert monitor.windowed(df, edges, ranges).first()["counts"] == [1, 1, 0]
    assert monitor.windowed(df, edges, ranges, ordering=Ordering(False)).first()["counts"] == [0, 1, 1]


# Contracts ---------------------------------------------------------------------------------------


def test_repeated_keys_fail_when_the_plan_runs(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, x string")
    right = spark.createDataFrame([(1, 10), (3, 30)], "k int, y int")
    got = contracts.many_to_one(left, right, ["k"], "facts").collect()
    assert sorted((r["x"], r["y"]) for r in got) == [("a", 10), ("b", 10), ("c", None), ("d", None)]
    twice = right.union(right.filter("k = 1"))
    with pytest.raises(Exception, match=r'facts: more than one row for \{"k":1\}'):
        contracts.many_to_one(left, twice, ["k"], "facts").collect()
    with pytest.raises(Exception, match="bands: more than one row"):
        contracts.one_to_one(left, right, ["k"], "bands").collect()
    assert contracts.one_to_one(left.filter("x != 'b'"), right, ["k"], "bands").count() == 3
    assert contracts.unique(left.filter("false"), ["k"], "none").count() == 0
    with pytest.raises(Exception, match='"k":null'):
        contracts.unique(left.filter("k is null").union(left.filter("k is null")), ["k"], "nulls").collect()


def test_reports_fail_on_a_repeated_band(spark, up):
    broken = run_of(spark, SF)
    broken.psi = up.psi.union(up.psi)
    with pytest.raises(Exception, match="band stability: more than one row"):
        broken.enriched("train").collect()
    broken = run_of(spark, SF)
    broken.performance = up.performance.withColumn("sample_group", F.lit("train"))
    assert broken.band_report().filter("sample_group = 'oot' and overall_m1_auc is not null").count() == 0


def test_headline_columns_come_first(up):
    columns = up.band_report().columns
    assert tuple(columns[: len(HEADLINE)]) == HEADLINE and len(set(columns)) == len(columns)
    assert headline(up.plan, ["status", "nothing"]).columns[0] == "status"
