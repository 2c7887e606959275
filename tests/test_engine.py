"""Golden figures, properties and edge cases of the engine's operators."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from scoreloom.functions.columns import clean_double, wilson
from scoreloom.operators import bands, funnel, policy, quantiles, samples, validation
from scoreloom.plans import report
from scoreloom.plans.pipeline import Run, search_many
from scoreloom.plans.queries import PERIODS, RANGES, SETTINGS, run_of
from scoreloom.settings import Periods
from scoreloom.sources import loans
from scoreloom.streaming import monitor


@pytest.fixture(scope="module")
def run(spark):
    return run_of(spark, "/root/testdata/sf0.01")


# Funnel and flow ---------------------------------------------------------------------------------

FUNNEL = [
    (1, "4.Funded", "4.Auto Approved Auto Funded", "Active_Account"),
    (1, "4.Funded", "4.Auto Approved Auto Funded", "Active_Account"),
    (2, "3.1.Approved Withdrawn", "3.1.Manual Approved Auto Withdrawn", "Cancelled"),
    (3, "4.Funded", "4.Manual Approved Auto Funded", None),
    (4, "2.3.Risk Declined", "2.3.Auto Declined", "Declined"),
    (5, "2.1.Declined", None, "Declined"),
    (6, None, None, None),
]
FUNNEL_SCHEMA = "application_id long, application_status string, assessment_status string, status string"


def test_funnel_counts_distinct_applications(spark):
    df = spark.createDataFrame(FUNNEL, FUNNEL_SCHEMA).withColumn("sample_group", F.when(F.col("application_id") < 5, "train").otherwise(""))
    got = {r["sample_group"]: r for r in funnel.by_group(df).collect()}
    everything = got["All"]
    assert [everything[f"actual_{s}_cnt"] for s in funnel.STEPS] == [6, 5, 3, 1, 2, 1]
    rates = ("completion_rate", "approval_rate", "auto_approval_rate", "manual_approval_rate", "auto_approval_share", "manual_approval_share", "deal_rate")
    assert [everything[f"actual_{r}"] for r in rates] == pytest.approx([5 / 6, 3 / 5, 1 / 5, 2 / 5, 1 / 3, 2 / 3, 1 / 3])
    assert got["Train"]["actual_apply_cnt"] == 4 and got["OOT"]["actual_apply_cnt"] == 0
    assert got["OOT"]["actual_deal_rate"] is None


def test_funnel_by_band(spark):
    rows = [(1, *FUNNEL[0][1:], 1, "A"), (2, *FUNNEL[4][1:], 1, "A"), (3, *FUNNEL[2][1:], 2, "B"), (4, None, None, None, 2, "B"), (5, *FUNNEL[0][1:], None, None)]
    got = {r["band"]: r for r in funnel.by_band(spark.createDataFrame(rows, FUNNEL_SCHEMA + ", band_order int, band string")).collect()}
    assert set(got) == {"A", "B"}
    assert (got["A"]["actual_completion_rate"], got["A"]["actual_approval_rate"], got["A"]["actual_auto_approval_rate"]) == (1.0, 0.5, 0.5)
    assert (got["B"]["actual_completion_rate"], got["B"]["actual_manual_approval_rate"]) == (0.5, 1.0)


def plan_row(spark, auto, accept):
    return spark.createDataFrame([("s", "OK", auto, accept, "A", "B")], "strategy_name string, status string, auto_pass_threshold double, reject_threshold double, auto_pass_band string, manual_review_upper_band string")


def test_flow_includes_the_thresholds(spark):
    rows = [(1, 0.1, "train"), (2, 0.2, "train"), (3, 0.3, "train"), (4, 0.31, "train"), (5, 0.2, "oot"), (6, 0.9, "oot"), (7, None, "oot")]
    df = spark.createDataFrame(rows, "application_id long, score_mlt double, sample_group string")
    got = {r["sample_group"]: r for r in policy.flow(df, plan_row(spark, 0.2, 0.3)).collect()}
    t = got["Train"]
    assert [t[f"estimated_{x}_rate"] for x in ("auto_pass", "manual_review", "total_accept", "reject")] == [0.5, 0.25, 0.75, 0.25]
    assert (got["OOT"]["estimated_auto_pass_rate"], got["OOT"]["estimated_reject_rate"]) == (0.5, 0.5)
    assert got["All"]["estimated_total_application_cnt"] == 6
    none = plan_row(spark, 0.2, 0.3).withColumn("status", F.lit(policy.NO_PLAN))
    assert policy.flow(df, none).count() == 0


def test_missing_status_is_not_incomplete(spark):
    rows = [(1, "0.Incomplete"), (2, "4.Funded"), (3, "1.In Progress"), (4, None)]
    df = samples.drop_incomplete(spark.createDataFrame(rows, "application_id long, application_status string"))
    assert sorted(r[0] for r in df.collect()) == [2, 4]


# Bins --------------------------------------------------------------------------------------------


def test_ties_collapse_edges(spark):
    df = spark.createDataFrame([(float(k % 4),) for k in range(400)] + [(None,), (float("nan"),)], "score_mlt double")
    assert quantiles.exact_quantiles(df, "score_mlt", [0, 0.5, 1]) == [0.0, 1.5, 3.0]
    edges = quantiles.equal_frequency_edges(df)
    assert edges[0] == -math.inf and edges[-1] == math.inf and len(edges) < 10
    with pytest.raises(ValueError):
        quantiles.require_bins(edges[:6], 6)
    with pytest.raises(ValueError):
        quantiles.equal_frequency_edges(df.filter("score_mlt = 1"))


def test_intervals_are_open_left_and_closed_right(spark):
    edges = (-math.inf, 1.0, 2.0, math.inf)
    rows = [(1.0,), (1.0000001,), (2.0,), (3.0,), (math.inf,), (-math.inf,), (None,)]
    got = bands.with_bins(spark.createDataFrame(rows, "score_mlt double"), edges).collect()
    assert [r["bin_order"] for r in got] == [1, 2, 2, 3, 3, 1, None]
    assert [r["bin"] for r in got][-1] is None


def test_sums_hold_across_levels(run):
    train = run.train.count()
    bins = run.train_sums.collect()
    assert sum(r["n"] for r in bins) == train
    stats = run.train_bands.orderBy("band_order").collect()
    last = stats[-1]
    assert last["cum_n"] == train and last["cum_pass_rate"] == 1
    for m in bands.NAMES:
        assert last[f"cum_{m}_cnt_bad"] == sum(r[f"{m}_cnt_bad"] for r in stats)
    raw = bands.band_stats(run.banded.filter("sample_group = 'train'")).orderBy("band_order").collect()
    for a, b in zip(stats, raw):
        for c in ("n", "principal_amt", "m1_cnt_bad", "m3_amt_bad", "m3_cnt_bad_rate_ci_low", "cum_m3_amt_bad_rate"):
            assert a[c] == pytest.approx(b[c])


def test_wilson_holds_the_rate_and_is_null_without_cases(spark):
    df = spark.createDataFrame([(b, n) for n in (0, 1, 5, 100) for b in range(0, n + 1, max(1, n // 4))], "b long, n long")
    low, high = wilson("b", "n")
    for b, n, lo, hi in df.select("b", "n", low, high).collect():
        if n == 0:
            assert lo is None and hi is None
        else:
            assert 0 <= lo <= b / n + 1e-12 and b / n - 1e-12 <= hi <= 1


def test_diagnostics_add_up(run):
    rows = bands.diagnostics(run.train_bands, "band_order").collect()
    for m in bands.NAMES:
        assert sum(r[f"{m}_iv_component"] for r in rows) == pytest.approx(rows[0][f"{m}_iv"])
        assert all(0 <= r[f"{m}_ks_curve"] <= 1 for r in rows)


def test_empty_bins_are_kept(spark):
    columns = "application_id long, score_mlt double, duedate_1m_30 int, duedate_3m_30 int, principal double, estimate_principal_remaining_mob1 double, estimate_principal_remaining_mob3 double, dpd_days_ever_mob1 double, dpd_days_ever_mob3 double"
    df = spark.createDataFrame([(1, 0.5, None, None, None, None, None, None, None)], columns)
    edges = (-math.inf, 1.0, 2.0, math.inf)
    got = bands.dense_bin_stats(bands.with_bins(df, edges), edges).orderBy("bin_order").collect()
    assert [r["n"] for r in got] == [1, 0, 0]
    assert got[0]["m1_cnt_bad_rate"] is None and got[0]["m1_cnt_bad_rate_ci_low"] is None and got[1]["m3_amt_bad"] == 0


# Validation --------------------------------------------------------------------------------------


def test_auc_of_a_score_and_of_its_opposite_add_to_one(run):
    keys = ("sample_group", "label")
    a = {tuple(r[k] for k in keys): r for r in validation.auc_ks(run.scored).collect()}
    b = {tuple(r[k] for k in keys): r for r in validation.auc_ks(run.scored, high_is_bad=False).collect()}
    assert len(a) == 4
    for k in a:
        assert a[k]["auc"] + b[k]["auc"] == pytest.approx(1)
        assert a[k]["ks"] == pytest.approx(b[k]["ks"])


def test_auc_with_ties_and_one_class(spark):
    rows = [("train", 1.0, 1, 0), ("train", 1.0, 0, 0), ("train", 2.0, 1, 0), ("train", 0.5, 0, 0), ("train", 0.4, None, 0)]
    got = {r["label"]: r for r in validation.auc_ks(spark.createDataFrame(rows, "sample_group string, score_mlt double, duedate_1m_30 int, duedate_3m_30 int")).collect()}
    one = got["duedate_1m_30"]
    assert (one["n"], one["auc"], one["ks"]) == (4, 0.875, 0.5)
    assert got["duedate_3m_30"]["auc"] is None and got["duedate_3m_30"]["n"] == 5


def test_stability_of_a_sample_with_itself_is_zero(run):
    same = run.banded.filter("sample_group = 'train'")
    both = same.unionByName(same.withColumn("sample_group", F.lit("oot")))
    assert validation.psi(both, run.band_edges).first()["psi_total"] == pytest.approx(0)


def test_segments_cover_the_scored(run):
    rows = policy.segments(run.scored, plan_row(run.applications.sparkSession, 0.3, 0.6)).collect()
    assert len(rows) == 6
    for g in ("train", "oot"):
        assert sum(r["estimated_segment_rate"] for r in rows if r["sample_group"] == g) == pytest.approx(1)


# Policy ------------------------------------------------------------------------------------------

CURVE = "threshold_order int, threshold double, band string, cum_pass_rate double, cum_m1_cnt_bad_rate double, cum_m3_cnt_bad_rate double, cum_m1_amt_bad_rate double, cum_m3_amt_bad_rate double, marginal_m3_cnt_bad_rate double, marginal_m3_cnt_bad_rate_ci_high double"


def curve(spark, rows):
    return spark.createDataFrame([(k, k / 10, "ABCDEFG"[k - 1], k / len(rows), m1, m3, m1, m3, marginal, marginal) for k, (m1, m3, marginal) in enumerate(rows, 1)], CURVE)


def test_choice_may_jump_over_a_gap_and_needs_known_figures(spark):
    c = curve(spark, [(0.001, 0.01, 0.01), (0.001, 0.01, 0.5), (0.001, 0.01, 0.01), (None, 0.01, 0.01)])
    assert policy.pick(c, SETTINGS.policy.auto).first()["threshold_order"] == 3
    got = policy.plan(c, SETTINGS.policy).first()
    assert got["status"] == "OK" and got["auto_order"] == 3 and got["accept_order"] == 3


def test_no_feasible_threshold(spark):
    c = curve(spark, [(0.5, 0.5, 0.5), (0.5, 0.5, 0.5)])
    plan = policy.plan(c, SETTINGS.policy)
    assert plan.first()["status"] == policy.NO_PLAN and plan.first()["auto_pass_threshold"] is None
    assert policy.sensitivity(c, plan).count() == 0
    assert {r["selected_role"] for r in policy.selection(c, plan, SETTINGS.policy).collect()} == {""}


def test_accepting_is_never_stricter_than_passing(spark):
    from scoreloom.settings import Limits, Policy

    odd = Policy(auto=Limits((("cum_m3_cnt_bad_rate", 0.5),)), accept=Limits((("cum_m3_cnt_bad_rate", 0.02),)))
    c = curve(spark, [(0.01, 0.01, 0.01), (0.01, 0.1, 0.1), (0.01, 0.9, 0.9)])
    plan = policy.plan(c, odd)
    assert (plan.first()["auto_order"], plan.first()["accept_order"]) == (2, 2)
    rows = {(r["threshold_type"], r["scenario"]): r for r in policy.sensitivity(c, plan).collect()}
    assert rows["auto_pass", "looser"]["note"].startswith("past") and rows["auto_pass", "looser"]["estimated_manual_review_rate"] == 0
    assert rows["total_accept", "tighter"]["note"].startswith("tighter")
    assert {r["selected_role"] for r in policy.selection(c, plan, odd).collect()} == {"", "auto_pass+reject"}


def test_sensitivity_ends_at_the_curve(spark):
    c = curve(spark, [(0.001, 0.01, 0.01)])
    rows = {(r["threshold_type"], r["scenario"]): r for r in policy.sensitivity(c, policy.plan(c, SETTINGS.policy)).collect()}
    assert rows["auto_pass", "tighter"]["threshold"] is None and rows["auto_pass", "looser"]["note"] == "already the loosest step"
    assert rows["auto_pass", "current"]["estimated_auto_pass_rate_delta"] == 0


def test_live_scores_that_are_no_numbers_are_rejected(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.3,), (0.4,), (None,), (float("nan"),), (-math.inf,)], "score_mlt double")
    assert [r["decision"] for r in policy.decide(df, 0.2, 0.3).collect()] == ["auto_pass", "auto_pass", "manual_review", "reject", "reject", "reject", "reject"]


# Sources -----------------------------------------------------------------------------------------


def test_csv_headers_and_required_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿application_id,user_id\n1,2\n".encode())
    assert loans.read_csv(spark, f"{tmp_path}/a.csv").columns == ["application_id", "user_id"]
    assert loans.clean_names(spark.createDataFrame([(1,)], ["ï»¿x"])).columns == ["x"]
    with pytest.raises(ValueError, match="user_id"):
        loans.require(spark.createDataFrame([(1,)], ["application_id"]), ("application_id", "user_id"), "sample")


def test_numbers_from_text(spark):
    rows = [("1.5",), (" 2 ",), ("1.5d",), ("x",), ("NaN",), (None,), ("-3e2",), ("Infinity",)]
    assert [r[0] for r in spark.createDataFrame(rows, "c string").select(clean_double("c")).collect()] == [1.5, 2.0, None, None, None, None, -300.0, math.inf]


def test_months(spark):
    rows = [("2024-05-01", None), ("202510", None), ("", "2024-01-02 03:04:05"), (None, "2024-01-02"), (None, "never")]
    df = spark.createDataFrame(rows, "application_month string, application_time string")
    got = [r[0] for r in df.select(loans.month_of()).collect()]
    assert got == ["2024-05", "202510", "", "2024-01", None]
    groups = [r[0] for r in samples.split(df.withColumn("application_month", loans.month_of()), Periods("2024-03", "2024-04")).select("sample_group").collect()]
    assert groups == ["oot", "", "", "train", ""]


def test_wide_table_takes_repeated_rows_once(spark):
    sample = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (3, 30)], "application_id long, user_id long")
    facts = "application_id long, user_id long, application_time string, application_status string, assessment_status string, status string, duedate_1m_30 string, duedate_3m_30 string, principal string, estimate_principal_remaining_mob1 string, estimate_principal_remaining_mob3 string, dpd_days_ever_mob1 string, dpd_days_ever_mob3 string"
    row = lambda i, u, t, p, s="4.Funded": (i, u, t, s, None, None, "0", "1", p, "5", "x", "0", "40")
    app = spark.createDataFrame([row(1, 10, "2024-01-01", "old"), row(1, 10, "2024-02-01", "100"), row(2, 20, "2024-01-01", "7", "0.Incomplete"), row(3, 30, "bad", "9")], facts)
    score = spark.createDataFrame([(1, "0.5"), (1, "0.4"), (3, "none")], "application_id long, raw string")
    got = loans.wide(sample, app, score, "raw")
    one = got.scored.collect()
    assert len(one) == 1 and one[0]["principal"] == 100 and one[0]["score_mlt"] == 0.4 and one[0]["application_month"] == "2024-02"
    assert one[0]["estimate_principal_remaining_mob3"] is None
    assert got.completed.count() == 3
    assert tuple(got.dropped().first()) == (4, 1, 2)


def test_both_samples_are_required(spark):
    df = spark.createDataFrame([("train",), ("",)], "sample_group string")
    with pytest.raises(ValueError, match="oot"):
        samples.require_both(df)


# Plans -------------------------------------------------------------------------------------------


def test_report_is_written_and_read(run, spark, tmp_path):
    free = Run(run.applications, SETTINGS)
    tables = report.sections(free)
    assert [len(t) for t in tables.values()] == [1, 3, 1, 6, 7, 3]
    small = {"01_overview": tables["01_overview"], "04_policy": {"plan": tables["04_policy"]["plan"]}}
    for kind in ("parquet", "csv"):
        paths = report.write(small, f"{tmp_path}/{kind}", kind)
        assert len(paths) == 2
    values = {(r["section"], r["metric"]): r for r in spark.read.parquet(f"{tmp_path}/parquet/01_overview/overview").collect()}
    assert values["bins", "initial"]["value_num"] == 20 and values["policy", "status"]["value"] in ("OK", policy.NO_PLAN)
    assert report.write_workbook(small, f"{tmp_path}/book.xlsx") in (True, False)
    config = {r["metric"]: r for r in report.config_table(free).collect()}
    assert config["periods.train_end"]["value"] == PERIODS.train_end and config["search.bins"]["value_num"] == 20


def test_many_models_are_searched_side_by_side(run):
    one = run.train_sums.drop("score_left", "score_right")
    both = one.withColumn("model", F.lit("a")).unionByName(one.withColumn("model", F.lit("b")))
    got = search_many(both, "model", SETTINGS).collect()
    assert sorted(r["model"] for r in got) == ["a", "b"] and got[0]["ranges"] == got[1]["ranges"]


def test_stream_of_scores_is_watched(spark, tmp_path):
    edges, ranges, frozen = (-math.inf, 0.3, 0.6, math.inf), ((1, 1), (2, 2), (3, 3)), (0.5, 0.3, 0.2)
    rows = [(f"2024-01-0{d} 10:00:00", s) for d in (1, 2) for s in ([0.1] * 5 + [0.5] * 3 + [0.9] * 2 if d == 1 else [0.9] * 10)]
    later = [("2024-01-01 11:00:00", 0.9)] * 4
    make = lambda r: spark.createDataFrame(r, "ts string, score_mlt double").withColumn("ts", F.to_timestamp("ts")).coalesce(1)
    psi_of = lambda df: {str(r["window"]["start"])[:10]: round(r["psi"], 9) for r in df}
    first, whole = (psi_of(monitor.drift(monitor.windowed(make(r), edges, ranges), frozen).collect()) for r in (rows, rows + later))
    assert first["2024-01-01"] == 0 and first["2024-01-02"] > 1 and whole["2024-01-01"] > 0
    long = monitor.by_band(monitor.windowed(make(rows), edges, ranges)).filter("n > 0").collect()
    assert sorted((r["band"], r["n"]) for r in long) == [("A", 5), ("B", 3), ("C", 2), ("C", 10)]
    make(rows).write.parquet(f"{tmp_path}/in")
    seen = []
    q = monitor.watch(spark.readStream.schema(make(rows).schema).parquet(f"{tmp_path}/in"), edges, ranges, frozen, lambda df, k: seen.append(psi_of(df.collect())), f"{tmp_path}/check")
    q.processAllAvailable()
    # An update of one band must still see the window's other bands.
    make(later).write.mode("append").parquet(f"{tmp_path}/in")
    q.processAllAvailable()
    q.stop()
    got = [x for x in seen if x]
    assert got[0] == first and got[1] == {"2024-01-01": whole["2024-01-01"]}


def test_fixed_ranges_cover_all_bins():
    assert [x for a, b in RANGES for x in range(a, b + 1)] == list(range(1, 21))
