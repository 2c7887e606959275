"""The ordered operators where low scores are the risky ones, over negated scores.

What they say must be what the plain SQL says of the scores themselves, seen from the other end: thresholds
negated, bands counted from the top.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions.ordering import Ordering
from scoreloom.operators import bands, policy, validation
from scoreloom.plans.pipeline import Run
from scoreloom.plans.queries import (
    BOTH,
    CURVE_DOUBLES,
    CURVE_PARTS,
    DECIDED,
    GROUP_SQL,
    MONTHLY_SQL,
    NAMES,
    PLAIN_RATES,
    PLAN_PARTS,
    RANGES,
    SEGMENT_SQL,
    SETTINGS,
    TRAIN_BINS,
    derived_sql,
    diagnosed_sql,
    query,
    sql,
)
from scoreloom.sources import loans

LOW_IS_BAD = Ordering(high_is_bad=False)
BANDS = len(RANGES)
TURNED = tuple((21 - b, 21 - a) for a, b in reversed(RANGES))


def turned(spark: SparkSession, sf_dir: str) -> Run:
    view = loans.loan_view(spark, sf_dir).withColumn("score_mlt", -F.col("score_mlt"))
    return Run(view, replace(SETTINGS, search=replace(SETTINGS.search, high_is_bad=False)), TURNED)


BAND = f"{BANDS} + 1 - band_order"
CURVE = f"SELECT * EXCLUDE (merged_from) REPLACE (-threshold AS threshold, -prev_threshold AS prev_threshold, CAST({BAND} AS INTEGER) AS band_order, chr(CAST(64 + {BAND} AS INTEGER)) AS band) FROM curve"


@query("low_is_bad_curve", sql(CURVE, *CURVE_PARTS), CURVE_DOUBLES)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turned(spark, sf_dir).curve.drop("merged_from")


@query("low_is_bad_ks_curve", sql(f"SELECT CAST(21 - bin_order AS INTEGER) AS bin_order, cum_n, cum_pass_rate, m1_ks_curve, m3_ks_curve FROM ({diagnosed_sql(derived_sql(TRAIN_BINS, 'bin_order'), 'bin_order')}) x"), ["cum_pass_rate", "m1_ks_curve", "m3_ks_curve"])
def _(spark, sf_dir):
    run = turned(spark, sf_dir)
    stats = bands.bin_stats(run.binned.filter("sample_group = 'train'"), run.ordering)
    return bands.diagnostics(stats, "bin_order", ordering=run.ordering).select("bin_order", "cum_n", "cum_pass_rate", "m1_ks_curve", "m3_ks_curve")


SEGMENT_DOUBLES = ["lower_threshold_exclusive", "upper_threshold_inclusive", "estimated_segment_rate", "estimated_segment_principal_rate", "principal_amt", *(f"{m}_{c}" for m in NAMES for c in ("amt_exposure", "amt_bad")), *PLAIN_RATES]


@query("low_is_bad_segments", sql(f"SELECT * REPLACE (-lower_threshold_exclusive AS lower_threshold_exclusive, -upper_threshold_inclusive AS upper_threshold_inclusive) FROM ({SEGMENT_SQL}) s", *PLAN_PARTS, DECIDED), SEGMENT_DOUBLES)
def _(spark, sf_dir):
    run = turned(spark, sf_dir)
    return policy.segments(run.scored, run.plan, ordering=run.ordering)


@query(
    "low_is_bad_decision",
    sql(
        "SELECT application_id, CASE WHEN score_mlt IS NULL THEN 'reject' WHEN score_mlt <= CAST(0.5 AS DOUBLE) THEN 'auto_pass' WHEN score_mlt <= CAST(0.8 AS DOUBLE) THEN 'manual_review' ELSE 'reject' END AS decision, "
        f"{GROUP_SQL} AS sample_group FROM loans"
    ),
)
def _(spark, sf_dir):
    rows = turned(spark, sf_dir).applications
    group = F.when(F.col("application_month") <= SETTINGS.periods.train_end, "train").when(F.col("application_month") >= SETTINGS.periods.oot_start, "oot").otherwise("")
    return policy.decide(rows, -0.5, -0.8, ordering=LOW_IS_BAD).select("application_id", "decision", group.alias("sample_group"))


@query("low_is_bad_bands", sql(f"SELECT CAST({BAND} AS INTEGER) AS band_order, sample_group, n, CASE WHEN p.status <> 'OK' THEN 'undecided' WHEN d.band <= p.auto_pass_band THEN 'auto_pass' WHEN d.band <= p.manual_review_upper_band THEN 'manual_review' ELSE 'reject' END AS estimated_decision FROM both_bands d, plan p WHERE sample_group = 'train'", *PLAN_PARTS, ("both_bands", BOTH)))
def _(spark, sf_dir):
    run = turned(spark, sf_dir)
    return policy.band_decision(run.sample_bands("train"), run.plan, run.ordering).select("band_order", "sample_group", "n", "estimated_decision")


@query("low_is_bad_months", sql(f"SELECT sample_group, application_month, CAST({BAND} AS INTEGER) AS band_order, cum_n, primary_rate_diff_prev, primary_inversion_flag FROM ({MONTHLY_SQL}) m"), ["primary_rate_diff_prev"])
def _(spark, sf_dir):
    return turned(spark, sf_dir).monthly.select("sample_group", "application_month", "band_order", "cum_n", "primary_rate_diff_prev", "primary_inversion_flag")


@query(
    "low_is_bad_monotonicity",
    sql(
        "SELECT sample_group, metric, CAST(count(*) FILTER (WHERE falls) AS BIGINT) AS violation_cnt, count(*) FILTER (WHERE falls) = 0 AS is_monotonic FROM ("
        + " UNION ALL ".join(f"SELECT sample_group, '{r}' AS metric, coalesce({r} - lag({r}) OVER (PARTITION BY sample_group ORDER BY band_order) < 0, false) AS falls FROM both_bands" for r in validation.RATES)
        + ") u GROUP BY sample_group, metric",
        ("both_bands", BOTH),
    ),
)
def _(spark, sf_dir):
    run = turned(spark, sf_dir)
    return validation.monotonicity(run.both_bands, ordering=run.ordering).drop("violation_bands")
