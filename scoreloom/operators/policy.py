"""Thresholds: the curve over bands, the choice under limits, and what it would do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions.columns import additive, distinct_flags, ratio
from scoreloom.functions.ordering import RISING, Ordering
from scoreloom.operators.bands import NAMES, rates
from scoreloom.settings import Limits, Policy


COUNTED = ("n", "principal_amt", *(f"{m}_{c}" for m in NAMES for c in ("cnt_mature", "cnt_bad", "amt_exposure", "amt_bad")))


def portfolio(df: DataFrame, *by: str) -> DataFrame:
    """Totals and rates of a portfolio, whole or by groups."""
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *additive()[1:])
    return _with_rates(out, "")


def _with_rates(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumns(
        {f"{prefix}{m}_{c}_bad_rate": ratio(f"{prefix}{m}_{c}_bad", f"{prefix}{m}_{b}") for m in NAMES for c, b in (("cnt", "cnt_mature"), ("amt", "amt_exposure"))}
    )


def curve(bands: DataFrame, ordering: Ordering = RISING) -> DataFrame:
    """What passes at each band's risky edge: all on the safe side of it, and the band alone.

    bands has a row for each band of the training sample, as made by regroup_sums(); the last threshold is
    the riskiest training score. A threshold is a band's edge, so running sums over bands are exact.
    """
    order = ordering.window("band_order")
    up_to, whole = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    t = bands.withColumn("threshold", ordering.threshold(whole)).filter("threshold is not null")
    out = t.select(
        F.row_number().over(order).alias("threshold_order"),
        "threshold",
        F.lag("threshold").over(order).alias("prev_threshold"),
        "band_order",
        "band",
        "merged_from",
        *[F.sum(c).over(up_to).alias(f"cum_{c}") for c in COUNTED],
        *[F.col(c).alias(f"marginal_{c}") for c in COUNTED],
        F.sum("n").over(whole).alias("total_n"),
        F.sum("principal_amt").over(whole).alias("total_principal"),
    )
    return out.withColumns(
        {
            **rates("cum_"),
            **rates("marginal_"),
            "cum_pass_rate": ratio("cum_n", "total_n"),
            "cum_principal_pct": ratio("cum_principal_amt", "total_principal"),
            "marginal_sample_pct": ratio("marginal_n", "total_n"),
            "marginal_principal_pct": ratio("marginal_principal_amt", "total_principal"),
        }
    ).drop("total_n", "total_principal")


def within(limits: Limits) -> Column:
    """Every limited metric is known and at most its limit."""
    out = F.lit(True)
    for metric, most in limits.limits:
        out = out & F.coalesce(F.col(metric) <= most, F.lit(False))
    return out


def pick(curve_: DataFrame, limits: Limits) -> DataFrame:
    """The row of highest pass rate within limits, the later one of equals; none if no row is."""
    return curve_.filter(within(limits)).orderBy(F.desc("cum_pass_rate"), F.desc("threshold_order")).limit(1)


PLAN = ("threshold_order", "threshold", "band", "cum_pass_rate", "cum_m1_cnt_bad_rate", "cum_m3_cnt_bad_rate", "cum_m1_amt_bad_rate", "cum_m3_amt_bad_rate", "marginal_m3_cnt_bad_rate")
NO_PLAN = "no feasible threshold"


def plan(curve_: DataFrame, policy: Policy) -> DataFrame:
    """One row: thresholds and expected shares, or a status that there are none.

    Accepting never stops before automatic passing does.
    """
    row = F.struct("cum_pass_rate", F.col("threshold_order").alias("at"), *[F.col(c).alias(f"p_{c}") for c in PLAN])
    best = curve_.agg(*[F.max(F.when(within(limits), row)).alias(g) for g, limits in policy.groups])
    auto = F.col("auto")
    accept = F.when(F.col("accept.at") < F.col("auto.at"), auto).otherwise(F.col("accept"))
    best = best.select("auto", accept.alias("accept"))
    ok = auto.isNotNull() & F.col("accept").isNotNull()
    given = lambda c: F.when(ok, c)
    a, b = (lambda c: F.col(f"auto.p_{c}")), (lambda c: F.col(f"accept.p_{c}"))
    return best.select(
        F.lit(policy.name).alias("strategy_name"),
        F.lit(policy.objective).alias("objective"),
        F.when(ok, "OK").otherwise(NO_PLAN).alias("status"),
        given(a("threshold_order")).alias("auto_order"),
        given(b("threshold_order")).alias("accept_order"),
        given(a("threshold")).alias("auto_pass_threshold"),
        given(a("band")).alias("auto_pass_band"),
        given(b("threshold")).alias("reject_threshold"),
        given(b("band")).alias("manual_review_upper_band"),
        given(a("cum_pass_rate")).alias("estimated_auto_pass_rate"),
        given(b("cum_pass_rate")).alias("estimated_total_accept_rate"),
        given(b("cum_pass_rate") - a("cum_pass_rate")).alias("estimated_manual_review_rate"),
        given(1 - b("cum_pass_rate")).alias("estimated_reject_rate"),
        *[given(b(f"cum_{r}")).alias(f"accepted_{r}") for r in ("m1_cnt_bad_rate", "m3_cnt_bad_rate", "m1_amt_bad_rate", "m3_amt_bad_rate")],
        given(b("marginal_m3_cnt_bad_rate")).alias("last_accepted_marginal_m3_cnt_bad_rate"),
    )


def selection(curve_: DataFrame, plan_: DataFrame, policy: Policy) -> DataFrame:
    """The curve with each limit, whether it is met, and the role of chosen rows."""
    out = curve_
    for g, limits in policy.groups:
        out = out.withColumns({f"{g}_limit_{m}": F.lit(float(most)) for m, most in limits.limits})
        out = out.withColumns({f"{g}_check_{m}": F.coalesce(F.col(m) <= most, F.lit(False)) for m, most in limits.limits})
        out = out.withColumn(f"{g}_all_ok", within(limits))
    roles = plan_.select(F.explode(F.array(F.struct(F.col("auto_order").alias("k"), F.lit("auto_pass").alias("r")), F.struct(F.col("accept_order").alias("k"), F.lit("reject").alias("r")))).alias("x"))
    roles = roles.filter("x.k is not null").groupBy(F.col("x.k").alias("k")).agg(F.concat_ws("+", F.array_sort(F.collect_set("x.r"))).alias("selected_role"))
    out = out.join(F.broadcast(roles), F.col("threshold_order") == F.col("k"), "left").drop("k")
    role = F.col("selected_role")
    reason = (
        F.when(role == "auto_pass", "highest pass rate within the automatic limits")
        .when(role == "reject", "highest pass rate within the acceptance limits")
        .when(role.isNotNull(), "both choices are this threshold")
        .otherwise("")
    )
    return out.withColumns({"selection_reason": reason, "selected_role": F.coalesce(role, F.lit(""))})


MOVES = (("current", 0), ("tighter", -1), ("looser", 1))


def sensitivity(curve_: DataFrame, plan_: DataFrame) -> DataFrame:
    """Both thresholds as chosen, one step tighter and one looser; nothing without a plan.

    A step beyond the curve has no figures; a step past the other threshold moves to it.
    """
    n = curve_.agg(F.max("threshold_order").alias("steps"))
    base = plan_.filter("status = 'OK'").select("auto_order", "accept_order", F.lit(1).alias("one")).join(n.withColumn("one", F.lit(1)), "one")
    cases = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold_type"), F.lit(s).alias("scenario"), F.lit(d).alias("d")) for t in ("auto_pass", "total_accept") for s, d in MOVES]))
    rows = base.select("auto_order", "accept_order", "steps", cases.alias("c")).select("*", "c.threshold_type", "c.scenario", "c.d")
    is_auto = F.col("threshold_type") == "auto_pass"
    at = F.when(is_auto, F.col("auto_order")).otherwise(F.col("accept_order")) + F.col("d")
    there = at.between(1, F.col("steps"))
    crossed = there & F.when(is_auto, F.col("accept_order") < at).otherwise(at < F.col("auto_order"))
    note = (
        F.when(~there & (F.col("d") < 0), "already the tightest step")
        .when(~there, "already the loosest step")
        .when(crossed & is_auto, "past the acceptance threshold, moved to it")
        .when(crossed, "tighter than the automatic threshold, moved to it")
        .otherwise("")
    )
    rows = rows.select(
        "threshold_type",
        "scenario",
        F.when(there & is_auto, F.least(at, F.col("accept_order"))).when(there, F.col("auto_order")).alias("x"),
        F.when(there & is_auto, F.col("accept_order")).when(there, F.greatest(at, F.col("auto_order"))).alias("y"),
        note.alias("note"),
    )
    side = lambda p, *cols: curve_.select(F.col("threshold_order").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in cols])
    both = rows.join(F.broadcast(side("x", "threshold", "band", "cum_pass_rate", "cum_m1_cnt_bad_rate", "cum_m3_cnt_bad_rate")), "x", "left")
    both = both.join(F.broadcast(side("y", "threshold", "band", "cum_pass_rate", "cum_m3_cnt_bad_rate", "marginal_m3_cnt_bad_rate", "marginal_m3_cnt_bad_rate_ci_high")), "y", "left")
    auto = F.col("threshold_type") == "auto_pass"
    known = F.col("x").isNotNull()
    out = both.select(
        "threshold_type",
        "scenario",
        F.when(auto, F.col("x_threshold")).otherwise(F.col("y_threshold")).alias("threshold"),
        F.coalesce(F.when(auto, F.col("x_band")).otherwise(F.col("y_band")), F.lit("")).alias("band"),
        F.col("x_cum_pass_rate").alias("estimated_auto_pass_rate"),
        F.when(known, F.greatest(F.lit(0.0), F.col("y_cum_pass_rate") - F.col("x_cum_pass_rate"))).alias("estimated_manual_review_rate"),
        F.col("y_cum_pass_rate").alias("estimated_total_accept_rate"),
        (1.0 - F.col("y_cum_pass_rate")).alias("estimated_reject_rate"),
        F.col("x_cum_m1_cnt_bad_rate").alias("auto_m1_cnt_bad_rate"),
        F.col("x_cum_m3_cnt_bad_rate").alias("auto_m3_cnt_bad_rate"),
        F.col("y_cum_m3_cnt_bad_rate").alias("accept_m3_cnt_bad_rate"),
        F.col("y_marginal_m3_cnt_bad_rate").alias("accept_marginal_m3_cnt_bad_rate"),
        F.col("y_marginal_m3_cnt_bad_rate_ci_high").alias("accept_marginal_m3_cnt_bad_rate_ci_high"),
        "note",
    )
    w = Window.partitionBy("threshold_type")
    kinds = ("auto_pass", "manual_review", "total_accept", "reject")
    now = lambda c: F.max(F.when(F.col("scenario") == "current", F.col(c))).over(w)
    return out.withColumns({f"estimated_{r}_rate_delta": F.col(f"estimated_{r}_rate") - now(f"estimated_{r}_rate") for r in kinds})


SEGMENTS = ("auto_pass", "manual_review", "reject")


def segment_of(score: Column, auto: Column, accept: Column, ordering: Ordering = RISING) -> Column:
    """auto_pass on the safe side of and at the automatic threshold, manual_review so at the acceptance one, else reject."""
    return F.when(ordering.passes(score, auto), SEGMENTS[0]).when(ordering.passes(score, accept), SEGMENTS[1]).when(score.isNotNull(), SEGMENTS[2])


def _placed(df: DataFrame, plan_: DataFrame, score: str, ordering: Ordering) -> DataFrame:
    """Rows with the plan's thresholds and their segment; none without a plan. The plan is one row."""
    p = plan_.filter("status = 'OK'").select(F.lit(1).alias("__k"), "strategy_name", "auto_pass_threshold", "reject_threshold")
    out = df.withColumn("__k", F.lit(1)).join(F.broadcast(p), "__k").drop("__k")
    return out.withColumn("decision", segment_of(F.col(score), F.col("auto_pass_threshold"), F.col("reject_threshold"), ordering))


def segments(df: DataFrame, plan_: DataFrame, score: str = "score_mlt", ordering: Ordering = RISING) -> DataFrame:
    """Portfolio figures of the three segments in both samples; a segment without rows has zeros.

    The exclusive bound is the one on the safe side, the inclusive one that on the risky side.
    """
    rows = _placed(df.filter(F.col("sample_group").isin("train", "oot")), plan_, score, ordering)
    found = rows.groupBy("sample_group", "decision").agg(F.count(F.lit(1)).alias("n"), *additive()[1:])
    every = F.explode(F.array(*[F.struct(F.lit(g).alias("sample_group"), F.lit(s).alias("decision")) for g in ("train", "oot") for s in SEGMENTS]))
    frame = plan_.filter("status = 'OK'").select("strategy_name", "auto_pass_threshold", "reject_threshold", every.alias("e")).select("e.*", "strategy_name", "auto_pass_threshold", "reject_threshold")
    out = F.broadcast(frame).join(found, ["sample_group", "decision"], "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast(found.schema[c].dataType)) for c in COUNTED})
    # Shares are of all rows, so unscored ones count below the line.
    totals = df.groupBy("sample_group").agg(F.count(F.lit(1)).alias("total_n"), F.sum(F.coalesce("principal", F.lit(0.0))).alias("total_principal"))
    out = _with_rates(out, "").join(totals, "sample_group", "left")
    d = F.col("decision")
    return out.select(
        "sample_group",
        "strategy_name",
        "decision",
        F.when(d == SEGMENTS[1], F.col("auto_pass_threshold")).when(d == SEGMENTS[2], F.col("reject_threshold")).alias("lower_threshold_exclusive"),
        F.when(d == SEGMENTS[0], F.col("auto_pass_threshold")).when(d == SEGMENTS[1], F.col("reject_threshold")).alias("upper_threshold_inclusive"),
        ratio("n", "total_n").alias("estimated_segment_rate"),
        ratio("principal_amt", "total_principal").alias("estimated_segment_principal_rate"),
        *COUNTED,
        *[f"{m}_{c}_bad_rate" for m in NAMES for c in ("cnt", "amt")],
    )


def flow(df: DataFrame, plan_: DataFrame, score: str = "score_mlt", ordering: Ordering = RISING) -> DataFrame:
    """Distinct applications by decision in Train, OOT and both; accepted is automatic plus manual."""
    rows = _placed(df.filter(F.col("sample_group").isin("train", "oot") & F.col(score).isNotNull() & F.col("application_id").isNotNull()), plan_, score, ordering)
    keys = ["auto_pass_threshold", "reject_threshold"]
    test = {"Train": F.col("sample_group") == "train", "OOT": F.col("sample_group") == "oot", "All": F.lit(True)}
    flags = {f"{g}_{s}": c if s == "total" else c & (F.col("decision") == s) for g, c in test.items() for s in ("total", *SEGMENTS)}
    one = distinct_flags(rows, keys, "application_id", flags)
    tall = one.select(*keys, F.explode(F.array(*[F.struct(F.lit(g).alias("sample_group"), *[F.col(f"{g}_{s}").alias(s) for s in ("total", *SEGMENTS)]) for g in test])).alias("r")).select(*keys, "r.*")
    accepted = F.col("auto_pass") + F.col("manual_review")
    return tall.select(
        "sample_group",
        F.col("total").alias("estimated_total_application_cnt"),
        F.col("auto_pass").alias("estimated_auto_pass_cnt"),
        F.col("manual_review").alias("estimated_manual_review_cnt"),
        accepted.alias("estimated_total_accept_cnt"),
        F.col("reject").alias("estimated_reject_cnt"),
        ratio("auto_pass", "total").alias("estimated_auto_pass_rate"),
        ratio("manual_review", "total").alias("estimated_manual_review_rate"),
        ratio(accepted, F.col("total")).alias("estimated_total_accept_rate"),
        ratio("reject", "total").alias("estimated_reject_rate"),
        F.col("auto_pass_threshold"),
        F.col("reject_threshold").alias("total_accept_threshold"),
    )


def band_decision(bands: DataFrame, plan_: DataFrame, ordering: Ordering = RISING) -> DataFrame:
    """Bands with what the plan decides for them; undecided without a plan."""
    # A threshold is a band's risky edge, so that the orders of both are the same.
    p = plan_.select(F.lit(1).alias("__k"), "status", "auto_order", "accept_order")
    bands, at = bands.withColumn("__at", ordering.place("band_order")), F.col("__at")
    decision = F.when(F.col("status") != "OK", "undecided").when(at <= F.col("auto_order"), SEGMENTS[0]).when(at <= F.col("accept_order"), SEGMENTS[1]).otherwise(SEGMENTS[2])
    out = bands.withColumn("__k", F.lit(1)).join(F.broadcast(p), "__k").withColumn("estimated_decision", decision)
    return out.drop("__k", "__at", "status", "auto_order", "accept_order")


def decide(df: DataFrame, auto: float, accept: float, score: str = "score_mlt", ordering: Ordering = RISING) -> DataFrame:
    """Online rules as an expression: a missing, NaN or infinite score is rejected; then the segments."""
    s = F.col(score)
    usable = s.isNotNull() & ~F.isnan(s) & (F.abs(s) != float("inf"))
    return df.withColumn("decision", F.when(usable, segment_of(s, F.lit(auto), F.lit(accept), ordering)).otherwise(SEGMENTS[2]))

__all__ = [n for n in dir() if not n.startswith("_") and n not in ("HORIZONS", "band_letter")]
