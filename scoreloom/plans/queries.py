"""The engine's queries over the loan view, and DuckDB SQL that says the same.

Bands are given as literal ranges wherever SQL is to check what follows from them. Doubles are rounded
to nine digits on both sides, as the two engines' logarithms and sums differ in their last bits.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions.columns import ADDITIVE, ratio, wilson
from scoreloom.operators import bands, funnel, policy, samples, validation
from scoreloom.operators.bands import NAMES
from scoreloom.plans import report
from scoreloom.plans.pipeline import Run
from scoreloom.settings import HORIZONS, INCOMPLETE, Floors, Limits, Periods, Policy, Search, Settings
from scoreloom.sources import loans
from scoreloom.streaming import monitor

RANGES = ((1, 1), (2, 4), (5, 8), (9, 12), (13, 16), (17, 19), (20, 20))
POLICY = Policy(
    auto=Limits((("cum_m1_cnt_bad_rate", 0.0090), ("cum_m3_cnt_bad_rate", 0.0550), ("marginal_m3_cnt_bad_rate", 0.0900))),
    accept=Limits((("cum_m1_cnt_bad_rate", 0.0130), ("cum_m3_cnt_bad_rate", 0.0750), ("marginal_m3_cnt_bad_rate", 0.1700))),
)
PERIODS = Periods("2000-06", "2000-07")
#: The default floors fit large samples; these fit a few hundred rows a bin.
SETTINGS = Settings(periods=PERIODS, policy=POLICY, search=Search(floors=Floors(mature=500, extreme_mature=250, good=100, best_good=100)))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(F.col(f"`{c}`"), 9) + 0.0).alias(c) if k == "double" else F.col(f"`{c}`") for c, k in df.dtypes])


def query(name: str, sql: str | None = None, doubles: Sequence[str] = ()):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            replaced = ", ".join(f"round({c}, {9}) + 0.0 AS {c}" for c in doubles)
            ORACLES[name] = f"SELECT *{f' REPLACE ({replaced})' if doubles else ''} FROM ({sql}) last"
        return f

    return add


def run_of(spark: SparkSession, sf_dir: str, fixed: bool = True) -> Run:
    return Run(loans.loan_view(spark, sf_dir), SETTINGS, RANGES if fixed else None)


# SQL parts ---------------------------------------------------------------------------------------

INCOMPLETE_SQL = ", ".join(f"'{s}'" for s in INCOMPLETE)
SHARES = [k / 20 for k in range(1, 20)]
BAND_SQL = "CASE " + " ".join(f"WHEN bin_order BETWEEN {a} AND {b} THEN {k}" for k, (a, b) in enumerate(RANGES, 1)) + " END"
GROUP_SQL = "CASE WHEN application_month <= '2000-06' THEN 'train' WHEN application_month >= '2000-07' THEN 'oot' ELSE '' END"

CHAIN = {
    "loans": loans.LOANS_SQL.replace("{orders}", "orders"),
    "kept": f"SELECT *, {GROUP_SQL} AS sample_group FROM loans WHERE application_status IS NULL OR application_status NOT IN ({INCOMPLETE_SQL})",
    "scored": "SELECT * FROM kept WHERE score_mlt IS NOT NULL",
    "cuts": f"SELECT quantile_cont(score_mlt, {SHARES}) AS q FROM scored WHERE sample_group = 'train'",
    "binned": "SELECT s.*, CAST(1 + len(list_filter(q, lambda x: score_mlt > x)) AS INTEGER) AS bin_order FROM scored s, cuts",
    "banded": f"SELECT *, CAST({BAND_SQL} AS INTEGER) AS band_order, chr(64 + {BAND_SQL}) AS band FROM binned",
    "edge": "SELECT CAST(k AS INTEGER) AS bin_order, printf('B%02d', k) AS bin, CASE WHEN k = 1 THEN CAST('-Infinity' AS DOUBLE) ELSE q[k - 1] END AS score_left, CASE WHEN k = 20 THEN CAST('Infinity' AS DOUBLE) ELSE q[k] END AS score_right FROM cuts, range(1, 21) r(k)",
}


def sql(body: str, *more: tuple[str, str]) -> str:
    """body with the common parts that it may need in front."""
    return "WITH " + ", ".join(f"{n} AS ({s})" for n, s in [*CHAIN.items(), *more]) + " " + body


def sums_sql(source: str, by: str) -> str:
    parts = [by, "CAST(count(application_id) AS BIGINT) AS n", "coalesce(sum(coalesce(principal, 0)), 0) AS principal_amt"]
    for h in HORIZONS:
        parts += [
            f"CAST(count(*) FILTER (WHERE {h.label} IN (0, 1)) AS BIGINT) AS {h.name}_cnt_mature",
            f"CAST(count(*) FILTER (WHERE {h.label} = 1) AS BIGINT) AS {h.name}_cnt_bad",
            f"coalesce(sum(CASE WHEN {h.dpd} IS NOT NULL THEN coalesce(principal, 0) END), 0) AS {h.name}_amt_exposure",
            f"coalesce(sum(CASE WHEN {h.dpd} >= 30 THEN coalesce({h.remaining}, 0) END), 0) AS {h.name}_amt_bad",
        ]
    parts += ["min(score_mlt) AS score_min", "max(score_mlt) AS score_max", "coalesce(sum(score_mlt), 0) AS score_sum", "count(score_mlt) AS score_n"]
    return f"SELECT {', '.join(p for p in parts if p)} FROM {source}" + (f" GROUP BY {by}" if by else "")


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def wilson_sql(bad: str, n: str) -> tuple[str, str]:
    z2 = "(CAST(1.96 AS DOUBLE) * CAST(1.96 AS DOUBLE))"
    p, m = div(bad, n), f"CAST({n} AS DOUBLE)"
    centre = f"(({p} + {z2} / (2 * {m})) / (1 + {z2} / {m}))"
    half = f"(CAST(1.96 AS DOUBLE) * sqrt({p} * (1 - {p}) / {m} + {z2} / (4 * {m} * {m})) / (1 + {z2} / {m}))"
    return f"CASE WHEN {n} > 0 THEN greatest(0.0, {centre} - {half}) END", f"CASE WHEN {n} > 0 THEN least(1.0, {centre} + {half}) END"


def rates_sql(prefix: str) -> list[str]:
    out = []
    for m in NAMES:
        low, high = wilson_sql(f"{prefix}{m}_cnt_bad", f"{prefix}{m}_cnt_mature")
        out += [
            f"{div(f'{prefix}{m}_cnt_bad', f'{prefix}{m}_cnt_mature')} AS {prefix}{m}_cnt_bad_rate",
            f"{low} AS {prefix}{m}_cnt_bad_rate_ci_low",
            f"{high} AS {prefix}{m}_cnt_bad_rate_ci_high",
            f"{div(f'{prefix}{m}_amt_bad', f'{prefix}{m}_amt_exposure')} AS {prefix}{m}_amt_bad_rate",
        ]
    return out


def derived_sql(source: str, order: str, by: str = "") -> str:
    whole = f"(PARTITION BY {by})" if by else "()"
    up_to = f"({f'PARTITION BY {by} ' if by else ''}ORDER BY {order} NULLS LAST ROWS UNBOUNDED PRECEDING)"
    running = ["n", *(f"{m}_{c}" for m in NAMES for c in ("cnt_mature", "cnt_bad", "amt_exposure", "amt_bad"))]
    kind = lambda c: "BIGINT" if c == "n" or "cnt" in c else "DOUBLE"
    first = ", ".join([f"CAST(sum({c}) OVER {up_to} AS {kind(c)}) AS cum_{c}" for c in running] + [f"CAST(sum(n) OVER {whole} AS BIGINT) AS total_n"])
    second = [f"{div('n', 'total_n')} AS sample_pct", f"{div('cum_n', 'total_n')} AS cum_pass_rate", f"{div('score_sum', 'score_n')} AS score_mean"]
    second += [f"{m}_cnt_mature - {m}_cnt_bad AS {m}_cnt_good" for m in NAMES] + rates_sql("") + rates_sql("cum_")
    return f"SELECT * EXCLUDE (score_sum, score_n), {', '.join(second)} FROM (SELECT *, {first} FROM ({source}) a) b"


RATE_COLUMNS = [f"{p}{m}_{c}" for p in ("", "cum_") for m in NAMES for c in ("cnt_bad_rate", "cnt_bad_rate_ci_low", "cnt_bad_rate_ci_high", "amt_bad_rate")]
AMOUNTS = ["principal_amt", *(f"{m}_{c}" for m in NAMES for c in ("amt_exposure", "amt_bad"))]
CUM_AMOUNTS = [f"cum_{m}_{c}" for m in NAMES for c in ("amt_exposure", "amt_bad")]
STATS = ["sample_pct", "cum_pass_rate", "score_mean", "score_min", "score_max", *RATE_COLUMNS, *AMOUNTS, *CUM_AMOUNTS]

TRAIN_BINS = sums_sql("binned WHERE sample_group = 'train'", "bin_order")
DENSE = "SELECT edge.*, s.* EXCLUDE (bin_order) FROM edge LEFT JOIN bin_sums s USING (bin_order)"
REGROUP = (
    f"SELECT CAST({BAND_SQL} AS INTEGER) AS band_order, chr(64 + {BAND_SQL}) AS band, min(bin_order) AS first_bin, max(bin_order) AS last_bin, "
    "arg_min(score_left, bin_order) AS score_left, arg_max(score_right, bin_order) AS score_right, "
    + ", ".join(f"CAST(sum({c}) AS {'BIGINT' if c == 'n' or 'cnt' in c else 'DOUBLE'}) AS {c}" for c in ADDITIVE)
    + ", min(score_min) AS score_min, max(score_max) AS score_max, sum(score_sum) AS score_sum, sum(score_n) AS score_n FROM dense GROUP BY 1, 2"
)
SOURCE_SQL = "CASE WHEN first_bin = last_bin THEN printf('B%02d', first_bin) ELSE printf('B%02d-B%02d', first_bin, last_bin) END"
ROLE_SQL = (
    "concat_ws(',', CASE WHEN first_bin = 1 AND last_bin = 1 THEN 'best_extreme' WHEN first_bin <= 1 AND last_bin >= 1 THEN 'contains_best_extreme' END, "
    "CASE WHEN first_bin = 20 AND last_bin = 20 THEN 'worst_extreme' WHEN first_bin <= 20 AND last_bin >= 20 THEN 'contains_worst_extreme' END)"
)
BAND_PARTS = [("bin_sums", TRAIN_BINS), ("dense", DENSE), ("band_sums", f"SELECT *, {SOURCE_SQL} AS merged_from FROM ({REGROUP}) g")]

CURVE_COUNTED = ["n", "principal_amt", *(f"{m}_{c}" for m in NAMES for c in ("cnt_mature", "cnt_bad", "amt_exposure", "amt_bad"))]


def curve_sql() -> str:
    kind = lambda c: "BIGINT" if c == "n" or "cnt" in c else "DOUBLE"
    cum = ", ".join(f"CAST(sum({c}) OVER (ORDER BY band_order ROWS UNBOUNDED PRECEDING) AS {kind(c)}) AS cum_{c}, {c} AS marginal_{c}" for c in CURVE_COUNTED)
    base = (
        "SELECT CAST(row_number() OVER (ORDER BY band_order) AS INTEGER) AS threshold_order, "
        "CASE WHEN isinf(score_right) THEN max(score_max) OVER () ELSE score_right END AS threshold, "
        f"band_order, band, merged_from, {cum}, sum(n) OVER () AS total_n, sum(principal_amt) OVER () AS total_principal FROM band_sums"
    )
    more = [
        "lag(threshold) OVER (ORDER BY band_order) AS prev_threshold",
        *rates_sql("cum_"),
        *rates_sql("marginal_"),
        f"{div('cum_n', 'total_n')} AS cum_pass_rate",
        f"{div('cum_principal_amt', 'total_principal')} AS cum_principal_pct",
        f"{div('marginal_n', 'total_n')} AS marginal_sample_pct",
        f"{div('marginal_principal_amt', 'total_principal')} AS marginal_principal_pct",
    ]
    return f"SELECT * EXCLUDE (total_n, total_principal), {', '.join(more)} FROM ({base}) c"


CURVE_PARTS = [*BAND_PARTS, ("curve", curve_sql())]
CURVE_DOUBLES = [
    "threshold",
    "prev_threshold",
    *(f"{p}{m}_{c}" for p in ("cum_", "marginal_") for m in NAMES for c in ("cnt_bad_rate", "cnt_bad_rate_ci_low", "cnt_bad_rate_ci_high", "amt_bad_rate", "amt_exposure", "amt_bad")),
    "cum_principal_amt",
    "marginal_principal_amt",
    "cum_pass_rate",
    "cum_principal_pct",
    "marginal_sample_pct",
    "marginal_principal_pct",
]


def within_sql(limits: Limits) -> str:
    return "(" + " AND ".join(f"coalesce({m} <= CAST({x} AS DOUBLE), false)" for m, x in limits.limits) + ")"


def pick_sql(limits: Limits) -> str:
    return f"SELECT * FROM curve WHERE {within_sql(limits)} ORDER BY cum_pass_rate DESC, threshold_order DESC LIMIT 1"


PLAN_SQL = f"""
SELECT '{POLICY.name}' AS strategy_name, '{POLICY.objective}' AS objective,
  CASE WHEN ok THEN 'OK' ELSE '{policy.NO_PLAN}' END AS status,
  a.threshold_order AS auto_order, b.threshold_order AS accept_order, a.threshold AS auto_pass_threshold, a.band AS auto_pass_band,
  b.threshold AS reject_threshold, b.band AS manual_review_upper_band, a.cum_pass_rate AS estimated_auto_pass_rate,
  b.cum_pass_rate AS estimated_total_accept_rate, b.cum_pass_rate - a.cum_pass_rate AS estimated_manual_review_rate,
  1 - b.cum_pass_rate AS estimated_reject_rate, b.cum_m1_cnt_bad_rate AS accepted_m1_cnt_bad_rate, b.cum_m3_cnt_bad_rate AS accepted_m3_cnt_bad_rate,
  b.cum_m1_amt_bad_rate AS accepted_m1_amt_bad_rate, b.cum_m3_amt_bad_rate AS accepted_m3_amt_bad_rate,
  b.marginal_m3_cnt_bad_rate AS last_accepted_marginal_m3_cnt_bad_rate
FROM (SELECT x, CASE WHEN y < x THEN x ELSE y END AS y, x IS NOT NULL AND y IS NOT NULL AS ok
      FROM (SELECT (SELECT threshold_order FROM picked_auto) AS x, (SELECT threshold_order FROM picked_accept) AS y) p) o
LEFT JOIN curve a ON ok AND a.threshold_order = o.x LEFT JOIN curve b ON ok AND b.threshold_order = o.y
"""
PLAN_PARTS = [*CURVE_PARTS, ("picked_auto", pick_sql(POLICY.auto)), ("picked_accept", pick_sql(POLICY.accept)), ("plan", PLAN_SQL)]
PLAN_DOUBLES = ["auto_pass_threshold", "reject_threshold", *(f"estimated_{r}_rate" for r in ("auto_pass", "total_accept", "manual_review", "reject")), *(f"accepted_{r}_bad_rate" for r in ("m1_cnt", "m3_cnt", "m1_amt", "m3_amt")), "last_accepted_marginal_m3_cnt_bad_rate"]

FLAG_SQL = {
    "apply": "true",
    "completed": f"(application_status IS NOT NULL AND application_status NOT IN ({INCOMPLETE_SQL}))",
    "approved": "substr(application_status, 1, 1) IN ('3', '4')",
    "auto": "(substr(application_status, 1, 1) IN ('3', '4') AND contains(assessment_status, 'Auto Approved'))",
    "manual": "(substr(application_status, 1, 1) IN ('3', '4') AND contains(assessment_status, 'Manual Approved'))",
    "deal": "status IN ('Active_Account', 'Closed', 'Blocked')",
}
FUNNEL_RATES = {"completion_rate": ("completed", "apply"), "approval_rate": ("approved", "completed"), "auto_approval_rate": ("auto", "completed"), "manual_approval_rate": ("manual", "completed"), "auto_approval_share": ("auto", "approved"), "manual_approval_share": ("manual", "approved"), "deal_rate": ("deal", "approved")}


def funnel_sql(source: str, keys: str, group: str) -> str:
    counts = ", ".join(f"count(DISTINCT application_id) FILTER (WHERE {c}) AS actual_{s}_cnt" for s, c in FLAG_SQL.items())
    rates = ", ".join(f"{div(f'actual_{a}_cnt', f'actual_{b}_cnt')} AS actual_{n}" for n, (a, b) in FUNNEL_RATES.items())
    return f"SELECT *, {rates} FROM (SELECT {keys}, {counts} FROM {source} {group}) f"


FUNNEL_DOUBLES = [f"actual_{n}" for n in FUNNEL_RATES]

# Sources and samples -----------------------------------------------------------------------------


@query("loan_view", sql("SELECT * FROM loans"), ["score_mlt"])
def _(spark, sf_dir):
    return loans.loan_view(spark, sf_dir)


@query("extract_since", sql("SELECT application_id, user_id, application_time, status FROM loans WHERE application_time >= TIMESTAMP '1999-01-01'"))
def _(spark, sf_dir):
    return loans.extract(loans.loan_view(spark, sf_dir), "1999-01-01", ("application_id", "user_id", "application_time", "status"))


@query("drop_incomplete", sql(f"SELECT application_id, application_status FROM loans WHERE application_status IS NULL OR application_status NOT IN ({INCOMPLETE_SQL})"))
def _(spark, sf_dir):
    return samples.drop_incomplete(loans.loan_view(spark, sf_dir)).select("application_id", "application_status")


@query(
    "month_backfill",
    sql("SELECT application_id, coalesce(substr(CASE WHEN application_id % 3 > 0 THEN application_month || '-xx' END, 1, 7), strftime(CASE WHEN application_id % 7 > 0 THEN application_time END, '%Y-%m')) AS month FROM loans"),
)
def _(spark, sf_dir):
    df = loans.loan_view(spark, sf_dir)
    holes = df.select(
        "application_id",
        F.when(F.col("application_id") % 3 > 0, F.concat("application_month", F.lit("-xx"))).alias("application_month"),
        F.when(F.col("application_id") % 7 > 0, F.col("application_time").cast("string")).otherwise("no time").alias("application_time"),
    )
    return holes.select("application_id", loans.month_of().alias("month"))


@query("sample_split", sql(f"SELECT sample_group, application_month, count(*) AS n FROM (SELECT {GROUP_SQL} AS sample_group, application_month FROM loans) g GROUP BY ALL"))
def _(spark, sf_dir):
    return samples.split(loans.loan_view(spark, sf_dir), PERIODS).groupBy("sample_group", "application_month").agg(F.count(F.lit(1)).alias("n"))


@query(
    "dedupe_first",
    sql("SELECT user_id, application_id, score_mlt FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY application_time DESC, application_id) AS k FROM loans) r WHERE k = 1"),
    ["score_mlt"],
)
def _(spark, sf_dir):
    return loans.keep_first(loans.loan_view(spark, sf_dir), ["user_id"], [F.desc("application_time"), "application_id"]).select("user_id", "application_id", "score_mlt")


@query(
    "wide_table",
    sql(
        "SELECT l.application_id, l.user_id, f.application_month, s.score_mlt, f.principal, f.status FROM loans l "
        "LEFT JOIN (SELECT * REPLACE (CASE WHEN application_id % 3 > 0 THEN user_id END AS user_id) FROM loans) f ON l.application_id = f.application_id AND l.user_id = f.user_id "
        f"LEFT JOIN (SELECT application_id, CASE WHEN application_id % 4 > 0 THEN score_mlt END AS score_mlt FROM loans) s ON l.application_id = s.application_id "
        f"WHERE s.score_mlt IS NOT NULL AND (f.application_status IS NULL OR f.application_status NOT IN ({INCOMPLETE_SQL}))"
    ),
    ["score_mlt"],
)
def _(spark, sf_dir):
    df = loans.loan_view(spark, sf_dir)
    # Some facts are without a user and some scores missing; repeated application and score rows are taken once.
    facts = df.withColumn("user_id", F.when(F.col("application_id") % 3 > 0, F.col("user_id"))).drop("score_mlt")
    score = df.select("application_id", F.when(F.col("application_id") % 4 > 0, F.col("score_mlt")).cast("string").alias("raw"))
    got = loans.wide(df.select("application_id", "user_id"), facts.unionAll(facts), score.unionAll(score), "raw")
    return got.scored.select("application_id", "user_id", "application_month", "score_mlt", "principal", "status")


@query(
    "null_safe_ratio",
    sql(f"SELECT o.user_id, {div('count(*) FILTER (WHERE duedate_3m_30 = 1)', 'count(*) FILTER (WHERE duedate_3m_30 IN (0, 1))')} AS bad_rate FROM loans o GROUP BY o.user_id"),
    ["bad_rate"],
)
def _(spark, sf_dir):
    d = F.col("duedate_3m_30")
    return loans.loan_view(spark, sf_dir).groupBy("user_id").agg(ratio(F.count_if(d == 1), F.count_if(d.isin(0, 1))).alias("bad_rate"))


# Bins --------------------------------------------------------------------------------------------


@query("equal_freq_edges", sql("SELECT * FROM edge"), ["score_left", "score_right"])
def _(spark, sf_dir):
    return run_of(spark, sf_dir).edge_table


@query("score_bucket", sql("SELECT application_id, sample_group, bin_order, printf('B%02d', bin_order) AS bin FROM binned"))
def _(spark, sf_dir):
    return run_of(spark, sf_dir).binned.select("application_id", "sample_group", "bin_order", "bin")


@query("initial_bin_stats", sql(f"SELECT *, printf('B%02d', bin_order) AS bin FROM ({derived_sql(TRAIN_BINS, 'bin_order')}) d"), STATS)
def initial_bin_stats(spark, sf_dir):
    return bands.bin_stats(run_of(spark, sf_dir).binned.filter("sample_group = 'train'"))


@query("initial_bin_stats_dense", sql(derived_sql("SELECT * FROM dense", "bin_order"), *BAND_PARTS), [*STATS, "score_left", "score_right"])
def _(spark, sf_dir):
    run = run_of(spark, sf_dir)
    return bands.dense_bin_stats(run.binned.filter("sample_group = 'train'"), run.edges)


@query(
    "cumulative_stats",
    sql(f"SELECT bin_order, n, total_n, {', '.join(c for c in ['cum_n', 'cum_pass_rate', *CUM_AMOUNTS, *(x for x in RATE_COLUMNS if x.startswith('cum_'))])} FROM ({derived_sql(TRAIN_BINS, 'bin_order')}) d"),
    ["cum_pass_rate", *CUM_AMOUNTS, *(x for x in RATE_COLUMNS if x.startswith("cum_"))],
)
def _(spark, sf_dir):
    return initial_bin_stats(spark, sf_dir).select("bin_order", "n", "total_n", "cum_n", "cum_pass_rate", *CUM_AMOUNTS, *[c for c in RATE_COLUMNS if c.startswith("cum_")])


@query(
    "wilson_bounds",
    sql(f"SELECT user_id, {wilson_sql('b', 'm')[0]} AS ci_low, {wilson_sql('b', 'm')[1]} AS ci_high FROM (SELECT user_id, count(*) FILTER (WHERE duedate_3m_30 = 1) AS b, count(*) FILTER (WHERE duedate_3m_30 IN (0, 1)) AS m FROM loans GROUP BY user_id) c"),
    ["ci_low", "ci_high"],
)
def _(spark, sf_dir):
    d = F.col("duedate_3m_30")
    counted = loans.loan_view(spark, sf_dir).groupBy("user_id").agg(F.count_if(d == 1).alias("b"), F.count_if(d.isin(0, 1)).alias("m"))
    low, high = wilson("b", "m")
    return counted.select("user_id", low.alias("ci_low"), high.alias("ci_high"))


def diagnosed_sql(source: str, order: str) -> str:
    parts = []
    for m in NAMES:
        for side in ("bad", "good"):
            parts.append(f"({m}_cnt_{side} + CAST(0.5 AS DOUBLE)) / (sum({m}_cnt_{side}) OVER () + CAST(0.5 AS DOUBLE) * count(*) OVER ()) AS {m}_{side}_distribution")
        down = f"OVER (ORDER BY {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
        tops = [div(f"sum({m}_cnt_{s}) {down}", f"sum({m}_cnt_{s}) OVER ()") for s in ("bad", "good")]
        parts.append(f"abs({tops[0]} - {tops[1]}) AS {m}_ks_curve")
        parts.append(f"sum({m}_cnt_bad) OVER () > 0 AND sum({m}_cnt_good) OVER () > 0 AS {m}_some")
    woe = ", ".join(f"ln({m}_bad_distribution / {m}_good_distribution) AS {m}_woe" for m in NAMES)
    part = ", ".join(f"({m}_bad_distribution - {m}_good_distribution) * {m}_woe AS {m}_iv_component" for m in NAMES)
    iv = ", ".join(f"CASE WHEN {m}_some THEN sum({m}_iv_component) OVER () END AS {m}_iv" for m in NAMES)
    return f"SELECT * EXCLUDE ({', '.join(f'{m}_some' for m in NAMES)}), {iv} FROM (SELECT *, {part} FROM (SELECT *, {woe} FROM (SELECT *, {', '.join(parts)} FROM ({source}) a) b) c) d"


DIAGNOSED = [f"{m}_{c}" for m in NAMES for c in ("bad_distribution", "good_distribution", "woe", "iv_component", "iv", "ks_curve")]


@query("woe_iv", sql(f"SELECT bin_order, {', '.join(c for c in DIAGNOSED if 'ks' not in c)} FROM ({diagnosed_sql(derived_sql(TRAIN_BINS, 'bin_order'), 'bin_order')}) x"), [c for c in DIAGNOSED if "ks" not in c])
def _(spark, sf_dir):
    return bands.diagnostics(initial_bin_stats(spark, sf_dir), "bin_order").select("bin_order", *[c for c in DIAGNOSED if "ks" not in c])


@query("ks_curve", sql(f"SELECT bin_order, m1_ks_curve, m3_ks_curve FROM ({diagnosed_sql(derived_sql(TRAIN_BINS, 'bin_order'), 'bin_order')}) x"), ["m1_ks_curve", "m3_ks_curve"])
def _(spark, sf_dir):
    return bands.diagnostics(initial_bin_stats(spark, sf_dir), "bin_order").select("bin_order", "m1_ks_curve", "m3_ks_curve")


PLAIN_RATES = [f"{m}_{c}_bad_rate" for m in NAMES for c in ("cnt", "amt")]
PLAIN_RATES_SQL = ", ".join(f"{div(f'{m}_{c}_bad', f'{m}_{b}')} AS {m}_{c}_bad_rate" for m in NAMES for c, b in (("cnt", "cnt_mature"), ("amt", "amt_exposure")))


@query("portfolio_totals", sql(f"SELECT * EXCLUDE (score_min, score_max, score_sum, score_n), {PLAIN_RATES_SQL} FROM ({sums_sql('scored', 'sample_group')}) t"), [*AMOUNTS, *PLAIN_RATES])
def _(spark, sf_dir):
    return policy.portfolio(run_of(spark, sf_dir).scored, "sample_group")


@query(
    "interval_stats",
    sql(
        "SELECT a.bin_order AS first_bin, b.bin_order AS last_bin, "
        + ", ".join(f"CAST(sum(c.{x}) AS BIGINT) AS {x}" for x in ("n", "m1_cnt_mature", "m1_cnt_bad", "m3_cnt_mature", "m3_cnt_bad"))
        + ", "
        + ", ".join(f"{div(f'sum(c.{m}_cnt_bad)', f'sum(c.{m}_cnt_mature)')} AS {m}_cnt_bad_rate" for m in NAMES)
        + " FROM bin_sums a JOIN bin_sums b ON a.bin_order <= b.bin_order JOIN bin_sums c ON c.bin_order BETWEEN a.bin_order AND b.bin_order GROUP BY ALL",
        *BAND_PARTS,
    ),
    ["m1_cnt_bad_rate", "m3_cnt_bad_rate"],
)
def _(spark, sf_dir):
    return bands.intervals(run_of(spark, sf_dir).train_sums)


# Bands -------------------------------------------------------------------------------------------


@query("band_map", sql(f"SELECT bin_order, bin, band_order, band, {SOURCE_SQL} AS merged_from FROM (SELECT *, min(bin_order) OVER (PARTITION BY band_order) AS first_bin, max(bin_order) OVER (PARTITION BY band_order) AS last_bin FROM (SELECT bin_order, bin, CAST({BAND_SQL} AS INTEGER) AS band_order, chr(64 + {BAND_SQL}) AS band FROM edge) a) b"))
def _(spark, sf_dir):
    return bands.band_map(spark, RANGES)


EDGES_SQL = f"SELECT *, {SOURCE_SQL} AS merged_from, {ROLE_SQL} AS extreme_role FROM (SELECT CAST({BAND_SQL} AS INTEGER) AS band_order, chr(64 + {BAND_SQL}) AS band, min(bin_order) AS first_bin, max(bin_order) AS last_bin, arg_min(score_left, bin_order) AS score_left, arg_max(score_right, bin_order) AS score_right FROM edge GROUP BY 1, 2) a"


@query("band_edges", sql(EDGES_SQL), ["score_left", "score_right"])
def _(spark, sf_dir):
    return run_of(spark, sf_dir).band_edges


@query("band_stats", sql(derived_sql("SELECT * FROM band_sums", "band_order"), *BAND_PARTS), [*STATS, "score_left", "score_right"])
def _(spark, sf_dir):
    return run_of(spark, sf_dir).train_bands


@query(
    "band_inversions",
    sql(
        "SELECT CAST(coalesce(sum(" + " + ".join(f"coalesce(CAST({r} - lag_{r} < 0 AS BIGINT), 0)" for r in PLAIN_RATES) + "), 0) AS BIGINT) AS inversions FROM (SELECT *, "
        + ", ".join(f"lag({r}) OVER (ORDER BY band_order) AS lag_{r}" for r in PLAIN_RATES)
        + f" FROM ({derived_sql('SELECT * FROM band_sums', 'band_order')}) s) t",
        *BAND_PARTS,
    ),
)
def _(spark, sf_dir):
    return bands.inversions(run_of(spark, sf_dir).train_bands, "band_order", validation.RATES)


BOTH = derived_sql(sums_sql("banded WHERE sample_group IN ('train', 'oot')", "sample_group, band_order, band"), "band_order", "sample_group")


@query(
    "monotonicity",
    sql(
        "SELECT sample_group, metric, CAST(count(*) FILTER (WHERE falls) AS BIGINT) AS violation_cnt, coalesce(string_agg(CASE WHEN falls THEN CAST(band_order AS VARCHAR) END, ',' ORDER BY band_order), '') AS violation_bands, count(*) FILTER (WHERE falls) = 0 AS is_monotonic FROM ("
        + " UNION ALL ".join(f"SELECT sample_group, band_order, '{r}' AS metric, coalesce({r} - lag({r}) OVER (PARTITION BY sample_group ORDER BY band_order) < 0, false) AS falls FROM both_bands" for r in validation.RATES)
        + ") u GROUP BY sample_group, metric",
        ("both_bands", BOTH),
    ),
)
def _(spark, sf_dir):
    return validation.monotonicity(run_of(spark, sf_dir).both_bands)


PSI_SQL = """
SELECT *, sum(psi_component) OVER () AS psi_total FROM (
  SELECT *, (greatest(oot_pct, 1e-6) - greatest(train_pct, 1e-6)) * ln(greatest(oot_pct, 1e-6) / greatest(train_pct, 1e-6)) AS psi_component FROM (
    SELECT *, CAST(train_n AS DOUBLE) / sum(train_n) OVER () AS train_pct, CAST(oot_n AS DOUBLE) / sum(oot_n) OVER () AS oot_pct FROM (
      SELECT b.band_order, b.band, count(*) FILTER (WHERE r.sample_group = 'train') AS train_n, count(*) FILTER (WHERE r.sample_group = 'oot') AS oot_n
      FROM (SELECT DISTINCT band_order, band FROM banded) b LEFT JOIN banded r ON r.band_order = b.band_order GROUP BY 1, 2) a) c) d
"""
PSI_DOUBLES = ["train_pct", "oot_pct", "psi_component", "psi_total"]


@query("psi_by_band", sql(PSI_SQL), PSI_DOUBLES)
def _(spark, sf_dir):
    return run_of(spark, sf_dir).psi


@query(
    "psi_of_shares",
    sql(
        "SELECT sum((b - a) * ln(b / a)) AS psi FROM (SELECT band_order, CAST(count(*) FILTER (WHERE sample_group = 'train') AS DOUBLE) / (SELECT count(*) FROM banded WHERE sample_group = 'train') + 1e-6 AS a, "
        "CAST(count(*) FILTER (WHERE sample_group = 'oot') AS DOUBLE) / (SELECT count(*) FROM banded WHERE sample_group = 'oot') + 1e-6 AS b FROM banded GROUP BY 1) s"
    ),
    ["psi"],
)
def _(spark, sf_dir):
    run = run_of(spark, sf_dir)
    a, b = (run.both_bands.filter(F.col("sample_group") == g) for g in ("train", "oot"))
    return validation.psi_of_shares(a, b, "band")


MONTHLY = derived_sql(sums_sql("banded WHERE sample_group IN ('train', 'oot') AND application_month IS NOT NULL", "sample_group, application_month, band_order, band"), "band_order", "sample_group, application_month")
MONTHLY_SQL = f"SELECT *, coalesce(primary_rate_diff_prev < -0.003, false) AS primary_inversion_flag FROM (SELECT *, m3_cnt_bad_rate - lag(m3_cnt_bad_rate) OVER (PARTITION BY sample_group, application_month ORDER BY band_order) AS primary_rate_diff_prev FROM ({MONTHLY}) a) b"


# Scores have eight decimals, so the mean of two rows lies half-way between nine-digit values: left out.
@query("monthly_band", sql(f"SELECT * EXCLUDE (score_mean) FROM ({MONTHLY_SQL}) m"), [*(c for c in STATS if c != "score_mean"), "primary_rate_diff_prev"])
def _(spark, sf_dir):
    return run_of(spark, sf_dir).monthly.drop("score_mean")


@query(
    "monthly_summary",
    sql(
        f"SELECT *, {div('bad_count', 'mature_count')} AS primary_bad_rate, primary_inversion_count = 0 AS primary_monotonic_ok FROM (SELECT sample_group, application_month, CAST(sum(n) AS BIGINT) AS n, CAST(sum(m3_cnt_mature) AS BIGINT) AS mature_count, CAST(sum(m3_cnt_bad) AS BIGINT) AS bad_count, count(DISTINCT band) AS band_count, count(*) FILTER (WHERE primary_inversion_flag) AS primary_inversion_count, max(CASE WHEN primary_rate_diff_prev IS NOT NULL THEN greatest(-primary_rate_diff_prev, 0) END) AS max_primary_rate_drop FROM months GROUP BY 1, 2) s",
        ("months", MONTHLY_SQL),
    ),
    ["primary_bad_rate", "max_primary_rate_drop"],
)
def _(spark, sf_dir):
    return validation.monthly_summary(run_of(spark, sf_dir).monthly)


@query(
    "train_oot_compare",
    sql(
        f"SELECT e.band_order, e.band, e.merged_from, e.extreme_role, e.score_left, e.score_right, "
        + ", ".join(f"t.{c} AS {c}_train, o.{c} AS {c}_oot" for c in validation.COMPARED)
        + " FROM band_edge e LEFT JOIN (SELECT * FROM both_bands WHERE sample_group = 'train') t USING (band) LEFT JOIN (SELECT * FROM both_bands WHERE sample_group = 'oot') o USING (band)",
        ("both_bands", BOTH),
        ("band_edge", EDGES_SQL),
    ),
    ["score_left", "score_right", *(f"{c}_{g}" for c in validation.COMPARED if "cnt_mature" not in c and not c.endswith("cnt_bad") and c != "n" for g in ("train", "oot"))],
)
def _(spark, sf_dir):
    run = run_of(spark, sf_dir)
    train, oot = (run.both_bands.filter(F.col("sample_group") == g) for g in ("train", "oot"))
    return validation.compare(train, oot, run.band_edges)


PROCESS_SQL = (
    f"SELECT d.* EXCLUDE (first_bin, last_bin), {SOURCE_SQL.replace('first_bin', 'm.first_bin').replace('last_bin', 'm.last_bin')} AS merged_from, "
    + ", ".join(f"coalesce({m}_rate_diff_prev < 0, false) AS {m}_inversion_flag" for m in NAMES)
    + f", {ROLE_SQL.replace('first_bin', 'd.bin_order').replace('last_bin', 'd.bin_order')} AS extreme_role, CASE WHEN m.first_bin < m.last_bin THEN 'merged' ELSE 'kept' END AS merge_action FROM (SELECT *, 0 AS first_bin, 0 AS last_bin, CAST({BAND_SQL} AS INTEGER) AS band_order, chr(64 + {BAND_SQL}) AS band, "
    + ", ".join(f"{m}_cnt_bad_rate - lag({m}_cnt_bad_rate) OVER (ORDER BY bin_order) AS {m}_rate_diff_prev" for m in NAMES)
    + f" FROM ({derived_sql('SELECT * FROM dense', 'bin_order')}) s) d JOIN (SELECT band_order, min(first_bin) AS first_bin, max(last_bin) AS last_bin FROM band_sums GROUP BY 1) m USING (band_order)"
)


@query("bin_process", sql(PROCESS_SQL, *BAND_PARTS), [*STATS, "score_left", "score_right", "m1_rate_diff_prev", "m3_rate_diff_prev"])
def _(spark, sf_dir):
    run = run_of(spark, sf_dir)
    return bands.process_table(bands.dense_bin_stats(run.binned.filter("sample_group = 'train'"), run.edges), RANGES)


# Funnel ------------------------------------------------------------------------------------------


@query("funnel_by_group", sql(" UNION ALL ".join(funnel_sql(f"kept WHERE {test}", f"'{g}' AS sample_group", "") for g, test in (("Train", "sample_group = 'train'"), ("OOT", "sample_group = 'oot'"), ("All", "true")))), FUNNEL_DOUBLES)
def _(spark, sf_dir):
    return funnel.by_group(run_of(spark, sf_dir).completed)


@query("funnel_by_band", sql(funnel_sql("banded WHERE band_order IS NOT NULL", "band_order, band", "GROUP BY band_order, band")), FUNNEL_DOUBLES)
def _(spark, sf_dir):
    return funnel.by_band(run_of(spark, sf_dir).banded)


# Ranking -----------------------------------------------------------------------------------------

GRID_SQL = """
SELECT sample_group, label, sum(b + g) AS n, sum(b) AS bad_cnt, sum(g) AS good_cnt, CAST(sum(b) AS DOUBLE) / nullif(sum(b + g), 0) AS bad_rate,
  CASE WHEN sum(b) > 0 AND sum(g) > 0 THEN (sum(b * (c - b - g + (b + g + 1) / CAST(2 AS DOUBLE))) - sum(b) * (CAST(sum(b) AS DOUBLE) + 1) / 2) / (CAST(sum(b) AS DOUBLE) * sum(g)) END AS auc,
  CASE WHEN sum(b) > 0 AND sum(g) > 0 THEN max(abs(CAST(cb AS DOUBLE) / nullif(tb, 0) - CAST(cg AS DOUBLE) / nullif(tg, 0))) END AS ks
FROM (SELECT *, sum(b + g) OVER w AS c, sum(b) OVER w AS cb, sum(g) OVER w AS cg, sum(b) OVER (PARTITION BY sample_group, label) AS tb, sum(g) OVER (PARTITION BY sample_group, label) AS tg
  FROM (SELECT sample_group, label, score_mlt, count(*) FILTER (WHERE y = 1) AS b, count(*) FILTER (WHERE y = 0) AS g FROM (
    SELECT sample_group, score_mlt, 'duedate_1m_30' AS label, duedate_1m_30 AS y FROM scored WHERE sample_group IN ('train', 'oot') UNION ALL
    SELECT sample_group, score_mlt, 'duedate_3m_30', duedate_3m_30 FROM scored WHERE sample_group IN ('train', 'oot')) l GROUP BY 1, 2, 3) h
  WINDOW w AS (PARTITION BY sample_group, label ORDER BY score_mlt ROWS UNBOUNDED PRECEDING)) r
GROUP BY sample_group, label
"""
GRID_SQL = f"SELECT sample_group, label, CAST(n AS BIGINT) AS n, CAST(bad_cnt AS BIGINT) AS bad_cnt, CAST(good_cnt AS BIGINT) AS good_cnt, bad_rate, auc, ks FROM ({GRID_SQL}) z"


@query("auc_ks_grid", sql(GRID_SQL), ["bad_rate", "auc", "ks"])
def _(spark, sf_dir):
    return run_of(spark, sf_dir).performance


@query("performance_wide", sql("SELECT sample_group, " + ", ".join(f"max(CASE WHEN label = '{h.label}' THEN {m} END) AS {h.name}_{m}" for h in HORIZONS for m in ("auc", "ks")) + f" FROM ({GRID_SQL}) g GROUP BY 1"), ["m1_auc", "m1_ks", "m3_auc", "m3_ks"])
def _(spark, sf_dir):
    return validation.performance_wide(run_of(spark, sf_dir).performance)


@query(
    "spearman",
    sql(
        "SELECT count(*) AS n, corr(rx, ry) AS spearman FROM (SELECT (rank() OVER (ORDER BY score_mlt)) + (count(*) OVER (PARTITION BY score_mlt) - 1) / CAST(2 AS DOUBLE) AS rx, "
        "(rank() OVER (ORDER BY principal)) + (count(*) OVER (PARTITION BY principal) - 1) / CAST(2 AS DOUBLE) AS ry FROM scored WHERE principal IS NOT NULL) r"
    ),
    ["spearman"],
)
def _(spark, sf_dir):
    return validation.spearman(run_of(spark, sf_dir).scored, "score_mlt", "principal")


# Policy ------------------------------------------------------------------------------------------


@query("threshold_curve", sql("SELECT * FROM curve", *CURVE_PARTS), CURVE_DOUBLES)
def _(spark, sf_dir):
    return run_of(spark, sf_dir).curve


PICK = ("threshold_order", "threshold", "band", "cum_pass_rate")


@query("threshold_pick", sql(" UNION ALL ".join(f"SELECT '{g}' AS limits, {', '.join(PICK)} FROM picked_{g}" for g, _ in POLICY.groups), *PLAN_PARTS), ["threshold", "cum_pass_rate"])
def _(spark, sf_dir):
    curve = run_of(spark, sf_dir).curve
    auto, accept = (policy.pick(curve, limits).select(F.lit(g).alias("limits"), *PICK) for g, limits in POLICY.groups)
    return auto.unionByName(accept)


@query("strategy_plan", sql("SELECT * FROM plan", *PLAN_PARTS), PLAN_DOUBLES)
def _(spark, sf_dir):
    return run_of(spark, sf_dir).plan


SELECTION_SQL = (
    "SELECT c.*, "
    + ", ".join(
        x
        for g, limits in POLICY.groups
        for x in [f"CAST({v} AS DOUBLE) AS {g}_limit_{m}" for m, v in limits.limits] + [f"coalesce({m} <= CAST({v} AS DOUBLE), false) AS {g}_check_{m}" for m, v in limits.limits] + [f"{within_sql(limits)} AS {g}_all_ok"]
    )
    + ", CASE WHEN threshold_order = auto_order AND threshold_order = accept_order THEN 'auto_pass+reject' WHEN threshold_order = auto_order THEN 'auto_pass' WHEN threshold_order = accept_order THEN 'reject' ELSE '' END AS selected_role"
    + ", CASE WHEN threshold_order = auto_order AND threshold_order = accept_order THEN 'both choices are this threshold' WHEN threshold_order = auto_order THEN 'highest pass rate within the automatic limits' WHEN threshold_order = accept_order THEN 'highest pass rate within the acceptance limits' ELSE '' END AS selection_reason"
    + " FROM curve c, plan p"
)


@query("selection_table", sql(SELECTION_SQL, *PLAN_PARTS), CURVE_DOUBLES)
def _(spark, sf_dir):
    run = run_of(spark, sf_dir)
    return policy.selection(run.curve, run.plan, POLICY)


def move_sql(kind: str, scenario: str, d: int) -> str:
    at = f"({'auto_order' if kind == 'auto_pass' else 'accept_order'} + {d})"
    there = f"{at} BETWEEN 1 AND (SELECT max(threshold_order) FROM curve)"
    if kind == "auto_pass":
        x, y, crossed, note = f"least({at}, accept_order)", "accept_order", f"accept_order < {at}", "past the acceptance threshold, moved to it"
    else:
        x, y, crossed, note = "auto_order", f"greatest({at}, auto_order)", f"{at} < auto_order", "tighter than the automatic threshold, moved to it"
    edge = "already the tightest step" if d < 0 else "already the loosest step"
    return f"SELECT '{kind}' AS threshold_type, '{scenario}' AS scenario, CASE WHEN {there} THEN {x} END AS x, CASE WHEN {there} THEN {y} END AS y, CASE WHEN NOT ({there}) THEN '{edge}' WHEN {crossed} THEN '{note}' ELSE '' END AS note FROM plan WHERE status = 'OK'"


SENSITIVITY_SQL = (
    "SELECT s.* EXCLUDE (x, y), "
    + ", ".join(f"estimated_{r}_rate - max(CASE WHEN scenario = 'current' THEN estimated_{r}_rate END) OVER (PARTITION BY threshold_type) AS estimated_{r}_rate_delta" for r in ("auto_pass", "manual_review", "total_accept", "reject"))
    + " FROM (SELECT m.*, CASE WHEN threshold_type = 'auto_pass' THEN a.threshold ELSE b.threshold END AS threshold, coalesce(CASE WHEN threshold_type = 'auto_pass' THEN a.band ELSE b.band END, '') AS band, "
    "a.cum_pass_rate AS estimated_auto_pass_rate, CASE WHEN x IS NOT NULL THEN greatest(0.0, b.cum_pass_rate - a.cum_pass_rate) END AS estimated_manual_review_rate, b.cum_pass_rate AS estimated_total_accept_rate, 1 - b.cum_pass_rate AS estimated_reject_rate, "
    "a.cum_m1_cnt_bad_rate AS auto_m1_cnt_bad_rate, a.cum_m3_cnt_bad_rate AS auto_m3_cnt_bad_rate, b.cum_m3_cnt_bad_rate AS accept_m3_cnt_bad_rate, b.marginal_m3_cnt_bad_rate AS accept_marginal_m3_cnt_bad_rate, b.marginal_m3_cnt_bad_rate_ci_high AS accept_marginal_m3_cnt_bad_rate_ci_high "
    "FROM (" + " UNION ALL ".join(move_sql(t, s, d) for t in ("auto_pass", "total_accept") for s, d in policy.MOVES) + ") m LEFT JOIN curve a ON a.threshold_order = m.x LEFT JOIN curve b ON b.threshold_order = m.y) s"
)
SENSITIVITY_DOUBLES = ["threshold", *(f"estimated_{r}_rate{d}" for r in ("auto_pass", "manual_review", "total_accept", "reject") for d in ("", "_delta")), "auto_m1_cnt_bad_rate", "auto_m3_cnt_bad_rate", "accept_m3_cnt_bad_rate", "accept_marginal_m3_cnt_bad_rate", "accept_marginal_m3_cnt_bad_rate_ci_high"]


@query("sensitivity", sql(SENSITIVITY_SQL, *PLAN_PARTS), SENSITIVITY_DOUBLES)
def _(spark, sf_dir):
    run = run_of(spark, sf_dir)
    return policy.sensitivity(run.curve, run.plan)


DECIDED = ("decided", "SELECT s.*, p.auto_pass_threshold, p.reject_threshold, p.strategy_name, CASE WHEN score_mlt <= auto_pass_threshold THEN 'auto_pass' WHEN score_mlt <= reject_threshold THEN 'manual_review' ELSE 'reject' END AS decision FROM scored s, plan p WHERE p.status = 'OK' AND sample_group IN ('train', 'oot')")
SEGMENT_SQL = (
    "SELECT f.sample_group, p.strategy_name, f.decision, CASE f.decision WHEN 'manual_review' THEN auto_pass_threshold WHEN 'reject' THEN reject_threshold END AS lower_threshold_exclusive, CASE f.decision WHEN 'auto_pass' THEN auto_pass_threshold WHEN 'manual_review' THEN reject_threshold END AS upper_threshold_inclusive, "
    + f"{div('coalesce(d.n, 0)', 't.n')} AS estimated_segment_rate, {div('coalesce(d.principal_amt, 0)', 't.principal_amt')} AS estimated_segment_principal_rate, "
    + ", ".join(f"coalesce(d.{c}, 0) AS {c}" for c in CURVE_COUNTED)
    + ", "
    + ", ".join(f"{div(f'd.{m}_{c}_bad', f'd.{m}_{b}')} AS {m}_{c}_bad_rate" for m in NAMES for c, b in (("cnt", "cnt_mature"), ("amt", "amt_exposure")))
    + " FROM (SELECT * FROM (VALUES ('train'), ('oot')) g(sample_group), (VALUES ('auto_pass'), ('manual_review'), ('reject')) h(decision)) f JOIN plan p ON p.status = 'OK' "
    f"LEFT JOIN ({sums_sql('decided', 'sample_group, decision')}) d USING (sample_group, decision) LEFT JOIN ({sums_sql('scored', 'sample_group')}) t ON t.sample_group = f.sample_group"
)


@query("segment_report", sql(SEGMENT_SQL, *PLAN_PARTS, DECIDED), ["lower_threshold_exclusive", "upper_threshold_inclusive", "estimated_segment_rate", "estimated_segment_principal_rate", *AMOUNTS, *PLAIN_RATES])
def _(spark, sf_dir):
    run = run_of(spark, sf_dir)
    return policy.segments(run.scored, run.plan)


def flow_sql(group: str, test: str) -> str:
    counts = ", ".join(f"count(DISTINCT application_id){f' FILTER (WHERE decision = {chr(39)}{s}{chr(39)})' if s else ''} AS {n}" for s, n in (("", "t"), ("auto_pass", "a"), ("manual_review", "m"), ("reject", "r")))
    return (
        f"SELECT '{group}' AS sample_group, t AS estimated_total_application_cnt, a AS estimated_auto_pass_cnt, m AS estimated_manual_review_cnt, a + m AS estimated_total_accept_cnt, r AS estimated_reject_cnt, "
        f"{div('a', 't')} AS estimated_auto_pass_rate, {div('m', 't')} AS estimated_manual_review_rate, {div('a + m', 't')} AS estimated_total_accept_rate, {div('r', 't')} AS estimated_reject_rate, auto_pass_threshold, reject_threshold AS total_accept_threshold "
        f"FROM (SELECT auto_pass_threshold, reject_threshold, {counts} FROM decided WHERE {test} GROUP BY 1, 2) c"
    )


@query("estimated_flow", sql(" UNION ALL ".join(flow_sql(g, t) for g, t in (("Train", "sample_group = 'train'"), ("OOT", "sample_group = 'oot'"), ("All", "true"))), *PLAN_PARTS, DECIDED), [*(f"estimated_{r}_rate" for r in ("auto_pass", "manual_review", "total_accept", "reject")), "auto_pass_threshold", "total_accept_threshold"])
def _(spark, sf_dir):
    run = run_of(spark, sf_dir)
    return policy.flow(run.scored, run.plan)


def enriched_sql(group: str) -> str:
    """The bands of a sample; needs PLAN_PARTS, both_bands and band_edge in front."""
    return (
        "SELECT d.band_order, d.band, d.n, d.sample_pct, e.merged_from, e.extreme_role, e.score_left, e.score_right, "
        + ", ".join(f"d.{c}" for c in [*PLAIN_RATES, *DIAGNOSED])
        + ", f.actual_apply_cnt, "
        + ", ".join(f"f.{c}" for c in FUNNEL_DOUBLES)
        + ", s.psi_component AS train_oot_psi_component, s.psi_total AS train_oot_psi_total, CASE WHEN p.status <> 'OK' THEN 'undecided' WHEN d.band <= p.auto_pass_band THEN 'auto_pass' WHEN d.band <= p.manual_review_upper_band THEN 'manual_review' ELSE 'reject' END AS estimated_decision, d.sample_pct AS estimated_band_flow_rate, d.cum_pass_rate AS estimated_cumulative_flow_rate FROM ("
        + diagnosed_sql(f"SELECT * FROM both_bands WHERE sample_group = '{group}'", "band_order")
        + ") d LEFT JOIN band_edge e USING (band_order) LEFT JOIN ("
        + funnel_sql(f"banded WHERE sample_group = '{group}'", "band_order", "GROUP BY band_order")
        + f") f USING (band_order) LEFT JOIN ({PSI_SQL}) s USING (band_order), plan p"
    )


ENRICHED = ["band_order", "band", "n", "sample_pct", "merged_from", "extreme_role", "score_left", "score_right", *PLAIN_RATES, *DIAGNOSED, "actual_apply_cnt", *FUNNEL_DOUBLES, "train_oot_psi_component", "train_oot_psi_total", "estimated_decision", "estimated_band_flow_rate", "estimated_cumulative_flow_rate"]


ENRICHED_DOUBLES = ["sample_pct", "score_left", "score_right", *PLAIN_RATES, *DIAGNOSED, *FUNNEL_DOUBLES, "train_oot_psi_component", "train_oot_psi_total", "estimated_band_flow_rate", "estimated_cumulative_flow_rate"]


@query("band_decision", sql(enriched_sql("train"), *PLAN_PARTS, ("both_bands", BOTH), ("band_edge", EDGES_SQL)), ENRICHED_DOUBLES)
def _(spark, sf_dir):
    return run_of(spark, sf_dir).enriched("train").select(*ENRICHED)


OVERALL = [f"estimated_overall_{r}_rate" for r in ("auto_pass", "manual_review", "total_accept", "reject")]
RANKED = [f"overall_{m}_{c}" for m in NAMES for c in ("auc", "ks")]


@query(
    "band_report",
    sql(
        "SELECT b.*, " + ", ".join(f"f.{c.replace('overall_', '')} AS {c}" for c in OVERALL) + ", " + ", ".join(f"max(g.{c}) FILTER (WHERE g.label = '{h.label}') OVER (PARTITION BY b.sample_group) AS overall_{h.name}_{c}" for h in HORIZONS for c in ("auc", "ks"))
        + " FROM (" + " UNION ALL ".join(f"SELECT '{g}' AS sample_group, * FROM ({enriched_sql(g)}) {g}_rows" for g in ("train", "oot")) + ") b LEFT JOIN ("
        + " UNION ALL ".join(flow_sql(g, f"sample_group = '{g}'") for g in ("train", "oot")) + f") f USING (sample_group) LEFT JOIN ({GRID_SQL}) g USING (sample_group) QUALIFY row_number() OVER (PARTITION BY b.sample_group, b.band_order) = 1",
        *PLAN_PARTS, DECIDED, ("both_bands", BOTH), ("band_edge", EDGES_SQL),
    ),
    [*ENRICHED_DOUBLES, *OVERALL, *RANKED],
)
def _(spark, sf_dir):
    return run_of(spark, sf_dir).band_report().select("sample_group", *ENRICHED, *OVERALL, *RANKED)


@query(
    "online_decision",
    sql(
        "SELECT application_id, CASE WHEN score_mlt IS NULL OR isinf(score_mlt) THEN 'reject' WHEN score_mlt <= CAST(0.5 AS DOUBLE) THEN 'auto_pass' WHEN score_mlt <= CAST(0.8 AS DOUBLE) THEN 'manual_review' ELSE 'reject' END AS decision "
        "FROM (SELECT application_id, CASE WHEN application_id % 50 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE score_mlt END AS score_mlt FROM loans) l"
    ),
)
def _(spark, sf_dir):
    df = loans.loan_view(spark, sf_dir)
    score = F.when(F.col("application_id") % 50 == 0, float("inf")).otherwise(F.col("score_mlt"))
    return policy.decide(df.withColumn("score_mlt", score), 0.5, 0.8).select("application_id", "decision")


CSV_NUMBERS = [c for c in loans.NUMBERS if not c.startswith("duedate")]


@query("csv_scan", sql(f"SELECT application_id, application_status, assessment_status, status, application_month, {', '.join(CSV_NUMBERS)} FROM loans"), CSV_NUMBERS)
def _(spark, sf_dir):
    """The loans as a CSV file with a byte-order mark in its header, read and cleaned again."""
    folder = monitor.work_folder(spark)
    names = ["application_id", "application_status", "assessment_status", "status", "application_month", *CSV_NUMBERS]
    view = loans.loan_view(spark, sf_dir).select(*names).withColumnRenamed("application_id", loans.BOM + "application_id")
    view.write.option("header", True).csv(folder)
    got = loans.read_csv(spark, folder)
    loans.require(got, tuple(names), "loans")
    return got.withColumns({"application_id": F.col("application_id").cast("long"), **{c: loans.clean_double(c) for c in CSV_NUMBERS}}).select(*names)


def figures_sql() -> str:
    row = lambda section, metric, value, source: f"SELECT '{section}' AS section, '{metric}' AS metric, CAST({value} AS DOUBLE) AS value_num FROM {source}"
    counted = {"completed": "count(*)", "without_score": "count(*) FILTER (WHERE score_mlt IS NULL)", "train": "count(*) FILTER (WHERE sample_group = 'train')", "oot": "count(*) FILTER (WHERE sample_group = 'oot')", "first_month": "NULL", "last_month": "NULL"}
    rows = [row("sample", m, v, "kept" if v != "NULL" else "(SELECT 1) o") for m, v in counted.items()]
    rows += [row("bins", "initial", 20, "(SELECT 1) o"), row("bins", "bands", len(RANGES), "(SELECT 1) o")]
    numbers = ["auto_order", "accept_order", *PLAN_DOUBLES]
    rows += [row("policy", c, c, "plan") for c in numbers] + [row("policy", c, "NULL", "plan") for c in ("strategy_name", "objective", "status", "auto_pass_band", "manual_review_upper_band")]
    rows.append(row("stability", "psi_total", "max(psi_total)", f"({PSI_SQL}) s"))
    rows += [f"SELECT 'performance' AS section, sample_group || ' ' || label || ' {m}' AS metric, {m} AS value_num FROM ({GRID_SQL}) g" for m in ("auc", "ks")]
    return " UNION ALL ".join(rows)


@query("overview_figures", sql(figures_sql(), *PLAN_PARTS), ["value_num"])
def _(spark, sf_dir):
    return report.overview(run_of(spark, sf_dir)).select("section", "metric", "value_num")


SECTION_ROWS = [
    ("02_bins", "process", "SELECT count(*) FROM edge"),
    ("03_bands", "bands", "SELECT count(*) FROM both_bands"),
    ("04_policy", "actual_funnel", "SELECT 3"),
    ("04_policy", "estimated_flow", "SELECT 3 * count(*) FROM plan WHERE status = 'OK'"),
    ("04_policy", "threshold_selection", "SELECT count(*) FROM curve"),
    ("04_policy", "plan", "SELECT count(*) FROM plan"),
    ("04_policy", "sensitivity", "SELECT 6 * count(*) FROM plan WHERE status = 'OK'"),
    ("04_policy", "segments", "SELECT 6 * count(*) FROM plan WHERE status = 'OK'"),
    ("05_validation", "comparison", "SELECT count(DISTINCT band_order) FROM banded"),
    ("05_validation", "performance", f"SELECT count(*) FROM ({GRID_SQL}) g"),
    ("05_validation", "performance_wide", f"SELECT count(DISTINCT sample_group) FROM ({GRID_SQL}) g"),
    ("05_validation", "psi", "SELECT count(DISTINCT band_order) FROM banded"),
    ("05_validation", "monotonicity", f"SELECT {len(validation.RATES)} * count(DISTINCT sample_group) FROM both_bands"),
    ("05_validation", "monthly_summary", f"SELECT count(*) FROM (SELECT DISTINCT sample_group, application_month FROM ({MONTHLY_SQL}) m) d"),
    ("05_validation", "monthly", f"SELECT count(*) FROM ({MONTHLY_SQL}) m"),
]


@query("report_sections", sql(" UNION ALL ".join(f"SELECT '{sheet}' AS sheet, '{name}' AS section, ({count}) AS n" for sheet, name, count in SECTION_ROWS), *PLAN_PARTS, ("both_bands", BOTH)))
def _(spark, sf_dir):
    """The report's sections over the data, written to a folder each and counted again from there."""
    folder, made = monitor.work_folder(spark), report.sections(run_of(spark, sf_dir))
    wanted = {sheet: {n: df for n, df in parts.items() if any((sheet, n) == x[:2] for x in SECTION_ROWS)} for sheet, parts in made.items()}
    report.write(wanted, folder)
    counts = [spark.read.parquet(f"{folder}/{sheet}/{n}").agg(F.lit(sheet).alias("sheet"), F.lit(n).alias("section"), F.count(F.lit(1)).alias("n")) for sheet, parts in wanted.items() for n in parts]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


# Search and report: beyond SQL --------------------------------------------------------------------


@query("merge_candidates")
def _(spark, sf_dir):
    return run_of(spark, sf_dir, fixed=False).candidates()


@query("merge_steps")
def _(spark, sf_dir):
    return run_of(spark, sf_dir, fixed=False).steps()


@query("overview")
def _(spark, sf_dir):
    return report.overview(run_of(spark, sf_dir, fixed=False))


@query("config_table")
def _(spark, sf_dir):
    return report.config_table(run_of(spark, sf_dir, fixed=False))


@query("metric_dictionary")
def _(spark, sf_dir):
    return report.metric_dictionary(spark)


@query("online_rules")
def _(spark, sf_dir):
    return report.online_rules(spark)


# Registers what it holds in the same tables.
from scoreloom.plans import model_queries, stream_queries, turned_queries  # noqa: E402, F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The performance table of the training bins."""
    return QUERIES["initial_bin_stats"](spark, sf_dir)


__all__ = ["ORACLES", "QUERIES", "flagship"]
