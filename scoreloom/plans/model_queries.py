"""Queries over many models at once, and their SQL: a model for each order priority of the loans.

Each model has bins of its own. Partitions are given as rows, so that SQL can judge the same ones; the search by model
walks to its own, and tests replay it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.operators import candidates, samples
from scoreloom.plans.pipeline import search_states
from scoreloom.plans.queries import PERIODS, POLICY, RANGES, div, query, sums_sql
from scoreloom.settings import Floors, Search, Settings
from scoreloom.sources import loans

BY = ["segment"]
#: A model has a fifth of the loans, and floors to fit.
SEARCH = Search(floors=Floors(mature=100, extreme_mature=50, bad=5, worst_bad=3, good=40, best_good=20))
MODEL_SETTINGS = Settings(periods=PERIODS, policy=POLICY, search=SEARCH)


def chunks(bands: int) -> tuple[tuple[int, int], ...]:
    """20 bins in so many nearly equal bands, the outermost bins on their own."""
    inner = [1 + round(18 * k / (bands - 2)) for k in range(bands - 1)]
    return ((1, 1), *((a + 1, b) for a, b in zip(inner, inner[1:])), (20, 20))


#: Partitions of every kind: the bins themselves, some that keep the extreme bins and some that do not, too many bands and too few.
NAMED = (
    ("bins", tuple((k, k) for k in range(1, 21))),
    ("given", RANGES),
    *((f"even{n}", chunks(n)) for n in (5, 6, 7, 8, 9, 12)),
    ("tens", tuple((2 * k + 1, 2 * k + 2) for k in range(10))),
    ("low_tail", ((1, 5), (6, 8), (9, 12), (13, 16), (17, 19), (20, 20))),
    ("high_tail", ((1, 1), (2, 4), (5, 8), (9, 12), (13, 14), (15, 20))),
    ("halves", ((1, 10), (11, 20))),
    ("whole", ((1, 20),)),
)


def model_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(segment, bin_order, sums) of the training loans, each segment in its own 20 bins."""
    view = loans.loan_view(spark, sf_dir, "o_orderpriority")
    rows = samples.scored(samples.split(samples.drop_incomplete(view), PERIODS)).filter("sample_group = 'train'")
    edges = candidates.edges_by(rows, BY)
    return candidates.dense_bins(candidates.binned_by(rows, edges, BY), edges, BY)


# SQL parts ---------------------------------------------------------------------------------------

SHARES = [k / 20 for k in range(1, 20)]
ROWS = ", ".join(f"('{name}', {k}, {a}, {b})" for name, ranges in NAMED for k, (a, b) in enumerate(ranges, 1))
COUNTED = [c for c in candidates.SUMMED if c == "n" or "cnt" in c]
KEPT = "application_status IS NULL OR application_status NOT IN ('0.Incomplete', '1.In Progress')"
ROLE = (
    "concat_ws(',', CASE WHEN first_bin = 1 AND last_bin = 1 THEN 'best_extreme' WHEN first_bin = 1 THEN 'contains_best_extreme' END, "
    "CASE WHEN first_bin = 20 AND last_bin = 20 THEN 'worst_extreme' WHEN last_bin = 20 THEN 'contains_worst_extreme' END)"
)


def typed(c: str, value: str) -> str:
    return f"CAST({value} AS {'BIGINT' if c in COUNTED else 'DOUBLE'}) AS {c}"


def needs_sql() -> dict[str, str]:
    f = SEARCH.floors
    by_role = lambda best, worst, rest: f"CASE extreme_role WHEN 'best_extreme' THEN {best} WHEN 'worst_extreme' THEN {worst} ELSE {rest} END"
    return {
        "sample_pct": f"CAST(CASE WHEN band_order IN (1, band_count) THEN {f.tail_share} ELSE {f.middle_share} END AS DOUBLE)",
        "mature": by_role(f.extreme_mature, f.extreme_mature, f.mature),
        "bad": by_role(f.best_bad, f.worst_bad, f.bad),
        "good": by_role(f.best_good, f.worst_good, f.good),
    }


def iv_sql(source: str, keys: str) -> str:
    """Smoothed information value of source(keys, m3_cnt_bad, m3_cnt_good)."""
    b, g = (f"((m3_cnt_{c} + CAST(0.5 AS DOUBLE)) / (sum(m3_cnt_{c}) OVER w + CAST(0.5 AS DOUBLE) * count(*) OVER w))" for c in ("bad", "good"))
    inner = f"SELECT {keys}, m3_cnt_bad, m3_cnt_good, ({b} - {g}) * ln({b} / {g}) AS part FROM {source} WINDOW w AS (PARTITION BY {keys})"
    return f"SELECT {keys}, CASE WHEN sum(m3_cnt_bad) > 0 AND sum(m3_cnt_good) > 0 THEN sum(part) END AS iv FROM ({inner}) x GROUP BY {keys}"


NEEDS = needs_sql()
HAVE = {"sample_pct": "sample_pct", "mature": "m3_cnt_mature", "bad": "m3_cnt_bad", "good": "m3_cnt_good"}
LACKS = " + ".join(f"CASE WHEN required_{k} > 0 THEN greatest(CAST(0 AS DOUBLE), 1 - {div(have, f'required_{k}')}) ELSE CAST(0 AS DOUBLE) END" for k, have in HAVE.items())
MODEL_CHAIN = {
    "seg_loans": loans.segmented_sql("o_orderpriority").replace("{orders}", "orders"),
    "seg_train": f"SELECT * FROM seg_loans WHERE ({KEPT}) AND score_mlt IS NOT NULL AND application_month <= '{PERIODS.train_end}'",
    "seg_cuts": f"SELECT segment, quantile_cont(score_mlt, {SHARES}) AS q FROM seg_train GROUP BY segment",
    "seg_binned": "SELECT t.*, CAST(1 + len(list_filter(q, lambda x: score_mlt > x)) AS INTEGER) AS bin_order FROM seg_train t JOIN seg_cuts USING (segment)",
    "seg_sums": sums_sql("seg_binned", "segment, bin_order"),
    "seg_bins": "SELECT c.segment, CAST(k AS INTEGER) AS bin_order, " + ", ".join(typed(c, f"coalesce(s.{c}, 0)") for c in candidates.SUMMED) + ", coalesce(s.m3_cnt_mature - s.m3_cnt_bad, 0) AS m3_cnt_good "
    "FROM (SELECT segment, k FROM seg_cuts, range(1, 21) r(k)) c LEFT JOIN seg_sums s ON s.segment = c.segment AND s.bin_order = c.k",
    "parts": f"SELECT candidate, CAST(band_order AS INTEGER) AS band_order, CAST(first_bin AS INTEGER) AS first_bin, CAST(last_bin AS INTEGER) AS last_bin FROM (VALUES {ROWS}) v(candidate, band_order, first_bin, last_bin)",
    "summed": "SELECT segment, candidate, band_order, first_bin, last_bin, " + ", ".join(typed(c, f"sum({c})") for c in candidates.SUMMED) + " FROM parts JOIN seg_bins ON bin_order BETWEEN first_bin AND last_bin GROUP BY 1, 2, 3, 4, 5",
    "bands": f"SELECT *, m3_cnt_mature - m3_cnt_bad AS m3_cnt_good, {', '.join(f'{div(*candidates.PARTS[r])} AS {r}_bad_rate' for r in candidates.RATES)}, "
    f"{div('n', 'sum(n) OVER w')} AS sample_pct, max(band_order) OVER w AS band_count, {ROLE} AS extreme_role FROM summed WINDOW w AS (PARTITION BY segment, candidate)",
    "needed": f"SELECT *, {', '.join(f'{c} AS required_{k}' for k, c in NEEDS.items())} FROM bands",
    "checked": f"SELECT *, {', '.join(f'coalesce({have} >= required_{k}, false) AS {k}_ok' for k, have in HAVE.items())}, {LACKS} AS violation_severity FROM needed",
    "judged": f"SELECT *, {' AND '.join(f'{k}_ok' for k in HAVE)} AS all_constraints_ok FROM checked",
}


def model_sql(body: str, *more: tuple[str, str]) -> str:
    return "WITH " + ", ".join(f"{n} AS ({t})" for n, t in [*MODEL_CHAIN.items(), *more]) + " " + body


CONSTRAINTS = ["segment", "candidate", "band_order", "first_bin", "last_bin", "extreme_role", "n", "sample_pct", *(f"required_{k}" for k in HAVE), *(f"{k}_ok" for k in HAVE), "violation_severity", "all_constraints_ok"]


@query("band_constraints", model_sql(f"SELECT {', '.join(CONSTRAINTS)} FROM judged"), ["sample_pct", "required_sample_pct", "violation_severity"])
def _(spark, sf_dir):
    bands = candidates.band_sums(model_bins(spark, sf_dir), candidates.partitions(spark, NAMED), BY)
    return candidates.constrained(bands, SEARCH).select(*CONSTRAINTS)


def falls_sql(names: tuple[str, ...]) -> str:
    return f"CAST(sum({' + '.join(f'coalesce(CAST(change_{r} < 0 AS INTEGER), 0)' for r in names)}) AS INTEGER)"


S = SEARCH
CROSSED = "CAST(count(DISTINCT e) FILTER (WHERE e NOT IN (SELECT last_bin FROM parts p WHERE p.candidate = z.candidate AND last_bin < 20)) AS INTEGER)"
SCORES = [
    ("moved", f"SELECT *, {', '.join(f'{r}_bad_rate - lag({r}_bad_rate) OVER (PARTITION BY segment, candidate ORDER BY band_order) AS change_{r}' for r in candidates.RATES)} FROM judged"),
    ("band_iv", iv_sql("bands", "segment, candidate")),
    ("first", iv_sql("seg_bins", "segment")),
    ("crossed", f"SELECT candidate, {CROSSED} AS extreme_cut_violation_cnt FROM (SELECT DISTINCT candidate FROM parts) z, (VALUES (1), (19)) x(e) GROUP BY candidate"),
    (
        "counted",
        f"SELECT segment, candidate, max(band_count) AS band_count, {falls_sql(candidates.PRIMARY)} AS primary_inversion_cnt, {falls_sql(candidates.RATES)} AS all_inversion_cnt, CAST(count(*) FILTER (WHERE NOT all_constraints_ok) AS INTEGER) AS constraint_violation_cnt, "
        "min(least(change_m1_cnt, change_m3_cnt)) AS least_adjacent_rate_diff, min(sample_pct) AS least_sample_pct, " + ", ".join(f"CAST(min(m3_cnt_{c}) AS DOUBLE) AS least_{c}_count" for c in ("mature", "bad", "good")) + " FROM moved GROUP BY 1, 2",
    ),
    (
        "told",
        f"SELECT c.*, x.extreme_cut_violation_cnt, i.iv AS primary_iv, i.iv / nullif(f.iv, 0) AS primary_iv_retention, band_count BETWEEN {S.least_bands} AND {S.most_bands} AS eligible_band_count, "
        f"band_count BETWEEN {S.least_bands} AND {S.most_bands} AND primary_inversion_cnt = 0 AND constraint_violation_cnt = 0 AND extreme_cut_violation_cnt = 0 AS hard_constraints_ok, abs(band_count - {S.target_bands}) AS target_band_distance "
        "FROM counted c JOIN crossed x USING (candidate) JOIN band_iv i USING (segment, candidate) JOIN first f USING (segment)",
    ),
    (
        "valued",
        f"SELECT *, {S.score_hard} * CAST(hard_constraints_ok AS DOUBLE) + {S.score_primary_inversion} * CAST(primary_inversion_cnt AS DOUBLE) + {S.score_any_inversion} * CAST(all_inversion_cnt AS DOUBLE) + {S.score_violation} * CAST(constraint_violation_cnt AS DOUBLE) "
        f"+ {S.score_retention} * least(greatest(coalesce(primary_iv_retention, 0), 0), CAST({S.retention_cap} AS DOUBLE)) + {S.score_separation} * greatest(coalesce(least_adjacent_rate_diff, 0), 0) + {S.score_distance} * CAST(target_band_distance AS DOUBLE) + {S.score_crossed} * CAST(extreme_cut_violation_cnt AS DOUBLE) AS candidate_score FROM told",
    ),
]
RANK = "eligible_band_count DESC, hard_constraints_ok DESC, primary_inversion_cnt, constraint_violation_cnt, all_inversion_cnt, candidate_score DESC, primary_iv_retention DESC NULLS LAST, target_band_distance, candidate"


@query(
    "candidate_scores",
    model_sql(f"SELECT *, row_number() OVER (PARTITION BY segment ORDER BY {RANK}) = 1 AS selected FROM valued", *SCORES),
    ["least_adjacent_rate_diff", "least_sample_pct", "least_mature_count", "least_bad_count", "least_good_count", "primary_iv", "primary_iv_retention", "candidate_score"],
)
def _(spark, sf_dir):
    return candidates.scored(model_bins(spark, sf_dir), candidates.partitions(spark, NAMED), BY, SEARCH)


LIMITS = [dict(limits.limits) for _, limits in POLICY.groups]
CUTS = " UNION ALL ".join(
    [
        "SELECT segment, CAST(e AS INTEGER) AS cut, 'extreme' AS why FROM seg_cuts, (VALUES (1), (19)) x(e)",
        *(f"SELECT segment, max(bin_order) FILTER (WHERE cum_rate <= CAST({x['cum_m3_cnt_bad_rate']} AS DOUBLE)), 'limit' FROM seen GROUP BY 1" for x in LIMITS),
        *(f"SELECT segment, min(bin_order) FILTER (WHERE rate > CAST({x['marginal_m3_cnt_bad_rate']} AS DOUBLE)) - 1, 'limit' FROM seen GROUP BY 1" for x in LIMITS),
        f"SELECT segment, bin_order - 1, 'jump' FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY jump DESC, bin_order) AS k FROM jumped WHERE jump IS NOT NULL) j WHERE k <= {S.protect_jumps}",
    ]
)
PROTECTED = [
    ("seen", f"SELECT segment, bin_order, {div('m3_cnt_bad', 'm3_cnt_mature')} AS rate, {div('sum(m3_cnt_bad) OVER w', 'sum(m3_cnt_mature) OVER w')} AS cum_rate FROM seg_bins WINDOW w AS (PARTITION BY segment ORDER BY bin_order ROWS UNBOUNDED PRECEDING)"),
    ("jumped", "SELECT *, rate - lag(rate) OVER (PARTITION BY segment ORDER BY bin_order) AS jump FROM seen"),
    ("protected", f"SELECT segment, cut, bool_or(why = 'extreme') AS is_extreme, bool_or(why = 'limit') AS is_limit, bool_or(why = 'jump') AS is_jump FROM ({CUTS}) u WHERE cut BETWEEN 1 AND 19 GROUP BY 1, 2"),
]


@query("protected_cuts", model_sql("SELECT * FROM protected", *PROTECTED))
def _(spark, sf_dir):
    return candidates.protected_cuts(model_bins(spark, sf_dir), BY, SEARCH, POLICY)


# DuckDB has no error function either: Simpson's rule over 4000 steps.
ERF = "(2 / sqrt(pi()) * (x / 4000) / 3 * list_sum(list_transform(range(0, 4001), lambda i: (CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-power(x * i / 4000, 2)))))"
PAIRS = [
    *PROTECTED,
    ("band_iv", iv_sql("bands", "segment, candidate")),
    ("less", "SELECT segment, candidate, pair_index, CASE WHEN band_order > pair_index THEN band_order - 1 ELSE band_order END AS b, sum(m3_cnt_bad) AS m3_cnt_bad, sum(m3_cnt_good) AS m3_cnt_good FROM (SELECT *, CAST(unnest(range(1, band_count)) AS INTEGER) AS pair_index FROM bands) u GROUP BY 1, 2, 3, 4"),
    ("less_iv", iv_sql("less", "segment, candidate, pair_index")),
    (
        "pairs",
        "SELECT a.segment, a.candidate, a.band_order AS pair_index, a.last_bin AS cut, a.m3_cnt_bad_rate AS left_rate, b.m3_cnt_bad_rate AS right_rate, coalesce(greatest(abs(a.m1_cnt_bad_rate - b.m1_cnt_bad_rate), abs(a.m3_cnt_bad_rate - b.m3_cnt_bad_rate)), 0) AS rate_gap, "
        "a.m3_cnt_mature > 0 AND b.m3_cnt_mature > 0 AS cases, CAST(a.m3_cnt_bad + b.m3_cnt_bad AS DOUBLE) / nullif(a.m3_cnt_mature + b.m3_cnt_mature, 0) AS pooled, 1 / CAST(nullif(a.m3_cnt_mature, 0) AS DOUBLE) + 1 / CAST(nullif(b.m3_cnt_mature, 0) AS DOUBLE) AS inverse FROM bands a JOIN bands b ON a.segment = b.segment AND a.candidate = b.candidate AND b.band_order = a.band_order + 1",
    ),
    ("distant", "SELECT *, CASE WHEN cases AND pooled * (1 - pooled) * inverse > 0 THEN abs(left_rate - right_rate) / sqrt(pooled * (1 - pooled) * inverse) END AS z FROM pairs"),
    ("tested", f"SELECT * EXCLUDE (x), CASE WHEN z IS NOT NULL THEN CASE WHEN x > 7 THEN 0 ELSE 1 - {ERF} END WHEN cases THEN CAST(left_rate = right_rate AS DOUBLE) END AS p_value FROM (SELECT *, z / sqrt(2) AS x FROM distant) d"),
    (
        "priced",
        f"SELECT t.segment, t.candidate, t.pair_index, t.cut, left_rate, right_rate, rate_gap, z, p_value, p.cut IS NOT NULL AS is_protected, coalesce(p.is_extreme, false) AS is_extreme, CASE WHEN n.iv IS NOT NULL AND l.iv IS NOT NULL THEN greatest(CAST(0 AS DOUBLE), n.iv - l.iv) ELSE CAST(0 AS DOUBLE) END AS iv_loss "
        "FROM tested t JOIN band_iv n USING (segment, candidate) JOIN less_iv l USING (segment, candidate, pair_index) LEFT JOIN protected p ON p.segment = t.segment AND p.cut = t.cut",
    ),
    ("costed", f"SELECT *, {S.gap_cost} * rate_gap + (1 - coalesce(p_value, 0)) + {S.iv_cost} * iv_loss + {S.protected_cost} * CAST(is_protected AS DOUBLE) + {S.extreme_cost} * CAST(is_extreme AS DOUBLE) AS merge_cost, is_extreme AS is_blocked FROM priced"),
]


@query(
    "pair_costs",
    # The two p-values differ by up to 1e-12, so that nine digits of a few hundred now and then round apart; six are compared.
    model_sql("SELECT * REPLACE (round(p_value, 6) AS p_value, round(merge_cost, 6) AS merge_cost), row_number() OVER (PARTITION BY segment, candidate ORDER BY is_blocked, round(merge_cost, 10), pair_index) = 1 AND NOT is_blocked AS cheapest_open FROM costed", *PAIRS),
    ["left_rate", "right_rate", "rate_gap", "z", "p_value", "iv_loss", "merge_cost"],
)
def _(spark, sf_dir):
    costs = candidates.pair_costs(model_bins(spark, sf_dir), candidates.partitions(spark, NAMED), BY, SEARCH, POLICY)
    return costs.withColumns({c: F.round(c, 6) for c in ("p_value", "merge_cost")})


# What the search is made of ---------------------------------------------------------------------------


@query(
    "merged_partitions",
    model_sql("SELECT segment, candidate, pair_index, CAST(CASE WHEN band_order > pair_index THEN band_order - 1 ELSE band_order END AS INTEGER) AS band_order, min(first_bin) AS first_bin, max(last_bin) AS last_bin, CAST(sum(n) AS BIGINT) AS n, CAST(sum(m3_cnt_bad) AS BIGINT) AS m3_cnt_bad FROM (SELECT *, CAST(unnest(range(1, band_count)) AS INTEGER) AS pair_index FROM bands) q GROUP BY 1, 2, 3, 4"),
)
def _(spark, sf_dir):
    """Every model's bands after each merge of neighbours in each partition."""
    less = candidates.merged(candidates.partitions(spark, NAMED), [])
    named = less.withColumn("candidate", F.concat_ws("#", "candidate", "pair_index"))
    bands = candidates.band_sums(model_bins(spark, sf_dir), named, BY)
    return bands.select(*BY, F.substring_index("candidate", "#", 1).alias("candidate"), "pair_index", "band_order", "first_bin", "last_bin", "n", "m3_cnt_bad")


@query("range_text", model_sql("SELECT segment, candidate, '[' || string_agg('(' || first_bin || ',' || last_bin || ')', ', ' ORDER BY band_order) || ']' AS ranges, count(*) AS bands, sum(last_bin - first_bin + 1) = 20 AS covers FROM bands GROUP BY 1, 2"))
def _(spark, sf_dir):
    """Every model's partitions as text, read again from it."""
    bands = candidates.band_sums(model_bins(spark, sf_dir), candidates.partitions(spark, NAMED), BY)
    told = candidates.texts(bands, [*BY, "candidate"])
    again = candidates.parsed(told, [*BY, "candidate", "ranges"])
    return again.groupBy(*BY, "candidate", "ranges").agg(F.count(F.lit(1)).alias("bands"), (F.sum(F.col("last_bin") - F.col("first_bin") + 1) == 20).alias("covers"))


@query(
    "extreme_spans",
    model_sql(f"SELECT segment, CAST(first_bin AS INTEGER) AS first_bin, CAST(last_bin AS INTEGER) AS last_bin, {ROLE} AS extreme_role, first_bin = 1 AS touches_best_extreme, last_bin = 20 AS touches_worst_extreme, CAST(CAST(first_bin = 1 AND last_bin > 1 AS INTEGER) + CAST(first_bin < 20 AND last_bin = 20 AS INTEGER) AS INTEGER) AS crossed_cuts FROM seg_cuts, range(1, 21) a(first_bin), range(1, 21) b(last_bin) WHERE first_bin <= last_bin"),
)
def _(spark, sf_dir):
    return candidates.spans(model_bins(spark, sf_dir), BY, SEARCH)


FALLEN = "SELECT segment, candidate, CAST(band_order - 1 AS INTEGER) AS pair_index, least(change_m1_cnt, change_m3_cnt) AS depth FROM moved WHERE change_m1_cnt < 0 OR change_m3_cnt < 0"


@query("inversion_pairs", model_sql(f"SELECT *, row_number() OVER (PARTITION BY segment, candidate ORDER BY round(depth, 12), pair_index) = 1 AS deepest FROM ({FALLEN}) f", SCORES[0]), ["depth"])
def _(spark, sf_dir):
    return candidates.inversion_pairs(model_bins(spark, sf_dir), candidates.partitions(spark, NAMED), BY, SEARCH)


@query("worst_violators", model_sql("SELECT segment, candidate, band_order, first_bin, last_bin, violation_severity FROM judged WHERE NOT all_constraints_ok QUALIFY row_number() OVER (PARTITION BY segment, candidate ORDER BY round(violation_severity, 12) DESC, band_order) = 1"), ["violation_severity"])
def _(spark, sf_dir):
    bands = candidates.band_sums(model_bins(spark, sf_dir), candidates.partitions(spark, NAMED), BY)
    return candidates.worst_violators(candidates.constrained(bands, SEARCH), BY)


@query("selected_partitions", model_sql(f"SELECT v.segment, v.candidate, t.ranges, v.candidate_score FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY {RANK}) AS k FROM valued) v JOIN (SELECT candidate, '[' || string_agg('(' || first_bin || ',' || last_bin || ')', ', ' ORDER BY band_order) || ']' AS ranges FROM parts GROUP BY 1) t USING (candidate) WHERE k = 1", *SCORES), ["candidate_score"])
def _(spark, sf_dir):
    parts = candidates.partitions(spark, NAMED)
    best = candidates.scored(model_bins(spark, sf_dir), parts, BY, SEARCH).filter("selected")
    return best.join(candidates.texts(parts, ["candidate"]), "candidate").select(*BY, "candidate", "ranges", "candidate_score")


# The search itself: beyond SQL, replayed by brute force in the tests ---------------------------------


@query("search_by_model")
def _(spark, sf_dir):
    """What each model's search chose, among how many states."""
    states = search_states(model_bins(spark, sf_dir), BY, MODEL_SETTINGS)
    best = F.max(F.when(F.col("selected"), F.struct("ranges", "step_no", "stage", "hard_constraints_ok", "primary_iv_retention", "candidate_score")))
    return states.groupBy(*BY).agg(F.count(F.lit(1)).alias("states"), best.alias("best")).select(*BY, "states", "best.*")


@query("search_states_scored")
def _(spark, sf_dir):
    """Every state of each model's search, scored again as rows of partitions."""
    bins = model_bins(spark, sf_dir)
    states = search_states(bins, BY, MODEL_SETTINGS).withColumn("candidate", F.col("ranges"))
    return candidates.scored(bins, candidates.parsed(states, [*BY, "candidate"]), BY, SEARCH)
