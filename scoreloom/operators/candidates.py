"""Partitions of bins as rows: their bands, constraints, costs and scores, for many models in one plan.

A partition is a set of rows (candidate, band_order, first_bin, last_bin); it may also carry the model's
columns, and else holds for every model. Bands are differences of the bins' running sums, found by two equi-joins
on the bin, so bins are summed once however many partitions look at them. Everything after that is a window or a
sum within one candidate of one model, a few dozen rows. `scoreloom.plans.search` walks through the same
states for one model on the driver; here they are a table.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreloom.functions.columns import ratio
from scoreloom.functions.special import two_proportion_p, two_proportion_z
from scoreloom.operators.bands import sums
from scoreloom.operators.quantiles import quantiles_by
from scoreloom.settings import Floors, Policy, Search

RATES = ("m1_cnt", "m3_cnt", "m1_amt", "m3_amt")
PRIMARY = ("m1_cnt", "m3_cnt")
PARTS = {r: (f"{r}_bad", f"{r}_mature" if r.endswith("cnt") else f"{r}_exposure") for r in RATES}
SUMMED = ("n", *(c for parts in PARTS.values() for c in parts))

Ranges = Sequence[tuple[int, int]]


# Bins of many models -----------------------------------------------------------------------------


def edges_by(train: DataFrame, by: Sequence[str], score: str = "score_mlt", bins: int = 20) -> DataFrame:
    """(by, edges): each model's distinct interpolated quantiles with infinite ends."""
    found = quantiles_by(train, score, [k / bins for k in range(bins + 1)], by)
    rows = []
    for model, cuts in found.items():
        inner = sorted(set(cuts))[1:-1]
        rows.append((*model, [-math.inf, *inner, math.inf]))
    fields = ", ".join(f"`{c}` {dict(train.dtypes)[c]}" for c in by)
    return train.sparkSession.createDataFrame(rows, f"{fields}, edges array<double>")


def binned_by(df: DataFrame, edges: DataFrame, by: Sequence[str], score: str = "score_mlt") -> DataFrame:
    """df with bin_order by its model's edges, (left, right]; null without a score or a model."""
    inner = F.slice("edges", F.lit(2), F.size("edges") - 2)
    order = F.when(F.col(score).isNotNull(), F.size(F.filter(inner, lambda e: e < F.col(score))) + 1)
    # Without edges size() would be -1.
    return df.join(edges, list(by), "left").withColumn("bin_order", F.when(F.col("edges").isNotNull(), order).cast("int")).drop("edges")


def dense_bins(binned: DataFrame, edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, bin_order, SUMMED): a row for each interval of each model, zeros where no row fell."""
    every = edges.select(*by, F.explode(F.sequence(F.lit(1), F.size("edges") - 1)).alias("bin_order"))
    found = sums(binned.filter("bin_order is not null"), *by, "bin_order").select(*by, "bin_order", *SUMMED)
    joined = every.join(found, [*by, "bin_order"], "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0).cast(found.schema[c].dataType)) for c in SUMMED})


# Partitions --------------------------------------------------------------------------------------


def partitions(spark: SparkSession, named: Iterable[tuple[str, Ranges]]) -> DataFrame:
    """(candidate, band_order, first_bin, last_bin) of ranges by name."""
    rows = [(name, k, a, b) for name, ranges in named for k, (a, b) in enumerate(ranges, 1)]
    return spark.createDataFrame(rows, "candidate string, band_order int, first_bin int, last_bin int")


def parsed(df: DataFrame, keys: Sequence[str], text: str = "ranges") -> DataFrame:
    """partitions from range text, [(1,2), (3,5)], in a column; keys stay."""
    pairs = F.regexp_extract_all(text, F.lit(r"\((\d+), *(\d+)\)"), F.lit(0))
    out = df.select(*keys, F.posexplode(pairs).alias("k", "pair"))
    number = lambda g: F.regexp_extract("pair", r"\((\d+), *(\d+)\)", g).cast("int")
    return out.select(*keys, (F.col("k") + 1).cast("int").alias("band_order"), number(1).alias("first_bin"), number(2).alias("last_bin"))


def band_sums(bins: DataFrame, parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """The bands of every partition in every model: sums, the model's bins and rows, shares and rates."""
    by = list(by)
    model = Window.partitionBy(*by)
    up_to = model.orderBy("bin_order").rowsBetween(Window.unboundedPreceding, 0)
    running = bins.select(*by, "bin_order", F.max("bin_order").over(model).alias("bins"), F.sum("n").over(model).alias("total_n"), *[F.sum(c).over(up_to).alias(c) for c in SUMMED])
    shared = [c for c in by if c in parts.columns]
    ends = parts.join(running.withColumnRenamed("bin_order", "last_bin"), [*shared, "last_bin"])
    starts = running.select(*by, (F.col("bin_order") + 1).alias("first_bin"), *[F.col(c).alias(f"before_{c}") for c in SUMMED])
    both = ends.join(starts, [*by, "first_bin"], "left")
    out = both.withColumns({c: F.col(c) - F.coalesce(f"before_{c}", F.lit(0)) for c in SUMMED}).drop(*[f"before_{c}" for c in SUMMED])
    out = out.withColumns({f"{m}_good": F.col(f"{m}_mature") - F.col(f"{m}_bad") for m in PRIMARY})
    out = out.withColumns({"sample_pct": ratio("n", "total_n"), **{f"{r}_bad_rate": ratio(*PARTS[r]) for r in RATES}})
    own = Window.partitionBy(*by, "candidate")
    out = out.withColumns({"band_count": F.count(F.lit(1)).over(own).cast("int"), "reached": F.max("last_bin").over(own)})
    # A partition that does not end with the model's last bin is none of that model.
    return out.filter(F.col("reached") == F.col("bins")).drop("reached")


def _extremes(search: Search, bins: Column) -> dict[str, tuple[Column, Column, Column]]:
    """(first bin, last bin, the cut inside) of the bins at the good and the bad end that are kept apart."""
    if not search.protect_extremes:
        return {}
    low, high = (search.best_bins, search.worst_bins) if search.high_is_bad else (search.worst_bins, search.best_bins)
    names = ("best_extreme", "worst_extreme") if search.high_is_bad else ("worst_extreme", "best_extreme")
    ends = {names[0]: (F.lit(1), F.lit(low), F.lit(low)), names[1]: (bins - (high - 1), bins, bins - high)}
    return {k: v for k, v in ends.items() if (low if k == names[0] else high) >= 1}


def role(search: Search, first: Column, last: Column, bins: Column) -> Column:
    """best_extreme or worst_extreme for exactly those bins, contains_ before it for more than them."""
    found, parts = _extremes(search, bins), []
    for name in ("best_extreme", "worst_extreme"):
        if name in found:
            a, b, _ = found[name]
            parts.append(F.when((first == a) & (last == b), name).when((first <= b) & (last >= a), f"contains_{name}"))
    return F.concat_ws(",", *parts) if parts else F.lit("")


def extreme_cuts(search: Search, bins: Column) -> Column:
    """array of the cuts between the kept bins and the rest."""
    cuts = [F.when((cut >= 1) & (cut <= bins - 1), cut) for _, _, cut in _extremes(search, bins).values()]
    return F.array_distinct(F.array_compact(F.array(*cuts))) if cuts else F.array().cast("array<int>")


def constrained(bands: DataFrame, search: Search) -> DataFrame:
    """bands with their role, least share, mature, bad and good cases, a check of each, and the shares they lack."""
    f: Floors = search.floors
    own = role(search, F.col("first_bin"), F.col("last_bin"), F.col("bins"))
    tail = (F.col("band_order") == 1) | (F.col("band_order") == F.col("band_count"))
    by_role = lambda best, worst, rest: F.when(F.col("extreme_role") == "best_extreme", best).when(F.col("extreme_role") == "worst_extreme", worst).otherwise(rest)
    needs = {
        "sample_pct": F.when(tail, f.tail_share).otherwise(f.middle_share),
        "mature": by_role(f.extreme_mature, f.extreme_mature, f.mature),
        "bad": by_role(f.best_bad, f.worst_bad, f.bad),
        "good": by_role(f.best_good, f.worst_good, f.good),
    }
    have = {"sample_pct": "sample_pct", "mature": "m3_cnt_mature", "bad": "m3_cnt_bad", "good": "m3_cnt_good"}
    out = bands.withColumn("extreme_role", own).withColumns({f"required_{k}": c for k, c in needs.items()})
    checks = {f"{k}_ok": F.coalesce(F.col(have[k]) >= F.col(f"required_{k}"), F.lit(False)) for k in needs}
    lacks = [F.when(F.col(f"required_{k}") > 0, F.greatest(F.lit(0.0), 1 - ratio(have[k], f"required_{k}"))).otherwise(0.0) for k in needs]
    every = F.lit(True)
    for k in needs:
        every = every & F.col(f"{k}_ok")
    return out.withColumns({**checks, "violation_severity": sum(lacks, F.lit(0.0))}).withColumn("all_constraints_ok", every)


def _information(df: DataFrame, keys: Sequence[str], smoothing: float) -> DataFrame:
    """(keys, iv): smoothed information value over the rows of each key; null without bad or without good cases."""
    whole = Window.partitionBy(*keys)
    k = F.count(F.lit(1)).over(whole)
    share = lambda c: ratio(F.col(c) + smoothing, F.sum(c).over(whole) + smoothing * k)
    parts = df.select(*keys, "m3_cnt_bad", "m3_cnt_good", share("m3_cnt_bad").alias("b"), share("m3_cnt_good").alias("g"))
    some = (F.sum("m3_cnt_bad") > 0) & (F.sum("m3_cnt_good") > 0)
    return parts.groupBy(*keys).agg(F.when(some, F.sum((F.col("b") - F.col("g")) * F.ln(F.col("b") / F.col("g")))).alias("iv"))


def _change(rate: str, search: Search, w) -> Column:
    """How much worse a rate is than in the band before."""
    change = F.col(rate) - F.lag(rate).over(w)
    return change if search.high_is_bad else -change


def scored(bins: DataFrame, parts: DataFrame, by: Sequence[str], search: Search) -> DataFrame:
    """One row for each candidate of each model, with what the search judges by, its score, and the chosen one marked.

    Chosen is, within each model, the best by hard constraints, inversions of primary rates, violations,
    inversions of any rate, score, retained information and distance from the wanted band count, among candidates of an
    eligible band count if there are any; of equal ones the first by name.
    """
    keys = [*by, "candidate"]
    bands = constrained(band_sums(bins, parts, by), search)
    w = Window.partitionBy(*keys).orderBy("band_order")
    falls = lambda names: sum((F.coalesce((F.col(f"change_{r}") < -search.tolerance).cast("int"), F.lit(0)) for r in names), F.lit(0))
    cut = F.when(F.col("band_order") < F.col("band_count"), F.col("last_bin"))
    moved = bands.withColumns({f"change_{r}": _change(f"{r}_bad_rate", search, w) for r in RATES}).withColumn("cut", cut)
    out = moved.groupBy(*keys).agg(
        F.max("band_count").alias("band_count"),
        F.sum(falls(PRIMARY)).cast("int").alias("primary_inversion_cnt"),
        F.sum(falls(RATES)).cast("int").alias("all_inversion_cnt"),
        F.count_if(~F.col("all_constraints_ok")).cast("int").alias("constraint_violation_cnt"),
        F.size(F.array_except(F.first(extreme_cuts(search, F.col("bins"))), F.collect_set("cut"))).alias("extreme_cut_violation_cnt"),
        # least() and min() pass over what is unknown.
        F.min(F.least(*[F.col(f"change_{r}") for r in PRIMARY])).alias("least_adjacent_rate_diff"),
        F.min("sample_pct").alias("least_sample_pct"),
        *[F.min(f"m3_cnt_{c}").cast("double").alias(f"least_{c}_count") for c in ("mature", "bad", "good")],
    )
    single = bins.withColumn("m3_cnt_good", F.col("m3_cnt_mature") - F.col("m3_cnt_bad"))
    first = _information(single, by, search.smoothing).withColumnRenamed("iv", "first_iv")
    out = out.join(_information(bands, keys, search.smoothing), keys).join(first, list(by), "left")
    s = search
    kept = F.when(F.col("first_iv") != 0, ratio("iv", "first_iv"))
    eligible = F.col("band_count").between(s.least_bands, s.most_bands)
    hard = eligible & (F.col("primary_inversion_cnt") == 0) & (F.col("constraint_violation_cnt") == 0) & (F.col("extreme_cut_violation_cnt") == 0)
    out = out.withColumns({"primary_iv": F.col("iv"), "primary_iv_retention": kept, "eligible_band_count": eligible, "hard_constraints_ok": hard, "target_band_distance": F.abs(F.col("band_count") - s.target_bands)})
    score = (
        s.score_hard * F.col("hard_constraints_ok").cast("int")
        + s.score_primary_inversion * F.col("primary_inversion_cnt")
        + s.score_any_inversion * F.col("all_inversion_cnt")
        + s.score_violation * F.col("constraint_violation_cnt")
        + s.score_retention * F.least(F.greatest(F.coalesce("primary_iv_retention", F.lit(0.0)), F.lit(0.0)), F.lit(s.retention_cap))
        + s.score_separation * F.greatest(F.coalesce("least_adjacent_rate_diff", F.lit(0.0)), F.lit(0.0))
        + s.score_distance * F.col("target_band_distance")
        + s.score_crossed * F.col("extreme_cut_violation_cnt")
    )
    rank = Window.partitionBy(*by).orderBy(
        F.desc("eligible_band_count"), F.desc("hard_constraints_ok"), "primary_inversion_cnt", "constraint_violation_cnt", "all_inversion_cnt", F.desc("candidate_score"), F.desc_nulls_last("primary_iv_retention"), "target_band_distance", "candidate"
    )
    return out.withColumn("candidate_score", score).withColumn("selected", F.row_number().over(rank) == 1).drop("iv", "first_iv")


# Pairs and cuts ----------------------------------------------------------------------------------


def protected_cuts(bins: DataFrame, by: Sequence[str], search: Search, policy: Policy) -> DataFrame:
    """(by, cut, is_extreme, is_limit, is_jump): cuts worth keeping, each once, with why.

    At the extremes, at the policy's limits (after the last bin whose running rate is within a limit, before the first bin
    whose own rate is above one), and at the largest jumps of the main rate, the lower cut first of equal ones.
    """
    by = list(by)
    model = Window.partitionBy(*by)
    in_order = model.orderBy("bin_order")
    up_to = in_order.rowsBetween(Window.unboundedPreceding, 0)
    rate = ratio("m3_cnt_bad", "m3_cnt_mature")
    seen = bins.select(*by, "bin_order", F.max("bin_order").over(model).alias("bins"), rate.alias("rate"), ratio(F.sum("m3_cnt_bad").over(up_to), F.sum("m3_cnt_mature").over(up_to)).alias("cum_rate"))
    seen = seen.withColumn("jump", _change("rate", search, in_order))
    found = []
    for _, limits in policy.groups:
        if (most := limits.get("cum_m3_cnt_bad_rate")) is not None:
            found.append(F.max(F.when(F.col("cum_rate") <= most, F.col("bin_order"))))
        if (most := limits.get("marginal_m3_cnt_bad_rate")) is not None:
            found.append(F.min(F.when(F.col("rate") > most, F.col("bin_order"))) - 1)
    one = seen.groupBy(*by).agg(F.max("bins").alias("bins"), F.array_compact(F.array(*found)).alias("limits") if found else F.array().cast("array<int>").alias("limits"))
    reason = lambda cuts, name: one.select(*by, "bins", F.explode(cuts).alias("cut"), F.lit(name).alias("why"))
    largest = model.orderBy(F.desc_nulls_last("jump"), "bin_order")
    jumps = seen.filter("jump is not null").withColumn("k", F.row_number().over(largest)).filter(F.col("k") <= search.protect_jumps)
    every = reason(extreme_cuts(search, F.col("bins")), "extreme").unionByName(reason(F.col("limits"), "limit")).unionByName(jumps.select(*by, "bins", (F.col("bin_order") - 1).alias("cut"), F.lit("jump").alias("why")))
    inside = every.filter((F.col("cut") >= 1) & (F.col("cut") <= F.col("bins") - 1))
    return inside.groupBy(*by, "cut").agg(*[F.max(F.col("why") == w).alias(f"is_{w}") for w in ("extreme", "limit", "jump")])


def merged(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """parts with, for each neighbouring pair of bands, the partition in which they are one: pair_index is the left band."""
    keys = [c for c in keys if c in parts.columns]
    counted = parts.withColumn("last_band", F.max("band_order").over(Window.partitionBy(*keys, "candidate")))
    pairs = counted.filter("last_band > 1").withColumn("pair_index", F.explode(F.sequence(F.lit(1), F.col("last_band") - 1)))
    w = Window.partitionBy(*keys, "candidate", "pair_index").orderBy("band_order")
    longer = pairs.withColumn("last_bin", F.when(F.col("band_order") == F.col("pair_index"), F.lead("last_bin").over(w)).otherwise(F.col("last_bin")))
    kept = longer.filter(F.col("band_order") != F.col("pair_index") + 1)
    return kept.withColumn("band_order", F.when(F.col("band_order") > F.col("pair_index"), F.col("band_order") - 1).otherwise(F.col("band_order"))).drop("last_band")


def pair_costs(bins: DataFrame, parts: DataFrame, by: Sequence[str], search: Search, policy: Policy) -> DataFrame:
    """What it costs to merge each pair of neighbouring bands of each candidate of each model.

    100 times the rate gap, the chance that the rates differ, 10 times the information lost, and the price of
    protected cuts, by the settings' weights; cheapest_open marks the pair that the search would take: the least cost among
    cuts that are not blocked, of equal ones the first.
    """
    by = list(by)
    keys = [*by, "candidate"]
    bands = band_sums(bins, parts, by)
    w = Window.partitionBy(*keys).orderBy("band_order")
    after = lambda c: F.lead(c).over(w)
    names = ("m3_cnt_bad", "m3_cnt_mature", *(f"{r}_bad_rate" for r in PRIMARY))
    pairs = bands.withColumns({f"next_{c}": after(c) for c in names}).filter(F.col("band_order") < F.col("band_count"))
    gap = F.coalesce(F.greatest(*[F.abs(F.col(f"{r}_bad_rate") - F.col(f"next_{r}_bad_rate")) for r in PRIMARY]), F.lit(0.0))
    cases = ("m3_cnt_bad", "m3_cnt_mature", "next_m3_cnt_bad", "next_m3_cnt_mature")
    pairs = pairs.select(
        *keys,
        F.col("band_order").alias("pair_index"),
        F.col("last_bin").alias("cut"),
        F.col("m3_cnt_bad_rate").alias("left_rate"),
        F.col("next_m3_cnt_bad_rate").alias("right_rate"),
        gap.alias("rate_gap"),
        two_proportion_z(*cases).alias("z"),
        two_proportion_p(*cases).alias("p_value"),
    )
    now = _information(bands, keys, search.smoothing).withColumnRenamed("iv", "iv_now")
    # In a merged partition the pair is part of the name, so that each is a candidate of its own.
    less = merged(parts, by).withColumns({"of": F.col("candidate"), "candidate": F.concat_ws("#", "candidate", "pair_index")})
    then = _information(band_sums(bins, less, by), [*by, "of", "pair_index"], search.smoothing).select(*by, F.col("of").alias("candidate"), "pair_index", F.col("iv").alias("iv_then"))
    kept = protected_cuts(bins, by, search, policy).select(*by, "cut", F.lit(True).alias("is_protected"), "is_extreme")
    out = pairs.join(now, keys).join(then, [*keys, "pair_index"]).join(kept, [*by, "cut"], "left")
    out = out.withColumns({"is_protected": F.coalesce("is_protected", F.lit(False)), "is_extreme": F.coalesce("is_extreme", F.lit(False)), "iv_loss": F.coalesce(F.greatest(F.lit(0.0), F.col("iv_now") - F.col("iv_then")), F.lit(0.0))})
    out = out.withColumn("iv_loss", F.when(F.col("iv_now").isNotNull() & F.col("iv_then").isNotNull(), F.col("iv_loss")).otherwise(0.0))
    price = search.protected_cost * F.col("is_protected").cast("int") + search.extreme_cost * F.col("is_extreme").cast("int")
    cost = search.gap_cost * F.col("rate_gap") + (1 - F.coalesce("p_value", F.lit(0.0))) + search.iv_cost * F.col("iv_loss") + price
    blocked = F.lit(False) if search.may_cross_extremes else F.col("is_extreme")
    out = out.withColumns({"merge_cost": cost, "is_blocked": blocked})
    cheapest = Window.partitionBy(*keys).orderBy(F.col("is_blocked"), F.round("merge_cost", 10), F.col("pair_index"))
    return out.withColumn("cheapest_open", (F.row_number().over(cheapest) == 1) & ~F.col("is_blocked")).drop("iv_now", "iv_then")


# What else the search looks at ------------------------------------------------------------------------


def texts(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ranges): the partitions as text, [(1,2), (3,5)], which parsed() reads again."""
    one = F.format_string("(%d,%d)", "first_bin", "last_bin")
    listed = F.array_sort(F.collect_list(F.struct("band_order", one.alias("text"))))
    return parts.groupBy(*keys).agg(F.concat(F.lit("["), F.array_join(listed["text"], ", "), F.lit("]")).alias("ranges"))


def overlaps(first: Column, last: Column, other_first: Column, other_last: Column) -> Column:
    """Whether two closed stretches of bins share one."""
    return (first <= other_last) & (other_first <= last)


def spans(bins: DataFrame, by: Sequence[str], search: Search) -> DataFrame:
    """Every stretch of neighbouring bins of each model: its role, which kept ends it touches, and the cuts of them that it crosses."""
    by = list(by)
    count = bins.groupBy(*by).agg(F.max("bin_order").alias("bins"))
    every = count.withColumn("first_bin", F.explode(F.sequence(F.lit(1), F.col("bins")))).withColumn("last_bin", F.explode(F.sequence(F.col("first_bin"), F.col("bins"))))
    first, last, k = F.col("first_bin"), F.col("last_bin"), F.col("bins")
    ends = _extremes(search, k)
    touched = {f"touches_{n}": overlaps(first, last, *ends[n][:2]) if n in ends else F.lit(False) for n in ("best_extreme", "worst_extreme")}
    crossed = F.size(F.filter(extreme_cuts(search, k), lambda c: (c >= first) & (c < last)))
    return every.withColumns({"extreme_role": role(search, first, last, k), **touched, "crossed_cuts": crossed}).drop("bins")


def inversion_pairs(bins: DataFrame, parts: DataFrame, by: Sequence[str], search: Search) -> DataFrame:
    """Neighbouring bands between which a primary rate falls by more than the tolerance, how deep, and the deepest of each candidate, the first of equal ones."""
    keys = [*by, "candidate"]
    w = Window.partitionBy(*keys).orderBy("band_order")
    moved = band_sums(bins, parts, by).withColumns({f"change_{r}": _change(f"{r}_bad_rate", search, w) for r in PRIMARY})
    fallen = [F.coalesce(F.col(f"change_{r}") < -search.tolerance, F.lit(False)) for r in PRIMARY]
    rows = moved.filter(fallen[0] | fallen[1]).select(*keys, (F.col("band_order") - 1).alias("pair_index"), F.least(*[F.col(f"change_{r}") for r in PRIMARY]).alias("depth"))
    return rows.withColumn("deepest", F.row_number().over(Window.partitionBy(*keys).orderBy(F.round("depth", 12), "pair_index")) == 1)


def worst_violators(constrained_: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of each candidate the band that lacks most of what it needs, the first of equal ones; none where all bands meet their floors."""
    keys = [*by, "candidate"]
    rank = Window.partitionBy(*keys).orderBy(F.desc(F.round("violation_severity", 12)), "band_order")
    short = constrained_.filter(~F.col("all_constraints_ok")).withColumn("k", F.row_number().over(rank)).filter("k = 1")
    return short.select(*keys, "band_order", "first_bin", "last_bin", "violation_severity")
