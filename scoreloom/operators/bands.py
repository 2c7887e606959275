"""Statistics by bin and band: additive sums, derived rates, running totals, diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions.columns import ADDITIVE, Ranges, additive, band_letter, band_order, bin_label, extreme_role, ratio, source_text, wilson
from scoreloom.functions.ordering import RISING, Ordering
from scoreloom.operators.quantiles import edge_table
from scoreloom.settings import HORIZONS, Search

NAMES = tuple(h.name for h in HORIZONS)


def with_bins(df: DataFrame, edges: Sequence[float], score: str = "score_mlt", ordering: Ordering = RISING) -> DataFrame:
    """Adds bin_order and bin; a null score has neither."""
    return df.withColumn("bin_order", ordering.bucket(score, edges)).withColumn("bin", bin_label("bin_order"))


def with_bands(df: DataFrame, ranges: Ranges) -> DataFrame:
    """Adds band_order and band to binned rows."""
    return df.withColumn("band_order", band_order("bin_order", ranges)).withColumn("band", band_letter("band_order"))


def sums(df: DataFrame, *by: str, score: str = "score_mlt") -> DataFrame:
    """Additive statistics and score extent of each group; null keys are a group."""
    s = F.col(score)
    return df.groupBy(*by).agg(
        *additive(), F.min(s).alias("score_min"), F.max(s).alias("score_max"), F.coalesce(F.sum(s), F.lit(0.0)).alias("score_sum"), F.count(s).alias("score_n")
    )


def derived(stats: DataFrame, order: str, by: Sequence[str] = (), ordering: Ordering = RISING) -> DataFrame:
    """Adds good counts, shares, rates, intervals and running totals from safe to risky within by."""
    whole = Window.partitionBy(*by)
    up_to = ordering.window(order, *by).rowsBetween(Window.unboundedPreceding, 0)
    summed = ["n", *(f"{m}_{c}" for m in NAMES for c in ("cnt_mature", "cnt_bad", "amt_exposure", "amt_bad"))]
    running = {"total_n": F.sum("n").over(whole), **{f"cum_{c}": F.sum(c).over(up_to) for c in summed}}
    shares = {"sample_pct": ratio("n", "total_n"), "cum_pass_rate": ratio("cum_n", "total_n")}
    for m in NAMES:
        shares[f"{m}_cnt_good"] = F.col(f"{m}_cnt_mature") - F.col(f"{m}_cnt_bad")
    if "score_sum" in stats.columns:
        shares["score_mean"] = ratio("score_sum", "score_n")
    return stats.withColumns(running).withColumns({**shares, **rates(""), **rates("cum_")}).drop("score_sum", "score_n")


def rates(prefix: str) -> dict[str, Column]:
    """Bad rates and intervals from counts and amounts whose names begin with prefix."""
    out = {}
    for m in NAMES:
        p = f"{prefix}{m}"
        low, high = wilson(f"{p}_cnt_bad", f"{p}_cnt_mature")
        out |= {f"{p}_cnt_bad_rate": ratio(f"{p}_cnt_bad", f"{p}_cnt_mature"), f"{p}_cnt_bad_rate_ci_low": low, f"{p}_cnt_bad_rate_ci_high": high}
        out[f"{p}_amt_bad_rate"] = ratio(f"{p}_amt_bad", f"{p}_amt_exposure")
    return out


def bin_stats(binned: DataFrame, ordering: Ordering = RISING) -> DataFrame:
    """Every bin, the one without a score too."""
    return derived(sums(binned, "bin_order", "bin"), "bin_order", ordering=ordering)


def dense_bin_sums(binned: DataFrame, edges: Sequence[float]) -> DataFrame:
    """A row for each interval between edges, zeros where no row fell."""
    table = edge_table(binned.sparkSession, edges)
    found = sums(binned.filter("bin_order is not null"), "bin_order").withColumnRenamed("bin_order", "k")
    joined = F.broadcast(table).join(found, F.col("bin_order") == F.col("k"), "left").drop("k")
    return joined.withColumns({c: F.coalesce(c, F.lit(0).cast(found.schema[c].dataType)) for c in (*ADDITIVE, "score_sum", "score_n")})


def dense_bin_stats(binned: DataFrame, edges: Sequence[float], ordering: Ordering = RISING) -> DataFrame:
    return derived(dense_bin_sums(binned, edges), "bin_order", ordering=ordering)


def regroup_sums(bin_sums: DataFrame, ranges: Ranges) -> DataFrame:
    """Band sums from bin sums; nothing is read from raw rows again."""
    ends = {"first_bin": F.min("bin_order"), "last_bin": F.max("bin_order"), "score_left": F.min_by("score_left", "bin_order"), "score_right": F.max_by("score_right", "bin_order")}
    added = {c: F.sum(c) for c in (*ADDITIVE, "score_sum", "score_n")}
    extent = {"score_min": F.min("score_min"), "score_max": F.max("score_max")}
    out = with_bands(bin_sums, ranges).filter("band_order is not null").groupBy("band_order", "band")
    out = out.agg(*[c.alias(n) for n, c in {**ends, **added, **extent}.items()])
    return out.withColumn("merged_from", source_text(F.col("first_bin"), F.col("last_bin")))


def regroup(bin_sums: DataFrame, ranges: Ranges, ordering: Ordering = RISING) -> DataFrame:
    """Band statistics from bin sums."""
    return derived(regroup_sums(bin_sums, ranges), "band_order", ordering=ordering)


def band_stats(banded: DataFrame, ordering: Ordering = RISING) -> DataFrame:
    return derived(sums(banded, "band_order", "band"), "band_order", ordering=ordering)


def band_map(spark, ranges: Ranges) -> DataFrame:
    """(bin_order, bin, band_order, band, merged_from) for each bin of the ranges."""
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(ranges, 1)], "band_order int, first int, last int")
    return rows.select(
        F.explode(F.sequence("first", "last")).alias("bin_order"), "band_order", source_text(F.col("first"), F.col("last")).alias("merged_from")
    ).select("bin_order", bin_label("bin_order").alias("bin"), "band_order", band_letter("band_order").alias("band"), "merged_from")


def band_edges(edges: DataFrame, ranges: Ranges, search: Search = Search()) -> DataFrame:
    """Each band's interval, source bins and role at the ends of the scale."""
    bins = ranges[-1][1]
    out = with_bands(edges, ranges).groupBy("band_order", "band").agg(
        F.min("bin_order").alias("first_bin"),
        F.max("bin_order").alias("last_bin"),
        F.min_by("score_left", "bin_order").alias("score_left"),
        F.max_by("score_right", "bin_order").alias("score_right"),
    )
    first, last = F.col("first_bin"), F.col("last_bin")
    role = extreme_role(first, last, bins, search.best_bins, search.worst_bins, search.high_is_bad) if search.protect_extremes else F.lit("")
    return out.withColumns({"merged_from": source_text(first, last), "extreme_role": role})


def diagnostics(stats: DataFrame, order: str, smoothing: float = 0.5, ordering: Ordering = RISING) -> DataFrame:
    """Adds smoothed class shares, weight of evidence, IV parts, IV, and the KS curve from the risky end."""
    whole = Window.partitionBy()
    down = ordering.window(order).rowsBetween(0, Window.unboundedFollowing)
    shares, woe, parts, totals = {}, {}, {}, {}
    for m in NAMES:
        sums_ = {side: F.sum(f"{m}_cnt_{side}").over(whole) for side in ("bad", "good")}
        for side, total in sums_.items():
            shares[f"{m}_{side}_distribution"] = ratio(F.col(f"{m}_cnt_{side}") + smoothing, total + smoothing * F.count(F.lit(1)).over(whole))
        tops = [ratio(F.sum(f"{m}_cnt_{side}").over(down), total) for side, total in sums_.items()]
        shares[f"{m}_ks_curve"] = F.abs(tops[0] - tops[1])
        shares[f"__{m}_some"] = (sums_["bad"] > 0) & (sums_["good"] > 0)
        bad, good = F.col(f"{m}_bad_distribution"), F.col(f"{m}_good_distribution")
        woe[f"{m}_woe"] = F.ln(ratio(bad, good))
        parts[f"{m}_iv_component"] = (bad - good) * F.col(f"{m}_woe")
        totals[f"{m}_iv"] = F.when(F.col(f"__{m}_some"), F.sum(f"{m}_iv_component").over(whole))
    out = stats.withColumns(shares).withColumns(woe).withColumns(parts).withColumns(totals)
    return out.drop(*[f"__{m}_some" for m in NAMES])


def process_table(bin_stats_: DataFrame, ranges: Ranges, search: Search = Search()) -> DataFrame:
    """Initial bins with rate changes from safe to risky, inversions, the band they went to and how."""
    w = Ordering(search.high_is_bad).window("bin_order")
    out = with_bands(bin_stats_, ranges)
    spans = F.broadcast(band_map(bin_stats_.sparkSession, ranges).select("bin_order", "merged_from"))
    out = out.join(spans, "bin_order", "left")
    for m in NAMES:
        change = F.col(f"{m}_cnt_bad_rate") - F.lag(f"{m}_cnt_bad_rate").over(w)
        out = out.withColumn(f"{m}_rate_diff_prev", change)
        out = out.withColumn(f"{m}_inversion_flag", F.coalesce(F.col(f"{m}_rate_diff_prev") < 0, F.lit(False)))
    one = F.col("bin_order")
    return out.withColumns(
        {
            "extreme_role": extreme_role(one, one, ranges[-1][1], search.best_bins, search.worst_bins, search.high_is_bad),
            "merge_action": F.when(F.coalesce(F.contains("merged_from", F.lit("-")), F.lit(False)), "merged").otherwise("kept"),
        }
    )


def intervals(bin_sums: DataFrame) -> DataFrame:
    """Every stretch of neighbouring bins with its counts, from prefix sums; bins are at most a few dozen."""
    w = Window.orderBy("bin_order").rowsBetween(Window.unboundedPreceding, 0)
    cols = ("n", *(f"{m}_cnt_{c}" for m in NAMES for c in ("mature", "bad")))
    prefix = bin_sums.select("bin_order", *cols, *[F.sum(c).over(w).alias(f"to_{c}") for c in cols])
    start = prefix.select(F.col("bin_order").alias("first_bin"), *[(F.col(f"to_{c}") - F.col(c)).alias(f"from_{c}") for c in cols])
    end = prefix.select(F.col("bin_order").alias("last_bin"), *[f"to_{c}" for c in cols])
    pairs = F.broadcast(start).join(end, F.col("first_bin") <= F.col("last_bin"))
    out = pairs.select("first_bin", "last_bin", *[(F.col(f"to_{c}") - F.col(f"from_{c}")).alias(c) for c in cols])
    return out.withColumns({f"{m}_cnt_bad_rate": ratio(f"{m}_cnt_bad", f"{m}_cnt_mature") for m in NAMES})


def oriented(rate: str, high_is_bad: bool = True) -> Column:
    return F.col(rate) if high_is_bad else -F.col(rate)


def inversions(stats: DataFrame, order: str, rates: Sequence[str], tolerance: float = 0.0, high_is_bad: bool = True) -> DataFrame:
    """One row: how often the rates fall from a band to the next by more than tolerance."""
    w = Window.orderBy(order)
    falls = [F.coalesce((oriented(r, high_is_bad) - F.lag(oriented(r, high_is_bad)).over(w) < -tolerance).cast("int"), F.lit(0)) for r in rates]
    return stats.select(sum(falls, F.lit(0)).alias("falls")).agg(F.coalesce(F.sum("falls"), F.lit(0)).alias("inversions"))
