"""Validation: AUC and KS, rank correlation, stability index, monotonicity, months, samples side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions.columns import ratio
from scoreloom.functions.ordering import RISING, Ordering
from scoreloom.operators.bands import NAMES, derived, sums
from scoreloom.operators.scan import ordered
from scoreloom.settings import HORIZONS


def auc_ks(df: DataFrame, score: str = "score_mlt", high_is_bad: bool = True) -> DataFrame:
    """n, counts, AUC (average ranks) and KS (ties together) by sample_group and label.

    Works on the histogram of scores, scanned in order by stretches, so no task sees a whole group.
    """
    s = F.col(score).cast("double") if high_is_bad else -F.col(score).cast("double")
    rows = df.filter(F.col("sample_group").isin("train", "oot") & F.col(score).isNotNull() & ~F.isnan(score))
    # All labels share one histogram. Those that are not known count no case, but keep their group in the result.
    counted = {f"{m}_{side}": F.count_if(F.col(h.label) == y) for m, h in zip(NAMES, HORIZONS) for side, y in (("b", 1), ("g", 0))}
    histogram = rows.withColumn("s", s).groupBy("sample_group", "s").agg(*[c.alias(n) for n, c in counted.items()])
    seen = ordered(histogram, ["sample_group"], "s", list(counted))

    def figures(m: str, label: str) -> Column:
        b, g, before_b, before_g, bads, goods = (F.col(f"{p}{m}_{side}") for p in ("", "before_", "total_") for side in ("b", "g"))
        rank = before_b + before_g + (b + g + 1) / 2
        gap = F.abs(ratio(before_b + b, bads) - ratio(before_g + g, goods))
        parts = {"n": F.sum(b + g), "bad_cnt": F.max(bads), "good_cnt": F.max(goods), "rank_sum": F.sum(b * rank), "gap": F.max(gap)}
        return F.struct(F.lit(label).alias("label"), *[c.alias(n) for n, c in parts.items()])

    tall = seen.groupBy("sample_group").agg(F.array(*[figures(m, h.label) for m, h in zip(NAMES, HORIZONS)]).alias("l"))
    out, group = tall.select("sample_group", F.inline("l")), ["sample_group", "label"]
    both = (F.col("bad_cnt") > 0) & (F.col("good_cnt") > 0)
    pairs = F.col("bad_cnt").cast("double") * F.col("good_cnt")
    auc = F.try_divide(F.col("rank_sum") - F.col("bad_cnt") * (F.col("bad_cnt").cast("double") + 1) / 2, pairs)
    return out.select(
        *group, "n", "bad_cnt", "good_cnt", ratio("bad_cnt", "n").alias("bad_rate"), F.when(both, auc).alias("auc"), F.when(both, F.col("gap")).alias("ks")
    )


def performance_wide(grid: DataFrame) -> DataFrame:
    """A row for each sample group, AUC and KS of each label side by side."""
    names = [h.label for h in HORIZONS]
    wide = grid.groupBy("sample_group").pivot("label", names).agg(F.first("auc").alias("auc"), F.first("ks").alias("ks"))
    return wide.select("sample_group", *[F.col(f"{h.label}_{m}").alias(f"{h.name}_{m}") for h in HORIZONS for m in ("auc", "ks")])


def _ranked(df: DataFrame, value: str, out: str) -> DataFrame:
    """(value, out): average rank of each distinct value."""
    h = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    return ordered(h, [], value, ["n"]).select(value, (F.col("before_n") + (F.col("n") + 1) / 2).alias(out))


def spearman(df: DataFrame, left: str, right: str) -> DataFrame:
    """One row: rank correlation of rows that have both values; null for less than two."""
    pairs = df.select(F.col(left).cast("double").alias("x"), F.col(right).cast("double").alias("y")).filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    counted = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("w"))
    ranked = counted.join(_ranked(pairs, "x", "rx"), "x").join(_ranked(pairs, "y", "ry"), "y")
    w, x, y = F.col("w").cast("double"), F.col("rx"), F.col("ry")
    s = ranked.agg(
        F.sum(w).alias("n"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"), F.sum(w * y * y).alias("syy"), F.sum(w * x * y).alias("sxy")
    )
    n = F.col("n")
    top = F.col("sxy") - F.col("sx") * F.col("sy") / n
    spread = (F.col("sxx") - F.col("sx") * F.col("sx") / n) * (F.col("syy") - F.col("sy") * F.col("sy") / n)
    return s.select(F.coalesce(n, F.lit(0.0)).cast("long").alias("n"), F.when(n > 1, F.try_divide(top, F.sqrt(spread))).alias("spearman"))


def psi(banded: DataFrame, bands: DataFrame, floor: float = 1e-6) -> DataFrame:
    """Stability by band of bands(band_order, band), with the total on every row."""
    count = lambda group: F.count_if(F.col("sample_group") == group).alias(f"{group}_n")
    return psi_of_counts(banded.filter("band_order is not null").groupBy("band_order").agg(count("train"), count("oot")), bands, floor)


def psi_of_counts(counts: DataFrame, bands: DataFrame, floor: float = 1e-6) -> DataFrame:
    """Stability by band from counts(band_order, train_n, oot_n), with the total on every row."""
    counts = counts.withColumnRenamed("band_order", "k")
    base = F.broadcast(bands.select("band_order", "band").distinct()).join(counts, F.col("band_order") == F.col("k"), "left").drop("k")
    whole = Window.partitionBy()
    out = base.withColumns({f"{g}_n": F.coalesce(f"{g}_n", F.lit(0)) for g in ("train", "oot")})
    out = out.withColumns({f"{g}_pct": ratio(F.col(f"{g}_n"), F.sum(f"{g}_n").over(whole)) for g in ("train", "oot")})
    a, b = (F.when(F.col(f"{g}_pct").isNotNull(), F.greatest(F.col(f"{g}_pct"), F.lit(floor))) for g in ("train", "oot"))
    return out.withColumn("psi_component", (b - a) * F.ln(b / a)).withColumn("psi_total", F.sum("psi_component").over(whole))


def psi_of_shares(base: DataFrame, other: DataFrame, key: str, floor: float = 1e-6) -> DataFrame:
    """One row: stability of sample_pct between two tables by key, with floor added to every share."""
    a = base.select(F.col(key), F.coalesce("sample_pct", F.lit(0.0)).alias("a"))
    b = other.select(F.col(key), F.coalesce("sample_pct", F.lit(0.0)).alias("b"))
    both = a.join(b, key, "full").select((F.coalesce("a", F.lit(0.0)) + floor).alias("a"), (F.coalesce("b", F.lit(0.0)) + floor).alias("b"))
    return both.agg(F.sum((F.col("b") - F.col("a")) * F.ln(F.col("b") / F.col("a"))).alias("psi"))


RATES = tuple(f"{m}_{c}_bad_rate" for m in NAMES for c in ("cnt", "amt"))


def monotonicity(stats: DataFrame, order: str = "band_order", rates: Sequence[str] = RATES, by: str = "sample_group", ordering: Ordering = RISING) -> DataFrame:
    """Per sample and rate: whether it never falls from safe to risky, how often it does, and at which bands."""
    w = ordering.window(order, by)
    checked = stats.filter(F.col(order).isNotNull()).select(by, order, *[F.coalesce(F.col(r) - F.lag(r).over(w) < 0, F.lit(False)).alias(r) for r in rates])
    tall = checked.select(by, order, F.explode(F.array(*[F.struct(F.lit(r).alias("metric"), F.col(r).alias("falls")) for r in rates])).alias("x"))
    out = tall.groupBy(by, "x.metric").agg(
        F.count_if("x.falls").alias("violation_cnt"),
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.when(F.col("x.falls"), F.col(order)))), lambda k: k.cast("string"))).alias("violation_bands"),
    )
    return out.withColumn("is_monotonic", F.col("violation_cnt") == 0)


def monthly(banded: DataFrame, tolerance: float = 0.003, ordering: Ordering = RISING) -> DataFrame:
    """Band statistics of each month from rows; shares and running totals stay within the month."""
    rows = banded.filter(F.col("sample_group").isin("train", "oot") & F.col("application_month").isNotNull() & F.col("band_order").isNotNull())
    by = ["sample_group", "application_month"]
    return with_changes(derived(sums(rows, *by, "band_order", "band"), "band_order", by, ordering), tolerance, ordering)


def with_changes(months: DataFrame, tolerance: float = 0.003, ordering: Ordering = RISING) -> DataFrame:
    """Band statistics of months with the main rate's change from the band before, and whether it falls."""
    by = ["sample_group", "application_month"]
    rate = F.col("m3_cnt_bad_rate")
    out = months.withColumn("primary_rate_diff_prev", rate - F.lag(rate).over(ordering.window("band_order", *by)))
    return out.withColumn("primary_inversion_flag", F.coalesce(F.col("primary_rate_diff_prev") < -tolerance, F.lit(False)))


def monthly_summary(months: DataFrame) -> DataFrame:
    out = months.groupBy("sample_group", "application_month").agg(
        F.sum("n").alias("n"),
        F.sum("m3_cnt_mature").alias("mature_count"),
        F.sum("m3_cnt_bad").alias("bad_count"),
        F.count_distinct("band").alias("band_count"),
        F.count_if("primary_inversion_flag").alias("primary_inversion_count"),
        F.max(F.when(F.col("primary_rate_diff_prev").isNotNull(), F.greatest(-F.col("primary_rate_diff_prev"), F.lit(0.0)))).alias("max_primary_rate_drop"),
    )
    return out.withColumns({"primary_bad_rate": ratio("bad_count", "mature_count"), "primary_monotonic_ok": F.col("primary_inversion_count") == 0})


COMPARED = ("n", "sample_pct", *(f"{m}_{c}" for m in NAMES for c in ("cnt_mature", "cnt_bad", "cnt_bad_rate", "amt_exposure", "amt_bad", "amt_bad_rate")))


def compare(train: DataFrame, oot: DataFrame, edges: DataFrame) -> DataFrame:
    """Each band's edges with its statistics in both samples."""
    sides = [s.select("band", *[F.col(c).alias(f"{c}_{g}") for c in COMPARED]) for s, g in ((train, "train"), (oot, "oot"))]
    both = sides[0].join(sides[1], "band", "full")
    return edges.select("band_order", "band", "merged_from", "extreme_role", "score_left", "score_right").join(both, "band", "left")
