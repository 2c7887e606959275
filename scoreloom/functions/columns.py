"""Column builders: null-safe arithmetic, intervals, maturity, buckets, roles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.settings import APPROVED_FIRST, AUTO_PHRASE, HORIZONS, INCOMPLETE, MANUAL_PHRASE, OPENED, Horizon

Ranges = Sequence[tuple[int, int]]


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(top: Column | str, bottom: Column | str) -> Column:
    """top / bottom as double; null where bottom is 0 or either is null."""
    return F.try_divide(as_col(top).cast("double"), as_col(bottom).cast("double"))


def clean_double(c: Column | str) -> Column:
    """A number from anything that reads as one; NaN and unreadable become null."""
    value = as_col(c)
    text = F.trim(value.cast("string"))
    number = F.when(text.rlike(r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|[iI]nf(inity)?)$"), text.try_cast("double"))
    return F.when(~F.isnan(number), number)


def wilson(bad: Column | str, mature: Column | str, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson score interval of bad / mature, within 0 and 1; null without mature cases."""
    n, p = as_col(mature).cast("double"), ratio(bad, mature)
    z2 = z * z
    shrink = 1 + F.try_divide(F.lit(z2), n)
    centre = F.try_divide(p + F.try_divide(F.lit(z2), 2 * n), shrink)
    half = F.try_divide(z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z2), 4 * n * n)), shrink)
    some = n > 0
    return F.when(some, F.greatest(F.lit(0.0), centre - half)), F.when(some, F.least(F.lit(1.0), centre + half))


def count_if(test: Column) -> Column:
    """How many rows pass, 0 over none."""
    return F.count_if(test).cast("long")


#: Flags that one number holds.
FLAGS = 62


def distinct_flags(df: DataFrame, keys: Sequence[str], entity: str, flags: dict[str, Column]) -> DataFrame:
    """(keys, flags): of how many distinct values of entity some row has each flag.

    The rows of a value meet first, their flags as bits of a few numbers, so that one narrow shuffle counts all flags.
    """
    lots = [list(flags.items())[k : k + FLAGS] for k in range(0, len(flags), FLAGS)]
    masks = [reduce(add, [F.when(c, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, (_, c) in enumerate(lot)]) for lot in lots]
    each = df.groupBy(*keys, entity).agg(*[F.bit_or(m).alias(f"__flags{k}") for k, m in enumerate(masks)])
    counts = [F.count_if(F.col(f"__flags{k}").bitwiseAND(F.lit(1 << j)) != 0).alias(n) for k, lot in enumerate(lots) for j, (n, _) in enumerate(lot)]
    return (each.groupBy(*keys) if keys else each).agg(*counts)


def is_mature(h: Horizon) -> Column:
    return F.coalesce(F.col(h.label).isin(0, 1), F.lit(False))


def is_bad(h: Horizon) -> Column:
    return F.coalesce(F.col(h.label) == 1, F.lit(False))


def exposure(h: Horizon) -> Column:
    """Principal of a loan whose days past due are known, else 0."""
    return F.when(F.col(h.dpd).isNotNull(), F.coalesce("principal", F.lit(0.0))).otherwise(0.0)


def bad_amount(h: Horizon) -> Column:
    """What remained of a loan that was 30 or more days late, else 0."""
    return F.when(F.coalesce(F.col(h.dpd) >= 30, F.lit(False)), F.coalesce(h.remaining, F.lit(0.0))).otherwise(0.0)


def additive() -> list[Column]:
    """Sums that any regrouping of rows can add up again."""
    out = [F.count("application_id").alias("n"), F.coalesce(F.sum(F.coalesce("principal", F.lit(0.0))), F.lit(0.0)).alias("principal_amt")]
    for h in HORIZONS:
        out += [
            count_if(is_mature(h)).alias(f"{h.name}_cnt_mature"),
            count_if(is_bad(h)).alias(f"{h.name}_cnt_bad"),
            F.coalesce(F.sum(exposure(h)), F.lit(0.0)).alias(f"{h.name}_amt_exposure"),
            F.coalesce(F.sum(bad_amount(h)), F.lit(0.0)).alias(f"{h.name}_amt_bad"),
        ]
    return out


ADDITIVE = ("n", "principal_amt", *(f"{h.name}_{m}" for h in HORIZONS for m in ("cnt_mature", "cnt_bad", "amt_exposure", "amt_bad")))


def steps(value: Column, cuts: Sequence[float], at_too: bool = False) -> Column:
    """How many of the ascending cuts lie below value, or at it if at_too, by halving."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        cut = F.lit(float(cuts[middle]))
        return F.when(value >= cut if at_too else value > cut, tree(middle + 1, high)).otherwise(tree(low, middle))

    return tree(0, len(cuts))


def bucket(score: Column | str, edges: Sequence[float]) -> Column:
    """1 + the number of inner edges below score: intervals (left, right]; null stays null."""
    s = as_col(score)
    return F.when(s.isNotNull(), steps(s, edges[1:-1]) + 1).cast("int")


def bin_label(order: Column | str) -> Column:
    """B01, B02 and so on; null stays null."""
    return F.when(as_col(order).isNotNull(), F.format_string("B%02d", as_col(order)))


def band_order(bin_order: Column | str, ranges: Ranges) -> Column:
    """Position from 1 of the range that holds a bin; null outside all."""
    of = {b: k for k, (first, last) in enumerate(ranges, 1) for b in range(first, last + 1)}
    # One lookup, so that the bin's own expression is not repeated for every range.
    places = F.array(*[F.lit(of.get(b)).cast("int") for b in range(max(of) + 1)])
    return F.get(places, as_col(bin_order))


def band_letter(order: Column | str) -> Column:
    """A, B, C and so on; null stays null."""
    return F.chr(as_col(order) + 64)


def source_text(first: Column, last: Column) -> Column:
    """B03 or B03-B05."""
    return F.when(first == last, bin_label(first)).otherwise(F.concat(bin_label(first), F.lit("-"), bin_label(last)))


def extreme_role(first: Column, last: Column, bins: int, best: int = 1, worst: int = 1, high_is_bad: bool = True) -> Column:
    """best_extreme or worst_extreme for exactly those bins, contains_ before it for more than them."""
    low, high = ((1, best), (bins - worst + 1, bins)) if high_is_bad else ((bins - best + 1, bins), (1, worst))
    parts = []
    for role, (a, b) in (("best_extreme", low), ("worst_extreme", high)):
        if b >= a >= 1:
            exact = (first == a) & (last == b)
            parts.append(F.when(exact, role).when((first <= b) & (last >= a), f"contains_{role}"))
    return F.concat_ws(",", *parts) if parts else F.lit("")


def is_incomplete(c: Column | str = "application_status") -> Column:
    """A null status is not incomplete."""
    return F.coalesce(as_col(c).isin(*INCOMPLETE), F.lit(False))


def funnel_flags() -> dict[str, Column]:
    """Steps of the historical funnel; a deal does not need an approval."""
    status = F.col("application_status")
    approved = F.coalesce(F.substring(status, 1, 1).isin(*APPROVED_FIRST), F.lit(False))
    says = lambda phrase: F.coalesce(F.col("assessment_status").contains(phrase), F.lit(False))
    return {
        "apply": F.lit(True),
        "completed": status.isNotNull() & ~is_incomplete(status),
        "approved": approved,
        "auto": approved & says(AUTO_PHRASE),
        "manual": approved & says(MANUAL_PHRASE),
        "deal": F.coalesce(F.col("status").isin(*OPENED), F.lit(False)),
    }
