"""Equal-frequency edges: exact interpolated quantiles by selection over the leading bits of values."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions.keys import BITS, double_of, leading, with_key
from scoreloom.functions.ordering import RISING, Ordering

#: Bits that a pass tells apart, so that it counts at most 65,536 of them in each stretch that is asked for.
STEP = 16
#: Rows of all asked stretches together from which on their values are counted one by one.
FEW = 100_000


def quantiles_by(df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = ()) -> dict[tuple, list[float]]:
    """Linearly interpolated quantiles of each group, exactly as percentile() has them; a group without values has none.

    A pass counts values by some more leading bits of their keys, within the stretches that hold a wanted rank, and keeps
    those that still do: two for each share at most, so groups times shares rows come to the driver. It ends when the
    stretches hold few rows, or after four passes, when all bits are known.
    """
    by, count = list(by), len(by)
    rows = with_key(df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, value), F.col(value), "__key").select(*by, "__key")
    asked: list[tuple] | None = None
    shares = [float(q) for q in shares]
    sizes: dict[tuple, int] = {}
    kinds = [rows.schema[c] for c in by]
    bits = 0
    while bits < BITS:
        last = asked is not None and sum(t[-2] for t in asked) <= FEW
        more = BITS if last else bits + STEP
        if asked is None:
            counted = rows.groupBy(*by, leading(F.col("__key"), more).alias("__at")).agg(F.count(F.lit(1)).alias("__n"))
            group = Window.partitionBy(*by)
            n = F.sum("__n").over(group)
            ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor((n - 1) * q), F.ceil((n - 1) * q)) for q in shares])))
            counted = counted.withColumns({"__size": n, "__ranks": ranks, "__base": F.lit(0).cast("long")})
            within = group.orderBy("__at")
        else:
            schema = ", ".join([*(f"`{k.name}` {k.dataType.simpleString()}" for k in kinds), "__from long, __base long, __rows long, __ranks array<bigint>, __stretch int"])
            targets = df.sparkSession.createDataFrame([(*t, k) for k, t in enumerate(asked)], schema)
            same = leading(F.col("__key"), bits) == F.col("__from")
            for c in by:
                same &= F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}"))
            # Two rows for each share and group at most; rows are counted by numbers alone.
            met = rows.alias("r").join(F.broadcast(targets.alias("t")), same).select("__stretch", leading(F.col("__key"), more).alias("__at"))
            counted = met.groupBy("__stretch", "__at").agg(F.count(F.lit(1)).alias("__n")).withColumn("__size", F.lit(0).cast("long"))
            counted = counted.join(F.broadcast(targets), "__stretch")
            within = Window.partitionBy("__stretch").orderBy("__at")
        before = F.col("__base") + F.coalesce(F.sum("__n").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = counted.withColumn("__before", before)
        hit = F.filter("__ranks", lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__n")))
        found = placed.select(*by, "__at", "__before", "__n", "__size", hit.alias("__hit")).filter(F.size("__hit") > 0).collect()
        if asked is None:
            sizes = {tuple(r[:count]): r["__size"] for r in found}
        asked = [(*r[:count], r["__at"], r["__before"], r["__n"], r["__hit"]) for r in found]
        bits = more
    values: dict[tuple, dict[int, float]] = {}
    for t in asked or []:
        values.setdefault(tuple(t[:count]), {}).update(dict.fromkeys(t[-1], double_of(t[count])))
    return {g: [_between(values[g], q * (n - 1)) for q in shares] for g, n in sizes.items()}


def _between(values: dict[int, float], place: float) -> float:
    """The value at a place between two ranks."""
    low, high = math.floor(place), math.ceil(place)
    a, b = values[low], values[high]
    return a if low == high or a == b else (high - place) * a + (place - low) * b


def exact_quantiles(df: DataFrame, value: str, shares: Sequence[float]) -> list[float]:
    """Linearly interpolated quantiles of all values; empty without any."""
    return quantiles_by(df, value, shares).get((), [])


def equal_frequency_edges(train: DataFrame, score: str = "score_mlt", bins: int = 20, ordering: Ordering = RISING) -> tuple[float, ...]:
    """Distinct quantile edges with infinite ends; fails if less than two are left.

    Ranks are counted from the safe end: a share times the rows is rounded, so that counted from the other end
    an edge may lie just beside the score that it else is.
    """
    shares = [k / bins for k in range(bins + 1)]
    if ordering.high_is_bad:
        found = exact_quantiles(train, score, shares)
    else:
        found = [0.0 - x for x in exact_quantiles(train.select((-F.col(score)).alias(score)), score, shares)]
    inner = sorted(set(found))
    if len(inner) < 2:
        raise ValueError("fewer than two distinct edges")
    return (-math.inf, *inner[1:-1], math.inf)


def require_bins(edges: Sequence[float], least: int) -> None:
    if len(edges) - 1 < least:
        raise ValueError(f"{len(edges) - 1} bins, but at least {least} are needed")


def edge_table(spark, edges: Sequence[float]) -> DataFrame:
    """(bin_order, bin, score_left, score_right)."""
    rows = [(k, f"B{k:02d}", float(a), float(b)) for k, (a, b) in enumerate(zip(edges, edges[1:]), 1)]
    return spark.createDataFrame(rows, "bin_order int, bin string, score_left double, score_right double")
