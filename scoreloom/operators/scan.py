"""Running sums over values in order, with no task that sees all values and no sampled cuts.

Values are cut into stretches by the leading bits of their order-preserving keys: up to 4,096 stretches for each power of
two, so their number grows with the distinct values. A stretch's start is the sum over the stretches before it within the
same 16 leading bits, and over the 16-bit ones before: at most 256 and at most 65,536 rows are put in order at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions.keys import leading, with_key

TOP, STRETCH = 16, 24


def ordered(rows: DataFrame, by: Sequence[str], value: str, sums: Sequence[str]) -> DataFrame:
    """rows(by, value, sums), each value once in its group, with before_<c>, the sum over all smaller values, and total_<c>."""
    by = list(by)
    rows = rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    placed = with_key(rows, F.col(value), "__key").withColumn("__part", leading(F.col("__key"), STRETCH)).drop("__key")
    names = lambda prefix: [f"__{prefix}_{c}" for c in sums]
    parts = placed.groupBy(*by, "__part").agg(*[F.sum(c).alias(n) for c, n in zip(sums, names("own"))]).withColumn("__top", F.shiftright("__part", STRETCH - TOP))
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sum_of = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    inner = so_far(Window.partitionBy(*by, "__top").orderBy("__part"))
    parts = parts.withColumns({n: sum_of(o, inner) for o, n in zip(names("own"), names("in"))})
    tops = parts.groupBy(*by, "__top").agg(*[F.sum(o).alias(n) for o, n in zip(names("own"), names("all"))])
    outer, whole = so_far(Window.partitionBy(*by).orderBy("__top")), Window.partitionBy(*by)
    tops = tops.select(*by, "__top", *[sum_of(a, outer).alias(n) for a, n in zip(names("all"), names("up"))], *[F.sum(a).over(whole).alias(f"total_{c}") for a, c in zip(names("all"), sums)])
    starts = parts.join(tops, [*by, "__top"]).select(*by, "__part", *[(F.col(i) + F.col(u)).alias(n) for i, u, n in zip(names("in"), names("up"), names("start"))], *[f"total_{c}" for c in sums])
    inside = so_far(Window.partitionBy(*by, "__part").orderBy(value))
    out = placed.join(starts, [*by, "__part"])
    return out.withColumns({f"before_{c}": F.col(n) + sum_of(c, inside) for c, n in zip(sums, names("start"))}).drop("__part", *names("start"))
