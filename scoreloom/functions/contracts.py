"""Joins that state how many rows a key may have, and fail where there are more; the check is part of the plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """df, which fails when run if a key has several rows; null keys count as one key.

    Rows are counted by key with partial sums, so a repeated key costs no more than any other.
    """
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"), F.any_value(F.struct(*rest)).alias("__row"))
    shown = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    failed = F.raise_error(F.concat(F.lit(f"{what}: more than one row for "), shown))
    checked = packed.withColumn("__row", F.when(F.col("__rows") == 1, F.col("__row")).otherwise(failed))
    return checked.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def many_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """left with the one row of right that has its keys, if there is any."""
    return left.join(unique(right, keys, what), list(keys), "left")


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """many_to_one() of a left side that has no key twice either."""
    return many_to_one(unique(left, keys, what), right, keys, what)
