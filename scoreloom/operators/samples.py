"""Filters and groups of applications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.columns import is_incomplete
from scoreloom.settings import Periods


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Without unfinished applications; those without a status stay."""
    return df.filter(~is_incomplete())


def group_of(periods: Periods, month: str = "application_month") -> Column:
    """train, oot, or an empty text for months that are missing, malformed or in between."""
    m = F.when(F.col(month).rlike(r"^\d{4}-\d{2}$"), F.col(month))
    return F.when(m <= periods.train_end, "train").when(m >= periods.oot_start, "oot").otherwise("")


def split(df: DataFrame, periods: Periods) -> DataFrame:
    return df.withColumn("sample_group", group_of(periods))


def scored(df: DataFrame, score: str = "score_mlt") -> DataFrame:
    """Rows with a score; infinite ones count, NaN does not."""
    return df.filter(F.col(score).isNotNull() & ~F.isnan(score))


def require_both(df: DataFrame) -> None:
    """Fails if a grouped table lacks training or out-of-time rows."""
    found = {r[0] for r in df.select("sample_group").filter("sample_group in ('train', 'oot')").distinct().collect()}
    if found != {"train", "oot"}:
        raise ValueError(f"empty sample: {sorted({'train', 'oot'} - found)}")
