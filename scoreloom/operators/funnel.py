"""The historical approval funnel, by distinct applications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.columns import distinct_flags, funnel_flags, ratio

STEPS = ("apply", "completed", "approved", "auto", "manual", "deal")


def _rates(df: DataFrame) -> DataFrame:
    share = lambda a, b: ratio(f"actual_{a}_cnt", f"actual_{b}_cnt")
    return df.withColumns(
        {
            "actual_completion_rate": share("completed", "apply"),
            "actual_approval_rate": share("approved", "completed"),
            "actual_auto_approval_rate": share("auto", "completed"),
            "actual_manual_approval_rate": share("manual", "completed"),
            "actual_auto_approval_share": share("auto", "approved"),
            "actual_manual_approval_share": share("manual", "approved"),
            "actual_deal_rate": share("deal", "approved"),
        }
    )


def _distinct(df: DataFrame, by: list[str], flags: dict[str, Column]) -> DataFrame:
    return distinct_flags(df.filter("application_id is not null"), by, "application_id", flags)


def by_group(df: DataFrame) -> DataFrame:
    """Train, OOT and All; rows of neither period count in All alone."""
    groups = {"Train": F.col("sample_group") == "train", "OOT": F.col("sample_group") == "oot", "All": F.lit(True)}
    flags = {f"{g}_{s}": test & c for g, test in groups.items() for s, c in funnel_flags().items()}
    one = _distinct(df, [], flags)
    rows = [F.struct(F.lit(g).alias("sample_group"), *[F.col(f"{g}_{s}").alias(f"actual_{s}_cnt") for s in STEPS]) for g in groups]
    return _rates(one.select(F.explode(F.array(*rows)).alias("r")).select("r.*"))


def by_band(banded: DataFrame, *by: str) -> DataFrame:
    """Scored applications by band, within by; those without one are left out."""
    rows = banded.filter("band_order is not null")
    return _rates(_distinct(rows, [*by, "band_order", "band"], {f"actual_{s}_cnt": c for s, c in funnel_flags().items()}))
