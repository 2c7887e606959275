"""Which end of the score is the risky one, and all that turns with it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from scoreloom.functions.columns import as_col, steps


@dataclass(frozen=True)
class Ordering:
    """Safe to risky is up the score if high is bad, else down it.

    With the other end the engine does what it would do to the negated score: running figures begin at the high
    scores, a band holds its lower edge and not its upper one, its threshold is the lower edge, and a score at a
    threshold passes. Bins and bands stay numbered up the score.
    """

    high_is_bad: bool = True

    def along(self, order: Column | str) -> Column:
        """Sort order from safe to risky; null last."""
        return F.asc_nulls_last(order) if self.high_is_bad else F.desc_nulls_last(order)

    def window(self, order: Column | str, *by: str) -> WindowSpec:
        return Window.partitionBy(*by).orderBy(self.along(order))

    def bucket(self, score: Column | str, edges: Sequence[float]) -> Column:
        """1 + the inner edges that lie below score: intervals (left, right], or [left, right) if high is good; null stays null."""
        s = as_col(score)
        return F.when(s.isNotNull(), steps(s, edges[1:-1], at_too=not self.high_is_bad) + 1).cast("int")

    def passes(self, score: Column, threshold: Column) -> Column:
        """Whether a score is no riskier than a threshold."""
        return score <= threshold if self.high_is_bad else score >= threshold

    def threshold(self, whole: WindowSpec) -> Column:
        """The risky edge of each band, and for the last the riskiest score of the sample."""
        edge, end, far = ("score_right", float("inf"), F.max("score_max")) if self.high_is_bad else ("score_left", float("-inf"), F.min("score_min"))
        return F.when(F.col(edge) == end, far.over(whole)).otherwise(F.col(edge))

    def place(self, order: str) -> Column:
        """A band's place from the safe end, from 1, where all bands are rows."""
        return F.col(order) if self.high_is_bad else F.max(order).over(Window.partitionBy()) + 1 - F.col(order)


RISING = Ordering()
