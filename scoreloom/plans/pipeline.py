"""From applications to bands, policy and reports.

Three small results come to the driver: the edges, the sums of at most a few dozen bins, and the
plan's thresholds. Everything else stays a lazy plan over the binned applications.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import contracts
from scoreloom.functions.ordering import Ordering
from scoreloom.operators import bands, cube, funnel, policy, quantiles, samples, validation
from scoreloom.plans import search
from scoreloom.settings import Settings

log = logging.getLogger(__name__)


def small(df: DataFrame, most: int) -> DataFrame:
    """A table of at most so many rows, computed once and held as a local one; fails beyond."""
    rows = df.limit(most + 1).toArrow()
    if rows.num_rows > most:
        raise ValueError(f"more than {most} rows")
    # From Arrow it is a relation of the driver's own, which plans read without a Python worker.
    return df.sparkSession.createDataFrame(rows, df.schema)


#: Bins that a search is meant for, at most.
MOST_BINS = 1000
#: Rows of a cube: samples times months times bins, some ten thousand for decades of months.
MOST_CUBE = 200_000


@dataclass
class Run:
    """One run over an application table; each part is made when first asked for."""

    applications: DataFrame
    settings: Settings = Settings()
    #: Ranges of bins to use instead of searching.
    fixed: tuple[tuple[int, int], ...] | None = None

    def timed(self, what: str, make):
        began = time.time()
        out = make()
        log.info("%s: %.1f s", what, time.time() - began)
        return out

    @cached_property
    def ordering(self) -> Ordering:
        return Ordering(self.settings.search.high_is_bad)

    @cached_property
    def completed(self) -> DataFrame:
        """Finished applications with their sample group, scored or not."""
        return samples.split(samples.drop_incomplete(self.applications), self.settings.periods)

    @cached_property
    def scored(self) -> DataFrame:
        return samples.scored(self.completed)

    @cached_property
    def train(self) -> DataFrame:
        return self.scored.filter("sample_group = 'train'")

    @cached_property
    def edges(self) -> tuple[float, ...]:
        """Learned on training rows alone."""
        return self.timed("edges", lambda: quantiles.equal_frequency_edges(self.train, bins=self.settings.search.bins, ordering=self.ordering))

    @cached_property
    def edge_table(self) -> DataFrame:
        return quantiles.edge_table(self.applications.sparkSession, self.edges)

    @cached_property
    def binned(self) -> DataFrame:
        return bands.with_bins(self.scored, self.edges, ordering=self.ordering)

    @cached_property
    def cube(self) -> DataFrame:
        """Sums by sample, month and bin: the one scan that bands, stability, months, comparison and curve share."""
        return self.timed("cube", lambda: small(cube.cube(self.binned), MOST_CUBE))

    @cached_property
    def train_sums(self) -> DataFrame:
        """One row for each bin."""
        return small(cube.bin_sums(self.cube, self.edges), MOST_BINS)

    @cached_property
    def found(self) -> search.Found:
        quantiles.require_bins(self.edges, self.settings.search.least_bands)
        rows = [r.asDict() for r in self.train_sums.orderBy("bin_order").collect()]
        return self.timed("search", lambda: search.search(rows, self.settings.policy, self.settings.search))

    @cached_property
    def ranges(self) -> list[tuple[int, int]]:
        return list(self.fixed) if self.fixed else self.found.ranges

    @cached_property
    def banded(self) -> DataFrame:
        return bands.with_bands(self.binned, self.ranges)

    @cached_property
    def train_bands(self) -> DataFrame:
        return bands.regroup(self.train_sums, self.ranges, self.ordering)

    @cached_property
    def band_edges(self) -> DataFrame:
        return bands.band_edges(self.edge_table, self.ranges, self.settings.search)

    def sample_bands(self, group: str) -> DataFrame:
        """Band statistics of one sample, with the bands' edges."""
        stats = cube.bands(self.cube.filter(F.col("sample_group") == group), self.ranges, ordering=self.ordering).withColumn("sample_group", F.lit(group))
        return stats.join(F.broadcast(self.band_edges.select("band_order", "score_left", "score_right", "merged_from", "extreme_role")), "band_order", "left")

    @cached_property
    def both_bands(self) -> DataFrame:
        return cube.bands(self.cube.filter(F.col("sample_group").isin("train", "oot")), self.ranges, "sample_group", ordering=self.ordering)

    @cached_property
    def curve(self) -> DataFrame:
        return small(policy.curve(bands.regroup_sums(self.train_sums, self.ranges), self.ordering), MOST_BINS)

    @cached_property
    def plan(self) -> DataFrame:
        return small(policy.plan(self.curve, self.settings.policy), 1)

    @cached_property
    def psi(self) -> DataFrame:
        return validation.psi_of_counts(cube.band_counts(self.cube, self.ranges), self.band_edges, self.settings.psi_floor)

    @cached_property
    def performance(self) -> DataFrame:
        """A row for each sample and label; computed once, as several sections tell it."""
        return self.timed("performance", lambda: small(validation.auc_ks(self.scored, high_is_bad=self.settings.search.high_is_bad), MOST_BINS))

    @cached_property
    def flow(self) -> DataFrame:
        return self.timed("flow", lambda: small(policy.flow(self.scored, self.plan, ordering=self.ordering), MOST_BINS))

    @cached_property
    def band_funnel(self) -> DataFrame:
        """The funnel of both samples by band, in one scan."""
        rows = self.banded.filter(F.col("sample_group").isin("train", "oot"))
        return self.timed("band funnel", lambda: small(funnel.by_band(rows, "sample_group"), 2 * MOST_BINS))

    @cached_property
    def monthly(self) -> DataFrame:
        return validation.with_changes(cube.months(self.cube, self.ranges, self.ordering), self.settings.monthly_tolerance, self.ordering)

    def enriched(self, group: str) -> DataFrame:
        """Bands of a sample with diagnostics, funnel, stability and decision; a band twice on either side of the funnel, or twice in the stability, fails."""
        stats = bands.diagnostics(self.sample_bands(group), "band_order", self.settings.search.smoothing, self.ordering)
        steps = self.band_funnel.filter(F.col("sample_group") == group).drop("sample_group", "band")
        drift = self.psi.select("band_order", F.col("psi_component").alias("train_oot_psi_component"), F.col("psi_total").alias("train_oot_psi_total"))
        out = contracts.one_to_one(stats, steps, ["band_order"], "band funnel")
        out = contracts.many_to_one(out, drift, ["band_order"], "band stability")
        out = policy.band_decision(out, self.plan, self.ordering)
        return out.withColumns({"estimated_band_flow_rate": F.col("sample_pct"), "estimated_cumulative_flow_rate": F.col("cum_pass_rate")})

    def band_report(self) -> DataFrame:
        """Bands of both samples, with what the plan does to each sample as a whole and how well the score ranks it."""
        rows = self.enriched("train").unionByName(self.enriched("oot"))
        flow = self.flow.withColumn("sample_group", F.lower("sample_group"))
        overall = flow.select("sample_group", *[F.col(f"estimated_{r}_rate").alias(f"estimated_overall_{r}_rate") for r in ("auto_pass", "manual_review", "total_accept", "reject")])
        ranked = validation.performance_wide(self.performance)
        ranked = ranked.select("sample_group", *[F.col(c).alias(f"overall_{c}") for c in ranked.columns if c != "sample_group"])
        out = contracts.many_to_one(rows, overall, ["sample_group"], "overall flow")
        return headline(contracts.many_to_one(out, ranked, ["sample_group"], "overall ranking"), HEADLINE)

    def candidates(self) -> DataFrame:
        """Every state of the search with its scores, the chosen one marked."""
        fields = "selected boolean, step_no int, stage string, merge_reason string, hard_constraints_ok boolean, eligible_band_count boolean, band_count int, ranges string, primary_inversion_cnt int, all_inversion_cnt int, constraint_violation_cnt int, extreme_cut_violation_cnt int, least_sample_pct double, least_mature_count double, least_bad_count double, least_good_count double, primary_iv double, primary_iv_retention double, least_adjacent_rate_diff double, candidate_score double, target_band_distance int"
        rows = [
            (c.selected, c.step, c.stage, c.reason, c.hard_ok, c.eligible, len(c.ranges), search.text_of(c.ranges), c.primary_inversions, c.all_inversions, c.violations, c.crossed, c.least_share, c.least_mature, c.least_bad, c.least_good, c.iv, c.retention, c.separation, c.score, c.distance)
            for c in self.found.candidates
        ]
        return self.applications.sparkSession.createDataFrame(rows, fields)

    def steps(self) -> DataFrame:
        """The merges in order."""
        fields = "step_no int, stage string, merge_reason string, left_range string, right_range string, cut int, is_protected boolean, is_extreme boolean, left_primary_rate double, right_primary_rate double, primary_rate_gap double, p_value double, iv_loss double, merge_cost double, before_ranges string, after_ranges string, after_band_count int"
        bins = self.settings.search.bins if not self.edges else len(self.edges) - 1
        text = lambda cuts: search.text_of(search.ranges_of(cuts, bins))
        rows = [
            (k, s.stage, s.reason, str(s.left), str(s.right), s.cut, s.protected, s.extreme, s.left_rate, s.right_rate, s.gap, s.p, s.iv_loss, s.cost, text(s.before), text(s.after), len(s.after) + 1)
            for k, s in enumerate(self.found.steps, 1)
        ]
        return self.applications.sparkSession.createDataFrame(rows, fields)


#: What a reader of bands looks for first.
HEADLINE = ("sample_group", "band_order", "band", "score_left", "score_right", "n", "sample_pct", "cum_pass_rate", "estimated_decision", "estimated_band_flow_rate", "m3_cnt_bad_rate", "m1_cnt_bad_rate", "m3_amt_bad_rate", "m1_amt_bad_rate")


def headline(df: DataFrame, first: Sequence[str]) -> DataFrame:
    """The columns named first that df has, in that order, then the others as they are."""
    head = [c for c in first if c in df.columns]
    return df.select(*head, *[c for c in df.columns if c not in head])


#: What search_states() tells of each state of a search.
STATES = "step_no int, stage string, ranges string, selected boolean, hard_constraints_ok boolean, primary_inversion_cnt int, all_inversion_cnt int, constraint_violation_cnt int, extreme_cut_violation_cnt int, primary_iv_retention double, least_adjacent_rate_diff double, candidate_score double"


def search_states(bin_sums: DataFrame, by: Sequence[str], settings: Settings = Settings()) -> DataFrame:
    """Every state that the search of each of many models scores; a group is one model's few dozen bins."""
    by = list(by)
    kinds = dict(bin_sums.dtypes)

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("bin_order").to_dict("records")
        found = search.search(rows, settings.policy, settings.search)
        told = [(*key, c.step, c.stage, search.text_of(c.ranges), c.selected, c.hard_ok, c.primary_inversions, c.all_inversions, c.violations, c.crossed, c.retention, c.separation, c.score) for c in found.candidates]
        return pd.DataFrame(told, columns=[*by, *(x.split()[0] for x in STATES.split(", "))])

    fields = ", ".join(f"`{c}` {kinds[c]}" for c in by)
    return bin_sums.select(*by, "bin_order", *search.SUMMED).groupBy(*by).applyInPandas(one, f"{fields}, {STATES}")


def search_many(bin_sums: DataFrame, by: str, settings: Settings = Settings()) -> DataFrame:
    """The chosen ranges for each of many models: (by, ranges, hard_ok)."""
    return search_states(bin_sums, [by], settings).filter("selected").select(by, "ranges", F.col("hard_constraints_ok").alias("hard_ok"))
