"""Settings, as frozen records that are passed explicitly."""

from __future__ import annotations

from dataclasses import dataclass

#: Fixed values of the application data: statuses of unfinished applications, of opened accounts,
#: first characters of approved statuses, and phrases of the two ways of approval.
INCOMPLETE = ("0.Incomplete", "1.In Progress")
OPENED = ("Active_Account", "Closed", "Blocked")
APPROVED_FIRST = ("3", "4")
AUTO_PHRASE, MANUAL_PHRASE = "Auto Approved", "Manual Approved"

#: Columns that the wide application table must have.
REQUIRED = (
    "application_id",
    "user_id",
    "application_time",
    "application_month",
    "score_mlt",
    "duedate_1m_30",
    "duedate_3m_30",
    "principal",
    "estimate_principal_remaining_mob1",
    "estimate_principal_remaining_mob3",
    "dpd_days_ever_mob1",
    "dpd_days_ever_mob3",
    "status",
    "application_status",
    "assessment_status",
)


@dataclass(frozen=True)
class Horizon:
    """One performance window: where its label, days past due and remaining principal are."""

    name: str
    label: str
    dpd: str
    remaining: str


HORIZONS = (
    Horizon("m1", "duedate_1m_30", "dpd_days_ever_mob1", "estimate_principal_remaining_mob1"),
    Horizon("m3", "duedate_3m_30", "dpd_days_ever_mob3", "estimate_principal_remaining_mob3"),
)


@dataclass(frozen=True)
class Periods:
    """Months compare as text, YYYY-MM."""

    train_end: str = "2025-10"
    oot_start: str = "2025-11"


#: The defaults of Periods, Floors, Search and Policy, and those of Settings below, are fixed values of the method: its months, floors,
#: costs, score weights and limits.


@dataclass(frozen=True)
class Floors:
    """Least size of a band; the outermost bands have floors of their own."""

    middle_share: float = 0.05
    tail_share: float = 0.025
    mature: int = 1000
    bad: int = 20
    good: int = 200
    extreme_mature: int = 500
    best_bad: int = 0
    best_good: int = 200
    worst_bad: int = 20
    worst_good: int = 0


@dataclass(frozen=True)
class Search:
    """The merge search: band counts, protection, costs and score weights."""

    bins: int = 20
    least_bands: int = 6
    most_bands: int = 8
    target_bands: int = 7
    high_is_bad: bool = True
    floors: Floors = Floors()
    tolerance: float = 0.0
    similar_p: float = 0.10
    similar_gap: float = 0.003
    protect_jumps: int = 1
    protect_extremes: bool = True
    best_bins: int = 1
    worst_bins: int = 1
    may_cross_extremes: bool = False
    protected_cost: float = 100.0
    extreme_cost: float = 10000.0
    gap_cost: float = 100.0
    iv_cost: float = 10.0
    smoothing: float = 0.5
    retention_cap: float = 1.5
    score_hard: float = 100.0
    score_primary_inversion: float = -30.0
    score_any_inversion: float = -4.0
    score_violation: float = -15.0
    score_retention: float = 12.0
    score_separation: float = 100.0
    score_distance: float = -1.5
    score_crossed: float = -50.0


@dataclass(frozen=True)
class Limits:
    """Greatest allowed value of each curve metric."""

    limits: tuple[tuple[str, float], ...]

    def get(self, metric: str) -> float | None:
        return dict(self.limits).get(metric)


@dataclass(frozen=True)
class Policy:
    name: str = "default"
    objective: str = "balance pass rate, overall risk and marginal risk"
    auto: Limits = Limits((("cum_m1_cnt_bad_rate", 0.0090), ("cum_m3_cnt_bad_rate", 0.0550), ("marginal_m3_cnt_bad_rate", 0.0900)))
    accept: Limits = Limits((("cum_m1_cnt_bad_rate", 0.0130), ("cum_m3_cnt_bad_rate", 0.0750), ("marginal_m3_cnt_bad_rate", 0.1700)))

    @property
    def groups(self) -> tuple[tuple[str, Limits], ...]:
        return (("auto", self.auto), ("accept", self.accept))


@dataclass(frozen=True)
class Settings:
    periods: Periods = Periods()
    search: Search = Search()
    policy: Policy = Policy()
    #: Population-stability shares are not taken below this.
    psi_floor: float = 1e-6
    #: Drops of a month's rate below this count as inversions.
    monthly_tolerance: float = 0.003
