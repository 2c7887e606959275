"""The constrained search for neighbouring bins to merge, on the driver over at most a few dozen bins.

Bins are reduced to prefix sums once; any band is then two lookups. A state is a tuple of cut points:
cut k lies between bin k and bin k + 1. Merging two bands removes a cut. The search removes cuts in
four stages (bands that are too small, rates that fall, too many bands, ever fewer bands) and scores
every state on its way; the best by hard constraints first, then score, is chosen.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

from scoreloom.settings import Policy, Search

Cuts = tuple[int, ...]
Ranges = list[tuple[int, int]]

RATES = ("m1_cnt", "m3_cnt", "m1_amt", "m3_amt")
PRIMARY = ("m1_cnt", "m3_cnt")
MAIN = "m3_cnt"
#: What a rate divides.
PARTS = {r: (f"{r}_bad", f"{r}_mature" if r.endswith("cnt") else f"{r}_exposure") for r in RATES}
SUMMED = ("n", *(c for parts in PARTS.values() for c in parts))


def p_value(bad_a: float, n_a: float, bad_b: float, n_b: float) -> float | None:
    """Two-sided p-value that two proportions are equal, with pooled variance; None without cases."""
    if n_a <= 0 or n_b <= 0:
        return None
    pooled = (bad_a + bad_b) / (n_a + n_b)
    spread = pooled * (1 - pooled) * (1 / n_a + 1 / n_b)
    gap = abs(bad_a / n_a - bad_b / n_b)
    if spread <= 0:
        return 1.0 if gap <= 1e-9 * max(bad_a / n_a, bad_b / n_b) else 0.0
    return 1 - math.erf(gap / math.sqrt(2 * spread))


def information_value(bad: Sequence[float], good: Sequence[float], smoothing: float = 0.5) -> float | None:
    """Smoothed information value over bands; None without bad or without good cases."""
    total_bad, total_good, k = sum(bad), sum(good), len(bad)
    if total_bad <= 0 or total_good <= 0:
        return None
    pairs = (((b + smoothing) / (total_bad + smoothing * k), (g + smoothing) / (total_good + smoothing * k)) for b, g in zip(bad, good))
    return sum((x - y) * math.log(x / y) for x, y in pairs)


def ranges_of(cuts: Cuts, bins: int) -> Ranges:
    starts = [1, *(c + 1 for c in cuts)]
    return list(zip(starts, [*cuts, bins]))


def cuts_of(ranges: Iterable[tuple[int, int]]) -> Cuts:
    return tuple(last for _, last in ranges)[:-1]


def text_of(ranges: Iterable[tuple[int, int]]) -> str:
    return "[" + ", ".join(f"({a},{b})" for a, b in ranges) + "]"


def read_text(text: str) -> Ranges:
    numbers = [int(x) for x in text.replace("(", " ").replace(")", " ").replace("[", " ").replace("]", " ").replace(",", " ").split()]
    return list(zip(numbers[::2], numbers[1::2]))


def merge_at(ranges: Ranges, k: int) -> Ranges:
    """ranges with the k-th (from 0) and the next one joined."""
    if not 0 <= k < len(ranges) - 1:
        raise IndexError(f"no pair {k} in {len(ranges)} ranges")
    return [*ranges[:k], (ranges[k][0], ranges[k + 1][1]), *ranges[k + 2 :]]


@dataclass(frozen=True)
class Band:
    first: int
    last: int
    sums: Mapping[str, float]
    share: float

    def rate(self, name: str) -> float | None:
        top, bottom = (self.sums[c] for c in PARTS[name])
        return top / bottom if bottom else None

    @property
    def bad(self) -> float:
        return self.sums["m3_cnt_bad"]

    @property
    def mature(self) -> float:
        return self.sums["m3_cnt_mature"]

    @property
    def good(self) -> float:
        return self.mature - self.bad


@dataclass
class Step:
    """A merge that was done, and why."""

    stage: str
    reason: str
    cut: int
    left: tuple[int, int]
    right: tuple[int, int]
    protected: bool
    extreme: bool
    left_rate: float | None
    right_rate: float | None
    gap: float
    p: float | None
    iv_loss: float
    cost: float
    before: Cuts
    after: Cuts


@dataclass
class Candidate:
    """A state on the way, and what it scores."""

    step: int
    stage: str
    reason: str
    ranges: Ranges
    hard_ok: bool
    eligible: bool
    primary_inversions: int
    all_inversions: int
    violations: int
    crossed: int
    iv: float | None
    retention: float | None
    separation: float | None
    least_share: float
    least_mature: float
    least_bad: float
    least_good: float
    score: float
    distance: int
    selected: bool = False


@dataclass
class Found:
    candidates: list[Candidate]
    steps: list[Step]
    protected: set[int]
    ranges: Ranges = field(default_factory=list)


def extremes(bins: int, s: Search) -> dict[str, tuple[int, int]]:
    """The bins at the good and the bad end that are kept apart."""
    if not s.protect_extremes:
        return {}
    low, high = (s.best_bins, s.worst_bins) if s.high_is_bad else (s.worst_bins, s.best_bins)
    names = ("best_extreme", "worst_extreme") if s.high_is_bad else ("worst_extreme", "best_extreme")
    both = dict(zip(names, ((1, low), (bins - high + 1, bins))))
    return {k: (a, b) for k, (a, b) in both.items() if 1 <= a <= b}


def role(first: int, last: int, bins: int, s: Search) -> str:
    out = []
    for name in ("best_extreme", "worst_extreme"):
        a, b = extremes(bins, s).get(name, (0, -1))
        if (first, last) == (a, b):
            out.append(name)
        elif first <= b and a <= last:
            out.append(f"contains_{name}")
    return ",".join(out)


def extreme_cuts(bins: int, s: Search) -> set[int]:
    ends = [b if a == 1 else a - 1 for a, b in extremes(bins, s).values()]
    return {c for c in ends if 1 <= c <= bins - 1}


class Table:
    """Bins as prefix sums."""

    def __init__(self, rows: Sequence[Mapping[str, float]], search: Search = Search()) -> None:
        self.search, self.bins = search, len(rows)
        self.prefix = {c: [0.0, *accumulate(float(r[c] or 0) for r in rows)] for c in SUMMED}
        self.total = self.prefix["n"][-1]
        self.band = lru_cache(None)(self._band)

    def _band(self, first: int, last: int) -> Band:
        if not 1 <= first <= last <= self.bins:
            raise ValueError(f"no bins from {first} to {last}")
        sums = {c: p[last] - p[first - 1] for c, p in self.prefix.items()}
        return Band(first, last, sums, sums["n"] / self.total if self.total else 0.0)

    def bands(self, cuts: Cuts) -> list[Band]:
        return [self.band(a, b) for a, b in ranges_of(cuts, self.bins)]

    def iv(self, cuts: Cuts) -> float | None:
        bands = self.bands(cuts)
        return information_value([b.bad for b in bands], [b.good for b in bands], self.search.smoothing)

    def oriented(self, band: Band, name: str) -> float | None:
        r = band.rate(name)
        return r if r is None or self.search.high_is_bad else -r

    def change(self, a: Band, b: Band, name: str) -> float | None:
        x, y = self.oriented(a, name), self.oriented(b, name)
        return None if x is None or y is None else y - x

    def falls(self, cuts: Cuts, names: Iterable[str]) -> list[tuple[int, str]]:
        """(position of the left band, rate) wherever a rate falls by more than the tolerance."""
        bands = self.bands(cuts)
        out = []
        for name in names:
            for k, (a, b) in enumerate(zip(bands, bands[1:])):
                d = self.change(a, b, name)
                if d is not None and d < -self.search.tolerance:
                    out.append((k, name))
        return out

    def floors(self, band: Band, at: int, count: int) -> tuple[float, float, float, float]:
        """Least share, mature, bad and good cases of the band at a position (from 0)."""
        f = self.search.floors
        share = f.tail_share if at in (0, count - 1) else f.middle_share
        own = role(band.first, band.last, self.bins, self.search)
        if own == "best_extreme":
            return share, f.extreme_mature, f.best_bad, f.best_good
        if own == "worst_extreme":
            return share, f.extreme_mature, f.worst_bad, f.worst_good
        return share, f.mature, f.bad, f.good

    def shortages(self, cuts: Cuts) -> list[tuple[bool, float]]:
        """For each band whether it meets its floors, and the sum of the shares that it lacks."""
        bands = self.bands(cuts)
        out = []
        for at, band in enumerate(bands):
            have = (band.share, band.mature, band.bad, band.good)
            need = self.floors(band, at, len(bands))
            lacks = sum(max(0.0, 1 - h / m) for h, m in zip(have, need) if m > 0)
            out.append((all(h >= m for h, m in zip(have, need)), lacks))
        return out

    def protected(self, policy: Policy) -> set[int]:
        """Cuts worth keeping: at the extremes, at the policy's limits, and at the largest jumps."""
        s, out = self.search, set(extreme_cuts(self.bins, self.search))
        singles = self.bands(tuple(range(1, self.bins)))
        for _, limits in policy.groups:
            most = limits.get("cum_m3_cnt_bad_rate")
            if most is not None:
                within = [k for k in range(1, self.bins + 1) if (r := self.band(1, k).rate(MAIN)) is not None and r <= most]
                out.update(within[-1:])
            most = limits.get("marginal_m3_cnt_bad_rate")
            if most is not None:
                above = [b.first for b in singles if (r := b.rate(MAIN)) is not None and r > most]
                out.update(x - 1 for x in above[:1])
        jumps = [(-d, k) for k, (a, b) in enumerate(zip(singles, singles[1:]), 1) if (d := self.change(a, b, MAIN)) is not None]
        out.update(k for _, k in sorted(jumps)[: s.protect_jumps])
        return {c for c in out if 1 <= c <= self.bins - 1}


class Walk:
    """One search over a table."""

    def __init__(self, table: Table, policy: Policy) -> None:
        self.t, self.s = table, table.search
        self.extreme = extreme_cuts(table.bins, self.s)
        self.keep = table.protected(policy)
        self.blocked = set() if self.s.may_cross_extremes else self.extreme
        self.cuts: Cuts = tuple(range(1, table.bins))
        self.first_iv = table.iv(self.cuts)
        self.steps: list[Step] = []
        self.seen = [self.judge("initial", "equal-frequency bins")]

    @property
    def count(self) -> int:
        return len(self.cuts) + 1

    def without(self, at: int) -> Cuts:
        return self.cuts[:at] + self.cuts[at + 1 :]

    def weigh(self, at: int, free: bool, stage: str = "", reason: str = "") -> Step:
        """What it costs to remove the cut at a position; free of the price of protected cuts if told so."""
        bands = self.t.bands(self.cuts)
        a, b, cut = bands[at], bands[at + 1], self.cuts[at]
        gap = max((abs(d) for name in PRIMARY if (d := self.t.change(a, b, name)) is not None), default=0.0)
        p = p_value(a.bad, a.mature, b.bad, b.mature)
        now, then = self.t.iv(self.cuts), self.t.iv(self.without(at))
        loss = max(0.0, now - then) if now is not None and then is not None else 0.0
        price = 0.0
        if not free:
            price = self.s.protected_cost * (cut in self.keep) + self.s.extreme_cost * (cut in self.extreme)
        cost = self.s.gap_cost * gap + (1 - (p or 0.0)) + self.s.iv_cost * loss + price
        return Step(
            stage, reason, cut, (a.first, a.last), (b.first, b.last), cut in self.keep, cut in self.extreme, a.rate(MAIN), b.rate(MAIN), gap, p, loss, cost, self.cuts, self.without(at)
        )

    def open(self, positions: Iterable[int]) -> list[int]:
        return [k for k in positions if self.cuts[k] not in self.blocked]

    def cheapest(self, positions: Iterable[int], free: bool) -> Step | None:
        """The cheapest removal; of equal ones the first."""
        return min((self.weigh(k, free) for k in self.open(positions)), key=lambda x: x.cost, default=None)

    def do(self, step: Step, stage: str, reason: str) -> None:
        step.stage, step.reason = stage, reason
        self.steps.append(step)
        self.cuts = step.after
        self.seen.append(self.judge(stage, reason))

    def judge(self, stage: str, reason: str) -> Candidate:
        bands, s = self.t.bands(self.cuts), self.s
        falls = [self.t.falls(self.cuts, names) for names in (PRIMARY, RATES)]
        violations = sum(not ok for ok, _ in self.t.shortages(self.cuts))
        crossed = len(self.extreme - set(self.cuts))
        iv = self.t.iv(self.cuts)
        retention = iv / self.first_iv if iv is not None and self.first_iv else None
        changes = [d for name in PRIMARY for a, b in zip(bands, bands[1:]) if (d := self.t.change(a, b, name)) is not None]
        separation = min(changes, default=None)
        eligible = s.least_bands <= self.count <= s.most_bands
        hard = eligible and not falls[0] and not violations and not crossed
        distance = abs(self.count - s.target_bands)
        score = (
            s.score_hard * hard
            + s.score_primary_inversion * len(falls[0])
            + s.score_any_inversion * len(falls[1])
            + s.score_violation * violations
            + s.score_retention * min(max(retention or 0.0, 0.0), s.retention_cap)
            + s.score_separation * max(separation or 0.0, 0.0)
            + s.score_distance * distance
            + s.score_crossed * crossed
        )
        least = [min(f(b) for b in bands) for f in (lambda b: b.share, lambda b: b.mature, lambda b: b.bad, lambda b: b.good)]
        return Candidate(
            len(self.steps), stage, reason, ranges_of(self.cuts, self.t.bins), hard, eligible, len(falls[0]), len(falls[1]), violations, crossed, iv, retention, separation, *least, score, distance
        )

    def enlarge(self) -> None:
        """Stage 1: the band that lacks most joins the cheaper neighbour; ends if that is blocked."""
        while self.count > self.s.least_bands:
            short = [(-lack, at) for at, (ok, lack) in enumerate(self.t.shortages(self.cuts)) if not ok]
            if not short:
                return
            at = min(short)[1]
            step = self.cheapest([k for k in (at - 1, at) if 0 <= k < len(self.cuts)], True)
            if step is None:
                return
            self.do(step, "small_bands", "a band is below its floors")

    def straighten(self) -> None:
        """Stage 2: the deepest fall of a primary rate is merged away; ends if that cut is blocked."""
        while self.count > self.s.least_bands:
            bands = self.t.bands(self.cuts)
            places = sorted({k for k, _ in self.t.falls(self.cuts, PRIMARY)})
            if not places:
                return
            depth = lambda k: min(d for name in PRIMARY if (d := self.t.change(bands[k], bands[k + 1], name)) is not None)
            step = self.cheapest([min(places, key=depth)], True)
            if step is None:
                return
            self.do(step, "monotone", "a primary rate falls")

    def compress(self) -> None:
        """Stage 3: down to the most bands allowed."""
        while self.count > self.s.most_bands and (step := self.cheapest(range(len(self.cuts)), False)):
            self.do(step, "compress", "too many bands")

    def reduce(self) -> None:
        """Stage 4: down to the least bands, neighbours that hardly differ first."""
        while self.count > self.s.least_bands:
            steps = [self.weigh(k, False) for k in self.open(range(len(self.cuts)))]
            if not steps:
                return
            alike = [x for x in steps if (x.p is not None and x.p >= self.s.similar_p) or x.gap <= self.s.similar_gap]
            self.do(min(alike or steps, key=lambda x: x.cost), "reduce", "neighbours hardly differ" if alike else "a leaner candidate")


def _low(x: float | None) -> float:
    return math.inf if x is None else -x


def search(rows: Sequence[Mapping[str, float]], policy: Policy = Policy(), settings: Search = Search()) -> Found:
    """Candidates (chosen first), steps, protected cuts and the chosen ranges over bins in order."""
    walk = Walk(Table(rows, settings), policy)
    for stage in (walk.enlarge, walk.straighten, walk.compress, walk.reduce):
        stage()
    found = list({text_of(c.ranges): c for c in walk.seen}.values())
    pool = [c for c in found if c.eligible] or found
    best = min(pool, key=lambda c: (not c.hard_ok, c.primary_inversions, c.violations, c.all_inversions, -c.score, _low(c.retention), c.distance))
    best.selected = True
    found.sort(key=lambda c: (not c.selected, not c.hard_ok, -c.score, -len(c.ranges)))
    return Found(found, walk.steps, walk.keep, best.ranges)
