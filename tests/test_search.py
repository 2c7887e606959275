"""The merge search on hand-made bins that force each stage and each early end."""

from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scoreloom.plans import search as s
from scoreloom.settings import Floors, Policy, Search

LOOSE = Floors(middle_share=0.01, tail_share=0.01, mature=10, bad=1, good=1, extreme_mature=1, best_good=1, worst_bad=1)


def bins(rates, n=1000, one=None):
    rates = [(r, r / 4) if not isinstance(r, tuple) else r for r in rates]
    out = []
    for k, (m3, m1) in enumerate(rates):
        size = n[k] if isinstance(n, list) else n
        out.append(
            {"n": size, "m1_cnt_mature": size, "m1_cnt_bad": round(m1 * size), "m3_cnt_mature": size, "m3_cnt_bad": round(m3 * size), "m1_amt_exposure": size, "m1_amt_bad": round(m1 * size), "m3_amt_exposure": size, "m3_amt_bad": round(m3 * size)}
        )
    return out


RISING = [0.01 * (k + 1) for k in range(20)]


def test_rising_bins_need_no_repair():
    found = s.search(bins(RISING), settings=Search(floors=LOOSE))
    assert {x.stage for x in found.steps} == {"compress", "reduce"}
    assert found.candidates[0].selected and found.candidates[0].hard_ok
    assert 6 <= len(found.ranges) <= 8
    assert found.ranges[0] == (1, 1) and found.ranges[-1] == (20, 20)
    assert sum(c.selected for c in found.candidates) == 1


def test_small_bands_are_enlarged_first():
    sizes = [1000] * 20
    sizes[9] = 50
    found = s.search(bins(RISING, sizes), settings=Search(floors=Floors(middle_share=0.02, tail_share=0.01, mature=100, bad=1, good=1, extreme_mature=1, best_good=1, worst_bad=1)))
    assert found.steps[0].stage == "small_bands" and 10 in (*range(found.steps[0].left[0], found.steps[0].right[1] + 1),)


def test_enlarging_ends_when_the_worst_band_is_blocked():
    sizes = [1000] * 20
    sizes[0], sizes[9] = 1, 100
    found = s.search(bins(RISING, sizes), settings=Search(floors=Floors(middle_share=0.02, tail_share=0.04, mature=500, bad=1, good=1, extreme_mature=500, best_good=200, worst_bad=1)))
    # Bin 1 lacks most, and its only cut is an extreme one, so bin 10 is not helped either.
    assert not [x for x in found.steps if x.stage == "small_bands"]


def test_falls_are_merged_deepest_first():
    rates = list(RISING)
    rates[5], rates[6] = 0.09, 0.05
    found = s.search(bins(rates), settings=Search(floors=LOOSE))
    first = found.steps[0]
    assert first.stage == "monotone" and (first.left, first.right) == ((6, 6), (7, 7))
    assert not found.candidates[0].primary_inversions


def test_a_fall_at_a_blocked_cut_ends_the_stage():
    rates = list(RISING)
    rates[0], rates[1] = 0.30, 0.02
    rates[10], rates[11] = 0.13, 0.125
    found = s.search(bins(rates), settings=Search(floors=LOOSE))
    assert not [x for x in found.steps if x.stage == "monotone"]
    open_ = s.search(bins(rates), settings=Search(floors=LOOSE, may_cross_extremes=True))
    assert open_.steps[0].stage == "monotone" and open_.steps[0].cut == 1
    assert open_.candidates[-1].crossed >= 0


def test_protected_cuts_cost_more():
    table = s.Table(bins(RISING), Search(floors=LOOSE))
    walk = s.Walk(table, Policy())
    assert {1, 19} <= walk.keep
    inside = [c for c in walk.keep if c not in (1, 19)]
    at = walk.cuts.index(inside[0])
    assert walk.weigh(at, False).cost == pytest.approx(walk.weigh(at, True).cost + 100)
    assert walk.weigh(0, False).cost == pytest.approx(walk.weigh(0, True).cost + 10100)


def test_low_scores_may_be_the_bad_ones():
    found = s.search(bins(RISING[::-1]), settings=Search(floors=LOOSE, high_is_bad=False))
    assert found.candidates[0].primary_inversions == 0
    assert s.role(1, 1, 20, Search(high_is_bad=False)) == "worst_extreme"


def test_roles():
    x = Search()
    assert [s.role(a, b, 20, x) for a, b in ((1, 1), (20, 20), (1, 2), (5, 6), (1, 20))] == ["best_extreme", "worst_extreme", "contains_best_extreme", "", "contains_best_extreme,contains_worst_extreme"]
    assert s.role(1, 1, 20, Search(protect_extremes=False)) == "" and s.extreme_cuts(20, Search(protect_extremes=False)) == set()


def test_p_values():
    assert s.p_value(1, 0, 1, 5) is None
    assert s.p_value(0, 5, 0, 9) == 1.0
    assert s.p_value(50, 100, 50, 100) == pytest.approx(1)
    assert s.p_value(10, 100, 30, 100) == pytest.approx(math.erfc(abs(0.1 - 0.3) / math.sqrt(0.2 * 0.8 * 0.02) / math.sqrt(2)))


def test_information_value():
    assert s.information_value([0, 0], [1, 2]) is None
    bad, good = [10, 20], [50, 20]
    x, y = [(b + 0.5) / 31 for b in bad], [(g + 0.5) / 71 for g in good]
    assert s.information_value(bad, good) == pytest.approx(sum((a - b) * math.log(a / b) for a, b in zip(x, y)))


def test_ranges_as_text():
    r = [(1, 2), (3, 5), (6, 6)]
    assert s.text_of(r) == "[(1,2), (3,5), (6,6)]" and s.read_text(s.text_of(r)) == r and s.read_text("[(1, 2), (3, 5), (6, 6)]") == r
    assert s.merge_at(r, 1) == [(1, 2), (3, 6)] and s.ranges_of(s.cuts_of(r), 6) == r
    with pytest.raises(IndexError):
        s.merge_at(r, 2)
    with pytest.raises(ValueError):
        s.Table(bins(RISING)).band(0, 3)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2000), st.floats(0, 0.5), st.floats(0, 0.3)), min_size=6, max_size=20))
def test_every_state_is_a_partition_and_blocked_cuts_stay(rows):
    table = bins([(a, b) for _, a, b in rows], [n for n, _, _ in rows])
    found = s.search(table)
    for c in found.candidates:
        assert [x for a, b in c.ranges for x in range(a, b + 1)] == list(range(1, len(rows) + 1))
        assert c.ranges[0] == (1, 1) and c.ranges[-1] == (len(rows), len(rows))
        assert c.crossed == 0
    assert len({s.text_of(c.ranges) for c in found.candidates}) == len(found.candidates)
    assert min(len(c.ranges) for c in found.candidates) >= min(6, len(rows))
