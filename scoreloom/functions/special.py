"""Special functions that the engine has no expression for, from built-in ones only."""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreloom.functions.columns import as_col, ratio

#: Degree of the polynomial, and the argument beyond which erfc is below the least double.
DEGREE, FAR = 26, 27.0


@lru_cache(None)
def _coefficients() -> tuple[float, ...]:
    """Of 1, y, y^2 ...: ln(erfc(x) / t) + x^2 for t = 2 / (2 + x) and y = 2t - 1, interpolated at Chebyshev nodes.

    The function is smooth over all x from 0 on, so that its Chebyshev coefficients fall fast; the
    powers' coefficients stay small enough for doubles.
    """
    n = DEGREE + 1
    angles = [math.pi * (k + 0.5) / n for k in range(n)]

    def value(y: float) -> float:
        t = (y + 1) / 2
        x = 2 / t - 2
        # Beyond the reach of doubles the continued fraction of erfc says the same.
        tail = math.log(math.erfc(x)) + x * x if x < 25 else -math.log(x * math.sqrt(math.pi)) + math.log1p(-0.5 / x**2 + 0.75 / x**4 - 1.875 / x**6)
        return tail - math.log(t)

    values = [value(math.cos(a)) for a in angles]
    weights = [(1 if j == 0 else 2) / n * sum(v * math.cos(j * a) for v, a in zip(values, angles)) for j in range(n)]
    # T_0 = 1, T_1 = y, T_j = 2 y T_(j-1) - T_(j-2), in whole numbers.
    before, now, out = [1], [0, 1], [0.0] * n
    for j, w in enumerate(weights):
        terms = before if j == 0 else now
        for k, c in enumerate(terms):
            out[k] += w * c
        if j:
            longer = [0, *(2 * c for c in now)]
            for k, c in enumerate(before):
                longer[k] -= c
            before, now = now, longer
    return tuple(out)


def erfc(x: Column | str) -> Column:
    """The complementary error function, within 1e-12; null stays null."""
    value = as_col(x).cast("double")

    def of(a: Column) -> Column:
        t = F.lit(2.0) / (F.lit(2.0) + a)
        y = F.lit(2.0) * t - F.lit(1.0)
        power = F.lit(_coefficients()[-1])
        for c in reversed(_coefficients()[:-1]):
            power = power * y + F.lit(c)
        return F.when(a > FAR, 0.0).when(a == 0, 1.0).otherwise(t * F.exp(power - a * a))

    # The argument is used once for each power: it is bound to a name, so that it is computed once.
    return F.when(value.isNotNull(), F.transform(F.array(value), lambda v: F.when(v < 0, F.lit(2.0) - of(-v)).otherwise(of(v)))[0])


def erf(x: Column | str) -> Column:
    return F.lit(1.0) - erfc(x)


def two_proportion_z(bad_a: Column | str, n_a: Column | str, bad_b: Column | str, n_b: Column | str) -> Column:
    """How many standard deviations two proportions differ by, with pooled variance; null without cases or spread."""
    bad_a, n_a, bad_b, n_b = (as_col(c).cast("double") for c in (bad_a, n_a, bad_b, n_b))
    pooled = ratio(bad_a + bad_b, n_a + n_b)
    spread = pooled * (1 - pooled) * (ratio(F.lit(1.0), n_a) + ratio(F.lit(1.0), n_b))
    gap = F.abs(ratio(bad_a, n_a) - ratio(bad_b, n_b))
    return F.when((n_a > 0) & (n_b > 0) & (spread > 0), ratio(gap, F.sqrt(spread)))


def two_proportion_p(bad_a: Column | str, n_a: Column | str, bad_b: Column | str, n_b: Column | str) -> Column:
    """Two-sided p-value that two proportions are equal; without spread 1 if they are and 0 if not, null without cases."""
    cases = (as_col(n_a) > 0) & (as_col(n_b) > 0)
    a, b = ratio(bad_a, n_a), ratio(bad_b, n_b)
    same = F.abs(a - b) <= F.lit(1e-9) * F.greatest(F.abs(a), F.abs(b))
    z = two_proportion_z(bad_a, n_a, bad_b, n_b)
    return F.when(~cases, None).when(z.isNotNull(), erfc(z / math.sqrt(2))).when(same, 1.0).when(cases, 0.0)
