"""Tail probabilities of Student's t, Snedecor's F and chi-squared as column expressions.

The incomplete beta and gamma functions are continued fractions, folded by ``aggregate`` over as many steps as they need to settle, so
that p-values stay inside a projection. Their factors are taken from Stirling's series, differences of large logarithms by one
logarithm of a ratio, so that degrees of freedom of any size lose no digits.
"""

from __future__ import annotations

from math import log, pi

from pyspark.sql import Column, functions as F

_TINY, _SMALL = 1e-300, 1e-6
_HALF_LOG_TWO_PI = 0.5 * log(2 * pi)
#: Arguments from which Stirling's series holds to the last digits; smaller ones are raised by as much first.
_LARGE = 10


def _series(z: Column) -> Column:
    """What Stirling's formula leaves of ln gamma(z)."""
    r = 1 / (z * z)
    return (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / z


def ln_gamma(z: Column) -> Column:
    """For z above 0."""
    raised = z + F.when(z < _LARGE, float(_LARGE)).otherwise(0.0)
    lowered = F.when(z < _LARGE, sum((F.log(z + i) for i in range(1, _LARGE)), F.log(z))).otherwise(0.0)
    return (raised - 0.5) * F.log(raised) - raised + _HALF_LOG_TWO_PI + _series(raised) - lowered


def _ln_beta(a: Column, b: Column) -> Column:
    low, high = F.least(a, b), F.greatest(a, b)
    gap = (high - 0.5) * F.log1p(low / high) + low * F.log(low + high) - low + _series(low + high) - _series(high)
    return ln_gamma(low) - F.when(high >= _LARGE, gap).otherwise(ln_gamma(low + high) - ln_gamma(high))


def _held(value: Column) -> Column:
    """A divisor that is not 0."""
    return F.when(F.abs(value) < _TINY, _TINY).otherwise(value)


def _fold(steps: Column, start: Column, step) -> Column:
    """The value that ``step(state, i)`` reaches over i = 1 ... steps; a state is (c, d, value)."""
    return F.aggregate(F.sequence(F.lit(1).cast("long"), steps.cast("long")), start, step, lambda s: s["value"])


def _state(c: Column, d: Column, value: Column) -> Column:
    return F.struct(c.alias("c"), d.alias("d"), value.alias("value"))


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, by Lentz's method; two of its terms a step."""
    first = 1 / _held(1 - (a + b) * x / (a + 1))

    def step(s: Column, i: Column) -> Column:
        m = i.cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / _held(1 + even * s["d"])
        c = _held(1 + even / s["c"])
        value = s["value"] * d * c
        d2 = 1 / _held(1 + odd * d)
        c2 = _held(1 + odd / c)
        return _state(c2, d2, value * d2 * c2)

    # From the nearer end it settles in steps that grow with the root of the smaller argument; from a tiny x also with b x.
    steps = 100 + 4 * F.sqrt(F.least(a, b)) + F.when(x <= _SMALL, F.least(2 * b * x, F.lit(20_000.0))).otherwise(0.0)
    return _fold(steps, _state(F.lit(1.0), first, first), step)


def incomplete_beta(a: Column, b: Column, x: Column, rest: Column) -> Column:
    """The regularised incomplete beta function at ``x``; ``rest`` is 1 - x, given too as either may be tiny.

    The fraction runs from the nearer end, but from a tiny one in any case: seen from the other its digits would be lost.
    """
    near = (x <= _SMALL) | ((x < (a + 1) / (a + b + 2)) & (rest > _SMALL))
    log_of = lambda u, v: F.when(u > 0.5, F.log1p(-v)).otherwise(F.log(u))
    front = F.exp(a * log_of(x, rest) + b * log_of(rest, x) - _ln_beta(a, b))
    p, q, u = (F.when(near, one).otherwise(other) for one, other in ((a, b), (b, a), (x, rest)))
    part = front * _beta_fraction(p, q, u) / p
    inside = F.when(near, part).otherwise(1 - part)
    return F.when(x <= 0, 0.0).when(rest <= 0, 1.0).otherwise(inside)


def upper_gamma(a: Column, x: Column) -> Column:
    """The regularised upper incomplete gamma function: a series below a + 1, a continued fraction above."""
    large = a * F.log1p((x - a) / a) - (x - a) + 0.5 * F.log(a) - _HALF_LOG_TWO_PI - _series(a)
    front = F.exp(F.when(a >= _LARGE, large).otherwise(a * F.log(x) - x - ln_gamma(a)))
    steps = 100 + 10 * F.sqrt(a)

    def add(s: Column, i: Column) -> Column:
        term = s["d"] * x / (a + i)
        return _state(s["c"], term, s["value"] + term)

    def divide(s: Column, i: Column) -> Column:
        term, base = -i * (i - a), x + 2 * i + 1 - a
        d = 1 / _held(base + term * s["d"])
        c = _held(base + term / s["c"])
        return _state(c, d, s["value"] * d * c)

    lower = front * _fold(steps, _state(F.lit(0.0), 1 / a, 1 / a), add)
    first = 1 / _held(x + 1 - a)
    upper = front * _fold(steps, _state(F.lit(1 / _TINY), first, first), divide)
    return F.when(x <= 0, 1.0).when(x < a + 1, 1 - lower).otherwise(upper)


def _between(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))


def t_p_value(t: Column, freedom: Column) -> Column:
    """Both tails of Student's t beyond ``t``. Null for no statistic or no freedom."""
    square = t * t
    p = incomplete_beta(freedom / 2, F.lit(0.5), freedom / (freedom + square), square / (freedom + square))
    return F.when(t.isNotNull() & (freedom > 0), _between(p))


def f_p_value(f: Column, first: Column, second: Column) -> Column:
    """The tail of F above ``f``."""
    top, bottom = first * f, second + first * f
    p = incomplete_beta(second / 2, first / 2, second / bottom, top / bottom)
    return F.when(f.isNotNull() & (first > 0) & (second > 0), _between(p))


def chi_square_p_value(x: Column, freedom: Column) -> Column:
    """The tail of chi-squared above ``x``."""
    return F.when(x.isNotNull() & (freedom > 0), _between(upper_gamma(freedom / 2, x / 2)))
