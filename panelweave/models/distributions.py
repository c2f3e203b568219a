"""Tail probabilities of the normal, chi-square, t and F distributions."""

from __future__ import annotations

import math


def normal_two_sided(z: float) -> float:
    """Probability of a standard normal beyond ``|z|`` on either side."""
    return math.erfc(abs(z) / math.sqrt(2.0))


def chi_square_tail(x: float, df: float) -> float:
    """Upper tail of chi-square: the regularised upper incomplete gamma function at (df/2, x/2)."""
    a, x = df / 2.0, x / 2.0
    if x <= 0 or df <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-17:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * scale)
    return scale * _fraction(lambda i: (i * (a - i), x + 2 * i + 1 - a), x + 1 - a)


def _fraction(step, first: float) -> float:
    """Reciprocal of a continued fraction, evaluated forwards (modified Lentz)."""
    tiny = 1e-300
    c = 1.0 / tiny
    d = 1.0 / (first if first else tiny)
    value = d
    for i in range(1, 10_000):
        a, b = step(i)
        d = b + a * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + a / c
        c = c if abs(c) > tiny else tiny
        change = c * d
        value *= change
        if abs(change - 1.0) < 1e-15:
            break
    return value


def _beta_lower(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_lower(1 - x, b, a)
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)

    def step(i: int) -> tuple[float, float]:
        m = i // 2
        if i % 2 == 0:
            return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0
        return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0

    return math.exp(log_front) / a * _fraction(step, 1.0)


def t_two_sided(t: float, df: float) -> float:
    """Probability of a t variable beyond ``|t|`` on either side."""
    return _beta_lower(df / (df + t * t), df / 2.0, 0.5)


def f_tail(f: float, df1: float, df2: float) -> float:
    """Upper tail of F."""
    return 1.0 if f <= 0 else _beta_lower(df2 / (df2 + df1 * f), df2 / 2.0, df1 / 2.0)
