"""Tail probabilities of t, F, chi-square and normal statistics, with math only; for handfuls of numbers, never rows."""

from __future__ import annotations

from math import erfc, exp, lgamma, log, sqrt


def normal_two_sided(z: float) -> float:
    return erfc(abs(z) / sqrt(2))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    tiny, value, top, bottom = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            part = 1.0
        elif i % 2 == 0:
            part = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            part = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        bottom = 1 / (1 + part * bottom or tiny)
        top = 1 + part / top or tiny
        value *= top * bottom
        if i and abs(top * bottom - 1) < 1e-14:
            break
    return front * (value - 1)


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, df1: float, df2: float) -> float:
    return incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * f)) if f > 0 else 1.0


def chi2_upper(x: float, df: float) -> float:
    """Upper tail of chi-square: series of the lower incomplete gamma, or its continued fraction."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-15:
            k += 1
            term *= x / k
            total += term
        return 1 - total * exp(-x + a * log(x) - lgamma(a))
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        part = -i * (i - a)
        b += 2
        d = 1 / (part * d + b)
        c = b + part / c
        h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h * exp(-x + a * log(x) - lgamma(a))
