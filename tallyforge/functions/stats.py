"""Distributions and tests for small inputs on the driver: bin counts, parameters, a test's statistic."""

from __future__ import annotations

from math import erfc, exp, floor, inf, lgamma, log, nan, pi, sqrt
from statistics import NormalDist

import numpy as np


def normal_cdf(x: float, mean: float = 0.0, std: float = 1.0) -> float:
    return 0.5 * erfc(-(x - mean) / (std * sqrt(2.0)))


def normal_quantile(p: float, mean: float = 0.0, std: float = 1.0) -> float:
    return -inf if p <= 0 else inf if p >= 1 else NormalDist(mean, std).inv_cdf(p)


def uniform_cdf(x: float, low: float, high: float) -> float:
    return min(1.0, max(0.0, (x - low) / (high - low)))


def gamma_upper(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function: a series below a + 1, a continued fraction (Lentz) above."""
    if x <= 0:
        return 1.0
    front = exp(a * log(x) - x - lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * front)
    b = x + 1 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi_square_p(statistic: float, dof: int) -> float:
    return gamma_upper(dof / 2, statistic / 2)


def kolmogorov_p(d: float, n: int, exact_to: int = 1000) -> float:
    """Two-sided p-value: by the matrix power of Marsaglia, Tsang and Wang up to ``exact_to`` values, by Kolmogorov's series beyond."""
    if n <= 0 or d != d:
        return nan
    if d <= 0.5 / n:
        return 1.0
    if d >= 1:
        return 0.0
    if n <= exact_to and n * d * d <= 18:
        return min(1.0, max(0.0, 1.0 - _exact_kolmogorov(d, n)))
    x = sqrt(n) * d
    if x < 1.0:
        total = sum(exp(-((2 * k - 1) ** 2) * pi * pi / (8 * x * x)) for k in range(1, 60))
        return min(1.0, max(0.0, 1.0 - sqrt(2 * pi) / x * total))
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * exp(-2 * k * k * x * x) for k in range(1, 101))))


def _exact_kolmogorov(d: float, n: int) -> float:
    k = floor(n * d) + 1
    h = k - n * d
    m = 2 * k - 1
    grid = np.tril(np.ones((m, m)), 1)
    powers = h ** np.arange(1, m + 1)
    grid[:, 0] -= powers
    grid[-1, :] -= powers[::-1]
    grid[-1, 0] += max(0.0, 2 * h - 1) ** m
    row = np.arange(m)
    lags = row[:, None] - row[None, :] + 1
    inverse = np.array([exp(-lgamma(i + 1)) for i in range(m + 1)])
    grid = np.where(lags > 0, grid * inverse[np.clip(lags, 0, m)], grid)
    result, scale = np.eye(m), 0
    base, base_scale, power = grid, 0, n
    while power:
        if power & 1:
            result, scale = result @ base, scale + base_scale
            if result[k - 1, k - 1] > 1e140:
                result, scale = result * 1e-140, scale + 140
        base, base_scale = base @ base, 2 * base_scale
        if base[k - 1, k - 1] > 1e140:
            base, base_scale = base * 1e-140, base_scale + 140
        power >>= 1
    value = result[k - 1, k - 1]
    for i in range(1, n + 1):
        value *= i / n
        if value < 1e-140:
            value, scale = value * 1e140, scale - 140
    return value * 10.0**scale


def entropy(counts: np.ndarray) -> float:
    """Natural logarithm; zeros count nothing."""
    p = np.asarray(counts, float)
    p = p[p > 0] / p.sum() if p.sum() > 0 else p[:0]
    return float(-(p * np.log(p)).sum())


def root_trace(a: np.ndarray, b: np.ndarray) -> float:
    """Trace of the root of the product of two covariance matrices."""
    values, vectors = np.linalg.eigh(a)
    half = (vectors * np.sqrt(np.clip(values, 0, None))) @ vectors.T
    return float(np.sqrt(np.clip(np.linalg.eigvalsh(half @ b @ half), 0, None)).sum())
