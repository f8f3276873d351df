"""Tail probabilities of the t, F and chi-square distributions, by integrating their densities.

Both integrands are taken in a variable in which they are smooth and about one unit, or 1 / sqrt(parameters),
wide: an angle for the beta distribution (behind t and F), the root for chi-square.  Gauss-Legendre panels
cover the part of the smaller tail that counts.  They see one row of test statistics.
"""
from __future__ import annotations

import math

import numpy as np

_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(16)
#: Beyond so many widths the densities are below the smallest double.
_REACH, _PANELS = 40.0, 200


def _integral(log_density, low: float, high: float) -> float:
    edges = np.linspace(low, high, _PANELS + 1)
    half = np.diff(edges)[:, None] / 2
    at = (edges[:-1, None] + half) + half * _NODES
    with np.errstate(divide="ignore", invalid="ignore"):
        return float((np.exp(log_density(at)) * _WEIGHTS * half).sum())


def beta_cdf(x: float, a: float, b: float) -> float:
    """P(X <= x) for a beta variable, a, b >= 1/2: with X = sin(u)**2 the density is that of the angle u."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > a / (a + b):
        return 1.0 - beta_cdf(1 - x, b, a)
    scale = math.log(2) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)

    def log_density(u):
        cosine = (2 * b - 1) * np.log(np.cos(u)) if b != 0.5 else 0.0
        sine = (2 * a - 1) * np.log(np.sin(u)) if a != 0.5 else 0.0
        return scale + sine + cosine

    end = math.asin(math.sqrt(x))
    return _integral(log_density, max(0.0, end - _REACH / math.sqrt(a + b)), end)


def chi2_sf(x: float, dof: float) -> float:
    """P(X > x) for a chi-square variable: the density of its root."""
    if x <= 0:
        return 1.0
    scale = (1 - dof / 2) * math.log(2) - math.lgamma(dof / 2)

    def log_density(u):
        return scale + (dof - 1) * np.log(u) - u * u / 2 if dof != 1 else scale - u * u / 2

    root = math.sqrt(x)
    if x < dof:
        return 1.0 - _integral(log_density, max(0.0, root - _REACH), root)
    return _integral(log_density, root, root + _REACH)


def t_two_sided(t: float, dof: float) -> float:
    """P(|T| > |t|)."""
    return beta_cdf(dof / (dof + t * t), dof / 2, 0.5)


def f_sf(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    return beta_cdf(d2 / (d2 + d1 * f), d2 / 2, d1 / 2) if f > 0 else 1.0


def p_value(kind: str, stat: float, d1: float, d2: float = 0.0) -> float:
    """p of a statistic: kind t (two-sided, d1 degrees), chi2 (d1) or F (d1, d2)."""
    if kind == "t":
        return t_two_sided(stat, d1)
    if kind == "chi2":
        return chi2_sf(stat, d1)
    if kind == "F":
        return f_sf(stat, d1, d2)
    raise ValueError(f"unknown statistic {kind}")


def t_ppf(q: float, dof: float) -> float:
    """The q-quantile of t, by halving an interval that holds it."""
    if q < 0.5:
        return -t_ppf(1 - q, dof)
    low, high = 0.0, 1.0
    while 1 - t_two_sided(high, dof) / 2 < q:
        low, high = high, 2 * high
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if 1 - t_two_sided(middle, dof) / 2 < q else (low, middle)
    return (low + high) / 2
