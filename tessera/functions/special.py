"""Distribution functions in NumPy: what Spark has no built-in for."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_erfc = np.frompyfunc(math.erfc, 1, 1)
_lgamma = np.frompyfunc(math.lgamma, 1, 1)
_probit = np.frompyfunc(NormalDist().inv_cdf, 1, 1)


def erfc(x):
    return np.asarray(_erfc(np.asarray(x, float)), float)


def normal_cdf(x):
    return 0.5 * erfc(-np.asarray(x, float) / math.sqrt(2))


def normal_sf(x):
    return 0.5 * erfc(np.asarray(x, float) / math.sqrt(2))


def normal_quantile(p):
    return np.asarray(_probit(np.asarray(p, float)), float)


def log_gamma(x):
    return np.asarray(_lgamma(np.asarray(x, float)), float)


def _gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        for _ in range(10_000):
            k += 1
            term *= x / k
            total += term
            if abs(term) < abs(total) * 1e-16:
                break
        return max(0.0, 1 - total * front)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + k * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + k / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def _beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


gamma_q = np.vectorize(_gamma_q, otypes=[float])
beta_i = np.vectorize(_beta_i, otypes=[float])


def chi2_sf(x, dof):
    """P(chi-square > x); real degrees of freedom, 1 at none."""
    x, dof = np.broadcast_arrays(np.asarray(x, float), np.asarray(dof, float))
    return np.where(dof > 0, gamma_q(np.maximum(dof, 1e-300) / 2, np.maximum(x, 0) / 2), 1.0)


def gamma_sf(x, shape, scale):
    return gamma_q(shape, np.maximum(np.asarray(x, float), 0) / scale)


def t_two_sided(t, dof):
    """Two-sided p-value of Student's t."""
    t, dof = np.broadcast_arrays(np.asarray(t, float), np.asarray(dof, float))
    return beta_i(dof / 2, 0.5, dof / (dof + t * t))


def f_sf(x, d1, d2):
    """P(F > x)."""
    x = np.maximum(np.asarray(x, float), 0)
    return beta_i(np.asarray(d2, float) / 2, np.asarray(d1, float) / 2, d2 / (d2 + d1 * x))


def expm(a: np.ndarray) -> np.ndarray:
    """Matrix exponential by scaling, a Taylor polynomial and squaring."""
    a = np.asarray(a, float)
    s = max(0, math.ceil(math.log2(max(np.abs(a).sum(axis=1).max(initial=0), 1e-300))) + 4)
    x = a / 2**s
    out = term = np.eye(len(a))
    for k in range(1, 19):
        term = term @ x / k
        out = out + term
    for _ in range(s):
        out = out @ out
    return out


def weighted_chi2_sf(x: float, weights, points: int = 40_000) -> float:
    """P(sum of weights times independent chi-squares of one degree > x), by Imhof's integral for positive weights.

    1/2 + 1/pi int_0^inf sin(theta) / (u rho) du with theta = sum atan(w u) / 2 - x u / 2 and rho = prod (1 + w^2 u^2)^(1/4);
    few weights, whose integrand falls slowly, are integrated by the density's recursion instead: two as one integral
    over an angle, one as a chi-square.
    """
    w = np.asarray(weights, float)
    w = w[w > 1e-12 * max(w.max(initial=0.0), 1e-300)]
    if not len(w):
        return float(x < 0)
    if x <= 0:
        return 1.0
    if np.allclose(w, w[0], rtol=1e-12):
        return float(chi2_sf(x / w[0], len(w)))
    if len(w) == 2:
        # in polar coordinates the squared radius is a chi-square of two degrees
        angle = (np.arange(points) + 0.5) * (math.pi / 2) / points
        return float(np.exp(-x / 2 / (w[0] * np.cos(angle) ** 2 + w[1] * np.sin(angle) ** 2)).mean())
    # u = v / (1 - v)^2 puts the half line on [0, 1); the midpoint rule never meets its ends
    v = (np.arange(8 * points) + 0.5) / (8 * points)
    u = v / (1 - v) ** 2 / w.mean()
    du = (1 + v) / (1 - v) ** 3 / w.mean()
    theta = 0.5 * np.arctan(w[:, None] * u).sum(axis=0) - 0.5 * x * u
    log_rho = 0.25 * np.log1p((w[:, None] * u) ** 2).sum(axis=0)
    return float(min(1.0, max(0.0, 0.5 + (np.sin(theta) / u * np.exp(-log_rho) * du).mean() / math.pi)))
