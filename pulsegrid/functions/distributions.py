"""Small numeric helpers for one-row-per-test frames: quantiles, studentised range, power, Royston's W."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_STD = NormalDist()


def normal_quantile(p) -> np.ndarray:
    return np.array([_STD.inv_cdf(float(v)) if 0 < v < 1 else np.nan for v in np.atleast_1d(p)])


def normal_cdf(x) -> np.ndarray:
    return 0.5 * np.vectorize(math.erfc, otypes=[float])(-np.asarray(x, float) / math.sqrt(2))


def _chi_scale_nodes(df: float, n: int = 96):
    """Nodes and weights for s = sqrt(chi2_df / df)."""
    half = 8.0 / math.sqrt(2.0 * df)
    lo, hi = max(1e-9, 1.0 - half), 1.0 + half
    x, w = np.polynomial.legendre.leggauss(n)
    s = 0.5 * (hi - lo) * x + 0.5 * (hi + lo)
    log_f = (df / 2) * math.log(df) - math.lgamma(df / 2) - (df / 2 - 1) * math.log(2) + (df - 1) * np.log(s) - df * s * s / 2
    return s, 0.5 * (hi - lo) * w * np.exp(log_f)


def studentized_range_tail(q: float, k: float, df: float) -> float:
    """P(Q > q) for ``k`` means and ``df`` degrees of freedom, by Gauss–Legendre quadrature."""
    if not (q > 0):
        return 1.0
    z, wz = np.polynomial.legendre.leggauss(128)
    z, wz = 9.0 * z, 9.0 * wz
    phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    s, ws = _chi_scale_nodes(df)
    inner = normal_cdf(z)[None, :] - normal_cdf(z[None, :] - q * s[:, None])
    cdf = k * (wz * phi * inner ** (k - 1)).sum(axis=1)
    return float(min(1.0, max(0.0, 1.0 - (ws * cdf).sum() / ws.sum())))


def t_quantile(p: float, df: float) -> float:
    """Quantile of Student's t by bisection on the quadrature CDF."""
    s, w = _chi_scale_nodes(df, 128)
    w = w / w.sum()
    lo, hi = -200.0, 200.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        lo, hi = (mid, hi) if float((w * normal_cdf(mid * s)).sum()) < p else (lo, mid)
    return 0.5 * (lo + hi)


def two_sample_power(d: float, n: int, alpha: float = 0.05) -> float:
    df, delta = 2 * n - 2, d * math.sqrt(n / 2)
    crit = t_quantile(1 - alpha / 2, df)
    s, w = _chi_scale_nodes(df, 128)
    w = w / w.sum()
    return float((w * (1 - normal_cdf(crit * s - delta) + normal_cdf(-crit * s - delta))).sum())


def detectable_effect(n: int, power: float = 0.8, alpha: float = 0.05) -> float:
    """Cohen's d that a two-sample t test with ``n`` per arm detects with the given power."""
    df = 2 * n - 2
    crit = t_quantile(1 - alpha / 2, df)
    s, w = _chi_scale_nodes(df, 128)
    w = w / w.sum()
    lo, hi = 0.0, 20.0
    for _ in range(60):
        d = 0.5 * (lo + hi)
        delta = d * math.sqrt(n / 2)
        reached = float((w * (1 - normal_cdf(crit * s - delta) + normal_cdf(-crit * s - delta))).sum())
        lo, hi = (d, hi) if reached < power else (lo, d)
    return 0.5 * (lo + hi)


# Royston's AS R94 polynomial coefficients, lowest power first (fixed values)
ROYSTON_C1 = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
ROYSTON_C2 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
ROYSTON_C3 = (0.5440, -0.39978, 0.025054, -6.714e-4)
ROYSTON_C4 = (1.3822, -0.77857, 0.062767, -0.0020322)
ROYSTON_C5 = (-1.5861, -0.31082, -0.083751, 0.0038915)
ROYSTON_C6 = (-0.4803, -0.082676, 0.0030302)
ROYSTON_G = (-2.273, 0.459)


def _poly(c, x):
    return sum(v * x ** i for i, v in enumerate(c))


def royston_p(n, mm, ss, mid, x1, x2, y2, y1, m1, m2):
    """W and its p from the sums ``inference.shapiro`` collects (extremes x1,x2 … y2,y1 and their scores)."""
    if not ss or ss <= 0:
        return 1.0, 1.0
    if n == 3:
        w = min(1.0, (math.sqrt(0.5) * (y1 - x1)) ** 2 / ss)
        p = 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return w, max(0.0, p)
    u = 1 / math.sqrt(n)
    a1 = m1 / math.sqrt(mm) + _poly(ROYSTON_C1, u)
    a2 = m2 / math.sqrt(mm) + _poly(ROYSTON_C2, u) if n > 5 else None
    if n > 5:
        scale = math.sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2))
        b = a1 * (y1 - x1) + a2 * (y2 - x2) + (0.0 if mid is None or mid != mid else mid) / scale
    else:
        scale = math.sqrt((mm - 2 * m1 * m1) / (1 - 2 * a1 * a1))
        inner = (0.0 if mid is None or mid != mid else mid) + m2 * (y2 - x2)
        b = a1 * (y1 - x1) + inner / scale
    w = min(1.0, b * b / ss)
    if w == 1.0:
        return w, 1.0
    y, ln = math.log(1 - w), math.log(n)
    if n <= 11:
        gamma = _poly(ROYSTON_G, n)
        if y >= gamma:
            return w, 0.0
        z = (-math.log(gamma - y) - _poly(ROYSTON_C3, n)) / math.exp(_poly(ROYSTON_C4, n))
    else:
        z = (y - _poly(ROYSTON_C5, ln)) / math.exp(_poly(ROYSTON_C6, ln))
    return w, 0.5 * math.erfc(z / math.sqrt(2))


def type_two_rows(a, b, n, mean, var_pop, min_n):
    """Sums of squares of A, B and A:B from weighted cell means (type II: each main effect after the other)."""
    n, mean = np.asarray(n, float), np.asarray(mean, float)
    la, lb = sorted(set(a)), sorted(set(b))
    total = n.sum()
    if len(la) < 2 or len(lb) < 2 or total < min_n:
        return []
    within = float((n * np.asarray(var_pop, float)).sum())
    one = np.ones((len(n), 1))
    da = np.array([[x == v for v in la[1:]] for x in a], float)
    db = np.array([[x == v for v in lb[1:]] for x in b], float)
    dab = np.hstack([da[:, [i]] * db[:, [j]] for i in range(da.shape[1]) for j in range(db.shape[1])])
    root = np.sqrt(n)

    def fit(*blocks):
        x = np.hstack([one, *blocks]) * root[:, None]
        coef, _, rank, _ = np.linalg.lstsq(x, mean * root, rcond=None)
        r = mean * root - x @ coef
        return float(r @ r), rank
    (r_a, k_a), (r_b, k_b), (r_ab, k_ab), (r_full, k_full) = fit(da), fit(db), fit(da, db), fit(da, db, dab)
    df_error = int(total - k_full)
    if df_error <= 0:
        return []
    mse = (within + r_full) / df_error
    rows = []
    for name, ss, df in (("a", r_b - r_ab, k_ab - k_b), ("b", r_a - r_ab, k_ab - k_a), ("a:b", r_ab - r_full, k_full - k_ab)):
        rows.append((name, ss, int(df), ss / df / mse if df > 0 and mse > 0 else None, df_error))
    return rows
