"""Tails and quantiles of t, F, the normal and the studentised range, without a statistics library."""

from __future__ import annotations

import math

import numpy as np


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 1000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / (c if abs(c) > tiny else tiny)
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def t_tail(t: float, df: float) -> float:
    """P(|T| > |t|)."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def t_quantile(p: float, df: float) -> float:
    """By bisection on the tail."""
    if p == 0.5:
        return 0.0
    tail, low, high = 2 * min(p, 1 - p), 0.0, 1.0
    while t_tail(high, df) > tail:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_tail(mid, df) > tail else (low, mid)
    return math.copysign((low + high) / 2, p - 0.5)


def f_tail(f: float, df1: float, df2: float) -> float:
    """P(F > f)."""
    return 1.0 if f <= 0 else incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def normal_cdf(z):
    return 0.5 * np.vectorize(math.erfc)(-np.asarray(z, float) / math.sqrt(2))


def _range_cdf(w: np.ndarray, k: int) -> np.ndarray:
    """P(range of k normals <= w), by Gauss-Legendre on the smallest."""
    x, wt = np.polynomial.legendre.leggauss(96)
    z = 8 * x
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return k * 8 * ((normal_cdf(z[:, None] + w[None]) - normal_cdf(z)[:, None]) ** (k - 1) * (density * wt)[:, None]).sum(axis=0)


def tukey_tail(q: float, k: int, df: float) -> float:
    """P(Q > q) of the studentised range of k means: the range's distribution over that of the estimated spread."""
    if q <= 0:
        return 1.0
    if not math.isfinite(df) or df > 20000:
        return float(1 - _range_cdf(np.array([q]), k)[0])
    x, wt = np.polynomial.legendre.leggauss(96)
    reach = 9 / math.sqrt(2 * df)
    low, high = max(1e-8, 1 - reach), 1 + reach
    if df < 12:
        low, high = 1e-8, 1 + 12 / math.sqrt(df)
    s = low + (high - low) * (x + 1) / 2
    log_density = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    inside = (np.exp(log_density) * wt * _range_cdf(q * s, k)).sum() * (high - low) / 2
    mass = (np.exp(log_density) * wt).sum() * (high - low) / 2
    return float(min(1.0, max(0.0, 1 - inside / mass)))


def adjust(p: list[float], method: str = "none") -> list[float]:
    """Multiplicity adjustments of p values: none, bonferroni, sidak, holm, hochberg, hommel, BH (fdr), BY."""
    p = np.asarray(p, float)
    n, order = len(p), np.argsort(p, kind="stable")
    back, up = np.argsort(order, kind="stable"), p[order]
    rank = np.arange(1, n + 1)
    if method == "none" or not n:
        out = p
    elif method == "bonferroni":
        out = p * n
    elif method == "sidak":
        out = 1 - (1 - p) ** n
    elif method == "holm":
        out = np.maximum.accumulate(up * (n - rank + 1))[back]
    elif method in ("hochberg", "BH", "fdr", "BY"):
        scale = n - rank + 1 if method == "hochberg" else n / rank * (np.sum(1 / rank) if method == "BY" else 1)
        out = np.minimum.accumulate((up * scale)[::-1])[::-1][back]
    elif method == "hommel":
        # The smallest level at which a closed test of Simes rejects each hypothesis.
        best = np.full(n, np.min(n * up / rank))
        for m in range(n - 1, 1, -1):
            simes = np.min(m * up[n - m + 1 :] / np.arange(2, m + 1))
            low = np.minimum(m * up[: n - m + 1], simes)
            best = np.maximum(best, np.concatenate([low, np.full(m - 1, low[-1])]))
        out = np.maximum(best, up)[back]
    else:
        raise ValueError(f"unknown adjustment: {method}")
    return np.minimum(out, 1.0).tolist()
