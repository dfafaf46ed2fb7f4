"""Unit-root tests of one series as an array, as the published formulas read: what the distributed ones are held against."""

import math

import numpy as np

from tributary.functions.dist import normal_cdf
from tributary.operators import stationarity as S


def ols(y, x):
    """By the design itself: its products would lose digits far from zero."""
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    r = y - x @ beta
    inverse = np.linalg.pinv(x)
    return beta, float(r @ r), inverse @ inverse.T


def adf(x):
    """tau, lags."""
    n, d = len(x), np.diff(x)
    most = min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)
    if most < 0:
        raise ValueError("too short")

    def design(lags, drop):
        y = d[drop:]
        return y, np.column_stack([x[drop:-1], *(d[drop - k : len(d) - k] for k in range(1, lags + 1)), np.ones(len(y))])

    scores = []
    for lags in range(most + 1):
        y, z = design(lags, most)
        scores.append(len(y) * (math.log(2 * math.pi) + math.log(max(ols(y, z)[1], 1e-300) / len(y)) + 1) + 2 * z.shape[1])
    lags = int(np.argmin(scores))
    y, z = design(lags, lags)
    beta, rss, inverse = ols(y, z)
    return beta[0] / math.sqrt(rss / (len(y) - z.shape[1]) * inverse[0, 0]), lags


def kpss(x):
    """Statistic, lags."""
    n = len(x)
    t = np.column_stack([np.ones(n), np.arange(1, n + 1)])
    r = x - t @ np.linalg.lstsq(t, x, rcond=None)[0]
    s0, s1 = float(r @ r) / n, 0.0
    for i in range(1, int(n ** (2 / 9)) + 1):
        c = float(r[i:] @ r[:-i]) / (n / 2)
        s0, s1 = s0 + c, s1 + i * c
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    s2 = float(r @ r) + sum(2 * float(r[i:] @ r[:-i]) * (1 - i / (lags + 1)) for i in range(1, lags + 1))
    return float((np.cumsum(r) ** 2).sum()) / n**2 / (s2 / n), lags


def order(x, test, most, alpha):
    def p(d):
        if test == "kpss":
            stat = kpss(np.diff(x, d))[0]
            return float(np.interp(stat, [c for c, _ in S.KPSS_LEVELS], [v for _, v in S.KPSS_LEVELS]))
        tau = adf(np.diff(x, d))[0]
        if tau > S.TAU_MAX or tau < S.TAU_MIN:
            return float(tau > S.TAU_MAX)
        return normal_cdf(sum(c * tau**k for k, c in enumerate(S.SMALL_P if tau <= S.TAU_STAR else S.LARGE_P)))

    return S.decide(len(x), lambda d: float(np.ptp(np.diff(x, d))), p, test, most, alpha)
