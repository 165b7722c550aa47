"""Numeric kernels in numpy: distribution functions, fits and matrix transforms.

All take and return arrays of doubles. There is no dependency on a statistics library.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

TINY = 2.2250738585072014e-308


def _lgamma(x):
    x = np.asarray(x, float)
    return np.fromiter(map(math.lgamma, x.ravel()), float, x.size).reshape(x.shape)


def betainc(a, b, x):
    """Regularised incomplete beta function, by its continued fraction."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    out = np.full(x.shape, np.nan)
    ok = np.isfinite(a) & np.isfinite(b) & np.isfinite(x) & (a > 0) & (b > 0)
    out[ok & (x <= 0)], out[ok & (x >= 1)] = 0.0, 1.0
    mid = ok & (x > 0) & (x < 1)
    if not mid.any():
        return out
    a, b, x = a[mid], b[mid], x[mid]
    flip = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
            c = np.where(np.abs(c) < 1e-300, 1e-300, c)
            h = h * (d * c)
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    out[mid] = np.where(flip, 1 - front * h, front * h)
    return out


def f_upper(f, d1, d2):
    """Upper tail of the F distribution."""
    f = np.asarray(f, float)
    return betainc(np.asarray(d2, float) / 2, np.asarray(d1, float) / 2, d2 / (d2 + d1 * f))


def corr_p(r, df):
    """Two-sided p-value of a correlation with so many degrees of freedom, at least the smallest normal double."""
    r2 = np.minimum(np.asarray(r, float) ** 2, 1.0)
    return np.maximum(betainc(np.asarray(df, float) / 2, 0.5, 1 - r2), TINY)


def _invert(f, target, lo, hi, steps=200):
    """Where an increasing function reaches the target."""
    lo, hi = np.full_like(target, lo), np.full_like(target, hi)
    for _ in range(steps):
        mid = (lo + hi) / 2
        below = f(mid) < target
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


def qbeta(p, a, b):
    p, a, b = (np.array(v, float) for v in np.broadcast_arrays(p, a, b))
    return _invert(lambda x: betainc(a, b, x), p, 0.0, 1.0)


def qf_upper(p, d1, d2):
    """The value that an F variate exceeds with probability p."""
    p, d1, d2 = (np.array(v, float) for v in np.broadcast_arrays(p, d1, d2))
    # in log space: tiny p-values lie near x = 0
    log_x = _invert(lambda y: betainc(d2 / 2, d1 / 2, np.exp(y)), p, -745.0, 0.0)
    x = np.exp(log_x)
    return d2 / d1 * (1 - x) / np.maximum(x, 1e-320)


def r_threshold(p, df):
    """The absolute correlation at which the p-value is p."""
    f = qf_upper(p, 1.0, df)
    return np.sqrt(f / (df + f))


def qnorm(p):
    inv = NormalDist().inv_cdf
    return np.array([inv(x) if 0 < x < 1 else math.copysign(math.inf, x - 0.5) for x in np.ravel(p)]).reshape(np.shape(p))


def binom_pmf(k, n, p):
    k, n, p = (np.array(v, float) for v in np.broadcast_arrays(k, n, p))
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.exp(_lgamma(n + 1) - _lgamma(k + 1) - _lgamma(n - k + 1) + np.where(k > 0, k * np.log(p), 0) + np.where(n - k > 0, (n - k) * np.log1p(-p), 0))
    return np.where(p <= 0, (k == 0) * 1.0, np.where(p >= 1, (k == n) * 1.0, out))


def binom_upper(k, n, p):
    """P(X > k)."""
    return np.where(np.asarray(k) >= np.asarray(n), 0.0, betainc(np.asarray(k, float) + 1, np.maximum(np.asarray(n, float) - k, 1e-9), p))


def binom_two_sided(x: int, n: int, p: float) -> float:
    """Exact test: the probability of all outcomes no likelier than the observed one, with a relative slack of 1e-7."""
    if n == 0:
        return 1.0
    if p <= 0 or p >= 1:
        return float(x == (0 if p <= 0 else n))
    pmf = binom_pmf(np.arange(n + 1), n, p)
    if x == n * p:
        return 1.0
    return float(min(1.0, pmf[pmf <= pmf[x] * (1 + 1e-7)].sum()))


def nelder_mead(f, start, step=0.1, size=0.01, limit=1000):
    """Minimise over a simplex that begins with relative steps; ends when its mean size falls below ``size``."""
    start = np.asarray(start, float)
    points = np.vstack([start, *[start + np.eye(start.size)[i] * step * start[i] for i in range(start.size)]])
    values = np.array([f(x) for x in points])
    for _ in range(limit):
        order = values.argsort(kind="stable")
        points, values = points[order], values[order]
        if np.linalg.norm(points - points.mean(axis=0), axis=1).mean() < size:
            break
        middle = points[:-1].mean(axis=0)
        near = middle + (middle - points[-1])
        v = f(near)
        if v < values[0]:
            far = middle + 2 * (middle - points[-1])
            w = f(far)
            points[-1], values[-1] = (far, w) if w < v else (near, v)
        elif v < values[-2]:
            points[-1], values[-1] = near, v
        else:
            inner = middle + 0.5 * ((near if v < values[-1] else points[-1]) - middle)
            w = f(inner)
            if w < min(v, values[-1]):
                points[-1], values[-1] = inner, w
            else:
                points[1:] = points[0] + 0.5 * (points[1:] - points[0])
                values[1:] = [f(x) for x in points[1:]]
    best = values.argmin()
    return points[best], values[best]


def beta_moments(p: np.ndarray) -> tuple[float, float]:
    m, v = p.mean(), p.var(ddof=1)
    a = m * (m * (1 - m) / v - 1)
    return a, a * (1 / m - 1)


def beta_fit(p: np.ndarray, shape1=(0.1, 10.0), shape2=(5.0, 1e6)) -> tuple[float, float]:
    """Maximum likelihood beta shapes from a start by moments; outside the bounds the moments stay."""
    start = beta_moments(p)
    p = np.where(p >= 1, 0.99999999, p)
    s1, s2, n = np.log(np.maximum(p, TINY)).sum(), np.log1p(-p).sum(), p.size

    def loss(x):
        a, b = x
        if a <= 0 or b <= 0:
            return math.inf
        return -((a - 1) * s1 + (b - 1) * s2 - n * (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)))

    (a, b), _ = nelder_mead(loss, start)
    return (a, b) if shape1[0] <= a <= shape1[1] and shape2[0] <= b <= shape2[1] else start


def fit_df(r: np.ndarray, start: float) -> float:
    """Degrees of freedom at which the p-values of null correlations have a first beta shape of 1."""

    def loss(x):
        if x[0] <= 0:
            return math.inf
        return abs(beta_moments(corr_p(r, x[0]))[0] - 1)

    return float(nelder_mead(loss, [start], limit=20)[0][0])


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1, ties averaged."""
    _, inverse, counts = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(counts) - (counts - 1) / 2)[inverse]


def rank_normal(x: np.ndarray) -> np.ndarray:
    """Normal quantiles of (rank - 1/2) / largest average rank."""
    r = average_ranks(x)
    return qnorm((r - 0.5) / r.max())


def impute(x: np.ndarray) -> np.ndarray:
    """Row means in place of NaN."""
    gap = np.isnan(x)
    if not gap.any():
        return x
    n = (~gap).sum(axis=-1, keepdims=True)
    mean = np.where(gap, 0, x).sum(axis=-1, keepdims=True) / np.where(n == 0, np.nan, n)
    return np.where(gap, mean, x)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows centred and scaled to unit length; constant rows become 0."""
    x = x - x.mean(axis=-1, keepdims=True)
    norm = np.sqrt((x * x).sum(axis=-1, keepdims=True))
    return x / np.where(norm == 0, 1, norm)


def sd(x: np.ndarray) -> np.ndarray:
    return x.std(axis=-1, ddof=1) if x.shape[-1] > 1 else np.zeros(x.shape[:-1])


def slope(r, sd_p, sd_g):
    return np.where((sd_p < 1e-16) | (sd_g < 1e-16), 0.0, r * sd_p / np.where(sd_g < 1e-16, 1, sd_g))


def slope_se(r, sd_p, sd_g, n):
    return np.where((sd_p < 1e-16) | (sd_g < 1e-16), 0.0, sd_p / np.where(sd_g < 1e-16, 1, sd_g) * np.sqrt(np.maximum(1 - r * r, 0) / max(n - 2, 1)))


def encode_covariates(rows: list[list[str | None]]) -> np.ndarray:
    """Numeric columns from covariates given as text: numbers stay, text becomes one column for each level but the
    first in order; NA takes the column's mean; constant columns go; a mix of numbers and text is an error."""
    columns = []
    for row in rows:
        known = [x for x in row if x is not None and x != "NA"]
        numeric = []
        for x in known:
            try:
                numeric.append(float(x))
            except ValueError:
                pass
        if numeric and len(numeric) < len(known):
            raise ValueError(f"a covariate mixes numbers and text: {known[:5]}")
        gap = [x is None or x == "NA" for x in row]
        if numeric:
            columns.append(np.array([np.nan if g else float(x) for x, g in zip(row, gap, strict=True)]))
        else:
            columns += [np.array([np.nan if g else float(x == level) for x, g in zip(row, gap, strict=True)]) for level in sorted(set(known))[1:]]
    columns = [impute(c[None])[0] for c in columns]
    kept = [c for c in columns if np.ptp(c) > 0]
    return np.array(kept).reshape(len(kept), -1)


def basis(covariates: np.ndarray, tol: float = 1e-7) -> np.ndarray:
    """Orthonormal rows that span a constant and the covariates (rows)."""
    design = np.vstack([np.ones(covariates.shape[1]), covariates])
    _, s, vt = np.linalg.svd(design / np.maximum(np.linalg.norm(design, axis=1, keepdims=True), TINY), full_matrices=False)
    return vt[s > tol * s[0]]


def residualise(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Rows of x less their projection on the basis; constant rows are returned as they are."""
    out = x - (x @ q.T) @ q
    return np.where(np.ptp(x, axis=-1, keepdims=True) == 0, x, out)


def regress_out(x: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Rows of x less their regression on one vector."""
    return residualise(x, basis(g[None]))
