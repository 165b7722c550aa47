"""Numeric kernels against identities and plain sums."""

import math
from statistics import NormalDist

import numpy as np
import pytest

from locusloom.functions import stats


def test_betainc_is_a_binomial_sum():
    for n, k, p in ((10, 3, 0.2), (40, 17, 0.6), (5, 0, 0.5)):
        tail = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1, n + 1))
        assert abs(float(stats.binom_upper(k, n, p)) - tail) < 1e-12
        assert abs(float(stats.binom_pmf(k, n, p)) - math.comb(n, k) * p**k * (1 - p) ** (n - k)) < 1e-12


def test_correlation_p_value_has_a_finite_sum_for_even_df():
    df = 48
    for r in (0.0, 0.1, -0.4, 0.8):
        t, s = 1.0, 1.0
        for k in range(1, df // 2):
            t *= (2 * k - 1) / (2 * k) * (1 - r * r)
            s += t
        assert abs(float(stats.corr_p(r, df)) - (1 - abs(r) * s)) < 1e-12
    assert float(stats.corr_p(1.0, df)) == stats.TINY


def test_quantiles_invert():
    p = np.array([1e-9, 0.01, 0.3, 0.99])
    assert np.allclose(stats.betainc(2.0, 7.0, stats.qbeta(p, 2.0, 7.0)), p, rtol=1e-8)
    assert np.allclose(stats.f_upper(stats.qf_upper(p, 1.0, 98.0), 1.0, 98.0), p, rtol=1e-6)
    assert np.allclose(stats.corr_p(stats.r_threshold(p, 98.0), 98.0), p, rtol=1e-6)
    assert np.allclose([NormalDist().cdf(x) for x in stats.qnorm(p)], p)


def test_two_sided_binomial():
    assert stats.binom_two_sided(5, 10, 0.5) == 1.0
    assert abs(stats.binom_two_sided(2, 10, 0.5) - 2 * sum(math.comb(10, i) for i in range(3)) / 1024) < 1e-12
    assert stats.binom_two_sided(0, 4, 0.0) == 1.0 and stats.binom_two_sided(1, 4, 0.0) == 0.0


def test_beta_fit_recovers_shapes():
    p = np.random.default_rng(1).beta(1.1, 40, 4000)
    a, b = stats.beta_fit(p)
    assert abs(a - 1.1) < 0.1 and abs(b - 40) < 4


def test_effective_df_of_independent_null():
    r = np.random.default_rng(2)
    x = stats.unit(r.normal(size=(2, 100)))
    null = np.array([x[0] @ x[1][r.permutation(100)] for _ in range(2000)])
    assert 85 < stats.fit_df(null, 98.0) < 112


def test_ranks_and_transforms():
    assert stats.average_ranks(np.array([3.0, 1, 3, 2])).tolist() == [3.5, 1, 3.5, 2]
    assert abs(stats.rank_normal(np.array([3.0, 1, 2]))[2]) < 0.3
    x = stats.impute(np.array([[1.0, np.nan, 3.0]]))
    assert x.tolist() == [[1, 2, 3]]
    assert np.allclose(stats.unit(np.array([[1.0, 1, 1], [1, 2, 3]])), [[0, 0, 0], [-(0.5**0.5), 0, 0.5**0.5]])


def test_covariates():
    c = stats.encode_covariates([["1", "2", "NA"], ["a", "b", "c"], ["k", "k", "k"]])
    assert c.tolist() == [[1, 2, 1.5], [0, 1, 0], [0, 0, 1]]
    with pytest.raises(ValueError):
        stats.encode_covariates([["1", "x"]])
    q = stats.basis(np.array([[1.0, 2, 3, 4, 5], [2, 4, 6, 8, 10]]))
    assert len(q) == 2
    y = np.random.default_rng(3).normal(size=(1, 5))
    assert np.allclose(stats.residualise(y, q) @ q.T, 0)
    assert stats.residualise(np.ones((1, 5)), q).tolist() == [[1.0] * 5]


def test_slope_and_its_error():
    r = np.random.default_rng(4)
    x, y = r.normal(size=50), r.normal(size=50)
    c = float(stats.unit(x[None])[0] @ stats.unit(y[None])[0])
    b, a = np.polyfit(x, y, 1)
    assert abs(float(stats.slope(c, stats.sd(y[None])[0], stats.sd(x[None])[0])) - b) < 1e-10
    se = math.sqrt(((y - b * x - a) ** 2).sum() / 48 / ((x - x.mean()) ** 2).sum())
    assert abs(float(stats.slope_se(c, stats.sd(y[None])[0], stats.sd(x[None])[0], 50)) - se) < 1e-10
