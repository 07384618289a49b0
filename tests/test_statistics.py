"""Distributions and tests against published values and identities."""

import math

import numpy as np
import pytest

from siltstone.functions import statistics as st


@pytest.mark.parametrize("df, p, t", [(1, 0.975, 12.7062), (5, 0.975, 2.5706), (10, 0.95, 1.8125), (30, 0.995, 2.7500), (120, 0.975, 1.9799)])
def test_t_table(df, p, t):
    assert st.t_quantile(p, df) == pytest.approx(t, abs=1e-4)
    assert st.t_two_sided(t, df) == pytest.approx(2 * (1 - p), abs=1e-5)


def test_normal():
    assert st.normal_cdf(1.959964) == pytest.approx(0.975, abs=1e-7) and st.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-6)


def test_wilcoxon_table_and_cases():
    a = np.array([125, 115, 130, 140, 140, 115, 140, 125, 140, 135], float)
    b = np.array([110, 122, 125, 120, 140, 124, 123, 137, 135, 145], float)
    w, p = st.wilcoxon(a, b)
    assert w == 18.0 and p == pytest.approx(0.594, abs=5e-3)
    w, p = st.wilcoxon(np.arange(1.0, 9), np.zeros(8))
    assert w == 0 and p == pytest.approx(2 / 2**8)
    assert all(math.isnan(x) for x in st.wilcoxon([1, 2], [1, 2]))


def test_shapiro_known_values():
    w, p = st.shapiro([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.79, abs=2e-3) and p == pytest.approx(0.0068, abs=1e-3)
    draw = np.random.default_rng(1)
    assert np.mean([st.shapiro(draw.normal(size=40))[1] < 0.05 for _ in range(400)]) == pytest.approx(0.05, abs=0.03)
    assert math.isnan(st.shapiro([1, 1, 1])[0])


def test_intervals_and_bootstrap():
    mean, low, high = st.mean_interval([1, 2, 3, 4, 5])
    assert (mean, low, high) == pytest.approx((3, 1.0368, 4.9632), abs=1e-4)
    draw = np.random.default_rng(2)
    a, b = draw.normal(0.5, 1, 200), draw.normal(0, 1, 200)
    diff, low, high, p = st.paired_bootstrap(a, b, 4000)
    assert low < diff < high and p < 0.01 and st.paired_bootstrap(a, b, 4000) == (diff, low, high, p)
    assert st.paired_bootstrap(a, a, 100)[0] == 0 and math.isnan(st.paired_bootstrap([], [])[0])
    assert st.difference_in_differences(a, b, 2000)[0] == pytest.approx(a.mean() - b.mean())
    one = st.clustered_bootstrap([8, 9], [10, 10], [1, 2], [10, 10], 500)
    assert one[0] == pytest.approx(0.7) and one[1] <= 0.7 <= one[2]


def test_paired_t_cases():
    assert st.paired_t([2, 3, 4], [1, 2, 3]) == (math.inf, 0.0)
    assert all(math.isnan(x) for x in st.paired_t([1, 1], [1, 1])) and math.isnan(st.paired_t([1], [2])[0])


def test_gee_without_clusters_is_logistic_regression():
    y, arm = np.array([1] * 30 + [0] * 10 + [1] * 15 + [0] * 25), np.array([1] * 40 + [0] * 40)
    effect, se, p = st.gee_exchangeable(y, arm, np.arange(80))
    assert effect == pytest.approx(math.log((30 / 10) / (15 / 25)), abs=1e-6) and p < 0.01
    assert se == pytest.approx(math.sqrt(1 / 30 + 1 / 10 + 1 / 15 + 1 / 25), rel=1e-3)
    assert st.separated([1, 1], [0, 1]) and not st.separated([0, 1], [1, 0])


def test_mixed_model_against_a_fine_grid():
    draw = np.random.default_rng(6)
    own = draw.normal(0, 1.2, 60)
    trials = np.full((60, 2), 12.0)
    hits = draw.binomial(12, 1 / (1 + np.exp(-(0.3 + own[:, None] + np.array([0.8, 0.0])))))
    grid = np.linspace(-8, 8, 4001)

    def likelihood(b0, b1, sigma):
        eta = b0 + b1 * np.array([1.0, 0.0]) + sigma * grid[:, None, None]
        return np.log((np.exp((hits * eta - trials * np.logaddexp(0, eta)).sum(axis=2)) * np.exp(-grid * grid / 2)[:, None]).sum(axis=0) * (grid[1] - grid[0]) / np.sqrt(2 * np.pi)).sum()

    effect, se, p, sigma = st.mixed_logistic(hits, trials, nodes=15)
    intercept = max(np.linspace(-1, 1, 401), key=lambda b: likelihood(b, effect, sigma))
    best = likelihood(intercept, effect, sigma)
    for step in (-0.02, 0.02):
        assert likelihood(intercept, effect + step, sigma) < best and likelihood(intercept, effect, sigma + step) < best
    # the standard error is the curvature of the profile
    assert effect == pytest.approx(0.8, abs=3 * se) and 0.08 < se < 0.2 and p < 1e-4 and 0.9 < sigma < 1.6
    assert st.mixed_logistic(hits, trials)[0] == pytest.approx(effect, abs=0.02)
    same = st.mixed_logistic(np.full((30, 2), 5.0), np.full((30, 2), 10.0))
    assert same[0] == pytest.approx(0, abs=1e-6) and same[2] == pytest.approx(1)
    assert all(np.isnan(x) for x in st.mixed_logistic(np.stack([np.full(20, 10.0), np.zeros(20)], axis=1), np.full((20, 2), 10.0)))
