"""Exact bootstrap intervals of a difference of shares."""

import itertools
import math

import numpy as np
import pytest

from tiltmeter.functions.stats import binomial_weights, share_gap_quantiles

LEVELS = [0.025, 0.5, 0.975]


def brute(n_a, k_a, n_b, k_b, level):
    def law(n, k, x):
        return math.comb(n, x) * (k / n) ** x * (1 - k / n) ** (n - x)
    weights = {}
    for x, y in itertools.product(range(n_a + 1), range(n_b + 1)):
        weights[x * n_b - y * n_a] = weights.get(x * n_b - y * n_a, 0) + law(n_a, k_a, x) * law(n_b, k_b, y)
    upto = 0.0
    for t in sorted(weights):
        upto += weights[t]
        if upto >= level:
            return t / (n_a * n_b)


@pytest.mark.parametrize("counts", [(1, 0, 1, 1), (1, 1, 1, 1), (5, 2, 7, 3), (12, 11, 9, 1), (30, 4, 17, 17), (23, 0, 31, 8), (40, 20, 40, 20)])
def test_against_all_pairs(counts):
    assert share_gap_quantiles(*counts, LEVELS) == [brute(*counts, v) for v in LEVELS]


def test_weights_are_a_law():
    for n, k in ((1, 1), (10, 3), (10 ** 6, 1), (10 ** 8, 5 * 10 ** 7), (10 ** 6, 999_999)):
        low, w = binomial_weights(n, k)
        at = low + np.arange(len(w))
        assert math.isclose(w.sum(), 1.0, rel_tol=1e-12) and math.isclose((w * at).sum(), k, rel_tol=1e-9)
        assert math.isclose((w * (at - float(k)) ** 2).sum(), k * (1 - k / n), rel_tol=1e-6, abs_tol=1e-12)


def test_draws_come_close():
    rng = np.random.default_rng(3)
    d = rng.binomial(900, 1 / 3, 400_000) / 900 - rng.binomial(2000, 0.4, 400_000) / 2000
    got = share_gap_quantiles(900, 300, 2000, 800, [0.025, 0.975])
    assert np.allclose(got, np.percentile(d, [2.5, 97.5]), atol=4e-4)


def test_large_groups_follow_the_normal_law():
    n = 10 ** 11
    low, high = share_gap_quantiles(n, n // 4, n, n // 2, [0.025, 0.975])
    half = 1.959963984540054 * math.sqrt((0.25 * 0.75 + 0.25) / n)
    assert math.isclose(low, -0.25 - half, rel_tol=1e-9) and math.isclose(high, -0.25 + half, rel_tol=1e-9)
    with pytest.raises(OverflowError):
        share_gap_quantiles(10 ** 13, 5, 10, 5, [0.5])
