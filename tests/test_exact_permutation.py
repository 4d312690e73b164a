"""The exact permutation law against sums over all counts in fractions."""

import math
import random
from fractions import Fraction

import pytest

from tiltmeter.functions.stats import hypergeometric_gap_p


def brute(n_a, k_a, n_b, k_b):
    n, k = n_a + n_b, k_a + k_b
    if n <= 10 or not n_a or not n_b:
        return None
    gap = abs(Fraction(k_a, n_a) - Fraction(k_b, n_b))
    ways = {x: math.comb(k, x) * math.comb(n - k, n_a - x) for x in range(max(0, n_a - n + k), min(n_a, k) + 1)}
    return Fraction(sum(w for x, w in ways.items() if abs(Fraction(x, n_a) - Fraction(k - x, n_b)) >= gap), sum(ways.values()))


def test_all_counts():
    rng = random.Random(5)
    cases = [(a, x, b, y) for a in (0, 1, 6, 9) for b in (0, 5, 8) for x in range(a + 1) for y in range(b + 1)]
    for _ in range(300):
        a, b = rng.randint(1, 300), rng.randint(1, 300)
        cases.append((a, rng.randint(0, a), b, rng.randint(0, b)))
    for c in cases:
        want, got = brute(*c), hypergeometric_gap_p(*c)
        assert (got is None) == (want is None), c
        assert want is None or math.isclose(got, want, rel_tol=1e-9, abs_tol=1e-300), (c, got, float(want))


@pytest.mark.parametrize("n", [10 ** 8, 10 ** 10])
def test_large_counts_follow_the_normal_form(n):
    k_a = n // 10 + int(1.2 * math.sqrt(n))
    p = hypergeometric_gap_p(n, k_a, n, n // 10)
    k = k_a + n // 10
    sd = math.sqrt(n * (k / (2 * n)) * (1 - k / (2 * n)) * n / (2 * n - 1))
    assert math.isclose(p, math.erfc((k_a - k / 2 - 0.5) / sd / math.sqrt(2)), rel_tol=1e-3)
