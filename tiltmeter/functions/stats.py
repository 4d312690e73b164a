"""Distribution functions without scipy, and the UDFs that apply them to aggregated rows.

The UDFs only ever see one row per group (counts, means), never raw rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F, types as T

#: numpy draws hypergeometric counts for fewer rows than this.
DRAW_LIMIT = 10 ** 9


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction.

    The fraction needs about sqrt(max(a, b)) steps; not to have settled after many
    times that is an error, not an answer.
    """
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000 + 50 * int(math.sqrt(max(a, b)))):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            return front * h
    raise ArithmeticError(f"incomplete beta of {a}, {b}, {x} did not settle")


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def chi2_1_upper(x: float) -> float:
    return math.erfc(math.sqrt(x / 2.0))


def t_two_sided(t: float, df: float) -> float:
    if math.isinf(t):
        return 0.0
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def binomial_half_two_sided(k: int, n: int) -> float:
    """Exact two-sided p at one half, for any number of trials."""
    if n == 0:
        return 1.0
    low = min(k, n - k)
    if 2 * low == n:
        return 1.0
    return min(1.0, 2.0 * incomplete_beta(n - low, low + 1.0, 0.5))


def signed_rank_is_exact(n, n_ties, n_zero):
    """Whether :func:`wilcoxon_p` sums all sign patterns; works on numbers and on Columns."""
    return (n <= 50) & (n_ties == 0) & (n_zero == 0)


def wilcoxon_p(w: float, n: int, tie_sum: float, has_ties: bool, has_zeros: bool) -> float | None:
    """Two-sided p of the signed-rank statistic: exact up to 50 untied values, else normal."""
    if n == 0:
        return None
    if signed_rank_is_exact(n, int(has_ties), int(has_zeros)):
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1.0
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:len(ways) - r]
        return float(min(1.0, 2.0 * ways[:int(w) + 1].sum() / 2.0 ** n))
    var = n * (n + 1.0) * (2.0 * n + 1.0) / 24.0 - tie_sum / 48.0
    if var <= 0:
        return None
    return float(min(1.0, normal_two_sided((w - n * (n + 1.0) / 4.0) / math.sqrt(var))))


def _rng(seed: int, key: str) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(key.encode("utf-8"))])


def _none(*values) -> bool:
    return any(v is None or (isinstance(v, float) and math.isnan(v)) for v in values)


def _each(fn, *cols) -> pd.Series:
    return pd.Series([None if _none(*row) else fn(*row) for row in zip(*cols)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series) -> pd.Series:
    return _each(chi2_1_upper, x)


@F.pandas_udf(T.DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _each(t_two_sided, t, df)


@F.pandas_udf(T.DoubleType())
def binomial_p(k: pd.Series, n: pd.Series) -> pd.Series:
    return _each(lambda a, b: binomial_half_two_sided(int(a), int(b)), k, n)


@F.pandas_udf(T.DoubleType())
def signed_rank_p(w: pd.Series, n: pd.Series, tie_sum: pd.Series, n_ties: pd.Series, n_zero: pd.Series) -> pd.Series:
    return _each(lambda a, b, c, d, e: wilcoxon_p(a, int(b), c, d > 0, e > 0), w, n, tie_sum, n_ties, n_zero)


def spd_interval(replicates: int, seed: int):
    """Percentile interval of the parity difference.

    Resampling a 0/1 column with replacement draws a binomial count, so the
    interval needs only the group sizes and hits.
    """

    @F.pandas_udf(T.StructType([T.StructField("lower", T.DoubleType()), T.StructField("upper", T.DoubleType())]))
    def interval(key: pd.Series, n_a: pd.Series, k_a: pd.Series, n_b: pd.Series, k_b: pd.Series) -> pd.DataFrame:
        out = []
        for key_, na, ka, nb, kb in zip(key, n_a, k_a, n_b, k_b):
            rng = _rng(seed, str(key_))
            d = rng.binomial(na, ka / na, replicates) / na - rng.binomial(nb, kb / nb, replicates) / nb
            out.append(np.percentile(d, [2.5, 97.5]))
        return pd.DataFrame(out, columns=["lower", "upper"])

    return interval


def permutation_gap_p(replicates: int, seed: int):
    """Permutation p of a rate gap between two groups.

    Shuffling a 0/1 column between groups of fixed size draws a hypergeometric
    count, from DRAW_LIMIT rows on its normal form (callers report which). Null
    with ten rows or fewer, or when a group is empty.
    """

    def draw(key, n_a, k_a, n_b, k_b):
        n, k = n_a + n_b, k_a + k_b
        if n <= 10 or n_a == 0 or n_b == 0:
            return float("nan")
        rng = _rng(seed, str(key))
        if n < DRAW_LIMIT:
            x = rng.hypergeometric(k, n - k, n_a, replicates)
        else:
            mean, var = n_a * k / n, n_a * (k / n) * (1 - k / n) * (n_b / (n - 1.0))
            x = np.rint(rng.normal(mean, math.sqrt(var), replicates))
        gap = x / n_a - (k - x) / n_b
        return float(np.mean(np.abs(gap) >= abs(k_a / n_a - k_b / n_b)))

    @F.pandas_udf(T.DoubleType())
    def p_value(key: pd.Series, n_a: pd.Series, k_a: pd.Series, n_b: pd.Series, k_b: pd.Series) -> pd.Series:
        p = pd.Series([draw(*row) for row in zip(key, n_a, k_a, n_b, k_b)], dtype="float64")
        return p.where(p.notna(), None)

    return p_value


#: Standard deviations on both sides of the mode beyond which a hypergeometric law has no weight that a double could add.
SUPPORT = 45


def hypergeometric_gap_p(n_a: int, k_a: int, n_b: int, k_b: int) -> float | None:
    """Chance that shuffling n_a + n_b marks, k_a + k_b of them hits, sets the two rates at least as far apart as they are.

    The weights of the law follow each other by a ratio; they are summed outward from
    the mode, within its effective support, so there is no draw and no largest size.
    Which counts are as far apart is decided in whole numbers. None with ten marks or
    fewer, or when a group is empty.
    """
    n, k = n_a + n_b, k_a + k_b
    if n <= 10 or n_a == 0 or n_b == 0:
        return None
    least, most = max(0, n_a - (n - k)), min(n_a, k)
    gap = abs(k_a * n - k * n_a)
    if gap == 0 or least == most:
        return 1.0
    mode = min(max((n_a + 1) * (k + 1) // (n + 2), least), most)
    reach = int(SUPPORT * math.sqrt(n_a * (k / n) * (1 - k / n) * (n_b / (n - 1)))) + 60
    low, high = max(least, mode - reach), min(most, mode + reach)

    def outward(to, step):
        """Weights beside the mode, relative to it, up to ``to``."""
        x = np.arange(mode, to, step, dtype=np.float64)
        if step > 0:
            ratio = (k - x) * (n_a - x) / ((x + 1) * (n - k - n_a + x + 1))
        else:
            ratio = x * (n - k - n_a + x) / ((k - x + 1) * (n_a - x + 1))
        return np.exp(np.cumsum(np.log(ratio)))

    up, down = outward(high, 1), outward(low, -1)
    below, above = (k * n_a - gap) // n, -((-k * n_a - gap) // n)  # last count and first count as far apart
    total = math.fsum([1.0, float(up.sum()), float(down.sum())])
    tails = 0.0
    if above <= high:
        tails += float(up[max(above - mode - 1, 0):].sum()) + (above <= mode) + float(down[:max(mode - above, 0)].sum())
    if below >= low:
        tails += float(down[max(mode - below - 1, 0):].sum()) + (below >= mode) + float(up[:max(below - mode, 0)].sum())
    return min(1.0, tails / total)


@F.arrow_udf(T.DoubleType())
def exact_gap_p(n_a: pa.Array, k_a: pa.Array, n_b: pa.Array, k_b: pa.Array) -> pa.Array:
    return pa.array([None if None in row else hypergeometric_gap_p(*row) for row in zip(*(c.to_pylist() for c in (n_a, k_a, n_b, k_b)))], pa.float64())


#: Standard deviations beyond which binomial counts are left out of an interval; together they weigh less than 1e-30.
TAIL = 12
#: Largest group of an exact interval: differences of counts are compared as 64-bit whole numbers.
INTERVAL_LIMIT = 10 ** 12


def binomial_weights(n: int, k: int) -> tuple[int, np.ndarray]:
    """First count and weights of a binomial law of n draws at rate k / n, within its effective support.

    Weights follow each other by a ratio, outward from the mode.
    """
    if k == 0 or k == n:
        return k, np.ones(1)
    mode = min((n + 1) * k // n, n)
    reach = int(TAIL * math.sqrt(k * (n - k) / n)) + 80
    low, high = max(0, mode - reach), min(n, mode + reach)
    up = np.arange(mode, high, dtype=np.float64)
    down = np.arange(mode, low, -1, dtype=np.float64)
    odds = k / (n - k)
    above = np.exp(np.cumsum(np.log((n - up) / (up + 1) * odds)))
    below = np.exp(np.cumsum(np.log(down / (n - down + 1) / odds)))
    w = np.concatenate([below[::-1], [1.0], above])
    return low, w / w.sum()


def share_gap_quantiles(n_a: int, k_a: int, n_b: int, k_b: int, levels: Sequence[float]) -> list[float]:
    """Quantiles of the difference of two resampled shares: the least difference with at least that much of the law up to it.

    Resampling 0/1 marks with replacement draws binomial counts x and y; x / n_a - y / n_b
    is compared as the whole number x * n_b - y * n_a. A search over these numbers
    weighs each x with the part of y's distribution function that keeps the difference small.
    """
    if max(n_a, n_b) > INTERVAL_LIMIT:
        raise OverflowError(f"groups of {n_a} and {n_b} are over {INTERVAL_LIMIT}")
    low_x, wx = binomial_weights(n_a, k_a)
    low_y, wy = binomial_weights(n_b, k_b)
    # Counted from both first counts; base is the difference there.
    base = low_x * n_b - low_y * n_a
    i = np.arange(len(wx), dtype=np.int64) * n_b
    at_least = np.append(np.cumsum(wy[::-1])[::-1], 0.0)

    def weight(t: int) -> float:
        """Chance of a difference of at most ``t``: y must be at least (i - t) / n_a, rounded up."""
        j = np.clip(-((t - i) // n_a), 0, len(wy))
        return float(np.dot(wx, at_least[j]))

    out = []
    for level in levels:
        least, most = -(len(wy) - 1) * n_a - 1, int(i[-1])
        while most - least > 1:
            middle = (least + most) // 2
            if weight(middle) >= level:
                most = middle
            else:
                least = middle
        out.append((base + most) / (n_a * n_b))
    return out


def exact_spd_interval(level: float):
    """Percentile interval of the parity difference by the law of all resamples, without draws."""
    levels = [(1 - level) / 2, (1 + level) / 2]

    @F.pandas_udf(T.StructType([T.StructField("lower", T.DoubleType()), T.StructField("upper", T.DoubleType())]))
    def interval(n_a: pd.Series, k_a: pd.Series, n_b: pd.Series, k_b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([share_gap_quantiles(*map(int, row), levels) for row in zip(n_a, k_a, n_b, k_b)], columns=["lower", "upper"], dtype="float64")

    return interval
