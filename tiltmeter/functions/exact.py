"""Means and deviations of doubles that no order of addition can change.

A floating-point sum depends on which partial sums meet first, so the last digit
of a mean follows the partitioning. Here each value is split into whole numbers
of fixed powers of two. Integers add up the same in any order, partial sums are
combined before the shuffle, and the one row per group that is left is divided
out in exact fractions.
"""

from __future__ import annotations

import math
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

#: Limbs of 24 bits, from 2^24 down to 2^-96. A bigint adds up 2^39 of them.
BITS = 24
UNITS = tuple(range(24, -97, -BITS))
#: Larger values, infinite ones and NaN have no exact sum; they make the mean NaN. Those whose square is larger make the deviation NaN.
LARGEST = 2.0 ** 60
LARGEST_SQUARED = 2.0 ** 30


def _limb_sums(x: Column) -> Column:
    """Sums of the limbs of x, the highest first; x is rounded to a whole number of 2^-96.

    A limb is what x, rounded to its unit, has beyond x rounded to the unit before:
    a small whole number, as doubles are scaled by powers of two without error.
    """
    def rounded(unit):
        return F.rint(x * 2.0 ** -unit)

    parts = [rounded(UNITS[0])] + [rounded(u) - rounded(u + BITS) * 2.0 ** BITS for u in UNITS[1:]]
    return F.array(*[F.coalesce(F.sum(p.cast("bigint")), F.lit(0)).cast("bigint") for p in parts])


def moments(x: Column, squares: bool = True) -> Column:
    """An aggregate: how many values there are, how many of them are out of range, limbs of their sum and of their squares' sum.

    Nulls are left out. Each square is rounded once, by itself.
    """
    x = x.cast("double")

    def beyond(limit):
        return F.coalesce(F.sum(F.when(F.abs(x) < limit, F.lit(0)).when(x.isNotNull(), F.lit(1))), F.lit(0)).cast("bigint")

    cols = [F.count(x).alias("n"), beyond(LARGEST).alias("out"), _limb_sums(F.when(F.abs(x) < LARGEST, x)).alias("sum")]
    if squares:
        cols += [beyond(LARGEST_SQUARED).alias("large"), _limb_sums(F.when(F.abs(x) < LARGEST_SQUARED, x * x)).alias("square")]
    return F.struct(*cols)


def _whole(limbs) -> int:
    """The sum that limbs stand for, in units of the lowest."""
    total = 0
    for limb in limbs:
        total = (total << BITS) + limb
    return total


@F.arrow_udf(T.DoubleType())
def _mean(n: pa.Array, out: pa.Array, sums: pa.Array) -> pa.Array:
    return pa.array([None if not k else math.nan if bad else float(Fraction(_whole(s), k << -UNITS[-1]))
                     for k, bad, s in zip(n.to_pylist(), out.to_pylist(), sums.to_pylist())], pa.float64())


@F.arrow_udf(T.DoubleType())
def _variance(n: pa.Array, fewer: pa.Array, out: pa.Array, sums: pa.Array, squares: pa.Array) -> pa.Array:
    got = []
    for k, less, bad, s, q in zip(*(c.to_pylist() for c in (n, fewer, out, sums, squares))):
        if k <= less:
            got.append(None)
        elif bad:
            got.append(math.nan)
        else:
            spread = (k * _whole(q) << -UNITS[-1]) - _whole(s) ** 2
            got.append(float(Fraction(max(spread, 0), k * (k - less) << -2 * UNITS[-1])))
    return pa.array(got, pa.float64())


def mean(m: Column) -> Column:
    """The mean of :func:`moments`, rounded once; null without values."""
    return _mean(m["n"], m["out"], m["sum"])


def deviation(m: Column, sample: bool = False) -> Column:
    """Population or sample deviation of :func:`moments`; null with too few values."""
    return F.sqrt(_variance(m["n"], F.lit(1 if sample else 0).cast("bigint"), m["large"], m["sum"], m["square"]))
