"""Sums that do not depend on the order of rows."""

import math
import random
import struct
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tiltmeter.functions import exact
from tiltmeter.operators import counterfactual as CF

rng = random.Random(2)
GROUPS = {
    "tenths": [round(rng.uniform(-1, 1), 4) for _ in range(640)],
    "any": [rng.uniform(-1, 1) for _ in range(333)],
    "sizes": [rng.uniform(-1, 1) * 2.0 ** rng.randint(-30, 25) for _ in range(200)],
    "cancel": [1e8, 1.0, -1e8, 0.25, 3e-9] * 7,
    "equal": [0.1] * 77,
    "one": [0.7],
    "nulls": [None, 0.5, None, -0.125],
}


def bits(x):
    return None if x is None else struct.pack("<d", x)


def rows():
    return [(g, x) for g, xs in GROUPS.items() for x in xs]


def report(df):
    m = df.groupBy("g").agg(exact.moments(F.col("x")).alias("m"))
    got = m.select("g", exact.mean(F.col("m")), exact.deviation(F.col("m")), exact.deviation(F.col("m"), sample=True)).collect()
    return {r[0]: tuple(map(bits, r[1:])) for r in got}


def test_equals_fractions(spark):
    got = report(spark.createDataFrame(rows(), "g string, x double"))
    for g, xs in GROUPS.items():
        xs = [Fraction(x) for x in xs if x is not None]
        mean = sum(xs) / len(xs)
        spread = sum((x - mean) ** 2 for x in xs)
        assert got[g][0] == bits(float(mean))
        assert math.isclose(struct.unpack("<d", got[g][1])[0], math.sqrt(spread / len(xs)), rel_tol=1e-12, abs_tol=1e-9)
        if len(xs) > 1:
            assert math.isclose(struct.unpack("<d", got[g][2])[0], math.sqrt(spread / (len(xs) - 1)), rel_tol=1e-12, abs_tol=1e-9)
        else:
            assert got[g][2] is None


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_any_order_gives_the_same_bits(spark, parts):
    shuffled = rows()
    random.Random(parts).shuffle(shuffled)
    want = report(spark.createDataFrame(rows(), "g string, x double").coalesce(1))
    assert report(spark.createDataFrame(shuffled, "g string, x double").repartition(parts)) == want


def test_values_without_an_exact_sum(spark):
    made = [("nan", math.nan), ("nan", 1.0), ("inf", math.inf), ("large", 1e200), ("wide", 2.0 ** 59), ("wide", 0.0), ("none", None)]
    m = spark.createDataFrame(made, "g string, x double").groupBy("g").agg(exact.moments(F.col("x")).alias("m"))
    got = {r.g: (r.a, r.b) for r in m.select("g", exact.mean(F.col("m")).alias("a"), exact.deviation(F.col("m")).alias("b")).collect()}
    assert all(math.isnan(v) for g in ("nan", "inf", "large") for v in got[g])
    assert got["wide"][0] == 2.0 ** 58 and math.isnan(got["wide"][1]) and got["none"] == (None, None)


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_word_impact_in_any_order(spark, parts):
    made = [(w, "c", round(rng.uniform(-1, 1), 3), i % 3 == 0, i, "m") for i, w in enumerate(["police", "army", "crowd"] * 64)]
    kind = "word string, category string, confidence_delta double, label_flipped boolean, event_id bigint, model string"
    want = CF.word_impact(spark.createDataFrame(made, kind).coalesce(1)).collect()
    random.Random(parts).shuffle(made)
    got = CF.word_impact(spark.createDataFrame(made, kind).repartition(parts)).collect()
    assert [tuple(map(repr, r)) for r in got] == [tuple(map(repr, r)) for r in want]
