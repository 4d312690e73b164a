"""Arithmetic with known results."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from tiltmeter.functions import ambiguity, stats
from tiltmeter.operators import compare as M, harm as H


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("k,n,low,high", [(0, 362, 0.0, 1.0500719437), (158, 339, 41.3650152729, 51.9263472689), (0, 0, 0.0, 0.0)])
def test_wilson(spark, k, n, low, high):
    lo, hi = H.wilson(F.lit(k), F.lit(n))
    assert one(spark, lo) == pytest.approx(low, abs=1e-8)
    assert one(spark, hi) == pytest.approx(high, abs=1e-8)


@pytest.mark.parametrize("k,n,p", [(32, 78, 0.2), (0, 0, 1.0), (50, 100, 1.0), (10, 100, 0.001), (4, 10, 1.0), (1, 10, 0.05)])
def test_bucketed_p(spark, k, n, p):
    assert one(spark, H.bucketed_p(F.lit(k), F.lit(n))) == p


def rows_of(spark, spec):
    """spec: {(true, pred): n} as prediction rows of one model."""
    data = [("m", i, t, p, "Police") for i, (t, p) in enumerate(tp for tp, n in spec.items() for _ in range(n))]
    return spark.createDataFrame(data, "model string, event_id int, true_label string, pred_label string, actor_norm string")


def test_net_bias_score(spark):
    df = rows_of(spark, {("V", "B"): 3, ("V", "V"): 359, ("B", "V"): 94, ("B", "B"): 245})
    r = H.bias_table(df).where("actor = 'Total'").first()
    assert round(r["nbs"], 3) == 0.942
    assert r["interpretation"] == "Strong Deleg."


def test_no_errors_is_no_bias(spark):
    r = H.bias_table(rows_of(spark, {("V", "V"): 5})).where("actor = 'Total'").first()
    assert (r["p_value"], r["risk_ratio"], r["interpretation"]) == (1.0, 1.0, "No bias")
    assert H.bias_table(rows_of(spark, {("V", "V"): 5})).count() == 3


def test_harm_ratio(spark):
    r = H.harm_rates(rows_of(spark, {("V", "B"): 2, ("V", "S"): 1, ("S", "V"): 1, ("B", "B"): 3})).first()
    assert r["harm_ratio_FL_to_FI"] == 3.0
    r = H.harm_rates(rows_of(spark, {("P", "P"): 4})).first()
    assert math.isinf(r["harm_ratio_FL_to_FI"]) and r["false_legitimization_rate_FLR"] == 0.0


def test_event_ambiguity_of_four_against_two(spark):
    parts = [F.lit(x) for x in (0.3552, 0.0583, 0.1067, 0.1667)]
    score = ambiguity.combine(*parts)
    assert round(one(spark, score), 4) == pytest.approx(0.1936, abs=1e-4)
    assert one(spark, ambiguity.tier(score)) == "Low"
    entropy = ambiguity.entropy_term(F.lit(4), F.lit(6)) + ambiguity.entropy_term(F.lit(2), F.lit(6))
    assert round(one(spark, entropy), 4) == 0.3552


def test_distribution_functions():
    assert stats.chi2_1_upper(3.841458820694124) == pytest.approx(0.05, abs=1e-12)
    assert stats.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert stats.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-10)
    assert stats.t_two_sided(12.706204736432095, 1) == pytest.approx(0.05, abs=1e-10)
    for n in (1, 2, 7, 30, 101):
        for k in range(n + 1):
            low = min(k, n - k)
            exact = min(1.0, 2 * sum(math.comb(n, i) for i in range(low + 1)) / 2 ** n)
            assert stats.binomial_half_two_sided(k, n) == pytest.approx(exact, rel=1e-9)


def test_signed_rank_exact_and_normal():
    n = 8
    sums = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in itertools.product((0, 1), repeat=n)]
    for w in (0, 3, 10, 18):
        assert stats.wilcoxon_p(w, n, 0.0, False, False) == pytest.approx(min(1.0, 2 * sum(s <= w for s in sums) / 2 ** n))
    z = (1000 - 100 * 101 / 4) / math.sqrt(100 * 101 * 201 / 24)
    assert stats.wilcoxon_p(1000, 100, 0.0, False, False) == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))
    assert stats.wilcoxon_p(0, 0, 0.0, False, True) is None


def test_mcnemar(spark):
    assert one(spark, M.mcnemar_statistic(F.lit(10), F.lit(2))) == pytest.approx(49 / 12)
    assert one(spark, M.mcnemar_statistic(F.lit(0), F.lit(0))) is None


def test_intervals_hold_the_point(spark):
    from tiltmeter.operators.fairness import fairness_table
    data = [("m", i, "V" if i % 3 else "B", "V" if i % 5 < 2 else "B", "Police" if i % 2 else "Rebels") for i in range(400)]
    df = spark.createDataFrame(data, "model string, event_id int, true_label string, pred_label string, actor_norm string")
    a, b = fairness_table(df).first(), fairness_table(df.repartition(5)).first()
    assert a == b
    assert a["SPD_CI_lower"] <= a["SPD"] <= a["SPD_CI_upper"]
    assert 0 <= a["TPR_pvalue"] <= 1


def test_permutation_p_against_shuffling(spark):
    import random
    from tiltmeter.functions.stats import permutation_gap_p
    n_a, k_a, n_b, k_b = 30, 18, 50, 18
    got = one(spark, permutation_gap_p(20000, 1)(F.lit("k"), F.lit(n_a), F.lit(k_a), F.lit(n_b), F.lit(k_b)))
    rnd, col, hits = random.Random(3), [1] * (k_a + k_b) + [0] * (n_a + n_b - k_a - k_b), 0
    for _ in range(5000):
        rnd.shuffle(col)
        a = sum(col[:n_a])
        hits += abs(a / n_a - (k_a + k_b - a) / n_b) >= abs(k_a / n_a - k_b / n_b)
    assert got == pytest.approx(hits / 5000, abs=0.02)
    assert one(spark, permutation_gap_p(10, 1)(F.lit("k"), F.lit(0), F.lit(0), F.lit(50), F.lit(5))) is None
