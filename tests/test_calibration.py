"""Isotonic fit, interpolation, thresholds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiltmeter.operators import calibration as C, compare as M, counterfactual as CF


def isotonic(x, y):
    """Isotonic means by the max-min formula over distinct x."""
    xs = sorted(set(x))
    s = np.array([sum(b for a, b in zip(x, y) if a == v) for v in xs], float)
    n = np.array([sum(a == v for a in x) for v in xs], float)
    cs, cn = np.concatenate([[0], np.cumsum(s)]), np.concatenate([[0], np.cumsum(n)])
    m = len(xs)
    return xs, [max(min((cs[j] - cs[i]) / (cn[j] - cn[i]) for j in range(k + 1, m + 1)) for i in range(k + 1)) for k in range(m)]


def frame(spark, x, y, model="m"):
    rows = [(model, i, "V", "V" if b else "B", a) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "model string, event_id int, true_label string, pred_label string, pred_conf double").repartition(5)


@pytest.mark.parametrize("seed", range(4))
def test_isotonic_map(spark, seed):
    rnd = np.random.default_rng(seed)
    x = np.round(rnd.random(200), 3 if seed % 2 else 1)
    x[: 70] = 0.9  # one confidence holds a third of the rows
    y = rnd.random(200) < x * x
    got = C.isotonic_maps(frame(spark, x.tolist(), y.tolist())).first()
    xs, ys = isotonic(x.tolist(), y.tolist())
    assert np.allclose(got["y"], np.interp(np.linspace(0, 1, 101), xs, ys), atol=1e-12)
    assert np.all(np.diff(got["y"]) >= 0)


def test_interpolation_clips(spark):
    y = F.array(*[F.lit(i / 100.0) for i in range(101)])
    for p, want in ((-1.0, 0.0), (0.0, 0.0), (0.123, 0.123), (1.0, 1.0), (7.0, 1.0)):
        assert spark.range(1).select(C.interpolate(F.lit(p), y)).first()[0] == pytest.approx(want)


def test_apply_calibration_defaults(spark):
    test = frame(spark, [0.2, 0.8], [1, 0]).withColumn("logits", F.when(F.col("event_id") == 0, '{"V": 1, "B": 1, "E": 1, "P": 1, "R": 1, "S": 1}').otherwise("[1,2]"))
    maps = spark.createDataFrame([], "model string, x array<double>, y array<double>")
    out = {r["event_id"]: r for r in C.apply_calibration(test, maps).collect()}
    assert out[0]["pred_conf_iso"] == 0.2 and out[0]["pred_conf_temp"] == pytest.approx(0.2)
    assert out[0]["prob_S"] == pytest.approx(1 / 6) and out[1]["prob_V"] is None


@pytest.mark.parametrize("raw,want", [
    ('{"V": 1, "S": 2.5}', [1, 0, 0, 0, 0, 2.5]), ("[1,2,3,4,5,6]", [1, 2, 3, 4, 5, 6]), ("[1,2]", None), ("oops", None),
    ('{"V": null}', None), (None, None), ("[1,2,3,4,5,null]", None)])
def test_logits_vector(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert df.select(C.logits_vector(F.col("raw"))).first()[0] == want


def test_global_threshold_without_coverage(spark):
    sweep = spark.createDataFrame([("m", "pred_conf", 0.9, 0.1, 0.5), ("m", "pred_conf", 0.8, 0.2, 0.9), ("m", "pred_conf", 0.99, 0.0, None)],
                                  "model string, prob_col string, threshold double, coverage double, accuracy double")
    assert C.global_thresholds(sweep).first()["threshold"] == 0.8


def test_paired_correctness_multiplies_repeats(spark):
    rows = [("a", 1, "V", "V"), ("a", 1, "V", "B"), ("b", 1, "V", "B"), ("b", 1, "V", "B"), ("a", 2, "V", "V"), ("b", 2, "V", "V"), ("c", 9, "V", "V")]
    df = spark.createDataFrame(rows, "model string, event_id int, true_label string, pred_label string")
    got = {(r["model_a"], r["model_b"]): r for r in M.paired_correctness(df, ["b", "a", "c"]).collect()}
    r = got[("b", "a")]
    assert (r["n_common"], r["both_correct"], r["a_correct_b_wrong"], r["a_wrong_b_correct"], r["both_wrong"]) == (5, 1, 0, 2, 2)
    assert got[("b", "c")]["n_common"] == 0 and got[("b", "c")]["mcnemar_p"] is None


def flips(spark, deltas):
    rows = [(i, "High", 0, "t", "m", True, False, float(x)) for i, x in enumerate(deltas)]
    return spark.createDataFrame(rows, "event_id int, ambiguity_tier string, pert_idx int, type string, model string, success boolean, label_flipped boolean, confidence_delta double").repartition(4)


@pytest.mark.parametrize("deltas", [[0.5, -0.25, 0.125, 0.75], [0.0, 0.0, 0.1], [0.1] * 40 + [-0.3] * 20 + [0.0] * 5, [0.2, 0.2]])
def test_differential_effect(spark, deltas):
    r = CF.differential_effect(flips(spark, deltas)).first()
    assert r["CDE_median"] == pytest.approx(float(np.median(deltas)))
    assert r["CDE_std"] == pytest.approx(float(np.std(deltas)))
    d = [x for x in deltas if x != 0]
    rank = {v: np.mean([i for i, x in enumerate(sorted(abs(z) for z in d), 1) if x == v]) for v in {abs(z) for z in d}}
    w = min(sum(rank[abs(x)] for x in d if x > 0), sum(rank[abs(x)] for x in d if x < 0))
    assert r["wilcoxon_statistic"] == pytest.approx(w)
    assert r["n_samples"] == len(deltas)


def test_single_change_has_no_effect_row(spark):
    assert CF.differential_effect(flips(spark, [0.3])).count() == 0
