"""Prompt experiment: from combined predictions to every evaluation table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.labels import is_valid
from ..operators import calibration, classification, disagreement, fairness, harm, sampling
from ..functions.tables import stored


def evaluate(predictions: DataFrame, params: DataFrame | None = None, raw: DataFrame | None = None, top_n: int = 20) -> dict[str, DataFrame]:
    """All tables of one run.

    Metrics and fairness read all predictions; harm, thresholds, per-class
    reports and disagreements read the calibrated test share, which is stored
    once because eight tables start from it.
    """
    valid = predictions.where(is_valid("true_label") & is_valid("pred_label"))
    split = sampling.calibration_split(valid)
    maps = stored(calibration.isotonic_maps(split.where("is_train")))
    test = stored(calibration.apply_calibration(split.where("is_test").drop("is_test", "is_train"), maps, params))
    sweep = calibration.threshold_sweep(test)
    return {
        "metrics": classification.overall_metrics(predictions), "confusion": classification.confusion_matrix(predictions),
        "fairness": fairness.fairness_table(predictions), "length_error": classification.length_error_rates(predictions),
        "length_correlation": classification.length_error_correlation(predictions),
        "isotonic_maps": maps, "calibrated": test, "sweep": sweep, "brier": calibration.brier_scores(test),
        "reliability": calibration.reliability_curve(test), "thresholds": calibration.class_thresholds(test),
        "global_thresholds": calibration.global_thresholds(sweep), "fl_fi": harm.fl_fi_counts(test),
        "harm": harm.harm_rates(test), "per_class": classification.per_class_report(test),
        "top_disagreements": disagreement.top_disagreements(test, top_n),
        "error_cases": disagreement.annotated_error_cases(test, raw),
    }
