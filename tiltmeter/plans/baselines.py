"""Fine-tuned baselines: leak-safe splits, and one publication table over models and countries."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import classification, cleaning, compare, fairness, harm, sampling
from ..functions.tables import stored

FAIRNESS = ["model", "country", "SPD", "SPD_CI_lower", "SPD_CI_upper", "TPR_diff", "TPR_pvalue", "FPR_diff", "FPR_pvalue",
            "n_state", "n_nonstate"]
HARM = ["model", "country", "false_legitimization_rate_FLR", "false_illegitimization_rate_FIR", "false_legitimization_count_FL",
        "false_illegitimization_count_FI", "harm_ratio_FL_to_FI", "n_illegit_events", "n_legit_events"]


def splits(raw: DataFrame, eval_codes: list[str], min_notes_len: int = 10, **options) -> DataFrame:
    """Standard events with their split; the standard events are stored once."""
    return sampling.split_bundle(stored(cleaning.standardize(raw, min_notes_len)), eval_codes, **options)


def publication(predictions: DataFrame, flip_rates: DataFrame | None = None, rfc_by_tier: DataFrame | None = None) -> dict[str, DataFrame]:
    """Core, fairness and harm tables per (model, country), and their left join."""
    by = ["model", "country"]
    core = classification.core_table(predictions)
    if flip_rates is not None and rfc_by_tier is not None:
        core = compare.add_robustness(core, flip_rates, rfc_by_tier)
    fair = fairness.fairness_table(predictions, by=by, n_bootstrap=300).select(*FAIRNESS)
    harms = harm.harm_rates(predictions, by).select(*HARM)
    return {"core": core, "fairness": fair, "harm": harms, "publication": compare.publication_table(core, fair, harms)}
