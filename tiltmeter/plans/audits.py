"""Counterfactual audit: disagreements, their variants, re-scoring, flip tables and rationale tracing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import counterfactual as CF, disagreement as D, perturb as PB, trace as T
from ..functions.tables import stored
from ..operators.scoring import Predictor, collect_rationales, score_variants


def counterfactual_audit(predictions: DataFrame, models: dict[str, Predictor], top: int = 20, percent: float | None = None,
                         prob: str = "pred_conf_temp", max_rationale_events: int | None = None, max_per_generator: int | None = 3) -> dict[str, DataFrame]:
    """Flip, effect, quality, cluster, word and rationale tables of the chosen disagreements.

    Scored variants and rationales are stored, so that no model is asked twice.
    Rationales are collected for all flips, or for those of the first
    ``max_rationale_events`` flipped events of each model; ``max_per_generator``
    valid variants are kept of each generator and text (None: all).
    """
    if percent is None:
        events = D.top_disagreements(predictions, top, prob)
    else:
        chosen = D.top_percent(D.disagreements(predictions, prob), percent)
        rows = predictions.join(chosen.select("event_id"), "event_id", "left_semi")
        events = D.annotate_ambiguity(chosen, D.event_ambiguity(rows, prob))
    events = stored(events)
    variants = stored(PB.valid_variants(events, keep=("event_id", "ambiguity_tier"), max_per_generator=max_per_generator))
    scored = score_variants(variants, models)
    original = predictions.withColumn("pred_conf", F.col(prob))
    flips = stored(PB.compare_with_original(scored, original))

    flipped = T.flipped_events(flips, max_rationale_events)
    asked = None
    for model, predictor in models.items():
        mine = flipped.where(F.col("model") == model)
        before = (events.join(mine.select("event_id").distinct(), "event_id", "left_semi")
                  .select("event_id", F.lit(-1).alias("pert_idx"), F.col("notes").alias("text")))
        got = collect_rationales(before.unionByName(mine.select("event_id", "pert_idx", "text")), model, predictor)
        asked = got if asked is None else asked.unionByName(got)
    records = T.rfc_records(flipped, stored(asked))
    rates, effects, words = CF.flip_rates(flips), CF.differential_effect(flips), CF.word_impact(CF.word_rows(flips))
    return {
        "events": events, "variants": variants, "flips": flips, "flip_rates": rates, "flip_rates_by_tier": CF.flip_rates_by_tier(flips),
        "tier_events": CF.tier_event_counts(flips), "effects": effects, "quality": CF.perturbation_quality(variants),
        "clusters": CF.sensitivity_clusters(flips), "summary": CF.flip_summary(rates, effects), "word_impact": words,
        "ranked_words": CF.ranked_words(words, CF.word_types(flips)), "counters": CF.report_counters(flips),
        "most_sensitive": CF.most_sensitive(rates), "rfc_records": records, "rfc": T.rfc_rates(records),
        "trace_summary": T.trace_summary(records),
    }
