"""Event ambiguity score columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from . import text_patterns as P
from .actors import any_contains
from .annotate import both_cases, match_count
from .common import let

# Weights and tier limits of the score.
WEIGHTS = {"label_entropy": 0.35, "conf_uncertainty": 0.25, "conf_dispersion": 0.20, "text_ambiguity": 0.20}
HIGH, MEDIUM = 0.60, 0.30
N_CLASSES = 6


def text_ambiguity(notes: Column, actor: Column) -> Column:
    """Boundary cues (three or more saturate), hedges (two), and an unclear actor name."""
    text, who = F.coalesce(notes, F.lit("")), F.lower(F.coalesce(actor, F.lit("")))

    def cues_and_hedges(t):
        cues = F.least(F.lit(1.0), match_count(t, P.BOUNDARY_CUES, "low").cast("double") / 3.0)
        return cues * 0.5 + F.least(F.lit(1.0), match_count(t, P.SCORE_HEDGES, "low").cast("double") / 2.0) * 0.25

    unclear = F.when(any_contains(who, P.SCORE_ACTOR_TERMS), 0.25).otherwise(0.0)
    return F.when(text == "", 0.0).otherwise(F.least(F.lit(1.0), let(both_cases(text), cues_and_hedges) + unclear))


def entropy_term(n: Column, total: Column) -> Column:
    """One label's share of the normalised entropy; sum it over the labels of an event."""
    p = n.cast("double") / total.cast("double")
    return -(p * F.log2(p)) / F.lit(math.log2(N_CLASSES))


def uncertainty(mean_conf: Column) -> Column:
    return 1.0 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean_conf))


def dispersion(std_conf: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), std_conf / 0.5))


def combine(entropy: Column, unc: Column, disp: Column, text: Column) -> Column:
    total = (entropy * WEIGHTS["label_entropy"] + unc * WEIGHTS["conf_uncertainty"]
             + disp * WEIGHTS["conf_dispersion"] + text * WEIGHTS["text_ambiguity"])
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))


def tier(score: Column) -> Column:
    return F.when(score >= HIGH, "High").when(score >= MEDIUM, "Medium").otherwise("Low")
