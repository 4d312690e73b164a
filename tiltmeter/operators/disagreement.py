"""Events on which models disagree, their ambiguity score, and error cases for reading."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import ambiguity
from ..functions.annotate import annotate
from ..functions.tables import control_table, stored
from .cleaning import enrich_metadata
from .ranking import head_global, keep_one, sample_hash

META = ["true_label", "actor_norm", "notes"]


def vote_counts(df: DataFrame, prob: str = "pred_conf_temp") -> DataFrame:
    """disagreement_count and max_confidence of events judged by every model, with no missing value.

    Narrow on purpose: texts are not carried through this aggregate, only
    whether they are there (see :func:`event_meta` for the texts).
    """
    complete = F.lit(True)
    for c in META:
        if c in df.columns:
            complete = complete & F.col(c).isNotNull()
    n_models = control_table(df.select("model").distinct().agg(F.count(F.lit(1)).alias("_n")))
    votes = df.select("event_id", "model", "pred_label", F.col(prob).alias("_p"), complete.alias("_full")).groupBy("event_id").agg(
        F.size(F.collect_set("pred_label")).alias("disagreement_count"), F.max("_p").alias("max_confidence"),
        F.min_by("_full", "model").alias("_full"),
        F.count(F.when(F.col("pred_label").isNotNull() & F.col("_p").isNotNull(), 1)).alias("_n"))
    return votes.where("_full").join(n_models, "_n", "left_semi").drop("_n", "_full")


def event_meta(df: DataFrame) -> DataFrame:
    """True label, actor and notes of each event, from its first model by name."""
    meta = [c for c in META if c in df.columns]
    return keep_one(df.select("event_id", "model", *meta), ["event_id"], ["model"]).drop("model")


def event_votes(df: DataFrame, prob: str = "pred_conf_temp") -> DataFrame:
    """One row per event judged by every model, with no missing value.

    disagreement_count is the number of distinct predictions, max_confidence the
    largest confidence. The wide table is :func:`widen`.
    """
    return event_meta(df).join(vote_counts(df, prob), "event_id")


def disagreements(df: DataFrame, prob: str = "pred_conf_temp") -> DataFrame:
    return event_votes(df, prob).where(F.col("disagreement_count") > 1)


def widen(df: DataFrame, prob: str = "pred_conf_temp", models: Sequence[str] | None = None) -> DataFrame:
    """pred_label_<model> and pred_prob_<model> columns per event; of several rows of one model, the least confident.

    With ``models`` nothing is read to learn their names.
    """
    p = df.groupBy("event_id").pivot("model", list(models) if models else None).agg(
        F.min_by("pred_label", F.struct(prob, "pred_label")).alias("label"), F.min(prob).alias("prob"))
    renamed = {}
    for c in p.columns[1:]:
        model, kind = c.rsplit("_", 1)
        renamed[c] = f"pred_{kind}_{model}"
    return p.withColumnsRenamed(renamed)


def _per_event(df: DataFrame, prob: str, *more: Column) -> DataFrame:
    """Label entropy, confidence uncertainty and dispersion per event, and whatever else is asked for, in one aggregate.

    An event has as many rows as there are models, so its labels fit in a list.
    """
    g = df.groupBy("event_id").agg(F.array_sort(F.collect_list("pred_label")).alias("_l"), F.avg(prob).alias("_m"),
                                   F.stddev_pop(prob).alias("_s"), *more)
    counts = F.array_sort(F.transform(F.array_distinct("_l"), lambda x: F.size(F.filter("_l", lambda y: y == x)).cast("bigint")))
    entropy = F.aggregate(counts, F.lit(0.0), lambda a, n: a + ambiguity.entropy_term(n, F.size("_l").cast("bigint")))
    return g.withColumns({"label_entropy": entropy, "conf_uncertainty": F.coalesce(ambiguity.uncertainty(F.col("_m")), F.lit(0.0)),
                          "conf_dispersion": F.coalesce(ambiguity.dispersion(F.col("_s")), F.lit(0.0))}).drop("_l", "_m", "_s")


def behavioural_ambiguity(df: DataFrame, prob: str = "pred_conf_temp") -> DataFrame:
    """Label entropy, confidence uncertainty and dispersion per event, over its models."""
    return _per_event(df, prob).select("event_id", "conf_uncertainty", "conf_dispersion", "label_entropy")


def event_ambiguity(df: DataFrame, prob: str = "pred_conf_temp") -> DataFrame:
    """Ambiguity score, tier and components per event; the tier uses the unrounded score."""
    d = _per_event(df, prob, F.min_by(F.struct("notes", "actor_norm"), F.col("model")).alias("_meta"))
    d = d.withColumn("text_ambiguity", ambiguity.text_ambiguity(F.col("_meta.notes"), F.col("_meta.actor_norm")))
    d = d.withColumn("_eas", ambiguity.combine(F.col("label_entropy"), F.col("conf_uncertainty"),
                                               F.col("conf_dispersion"), F.col("text_ambiguity")))
    return d.select("event_id", F.round("_eas", 4).alias("ambiguity_score"), ambiguity.tier(F.col("_eas")).alias("ambiguity_tier"),
                    *[F.round(c, 4).alias(f"eas_{c}") for c in ambiguity.WEIGHTS])


def annotate_ambiguity(events: DataFrame, scores: DataFrame) -> DataFrame:
    """Add the score columns; values an event already carries stay."""
    cols = [c for c in scores.columns if c != "event_id"]
    have = [c for c in cols if c in events.columns]
    d = events.join(scores.withColumnsRenamed({c: f"_new_{c}" for c in have}), "event_id", "left")
    return d.withColumns({c: F.coalesce(F.col(c), F.col(f"_new_{c}")) for c in have}).drop(*[f"_new_{c}" for c in have])


def top_disagreements(df: DataFrame, n: int = 20, prob: str = "pred_conf_temp") -> DataFrame:
    """The n disagreements with the largest confidence (ties by event id), with ambiguity columns.

    The top n are taken first; only their rows are scored and widened.
    """
    votes = vote_counts(df, prob).where(F.col("disagreement_count") > 1)
    top = control_table(votes.orderBy(F.desc("max_confidence"), "event_id").limit(n))
    rows = df.join(top.select("event_id"), "event_id", "left_semi")
    events = event_meta(rows).join(top, "event_id")
    return annotate_ambiguity(events, event_ambiguity(rows, prob)).orderBy(F.desc("max_confidence"), "event_id")


def top_percent(events: DataFrame, percent: float, score: str = "max_confidence", id_col: str = "event_id") -> DataFrame:
    """The top ceil(n·percent/100) rows by score, at least one; ties by id hash."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be in (0, 100]")
    keyed = stored(events.select(id_col, score))
    n = keyed.agg(F.count(F.lit(1)).alias("n")).select(F.greatest(
        F.lit(1).cast("bigint"), F.ceil(F.col("n") * F.lit(percent / 100.0))).alias("quota"))
    return events.join(head_global(keyed, n, score, id_col).select(id_col), id_col, "left_semi")


def error_kind() -> Column:
    t, p = F.col("true_label"), F.col("pred_label")
    return (F.when((t == "V") & p.isin("B", "S"), "false_legitimization")
            .when(t.isin("B", "S") & (p == "V"), "false_illegitimization"))


def error_cases(df: DataFrame, size: int = 200, seed: int = 42) -> DataFrame:
    """Errors of both harm kinds for reading, at most ``size`` of each.

    When a kind has more, each model first gives at most size // models + 1 by
    id hash, and the first ``size`` by (model, hash) stay.
    """
    e = df.withColumn("error_kind", error_kind()).where(F.col("error_kind").isNotNull())
    e = e.withColumn("_h", sample_hash(seed, "event_id"))
    # Both keys are false, but no constants, so that this stays a hash join.
    n_models = df.select("model").distinct().agg(F.count(F.lit(1)).alias("_m")).withColumn("_k", F.col("_m") < 0)
    sizes = e.groupBy("error_kind").agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.col("_n") < 0)
    limits = sizes.join(n_models, "_k").select("error_kind", F.when(
        F.col("_n") > size, F.floor(F.lit(size) / F.col("_m")) + 1).otherwise(size).alias("_cap"))
    by_model = Window.partitionBy("error_kind", "model").orderBy("_h", "event_id")
    by_kind = Window.partitionBy("error_kind").orderBy("model", "_h", "event_id")
    e = e.withColumn("_r", F.row_number().over(by_model)).where(F.col("_r") <= size)
    e = e.join(control_table(limits), "error_kind").where(F.col("_r") <= F.col("_cap"))
    e = e.withColumn("_r2", F.row_number().over(by_kind)).where(F.col("_r2") <= size)
    return e.select(*df.columns, "error_kind")


def annotated_error_cases(df: DataFrame, raw: DataFrame | None = None, size: int = 200, seed: int = 42) -> DataFrame:
    """Error cases with raw metadata joined in and the annotation columns added."""
    e = error_cases(df, size, seed)
    if raw is not None:
        e = enrich_metadata(e, raw)
    return annotate(e)
