"""Error tracing: do stated rationales and word attributions follow the label flips?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.common import let, ratio, strip
from ..functions.rationale import TOP_TOKENS, mentions, rationale_changed, word_attributions

def flipped_events(flips: DataFrame, max_events: int | None = None) -> DataFrame:
    """Flips of all flipped events, or of the first ``max_events`` of each model in event order."""
    f = flips.where(F.coalesce("label_flipped", F.lit(False)))
    if max_events is None:
        return f
    w = Window.partitionBy("model").orderBy("event_id")
    chosen = (f.select("model", "event_id").distinct().withColumn("_r", F.row_number().over(w))
              .where(F.col("_r") <= max_events).select("model", "event_id"))
    return f.join(chosen, ["model", "event_id"], "left_semi")


def rfc_records(flips: DataFrame, rationales: DataFrame) -> DataFrame:
    """Flips with the verdict whether the rationale moved with the label.

    ``rationales``: model, event_id, pert_idx (−1 for the original text) and an
    array of items. Concordant means the rationale changed and names the new
    word (or the old one if there is none); null where a rationale is missing.
    """
    r = rationales.where(F.size("reasoning") > 0)
    before = r.where(F.col("pert_idx") == -1).select("model", "event_id", F.col("reasoning").alias("_b"))
    after = r.where(F.col("pert_idx") >= 0).select("model", "event_id", "pert_idx", F.col("reasoning").alias("_a"))
    d = flips.join(before, ["model", "event_id"], "left").join(after, ["model", "event_id", "pert_idx"], "left")
    known = F.col("_b").isNotNull() & F.col("_a").isNotNull()
    new_word = F.coalesce(F.nullif("replacement", F.lit("")), F.col("phrase"))
    token = F.coalesce(F.nullif(new_word, F.lit("")), F.col("original"))
    d = d.withColumns({"rationale_changed": F.when(known, rationale_changed(F.col("_b"), F.col("_a"))),
                       "mentions_change": F.when(known, mentions(F.col("_a"), token))})
    d = d.withColumn("concordant", F.col("rationale_changed") & F.col("mentions_change"))
    return d.select("model", "event_id", "pert_idx", F.coalesce("ambiguity_tier", F.lit("Low")).alias("ambiguity_tier"),
                    F.col("type").alias("perturbation_type"), F.col("original").alias("original_word"),
                    new_word.alias("replacement_word"), "concordant", "rationale_changed", "mentions_change",
                    F.col("concordant").cast("double").alias("rfc_score"))


def rfc_rates(records: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Concordance overall, by perturbation type and by tier, in one pass of grouping sets.

    ``scope`` tells which; records without a verdict are not counted.
    """
    keys = list(keys)
    t, a = "perturbation_type", "ambiguity_tier"
    # Counting verdicts, rather than filtering on them, keeps the comparison from being computed twice.
    g = records.groupingSets([keys, [*keys, t], [*keys, a]], *keys, t, a).agg(
        F.grouping(t).alias("_gt"), F.grouping(a).alias("_ga"), F.count("concordant").alias("n"),
        F.sum(F.col("concordant").cast("bigint")).alias("n_concordant")).where("n > 0")
    rate = ratio(F.col("n_concordant"), F.col("n"), None)
    scope = F.when(F.col("_gt") == 0, "type").when(F.col("_ga") == 0, "tier").otherwise("all")
    return g.select(*keys, scope.alias("scope"), t, a, "n", F.round(rate, 4).alias("concordant_rate"),
                    F.round(1.0 - rate, 4).alias("discordant_rate"))


def attribution_words(attributions: DataFrame) -> DataFrame:
    """Word attributions of each scored text, as arrays of (word, score)."""
    return attributions.select(*[c for c in attributions.columns if c not in ("tokens", "scores")],
                               word_attributions(F.col("tokens"), F.col("scores")).alias("words"))


def top_tokens(words: DataFrame, k: int = TOP_TOKENS) -> DataFrame:
    return words.withColumn("words", F.slice("words", 1, k))


def _word_changes(before: Column, after: Column) -> Column:
    """array<struct<token, delta>>: each word's last, weakest place after minus that before; both are arrays of texts' words."""
    def placed(texts: Column, side: int) -> Column:
        return F.flatten(F.transform(texts, lambda t: F.transform(t, lambda w, i: F.struct(
            w["word"].alias("token"), F.lit(side).alias("side"), i.alias("i"), F.coalesce(w["score"], F.lit(0.0)).alias("s")))))

    def last(z: Column) -> Column:
        nxt = lambda k: F.get(z, k + 1)
        return F.filter(z, lambda x, k: F.coalesce((nxt(k)["token"] != x["token"]) | (nxt(k)["side"] != x["side"]), F.lit(True)))

    def changes(z: Column) -> Column:
        """At most one entry of each side for a word, that of before first."""
        def change(x, k):
            other = F.get(z, k - 1)
            was = F.when(F.coalesce(other["token"] == x["token"], F.lit(False)), other["s"]).otherwise(0.0)
            return F.struct(x["token"].alias("token"), F.round(F.when(x["side"] == 1, x["s"] - was).otherwise(F.lit(0.0) - x["s"]), 6).alias("delta"),
                            F.coalesce(F.get(z, k + 1)["token"] != x["token"], F.lit(True)).alias("ends"))

        return F.transform(F.filter(F.transform(z, change), lambda c: c["ends"]), lambda c: F.struct(c["token"].alias("token"), c["delta"].alias("delta")))

    return let(F.array_sort(F.concat(placed(before, 0), placed(after, 1))), lambda z: let(last(z), changes))


def attribution_deltas(flips: DataFrame, attributions: DataFrame, k: int | None = TOP_TOKENS) -> DataFrame:
    """Words whose attribution moved most between original and flipped text; ``k`` None keeps all.

    ``attributions``: model, event_id, pert_idx (−1 = original), tokens, scores.
    Only attributions of flipped events are turned into words. A text's words stay
    in one row as an array: those of a flip and of its original meet in one group
    and are held against each other there, so no task keeps a row per word.
    """
    f = flips.where(F.coalesce("label_flipped", F.lit(False))).select("model", "event_id", "pert_idx", "type")
    keys = ["model", "event_id", "pert_idx", "type"]
    after = attribution_words(attributions.where(F.col("pert_idx") >= 0).select("model", "event_id", "pert_idx", "tokens", "scores")
                              .join(f, ["model", "event_id", "pert_idx"]))
    per_event = f.groupBy("model", "event_id").agg(F.collect_list(F.struct("pert_idx", "type")).alias("_f"))
    before = attribution_words(attributions.where(F.col("pert_idx") == -1).select("model", "event_id", "tokens", "scores")
                               .join(per_event, ["model", "event_id"]))
    before = before.select("model", "event_id", F.explode("_f").alias("_f"), "words").select("model", "event_id", "_f.*", "words")

    def rows(d: DataFrame, is_after: bool) -> DataFrame:
        return d.select(*keys, F.coalesce("words", F.array().cast(d.schema["words"].dataType)).alias("_w"), F.lit(is_after).alias("_after"))

    both = rows(after, True).unionByName(rows(before, False)).groupBy(*keys).agg(
        F.collect_list(F.when(F.col("_after"), F.col("_w"))).alias("_a"), F.collect_list(F.when(~F.col("_after"), F.col("_w"))).alias("_b"))
    # A text without words still has its row; it only has no word to list.
    ordered = F.array_sort(F.transform(_word_changes(F.col("_b"), F.col("_a")), lambda x: F.struct((-F.abs(x["delta"])).alias("o"), x["token"].alias("token"), x["delta"].alias("delta"))))
    top = F.transform(ordered if k is None else F.slice(ordered, 1, k), lambda x: F.struct(x["token"].alias("token"), x["delta"].alias("delta")))
    return both.where((F.size("_a") > 0) & (F.size("_b") > 0)).select(*keys, top.alias("top_delta"))


def attributions_from_disagreements(events: DataFrame, attributions: DataFrame, k: int = TOP_TOKENS) -> DataFrame:
    """Top tokens of disagreement events, without perturbations; events with empty text are skipped."""
    tier = F.coalesce("ambiguity_tier", F.lit("Unknown")) if "ambiguity_tier" in events.columns else F.lit("Unknown")
    e = events.where(strip(F.coalesce("notes", F.lit(""))) != "").select("event_id", tier.alias("ambiguity_tier"))
    return top_tokens(attribution_words(attributions), k).join(e, "event_id")


def trace_summary(records: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """One flat table: a row per rationale verdict and a row per attributed event (its top token)."""
    blank = F.lit("")

    def s(c):
        return F.coalesce(F.col(c).cast("string"), blank).alias(c)

    words = ["perturbation_type", "original_word", "replacement_word", "concordant", "rationale_changed", "mentions_change", "rfc_score"]
    out = records.select(F.lit("rfc").alias("source"), "model", "event_id", s("ambiguity_tier"), *[s(c) for c in words],
                         blank.alias("top_attributed_token"), blank.alias("attribution_score"))
    if tokens is None:
        return out
    top = F.get("words", F.lit(0))
    lig = tokens.select(F.lit("lig").alias("source"), "model", "event_id", s("ambiguity_tier"), *[blank.alias(c) for c in words],
                        F.coalesce(top["word"], blank).alias("top_attributed_token"),
                        F.coalesce(top["score"].cast("string"), blank).alias("attribution_score"))
    return out.unionByName(lig)
