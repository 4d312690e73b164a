"""What perturbations do to predictions: flip rates, confidence effects, sensitivity, word impact.

Input is the long flips table: event_id, ambiguity_tier, pert_idx, type, model,
success, label_flipped, confidence_delta and the variant fields.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import exact
from ..functions.labels import significance_stars
from ..functions.stats import signed_rank_is_exact, signed_rank_p, t_p
from ..functions.tables import control_table, stored

TIERS = ["High", "Medium", "Low"]


def measured(flips: DataFrame) -> DataFrame:
    return flips.where(F.col("success") & F.col("label_flipped").isNotNull())


def t_of_mean(mean: Column, deviation: Column, n: Column, low: Column, high: Column) -> Column:
    """t statistic of a mean against 0. Equal values have no deviation, whatever their sum rounds to: t is
    infinite then, with the sign of the value, and null if the value is 0 or there is only one."""
    root = F.sqrt(n.cast("double"))
    equal = F.when(low > 0, F.lit(float("inf"))).when(low < 0, F.lit(float("-inf")))
    return F.when(n > 1, F.when(low == high, equal).otherwise(mean * root / F.nullif(deviation, F.lit(0.0))))


def _flip_columns() -> list[Column]:
    d = F.col("confidence_delta")
    return [F.avg(F.col("label_flipped").cast("double")).alias("flip_rate"), F.count(F.lit(1)).alias("n_perturbations"),
            F.avg(d).alias("mean_confidence_delta"), F.stddev_pop(d).alias("std_confidence_delta"),
            F.avg(F.abs(d)).alias("mean_abs_confidence_delta")]


def flip_rates(flips: DataFrame, by: Sequence[str] = ("type", "model")) -> DataFrame:
    """Flip rate, count, mean / population deviation / mean size of the confidence change."""
    return measured(flips).groupBy(*by).agg(*_flip_columns())


def flip_rates_by_tier(flips: DataFrame) -> DataFrame:
    """The same per ambiguity tier and for all events, in one pass of grouping sets."""
    m = measured(flips).withColumn("tier", F.coalesce("ambiguity_tier", F.lit("Low")))
    g = m.groupingSets([["tier", "type", "model"], ["type", "model"]], "tier", "type", "model")
    out = g.agg(F.grouping("tier").alias("_g"), *_flip_columns())
    out = out.withColumn("tier", F.when(F.col("_g") == 1, "all").otherwise(F.col("tier"))).drop("_g")
    return out.where(F.col("tier").isin(*TIERS, "all"))


def tier_event_counts(flips: DataFrame) -> DataFrame:
    """Events per tier and in all, also those without a measured flip."""
    e = flips.groupBy("event_id").agg(F.min(F.coalesce("ambiguity_tier", F.lit("Low"))).alias("tier"))
    g = e.groupingSets([["tier"], []], "tier").agg(F.grouping("tier").alias("_g"), F.count(F.lit(1)).alias("n_events"))
    return g.select(F.when(F.col("_g") == 1, "all").otherwise(F.col("tier")).alias("tier"), "n_events")


def differential_effect(flips: DataFrame, by: Sequence[str] = ("type", "model"), with_p: bool = True,
                        slices: int = 4096) -> DataFrame:
    """Mean, deviation and median confidence change, t statistic and signed-rank statistic, for n > 1.

    Changes are first counted per distinct value, and the counts stored. Ranks of
    |change| are the position inside a narrow slice of values, plus the rows of the
    narrow slices before it in its wide slice, plus those of the wide slices before
    it: where changes cluster, 4,096 narrow slices share what one wide slice holds.
    The median is found the same way.
    """
    by = list(by)
    d = flips.where(F.col("success") & F.col("confidence_delta").isNotNull())
    x = F.col("confidence_delta")
    basic = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n_samples"), exact.moments(x).alias("_m"), F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    basic = control_table(basic.withColumns({"CDE_mean": exact.mean(F.col("_m")), "CDE_std": F.when(F.col("_lo") == F.col("_hi"), 0.0).otherwise(exact.deviation(F.col("_m"))),
                                             "_s": exact.deviation(F.col("_m"), sample=True)}).drop("_m"))
    values = stored(d.groupBy(*by, x.alias("x")).agg(F.count(F.lit(1)).alias("n")))

    def position(v: DataFrame, key: str) -> DataFrame:
        """Rows before each distinct value of ``key`` within its group."""
        v = v.withColumns({"_s1": F.floor(F.col(key) * slices), "_s2": F.floor(F.col(key) * (slices * slices))})
        fine = v.groupBy(*by, "_s1", "_s2").agg(F.sum("n").alias("_n"))
        wide = fine.groupBy(*by, "_s1").agg(F.sum("_n").alias("_n"))

        def before(counts: DataFrame, part: list[str], order: str, name: str) -> DataFrame:
            w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
            return counts.withColumn(name, F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")

        inner = Window.partitionBy(*by, "_s1", "_s2").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
        v = v.withColumn("_in", F.sum("n").over(inner) - F.col("n"))
        v = v.join(before(fine, [*by, "_s1"], "_s2", "_b2"), [*by, "_s1", "_s2"]).join(before(wide, by, "_s1", "_b1"), [*by, "_s1"])
        return v.withColumn("before", F.col("_b1") + F.col("_b2") + F.col("_in")).drop("_s1", "_s2", "_in", "_b1", "_b2")

    ordered = position(values, "x").join(basic.select(*by, "n_samples"), by)
    lo = F.floor((F.col("n_samples") - 1) / 2)
    hi = F.floor(F.col("n_samples") / 2)

    def holds(p):
        return (F.col("before") <= p) & (p < F.col("before") + F.col("n"))

    median = ordered.groupBy(*by).agg(((F.max(F.when(holds(lo), F.col("x"))) + F.max(F.when(holds(hi), F.col("x")))) / 2.0)
                                      .alias("CDE_median"))
    sized = values.where("x != 0").groupBy(*by, F.abs("x").alias("a")).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("x") > 0, F.col("n")).otherwise(0)).alias("up"))
    n = F.col("n").cast("double")
    rank = F.col("before").cast("double") + (n + 1.0) / 2.0
    signed = position(sized, "a").groupBy(*by).agg(
        F.sum(F.col("up") * rank).alias("_wp"), F.sum((F.col("n") - F.col("up")) * rank).alias("_wm"),
        F.sum("n").alias("_nr"), F.sum(n * n * n - n).alias("_ties"),
        F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("_nt"))
    out = basic.join(median, by, "left").join(signed, by, "left").where(F.col("n_samples") > 1)
    out = out.withColumns({"wilcoxon_statistic": F.least("_wp", "_wm"),
                           "t_statistic": t_of_mean(F.col("CDE_mean"), F.col("_s"), F.col("n_samples"), F.col("_lo"), F.col("_hi"))})
    shown = [*by, "n_samples", "CDE_mean", "CDE_std", "CDE_median", "t_statistic", "wilcoxon_statistic"]
    if not with_p:
        return out.select(*shown)
    zero = F.col("n_samples") - F.coalesce("_nr", F.lit(0))
    return out.withColumns({
        "t_pvalue": t_p("t_statistic", (F.col("n_samples") - 1).cast("double")),
        "wilcoxon_pvalue": signed_rank_p("wilcoxon_statistic", F.coalesce("_nr", F.lit(0)), F.coalesce("_ties", F.lit(0.0)),
                                         F.coalesce("_nt", F.lit(0)), zero),
        "wilcoxon_method": F.when(signed_rank_is_exact(F.coalesce("_nr", F.lit(0)), F.coalesce("_nt", F.lit(0)), zero), "exact").otherwise("normal"),
    }).select(*shown, "t_pvalue", "wilcoxon_pvalue", "wilcoxon_method")


def flip_summary(rates: DataFrame, effects: DataFrame) -> DataFrame:
    """Summary rows for the cross-model table (upsert them by model)."""
    e = effects.select("type", "model", "CDE_mean", "CDE_median", "t_pvalue", "wilcoxon_pvalue")
    return rates.drop("std_confidence_delta").join(e, ["type", "model"], "left")


def perturbation_quality(variants: DataFrame) -> DataFrame:
    """Similarity and fluency per type; fluency is the headline score."""
    r, f = F.col("edit_distance_ratio"), F.col("fluency_score")
    return variants.groupBy("type").agg(
        F.avg(r).alias("mean_edit_distance_ratio"), F.stddev_pop(r).alias("std_edit_distance_ratio"),
        F.avg(f).alias("mean_fluency_score"), F.stddev_pop(f).alias("std_fluency_score"),
        F.count(F.lit(1)).alias("n_perturbations"), F.min(r).alias("min_edit_distance_ratio"),
        F.min(f).alias("min_fluency_score"), F.avg(f).alias("quality_score"))


def sensitivity_clusters(flips: DataFrame) -> DataFrame:
    """(event_id, cluster): the type with the largest mean share of flipped models.

    Types within .001 of the largest make it "mixed" (so an event that never
    flips but has several types is mixed); an event without measurements is
    "robust".
    """
    ok = F.col("success") & F.col("label_flipped").isNotNull()
    per = flips.groupBy("event_id", "type", "pert_idx").agg(
        F.avg(F.when(ok, F.col("label_flipped").cast("double"))).alias("share"))
    profile = per.groupBy("event_id", "type").agg(F.avg("share").alias("rate"))
    top = profile.groupBy("event_id").agg(
        F.max("rate").alias("_max"), F.collect_list(F.when(F.col("rate").isNotNull(), F.struct("rate", "type"))).alias("_p"))
    tied = F.filter("_p", lambda x: F.abs(x["rate"] - F.col("_max")) < 0.001)
    return top.select("event_id", F.when(F.col("_max").isNull(), "robust").when(F.size(tied) > 1, "mixed")
                      .otherwise(F.get(tied, F.lit(0))["type"]).alias("cluster"))


def word_token(prefix: str = "", lead_words: int | None = 5) -> Column:
    """Representative token of a variant: its replacement, else the first ``lead_words`` words (None: all) of its
    phrase, source or modifier, else the description up to the first comma."""
    def c(n):
        return F.col(prefix + n)

    phrase = F.coalesce(c("phrase"), c("source"), c("modifier"))
    words = F.filter(F.split(phrase, r"(?U)\s+"), lambda w: w != "")
    lead = F.array_join(words if lead_words is None else F.slice(words, 1, lead_words), " ")
    desc = F.nullif(c("description"), F.lit(""))
    return (F.when(c("original").isNotNull() & c("replacement").isNotNull(), c("replacement"))
            .when(phrase.isNotNull(), lead).otherwise(F.btrim(F.substring_index(desc, ",", 1))))


def word_rows(flips: DataFrame, lead_words: int | None = 5) -> DataFrame:
    """(word, category, confidence_delta, label_flipped, event_id, model) of measured variants."""
    d = flips.where(F.col("success") & F.col("confidence_delta").isNotNull()).withColumn("word", word_token(lead_words=lead_words))
    return d.where(F.col("word").isNotNull()).select(
        "word", F.col("type").alias("category"), "confidence_delta",
        F.coalesce("label_flipped", F.lit(False)).alias("label_flipped"), "event_id", "model")


def word_impact(words: DataFrame, with_p: bool = True) -> DataFrame:
    """Effect of each (word, category) across events and models, strongest first; the same in any order of rows."""
    x = F.col("confidence_delta")
    a = words.groupBy("word", "category").agg(
        exact.moments(x).alias("_m"), F.count(F.lit(1)).alias("count"), F.avg(F.col("label_flipped").cast("double")).alias("flip_rate"),
        F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    a = a.select("word", "category", exact.mean(F.col("_m")).alias("delta_mean"), exact.deviation(F.col("_m"), sample=True).alias("delta_std"),
                 "count", "flip_rate", "_lo", "_hi").withColumn("delta_std", F.when(F.col("_lo") == F.col("_hi"), F.lit(0.0)).otherwise(F.col("delta_std")))
    a = a.withColumns({"n_total": F.col("count"), "score_shift_pct": F.col("delta_mean") * 100.0})
    a = a.withColumn("impact_magnitude", F.abs("score_shift_pct") * F.sqrt(F.col("count").cast("double")))
    if with_p:
        n = F.col("count")
        t = t_of_mean(F.col("delta_mean"), F.col("delta_std"), n, F.col("_lo"), F.col("_hi"))
        a = a.withColumn("p_value", F.when(n > 1, t_p(t, (n - 1).cast("double"))).otherwise(1.0))
        a = a.withColumn("significant", F.coalesce(F.col("p_value") < 0.05, F.lit(False)))
    return a.drop("_lo", "_hi").orderBy(F.desc("impact_magnitude"), "word", "category")


def word_types(flips: DataFrame) -> DataFrame:
    """(word, perturbation_type): the type that used a word last, in event and variant order."""
    word = F.coalesce("modifier", "source", "phrase", "replacement")
    return (flips.where(F.coalesce(word, F.lit("")) != "").groupBy(word.alias("word"))
            .agg(F.max_by("type", F.struct("event_id", "pert_idx")).alias("perturbation_type")))


def ranked_words(impact: DataFrame, types: DataFrame, min_n: int = 10) -> DataFrame:
    """Words with enough rows or a small p, negations left out, with type and significance stars."""
    w = impact.where(~F.lower("word").contains("did not") & ((F.col("n_total") >= min_n) | (F.col("p_value") < 0.05)))
    return (w.join(types, "word", "left").withColumn("stars", significance_stars("p_value"))
            .orderBy("flip_rate", "word", "category"))


def report_counters(flips: DataFrame) -> DataFrame:
    """One row: events, perturbations, events per tier, events with any flip."""
    tier = F.coalesce("ambiguity_tier", F.lit("Low"))
    e = flips.groupBy("event_id", "pert_idx").agg(F.min(tier).alias("tier"), F.max(
        F.coalesce(F.col("label_flipped"), F.lit(False))).alias("any")).groupBy("event_id").agg(
        F.min("tier").alias("tier"), F.count(F.lit(1)).alias("perts"), F.max("any").alias("any"))
    return e.agg(F.count(F.lit(1)).alias("n_events"), F.sum("perts").alias("n_perturbations_total"),
                 *[F.sum(F.when(F.col("tier") == t, 1).otherwise(0)).alias(f"n_{t.lower()}") for t in TIERS],
                 F.sum(F.col("any").cast("int")).alias("n_flip_events"))


def most_sensitive(rates: DataFrame) -> DataFrame:
    """The (type, model) with the largest flip rate; ties by name."""
    return rates.select("type", "model", "flip_rate").orderBy(F.desc("flip_rate"), "type", "model").limit(1)
