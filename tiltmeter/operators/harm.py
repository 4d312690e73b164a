"""Directional harm: false legitimization (FL) and false illegitimization (FI).

Three definitions are in use and must not be mixed; each has its own operators.

* set    V predicted as B or S; B or S predicted as V   (fl_fi_counts, harm_rates)
* pair   V predicted as B; B predicted as V             (pair_*, actor_*, bias_table)
* binary V predicted as anything else; anything else predicted as V  (binary_harm)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.actors import mentions_actor
from ..functions.common import ratio
from ..functions.labels import ILLEGITIMATE, LEGITIMATE, condition_rank, is_valid
from ..functions.stats import binomial_p
from .classification import pair_counts, total

# The rounded and the exact 97.5% point of the normal distribution.
Z95 = 1.96
Z95_EXACT = 1.959963984540054


def _true(*labs):
    return F.coalesce(F.col("true_label").isin(*labs), F.lit(False))


def _pred(*labs):
    return F.coalesce(F.col("pred_label").isin(*labs), F.lit(False))


def fl_fi_counts(df: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """total, fl, fi per key, set definition."""
    return pair_counts(df, by).groupBy(*by).agg(
        F.sum("n").alias("total"),
        total(_true(*ILLEGITIMATE) & _pred(*LEGITIMATE)).alias("fl"),
        total(_true(*LEGITIMATE) & _pred(*ILLEGITIMATE)).alias("fi"))


def harm_rates(df: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """FL and FI rates, set definition. The ratio is infinite whenever FI is 0, even for 0/0."""
    a = pair_counts(df, by).groupBy(*by).agg(
        F.sum("n").alias("total_events"), total(_true(*ILLEGITIMATE)).alias("n_illegit_events"),
        total(_true(*LEGITIMATE)).alias("n_legit_events"),
        total(_true(*ILLEGITIMATE) & _pred(*LEGITIMATE)).alias("fl"),
        total(_true(*LEGITIMATE) & _pred(*ILLEGITIMATE)).alias("fi"))
    return a.select(
        *by, ratio(F.col("fl"), F.col("n_illegit_events")).alias("false_legitimization_rate_FLR"),
        F.col("fl").alias("false_legitimization_count_FL"), "n_illegit_events",
        ratio(F.col("fi"), F.col("n_legit_events")).alias("false_illegitimization_rate_FIR"),
        F.col("fi").alias("false_illegitimization_count_FI"), "n_legit_events", "total_events",
        ratio(F.col("fl"), F.col("fi"), float("inf")).alias("harm_ratio_FL_to_FI"))


def binary_harm(df: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """FL and FI of V against everything else, among rows with two valid labels, four decimals."""
    p = pair_counts(df, by).where(is_valid("true_label") & is_valid("pred_label"))
    a = p.groupBy(*by).agg(total(_true("V")).alias("n_violence"), total(~_true("V")).alias("n_non_violence"),
                           total(_true("V") & ~_pred("V")).alias("false_legitimization_count"),
                           total(~_true("V") & _pred("V")).alias("false_illegitimization_count"))
    return a.withColumns({
        "false_legitimization_rate": F.round(ratio(F.col("false_legitimization_count"), F.col("n_violence")), 4),
        "false_illegitimization_rate": F.round(ratio(F.col("false_illegitimization_count"), F.col("n_non_violence")), 4)})


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson 95% interval in percent, clamped to 0..100; (0, 0) for n = 0."""
    k, n1 = k.cast("double"), F.greatest(n.cast("double"), F.lit(1.0))
    p, z2 = k / n1, z * z
    denom = 1.0 + F.lit(z2) / n1
    center = (p + F.lit(z2) / (n1 * 2.0)) / denom
    margin = F.lit(z) * F.sqrt((p * (1.0 - p) + F.lit(z2) / (n1 * 4.0)) / n1) / denom
    low = F.when(n > 0, F.greatest(F.lit(0.0), center - margin) * 100.0).otherwise(0.0)
    high = F.when(n > 0, F.least(F.lit(1.0), center + margin) * 100.0).otherwise(0.0)
    return low, high


def bucketed_p(k: Column, n: Column) -> Column:
    """Stepwise p of k successes in n fair trials: normal steps above 20 trials, a coarse rule below."""
    nd = n.cast("double")
    z = F.abs(k.cast("double") - nd * 0.5) / F.sqrt(F.greatest(nd, F.lit(1.0)) * 0.25)
    return (F.when(n == 0, 1.0)
            .when(n > 20, F.when(z > 3, 0.001).when(z > 2.576, 0.01).when(z > 1.96, 0.05).when(z > 1, 0.2).otherwise(1.0))
            .when(F.abs(k.cast("double") - nd * 0.5) < 2, 1.0).otherwise(0.05))


def _pair_sums(p: DataFrame, by: Sequence[str]) -> DataFrame:
    a = p.groupBy(*by).agg(total(_true("V")).alias("true_v"), total(_true("B")).alias("true_b"),
                           total(_true("V") & _pred("B")).alias("n_fl"), total(_true("B") & _pred("V")).alias("n_fi"))
    return a.withColumns({"fl_pct": ratio(F.col("n_fl") * 100, F.col("true_v")),
                          "fi_pct": ratio(F.col("n_fi") * 100, F.col("true_b"))})


def _with_intervals(a: DataFrame, z: float = Z95) -> DataFrame:
    fl_lo, fl_hi = wilson(F.col("n_fl"), F.col("true_v"), z)
    fi_lo, fi_hi = wilson(F.col("n_fi"), F.col("true_b"), z)
    return a.withColumns({"fl_ci_lower": fl_lo, "fl_ci_upper": fl_hi, "fi_ci_lower": fi_lo, "fi_ci_upper": fi_hi,
                          "delta_lb": F.col("fi_pct") - F.col("fl_pct")})


def pair_summary(df: DataFrame, by: Sequence[str] = ("model", "condition")) -> DataFrame:
    """Pair definition with Wilson intervals, delta and the stepwise p."""
    a = _with_intervals(_pair_sums(pair_counts(df, by), by))
    return a.withColumn("p_value", bucketed_p(F.col("n_fl"), F.col("n_fl") + F.col("n_fi")))


def order_by_condition(summary: DataFrame) -> DataFrame:
    return summary.orderBy("model", condition_rank("condition"))


def _actor_pairs(df: DataFrame, by: Sequence[str], actors: Sequence[str]) -> DataFrame:
    """Pair counts per actor; a row counts for each actor it mentions and always for Total."""
    names = [F.when(mentions_actor("actor_norm", a), F.lit(a)) for a in actors] + [F.lit("Total")]
    d = df.select(*by, "true_label", "pred_label", F.explode(F.array_compact(F.array(*names))).alias("actor"))
    return pair_counts(d, [*by, "actor"])


def _fill_actors(a: DataFrame, by: Sequence[str], actors: Sequence[str]) -> DataFrame:
    """A zero row for actors a model never meets (Total is always there)."""
    seen = a.groupBy(*by).agg(F.collect_set("actor").alias("_s"))
    blank = seen.select(*by, F.explode(F.array_except(F.array(*[F.lit(x) for x in actors]), "_s")).alias("actor"))
    zeros = {c: F.lit(0).cast("bigint") for c in ("true_v", "true_b", "n_fl", "n_fi")}
    return a.unionByName(blank.withColumns({**zeros, "fl_pct": F.lit(0.0), "fi_pct": F.lit(0.0)}))


def actor_summary(df: DataFrame, actors: Sequence[str] = ("Police", "Military"),
                  by: Sequence[str] = ("model",)) -> DataFrame:
    """The pair summary per actor; actors overlap with Total."""
    a = _fill_actors(_pair_sums(_actor_pairs(df, by, actors), [*by, "actor"]), by, actors)
    return _with_intervals(a).withColumn("p_value", bucketed_p(F.col("n_fl"), F.col("n_fl") + F.col("n_fi")))


def bias_table(df: DataFrame, actors: Sequence[str] = ("Police", "Military"), by: Sequence[str] = ("model",),
               with_p: bool = True) -> DataFrame:
    """Net bias score and risk ratio per actor, exact binomial p and reading of the bias.

    Intervals, p and reading belong to the Total rows and are null elsewhere.
    Without errors the p is 1 and the reading "No bias".
    """
    a = _fill_actors(_pair_sums(_actor_pairs(df, by, actors), [*by, "actor"]), by, actors)
    is_total = F.col("actor") == "Total"
    fl, fi = F.col("fl_pct"), F.col("fi_pct")
    full = _with_intervals(a, Z95_EXACT)
    rr = F.when(fl > 0, fi / F.when(fl > 0, fl).otherwise(1.0)).when(fi > 0, float("inf")).otherwise(1.0)
    only_total = {c: F.when(is_total, F.col(c)) for c in
                  ("fl_ci_lower", "fl_ci_upper", "fi_ci_lower", "fi_ci_upper", "delta_lb")}
    out = full.withColumns({**only_total, "nbs": ratio(fi - fl, fi + fl), "risk_ratio": F.when(is_total, rr)})
    if not with_p:
        return out
    out = out.withColumn("p_value", F.when(is_total, binomial_p(F.col("n_fl"), F.col("n_fl") + F.col("n_fi"))))
    r = F.col("risk_ratio")
    return out.withColumn("interpretation", F.when(is_total, F.when(F.col("p_value") >= 0.05, "No bias")
                          .when(r > 1.5, "Strong Deleg.").when(r > 1.1, "Weak Deleg.")
                          .when(r < 0.67, "Strong Legit.").when(r < 0.91, "Weak Legit.").otherwise("No bias")))
