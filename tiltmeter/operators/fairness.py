"""Group fairness between state and non-state actors.

Rates, intervals and permutation tests all come from one aggregate of group
sizes and hits: resampling rows with replacement is a binomial draw on the
counts, shuffling a 0/1 column is a hypergeometric one. No row is resampled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.actors import actor_group
from ..functions.common import ratio
from ..functions.labels import is_valid
from ..functions.stats import DRAW_LIMIT, exact_gap_p, exact_spd_interval, permutation_gap_p, spd_interval
from .classification import pair_counts, total


def group_counts(df: DataFrame, target: str = "V", by: Sequence[str] = ("model",),
                 actor_col: str = "actor_norm") -> DataFrame:
    """Sizes and hits of both groups per key; keys lacking one group are dropped."""
    d = df.select(*by, "true_label", "pred_label", actor_group(actor_col).alias("_g"))
    p = pair_counts(d, [*by, "_g"]).where(is_valid("true_label") & is_valid("pred_label"))
    hit, pos = F.col("pred_label") == target, F.col("true_label") == target
    cols = []
    for g, name in (("state", "s"), ("non-state", "n")):
        here = F.col("_g") == g
        cols += [total(here).alias(f"{name}_all"), total(here & hit).alias(f"{name}_hit"),
                 total(here & pos).alias(f"{name}_pos"), total(here & pos & hit).alias(f"{name}_tp"),
                 total(here & ~pos).alias(f"{name}_neg"), total(here & ~pos & hit).alias(f"{name}_fp")]
    return p.groupBy(*by).agg(*cols).where((F.col("s_all") > 0) & (F.col("n_all") > 0))


def parity(df: DataFrame, target: str = "V", by: Sequence[str] = ("model",), **kw) -> DataFrame:
    """Statistical parity difference: P(target | state) − P(target | non-state)."""
    g = group_counts(df, target, by, **kw)
    return g.select(*by, F.lit(target).alias("target_label"), F.col("s_all").alias("n_state"),
                    F.col("n_all").alias("n_nonstate"),
                    (ratio(F.col("s_hit"), F.col("s_all")) - ratio(F.col("n_hit"), F.col("n_all"))).alias("SPD"))


def parity_interval(df: DataFrame, target: str = "V", by: Sequence[str] = ("model",), level: float = 0.95, **kw) -> DataFrame:
    """Parity with its bootstrap interval by the exact law of all resamples; ``significant`` if it leaves out 0."""
    g = group_counts(df, target, by, **kw).withColumn("_ci", exact_spd_interval(level)("s_all", "s_hit", "n_all", "n_hit"))
    low, high = F.col("_ci.lower"), F.col("_ci.upper")
    return g.select(*by, F.lit(target).alias("target_label"), F.col("s_all").alias("n_state"), F.col("n_all").alias("n_nonstate"),
                    (ratio(F.col("s_hit"), F.col("s_all")) - ratio(F.col("n_hit"), F.col("n_all"))).alias("SPD"),
                    low.alias("SPD_CI_lower"), high.alias("SPD_CI_upper"), ((low > 0) | (high < 0)).alias("significant"))


def equalized_odds(df: DataFrame, target: str = "V", by: Sequence[str] = ("model",), **kw) -> DataFrame:
    """True and false positive rates per group and their gaps; an empty side counts as 0."""
    g = group_counts(df, target, by, **kw)
    rates = {"TPR_state": ratio(F.col("s_tp"), F.col("s_pos")), "TPR_nonstate": ratio(F.col("n_tp"), F.col("n_pos")),
             "FPR_state": ratio(F.col("s_fp"), F.col("s_neg")), "FPR_nonstate": ratio(F.col("n_fp"), F.col("n_neg"))}
    return (g.withColumns(rates).withColumns({"TPR_diff": F.col("TPR_state") - F.col("TPR_nonstate"),
                                              "FPR_diff": F.col("FPR_state") - F.col("FPR_nonstate")})
            .select(*by, "TPR_state", "TPR_nonstate", "TPR_diff", "FPR_state", "FPR_nonstate", "FPR_diff"))


def equalized_odds_test(df: DataFrame, target: str = "V", by: Sequence[str] = ("model",), **kw) -> DataFrame:
    """Gaps of true and false positive rates with their permutation p, by the exact law of all shuffles instead of drawn ones."""
    g = group_counts(df, target, by, **kw)
    gaps = {"TPR": ("pos", "tp"), "FPR": ("neg", "fp")}
    cols = []
    for name, (n, k) in gaps.items():
        n_a, k_a, n_b, k_b = (F.col(c) for c in (f"s_{n}", f"s_{k}", f"n_{n}", f"n_{k}"))
        cols += [(ratio(k_a, n_a) - ratio(k_b, n_b)).alias(f"{name}_diff"), exact_gap_p(n_a, k_a, n_b, k_b).alias(f"{name}_pvalue")]
    return g.select(*by, *cols)


def fairness_table(df: DataFrame, target: str = "V", by: Sequence[str] = ("model",), n_bootstrap: int = 1000,
                   seed: int = 42, n_permutations: int | None = None, **kw) -> DataFrame:
    """Parity with bootstrap interval, equalized odds with permutation p. Seeded per key.

    ``n_permutations`` is ``n_bootstrap`` if not given. ``permutation_draws`` says what
    the permutations draw: hypergeometric counts, or their normal form where a
    group pair has 10^9 rows or more.
    """
    g = group_counts(df, target, by, **kw)
    key = F.concat_ws("|", *[F.coalesce(F.col(b).cast("string"), F.lit("")) for b in by])
    reps = n_bootstrap if n_permutations is None else n_permutations
    tpr_p, fpr_p = permutation_gap_p(reps, seed + 1), permutation_gap_p(reps, seed + 2)
    g = g.withColumn("_ci", spd_interval(n_bootstrap, seed)(key, "s_all", "s_hit", "n_all", "n_hit"))
    g = g.withColumns({"TPR_pvalue": tpr_p(key, "s_pos", "s_tp", "n_pos", "n_tp"),
                       "FPR_pvalue": fpr_p(key, "s_neg", "s_fp", "n_neg", "n_fp"),
                       "SPD": ratio(F.col("s_hit"), F.col("s_all")) - ratio(F.col("n_hit"), F.col("n_all")),
                       "TPR_state": ratio(F.col("s_tp"), F.col("s_pos")),
                       "TPR_nonstate": ratio(F.col("n_tp"), F.col("n_pos")),
                       "FPR_state": ratio(F.col("s_fp"), F.col("s_neg")),
                       "FPR_nonstate": ratio(F.col("n_fp"), F.col("n_neg"))})
    return g.select(*by, F.lit(target).alias("target_label"), F.col("s_all").alias("n_state"),
                    F.col("n_all").alias("n_nonstate"), "SPD", F.col("_ci.lower").alias("SPD_CI_lower"),
                    F.col("_ci.upper").alias("SPD_CI_upper"), "TPR_state", "TPR_nonstate",
                    (F.col("TPR_state") - F.col("TPR_nonstate")).alias("TPR_diff"), "TPR_pvalue",
                    "FPR_state", "FPR_nonstate",
                    (F.col("FPR_state") - F.col("FPR_nonstate")).alias("FPR_diff"), "FPR_pvalue",
                    F.when(F.greatest(F.col("s_pos") + F.col("n_pos"), F.col("s_neg") + F.col("n_neg")) < DRAW_LIMIT, "hypergeometric")
                    .otherwise("normal").alias("permutation_draws"))


def parity_rollup(tables: DataFrame, target: str = "V") -> DataFrame:
    """Mean parity and interval per model over many fairness tables, with error bars.

    ``significant`` is true when the mean interval excludes 0.
    """
    a = tables.where(F.col("target_label") == target).groupBy("model").agg(
        F.avg("SPD").alias("SPD_mean"), F.avg("SPD_CI_lower").alias("SPD_ci_low"),
        F.avg("SPD_CI_upper").alias("SPD_ci_high"), F.avg("n_state").alias("n_state"))
    return a.withColumns({"err_low": F.col("SPD_mean") - F.col("SPD_ci_low"),
                          "err_high": F.col("SPD_ci_high") - F.col("SPD_mean"),
                          "significant": (F.col("SPD_ci_low") > 0) | (F.col("SPD_ci_high") < 0)}).orderBy("SPD_mean")
