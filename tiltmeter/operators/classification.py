"""Confusion matrices, accuracy, precision/recall/F1, error rates by note length.

Everything starts from :func:`pair_counts`, one aggregate of (true, predicted)
pairs with map-side combine. What follows works on that small table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.common import lit_array, ratio
from ..functions.labels import LABELS, is_valid, note_length_bin
from ..functions.stats import t_p


def pair_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys, "true_label", "pred_label").agg(F.count(F.lit(1)).alias("n"))


def total(cond: Column, n: str = "n") -> Column:
    """Rows behind the pairs that meet cond (0 for an empty group)."""
    return F.coalesce(F.sum(F.when(cond, F.col(n)).otherwise(0)), F.lit(0)).cast("bigint")


def confusion_matrix(df: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """All 36 cells per key, zeros included; pairs with an invalid label are left out.

    A key without any valid true label has no matrix.
    """
    p = pair_counts(df, keys).where(is_valid("true_label"))
    cell = F.concat("true_label", "pred_label")
    cells = p.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.when(
        is_valid("pred_label"), F.struct(cell, "n")))).alias("_m"))
    grid = F.explode(F.array(*[F.struct(F.lit(t).alias("true_label"), F.lit(q).alias("pred_label"))
                               for t in LABELS for q in LABELS])).alias("_g")
    return (cells.select(*keys, "_m", grid).select(*keys, "_g.*", "_m")
            .select(*keys, "true_label", "pred_label",
                    F.coalesce(F.try_element_at("_m", F.concat("true_label", "pred_label")), F.lit(0))
                    .cast("bigint").alias("n")))


def _label_sums() -> dict[str, Column]:
    both = is_valid("true_label") & is_valid("pred_label")
    sums = {}
    for lab in LABELS:
        t, q = F.col("true_label") == lab, F.col("pred_label") == lab
        sums[f"_tp_{lab}"] = total(both & t & q)
        sums[f"_t_{lab}"] = total(both & t)
        sums[f"_p_{lab}"] = total(both & q)
    return sums


def _mean(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols) / float(len(cols))


def _f1(lab: str) -> Column:
    return ratio(F.col(f"_tp_{lab}") * 2, F.col(f"_t_{lab}") + F.col(f"_p_{lab}"))


def overall_metrics(df: DataFrame) -> DataFrame:
    """Accuracy and macro precision/recall per model over all six labels, three decimals.

    N counts rows with a valid true label; accuracy divides by the rows where
    both labels are valid.
    """
    agg = pair_counts(df, ["model"]).groupBy("model").agg(
        total(is_valid("true_label")).alias("N"), *[v.alias(k) for k, v in _label_sums().items()])
    hits = reduce(lambda a, b: a + b, [F.col(f"_tp_{lab}") for lab in LABELS])
    both = reduce(lambda a, b: a + b, [F.col(f"_t_{lab}") for lab in LABELS])

    def shown(c: Column) -> Column:
        return F.when(F.col("N") > 0, F.round(c, 3))

    return agg.select(
        "model", "N", shown(ratio(hits, both, None)).alias("accuracy"),
        shown(_mean([ratio(F.col(f"_tp_{x}"), F.col(f"_p_{x}")) for x in LABELS])).alias("precision_macro"),
        shown(_mean([ratio(F.col(f"_tp_{x}"), F.col(f"_t_{x}")) for x in LABELS])).alias("recall_macro"))


def per_class_report(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per model and label.

    Labels are the distinct true labels of the whole table, so every model gets
    a row for each of them.
    """
    p = pair_counts(df, ["model"])
    t, q, n, zero = F.col("true_label"), F.col("pred_label"), F.col("n"), F.lit(0).cast("bigint")
    sides = F.array(F.struct(t.alias("label"), zero.alias("_p"), n.alias("_t"), F.when(t == q, n).otherwise(zero).alias("_tp")),
                    F.struct(q.alias("label"), n.alias("_p"), zero.alias("_t"), zero.alias("_tp")))
    s = (p.select("model", F.explode(sides).alias("_s")).where("_s.label is not null")
         .groupBy("model", "_s.label").agg(F.sum("_s._tp").alias("_tp"), F.sum("_s._p").alias("_p"), F.sum("_s._t").alias("_t")))
    # Counts of (model, label) are few; the grid is laid out from one row that holds them, in the same pass.
    cell = F.struct(F.struct("model", "label"), F.struct("_tp", "_p", "_t"))
    every = s.agg(F.map_from_entries(F.collect_list(cell)).alias("_m"), F.collect_set("model").alias("_models"),
                  F.collect_set(F.when(F.col("_t") > 0, F.col("label"))).alias("_labels"))
    grid = every.select("_m", F.explode("_models").alias("model"), "_labels").select("_m", "model", F.explode("_labels").alias("label"))
    value = F.try_element_at("_m", F.struct("model", "label"))
    s = grid.select("model", "label", *[F.coalesce(value[c], zero).alias(o) for c, o in (("_tp", "_tp"), ("_p", "_p"), ("_t", "support"))])
    return s.select("model", "label", ratio(F.col("_tp"), F.col("_p")).alias("precision"),
                    ratio(F.col("_tp"), F.col("support")).alias("recall"),
                    ratio(F.col("_tp") * 2, F.col("_p") + F.col("support")).alias("f1"), "support")


def core_table(df: DataFrame) -> DataFrame:
    """n, accuracy, macro F1 and one F1 per label for each (model, country), four decimals."""
    keys = ["model", "country"]
    agg = pair_counts(df, keys).groupBy(*keys).agg(
        total(is_valid("true_label") & is_valid("pred_label")).alias("n"), *[v.alias(k) for k, v in _label_sums().items()])
    hits = reduce(lambda a, b: a + b, [F.col(f"_tp_{lab}") for lab in LABELS])
    return agg.where(F.col("n") > 0).select(
        *keys, "n", F.round(ratio(hits, F.col("n")), 4).alias("accuracy"),
        F.round(_mean([_f1(lab) for lab in LABELS]), 4).alias("macro_f1"),
        *[F.round(_f1(lab), 4).alias(f"f1_{lab}") for lab in LABELS])


def f1_matrix(report: DataFrame, models: list[str] | None = None) -> DataFrame:
    """Labels down, models across."""
    return report.groupBy("label").pivot("model", models).agg(F.first("f1"))


def _lengths(df: DataFrame, length: str | None) -> DataFrame:
    n = F.col(length) if length else F.length(F.coalesce("notes", F.lit("")))
    return (df.where(is_valid("true_label") & is_valid("pred_label"))
            .select("model", n.cast("bigint").alias("length"),
                    (F.col("true_label") != F.col("pred_label")).cast("bigint").alias("is_error")))


def length_error_rates(df: DataFrame, length: str | None = None, top: int | None = None) -> DataFrame:
    """Error rate per note-length bin and its distance from the model's overall rate; the last bin ends at ``top``, if given."""
    by_bin = (_lengths(df, length).groupBy("model", note_length_bin("length", top).alias("length_bin"))
              .agg(F.count(F.lit(1)).alias("n_samples"), F.sum("is_error").alias("_e")))
    whole = Window.partitionBy("model")
    overall = F.sum("_e").over(whole).cast("double") / F.sum("n_samples").over(whole).cast("double")
    rate = F.col("_e").cast("double") / F.col("n_samples").cast("double")
    return (by_bin.withColumn("_overall", overall).where(F.col("length_bin").isNotNull())
            .select("model", "length_bin", "n_samples", rate.alias("error_rate"),
                    (rate - F.col("_overall")).alias("error_rate_diff_from_overall")))


def length_error_correlation(df: DataFrame, length: str | None = None, with_p: bool = True) -> DataFrame:
    """Spearman correlation of note length with being wrong, for models with more than ten rows.

    Works on (model, length) counts, so a window sees distinct lengths and not
    rows. Ties share the average rank.
    """
    c = _lengths(df, length).groupBy("model", "length").agg(
        F.count(F.lit(1)).alias("n"), F.sum("is_error").alias("e"))
    up = Window.partitionBy("model").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    n, e = F.col("n").cast("double"), F.col("e").cast("double")
    c = c.withColumn("rx", F.sum("n").over(up).cast("double") - n + (n + 1.0) / 2.0)
    s = c.groupBy("model").agg(F.sum(n).alias("N"), F.sum(e).alias("E"), F.sum(n * F.col("rx")).alias("sx"),
                               F.sum(n * F.col("rx") * F.col("rx")).alias("sxx"), F.sum(e * F.col("rx")).alias("ex"))
    N, E = F.col("N"), F.col("E")
    ry0, ry1 = (N - E + 1.0) / 2.0, N - E + (E + 1.0) / 2.0
    sy, syy = (N - E) * ry0 + E * ry1, (N - E) * ry0 * ry0 + E * ry1 * ry1
    sxy = ry0 * (F.col("sx") - F.col("ex")) + ry1 * F.col("ex")
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / N, syy - sy * sy / N
    rho = F.when((vx > 0) & (vy > 0), (sxy - F.col("sx") * sy / N) / F.sqrt(vx * vy))
    out = s.where(N > 10).select("model", N.cast("bigint").alias("n_samples"), rho.alias("correlation"))
    if not with_p:
        return out
    r, dof = F.col("correlation"), F.col("n_samples") - 2
    t = F.when(F.abs(r) < 1, r * F.sqrt(dof / F.greatest(1 - r * r, F.lit(1e-300)))).when(
        r.isNotNull(), F.lit(float("inf")))
    return out.withColumn("p_value", t_p(t, dof.cast("double")))


def labels_from_logits(df: DataFrame, logits: str, codes: Column | None = None) -> DataFrame:
    """Arg-max class, softmax confidence and correctness flag from a logit vector.

    ``codes`` is the model's own ordered code list; the canonical order is used
    where it is missing, INVALID where it has no such position.
    """
    v = F.col(logits)
    pos = F.array_position(v, F.array_max(v)).cast("int")
    names = F.coalesce(codes, lit_array(LABELS)) if codes is not None else lit_array(LABELS)
    z = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    conf = 1.0 / F.aggregate(z, F.lit(0.0), lambda a, b: a + b)
    out = df.withColumns({"pred_label": F.coalesce(F.try_element_at(names, pos), F.lit("INVALID")), "pred_conf": conf})
    return out.withColumn("correct", F.coalesce(F.col("true_label") == F.col("pred_label"), F.lit(False)))
