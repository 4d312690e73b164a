"""Confidence calibration, Brier scores, reliability, threshold choice and application."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.common import col, let, lit_array, ratio
from ..functions.labels import LABELS, is_valid
from ..functions.tables import control_table

# Thresholds of the sweep, candidates of the per-class choice (the
# tenths as doubles of i * 0.1) and interior edges of ten reliability bins.
SWEEP = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99]
CANDIDATES = [i * 0.1 for i in range(10)] + [0.95, 0.97, 0.99]
EDGES = [i * 0.1 for i in range(1, 10)]
GRID = 101
CONFIDENCES = ["pred_conf", "pred_conf_iso", "pred_conf_temp"]


def confidence(c: str | Column) -> Column:
    """Numeric confidence, missing as 0."""
    return F.nanvl(F.coalesce(col(c).try_cast("double"), F.lit(0.0)), F.lit(0.0))


def temperature_scale(p: Column, temperature: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1.0 - 1e-12))
    return 1.0 / (1.0 + F.exp(-F.ln(q / (1.0 - q)) / temperature))


# Isotonic regression ------------------------------------------------------

def _push(blocks: list[list[float]], lo, hi, s, n) -> None:
    """Pool adjacent violators: put blocks, sorted by lo, behind those pooled so far. Each is merged at most once, so the work is linear."""
    for b in zip(lo, hi, s, n):
        b = list(b)
        while blocks and blocks[-1][2] * b[3] >= b[2] * blocks[-1][3]:
            a = blocks.pop()
            b = [a[0], b[1], a[2] + b[2], a[3] + b[3]]
        blocks.append(b)


def _pool_range(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pool one sorted partition as its batches come; blocks of a model leave when the next model starts."""
    model, blocks = None, []

    def out():
        return pd.DataFrame(blocks, columns=["lo", "hi", "s", "n"]).assign(model=model)

    for b in batches:
        for name, part in b.groupby("model", sort=False):
            if name != model and blocks:
                yield out()
                blocks = []
            model = name
            _push(blocks, *[part[c].tolist() for c in ("lo", "hi", "s", "n")])
    if blocks:
        yield out()


def _pool_model(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("lo")
    blocks: list[list[float]] = []
    _push(blocks, *[pdf[c].tolist() for c in ("lo", "hi", "s", "n")])
    xs = [v for b in blocks for v in (b[0], b[1])]
    ys = [b[2] / b[3] for b in blocks for _ in (0, 1)]
    grid = np.linspace(0.0, 1.0, GRID)
    return pd.DataFrame({"model": [pdf["model"].iloc[0]], "x": [grid.tolist()],
                         "y": [np.interp(grid, xs, ys).tolist()]})


#: Ranges of the second pooling, each of many ranges of the first.
WIDE_RANGES = 16


def isotonic_maps(train: DataFrame) -> DataFrame:
    """(model, x[101], y[101]): isotonic fit of correctness on confidence, sampled on a grid.

    Rows are first counted per distinct confidence, so ties are pooled by a
    plain aggregate. The distinct confidences are range-partitioned (even ranges
    however the values cluster) and violators pooled in each range, then again in
    few wide ranges; what survives of a model meets in one group. Block means are
    strictly increasing fractions of row counts, which bounds the number of blocks
    of a model by about rows^(2/3) however wide the range. Pooling is associative,
    so the ranges do not affect the result.
    """
    p = confidence("pred_conf")
    ok = (F.col("pred_label") == F.col("true_label")).cast("double")
    points = (train.where(is_valid("true_label") & is_valid("pred_label"))
              .groupBy("model", p.alias("lo")).agg(F.sum(ok).alias("s"), F.count(F.lit(1)).cast("double").alias("n"))
              .withColumn("hi", F.col("lo")).repartitionByRange("model", "lo").sortWithinPartitions("model", "lo"))
    shape = "lo double, hi double, s double, n double, model string"
    blocks = points.mapInPandas(_pool_range, shape)
    wide = blocks.repartitionByRange(WIDE_RANGES, "model", "lo").sortWithinPartitions("model", "lo").mapInPandas(_pool_range, shape)
    return wide.groupBy("model").applyInPandas(
        _pool_model, "model string, x array<double>, y array<double>")


def interpolate(p: Column, y: Column) -> Column:
    """Linear interpolation on the even grid over 0..1, clipped outside; null without a map."""
    q = F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
    i = F.least(F.floor(q * float(GRID - 1)), F.lit(GRID - 2)).cast("int")
    y0, y1 = F.get(y, i), F.get(y, i + 1)
    return y0 + (y1 - y0) * (q * float(GRID - 1) - i.cast("double"))


def class_probabilities(logits: Column, temperature: Column) -> Column:
    """Softmax of logits over temperature as array in canonical order, null for broken input."""
    def softmax(e):
        norm = F.aggregate(e, F.lit(0.0), lambda a, b: a + b) + F.lit(1e-12)
        return let(norm, lambda n: F.transform(e, lambda x: x / n))

    def scaled(v):
        return let(F.array_max(v), lambda top: let(F.transform(v, lambda x: F.exp((x - top) / temperature)), softmax))

    return let(logits_vector(logits), lambda v: F.when(v.isNotNull(), scaled(v)))


def logits_vector(raw: Column) -> Column:
    """JSON object (missing label = 0) or six-element array to array<double>; anything else null."""
    def from_map(m):
        values = F.transform(lit_array(LABELS), lambda lab: F.coalesce(F.try_element_at(m, lab), F.lit(0.0)))
        return F.when(~F.exists(F.map_values(m), lambda x: x.isNull()), values)

    def from_array(a):
        return F.when((F.size(a) == len(LABELS)) & ~F.exists(a, lambda x: x.isNull()), a)

    is_map = F.startswith(F.ltrim(raw), F.lit("{"))
    return F.when(is_map, let(F.from_json(raw, "map<string,double>"), from_map)).otherwise(
        let(F.from_json(raw, "array<double>"), from_array))


def apply_calibration(test: DataFrame, maps: DataFrame, params: DataFrame | None = None) -> DataFrame:
    """Add pred_conf_iso, pred_conf_temp and prob_V..prob_S.

    ``params`` holds (model, T, T_multiclass), both 1 where missing. Maps and
    parameters are one row per model and are broadcast after a size check.
    """
    d = test.join(control_table(maps.select("model", F.col("y").alias("_y"))), "model", "left")
    if params is not None:
        params = params.select("model", F.col("T").alias("_T"), F.col("T_multiclass").alias("_TM"))
        d = d.join(control_table(params), "model", "left")
        t, tm = F.coalesce("_T", F.lit(1.0)), F.coalesce("_TM", F.lit(1.0))
    else:
        t = tm = F.lit(1.0)
    p = confidence("pred_conf")
    new = {"pred_conf_iso": F.coalesce(interpolate(p, F.col("_y")), F.col("pred_conf")),
           "pred_conf_temp": temperature_scale(p, t)}
    if "logits" in test.columns:
        d = d.withColumn("_prob", class_probabilities(F.col("logits"), tm))
        new |= {f"prob_{lab}": F.get("_prob", F.lit(i)) for i, lab in enumerate(LABELS)}
    else:
        new |= {f"prob_{lab}": F.lit(None).cast("double") for lab in LABELS}
    return d.withColumns(new).select(*test.columns, *new)


def _unpivot_confidence(df: DataFrame, cols: list[str], keep: list[Column | str]) -> DataFrame:
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("prob_col"), confidence(c).alias("p")) for c in cols])).alias("_c")
    return df.select(*keep, long).select("*", "_c.*").drop("_c")


def threshold_sweep(df: DataFrame, cols: list[str] = CONFIDENCES) -> DataFrame:
    """accepted, coverage, correct and accuracy for each model, confidence column and threshold.

    One pass counts rows per (model, column, highest threshold met); the counts
    are then added up for all lower thresholds. Coverage divides by rows with a
    valid true label.
    """
    ok = is_valid("true_label") & is_valid("pred_label")
    d = _unpivot_confidence(df, cols, [
        "model", is_valid("true_label").alias("_t"), ok.alias("_ok"),
        (ok & (F.col("true_label") == F.col("pred_label"))).alias("_hit")])
    met = sum((F.when(F.col("p") >= t, 1).otherwise(0) for t in SWEEP), F.lit(0))
    c = d.groupBy("model", "prob_col", met.alias("_met")).agg(
        F.sum(F.col("_t").cast("bigint")).alias("_t"), F.sum(F.col("_ok").cast("bigint")).alias("_ok"),
        F.sum(F.col("_hit").cast("bigint")).alias("_hit"))
    each = F.posexplode(F.array(*[F.lit(t) for t in SWEEP])).alias("_i", "threshold")
    inside = F.col("_met") > F.col("_i")
    s = c.select("*", each).groupBy("model", "prob_col", "threshold").agg(
        F.sum(F.when(inside, F.col("_ok")).otherwise(0)).alias("accepted"),
        F.sum(F.when(inside, F.col("_hit")).otherwise(0)).alias("correct"), F.sum("_t").alias("total_valid"))
    return s.select("model", "prob_col", "threshold", "accepted",
                    ratio(F.col("accepted"), F.col("total_valid")).alias("coverage"), "correct",
                    F.round(ratio(F.col("correct"), F.col("accepted"), None), 3).alias("accuracy"), "total_valid")


def brier_scores(df: DataFrame) -> DataFrame:
    """Mean squared distance of each confidence from correctness; gains are null when a score is 0."""
    y = (F.col("pred_label") == F.col("true_label")).cast("double")

    def score(c):
        return F.avg((confidence(c) - y) * (confidence(c) - y))

    a = df.where(is_valid("true_label") & is_valid("pred_label")).groupBy("model").agg(
        F.count(F.lit(1)).alias("n_samples"), score("pred_conf").alias("brier_score_raw"),
        score("pred_conf_iso").alias("brier_score_isotonic"), score("pred_conf_temp").alias("brier_score_temperature"))
    raw = F.col("brier_score_raw")

    def gain(c):
        return F.when((raw != 0) & (F.col(c) != 0), raw - F.col(c))

    return a.withColumns({"brier_improvement_iso": gain("brier_score_isotonic"),
                          "brier_improvement_temp": gain("brier_score_temperature")})


def reliability_curve(df: DataFrame, cols: list[str] = CONFIDENCES) -> DataFrame:
    """Mean confidence and share correct in ten even bins, right-closed, empty bins left out."""
    d = _unpivot_confidence(df.where(is_valid("true_label") & is_valid("pred_label")), cols,
                            ["model", (F.col("pred_label") == F.col("true_label")).cast("double").alias("_y")])
    bin_ = sum((F.when(F.col("p") > e, 1).otherwise(0) for e in EDGES), F.lit(0))
    return d.groupBy("model", "prob_col", bin_.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_predicted"), F.avg("_y").alias("fraction_correct"))


def class_thresholds(df: DataFrame, target: float = 0.8) -> DataFrame:
    """Highest candidate per (model, label) at which enough of the confident true cases are right.

    0 where no candidate qualifies. One pass, counting rows by the highest
    candidate their own true label's probability reaches.
    """
    ok = df.where(is_valid("true_label") & is_valid("pred_label"))
    models = df.select("model").distinct().select("model", F.explode(lit_array(LABELS)).alias("label"))
    own = F.coalesce(*[F.when(F.col("true_label") == lab, F.col(f"prob_{lab}")) for lab in LABELS])
    met = sum((F.when(own >= t, 1).otherwise(0) for t in CANDIDATES), F.lit(0))
    c = ok.groupBy("model", F.col("true_label").alias("label"), met.alias("_met")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum((F.col("pred_label") == F.col("true_label")).cast("bigint")).alias("_k"))
    each = F.posexplode(F.array(*[F.lit(t) for t in CANDIDATES])).alias("_i", "threshold")
    s = c.select("*", each).where(F.col("_met") > F.col("_i")).groupBy("model", "label", "threshold").agg(
        F.sum("_n").alias("_n"), F.sum("_k").alias("_k"))
    best = s.where(ratio(F.col("_k"), F.col("_n")) >= target).groupBy("model", "label").agg(F.max("threshold").alias("_t"))
    return models.join(best, ["model", "label"], "left").select("model", "label", F.coalesce("_t", F.lit(0.0)).alias("threshold"))


def global_thresholds(sweep: DataFrame, min_coverage: float = 0.5) -> DataFrame:
    """One threshold per model: best accuracy among rows with enough coverage, all rows if none has.

    Ties go to the earlier row: confidence columns in their usual order, then
    the lower threshold.
    """
    enough = F.col("coverage") >= min_coverage
    order = F.array_position(lit_array(CONFIDENCES), F.col("prob_col"))
    d = sweep.withColumns({"_e": enough, "_any": F.max(enough).over(Window.partitionBy("model"))})
    w = Window.partitionBy("model").orderBy(F.col("accuracy").desc_nulls_last(), order, F.col("threshold"))
    d = d.where(F.col("_e") | ~F.col("_any")).withColumn("_r", F.row_number().over(w))
    return d.where("_r = 1").select("model", "prob_col", "threshold", "coverage", "accuracy")


def apply_class_thresholds(df: DataFrame, thresholds: DataFrame) -> DataFrame:
    """accepted, coverage, accuracy per model when each prediction must reach its class threshold."""
    prob = F.coalesce(*[F.when(F.col("pred_label") == lab, confidence(f"prob_{lab}")) for lab in LABELS])
    t = thresholds.groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct("label", "threshold"))).alias("_m"))
    d = df.join(control_table(t), "model").withColumn("_in", is_valid("true_label") & is_valid("pred_label") & F.coalesce(
        prob >= F.coalesce(F.try_element_at("_m", F.col("pred_label")), F.lit(0.0)), F.lit(False)))
    return _performance(d)


def apply_single_threshold(df: DataFrame, thresholds: DataFrame, prob_col: str = "pred_conf") -> DataFrame:
    """The same with one (model, threshold) and one confidence column; labels are not filtered."""
    d = df.join(control_table(thresholds.select("model", F.col("threshold").alias("_th"))), "model")
    return _performance(d.withColumn("_in", confidence(prob_col) >= F.col("_th")))


def _performance(d: DataFrame) -> DataFrame:
    hit = F.coalesce(F.col("pred_label") == F.col("true_label"), F.lit(False))
    a = d.groupBy("model").agg(
        F.sum(F.col("_in").cast("bigint")).alias("accepted"), F.sum((F.col("_in") & hit).cast("bigint")).alias("_k"),
        F.sum((is_valid("true_label") & is_valid("pred_label")).cast("bigint")).alias("total_valid"))
    return a.select("model", "accepted", ratio(F.col("accepted"), F.col("total_valid")).alias("coverage"),
                    ratio(F.col("_k"), F.col("accepted"), None).alias("accuracy"), "total_valid")
