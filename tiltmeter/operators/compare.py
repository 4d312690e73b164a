"""Model against model: paired correctness, paired flips, publication tables, upserts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.common import lookup
from ..functions.stats import chi2_p
from ..functions.tables import control_table
from .harm import fl_fi_counts

PAIRED_FLIP_TYPES = ["actor_substitution", "intensity_high", "action_substitution"]


def mcnemar_statistic(b: Column, c: Column) -> Column:
    """Continuity-corrected statistic, null without discordant pairs."""
    d = F.abs(b - c).cast("double") - 1.0
    return F.when(b + c > 0, d * d / F.greatest((b + c).cast("double"), F.lit(1.0)))


_PAIRS = "_oa int, _ob int, model_a string, model_b string, both_yes long, only_a long, only_b long, neither long"
#: Cells of the tables of models and keys that a task multiplies at a time.
CELLS = 1 << 21


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joint counts of all pairs of models over the keys of a task, one row per pair and task.

    A slice of keys is a table of models by keys with the number of true outcomes,
    and one of false ones; their products hold the counts of every pair at once.
    """
    known: dict[tuple, int] = {}
    sums = [np.zeros((0, 0), np.int64) for _ in range(3)]
    for batch in batches:
        lists = batch.column("_p")
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        flat = lists.flatten()
        coded = pc.struct_field(flat, "model").dictionary_encode("encode")
        models = coded.dictionary.to_pylist()
        named = np.stack([pc.struct_field(flat, "o").to_numpy(zero_copy_only=False), coded.indices.to_numpy(zero_copy_only=False)])
        distinct, local = np.unique(named, axis=1, return_inverse=True)
        at = np.array([known.setdefault((int(o), models[m]), len(known)) for o, m in distinct.T], dtype=np.int64)
        more = len(known) - len(sums[0])
        sums = [np.pad(t, ((0, more), (0, more))) for t in sums]
        yes, no = (pc.struct_field(flat, c).to_numpy(zero_copy_only=False) for c in ("yes", "no"))
        key = np.repeat(np.arange(len(lengths)), lengths)
        local, ends, step = local.ravel(), np.concatenate([[0], np.cumsum(lengths)]), max(1, CELLS // max(1, len(at)))
        most = int(max(yes.max(initial=0), no.max(initial=0)))
        # Products of doubles are exact below 2^53; beyond, whole numbers are multiplied.
        kind = np.float64 if most * most * step < 1 << 53 else np.int64
        for first in range(0, len(lengths), step):
            last = min(first + step, len(lengths))
            part = slice(ends[first], ends[last])
            y, n = (np.zeros((len(at), last - first), kind) for _ in range(2))
            y[local[part], key[part] - first] = yes[part]
            n[local[part], key[part] - first] = no[part]
            for t, product in zip(sums, (y @ y.T, y @ n.T, n @ n.T)):
                t[np.ix_(at, at)] += product.astype(np.int64)
    order = sorted(known, key=lambda k: (k[0], k[1] is not None, k[1] or ""))
    at = np.array([known[k] for k in order], dtype=np.int64)
    yy, yn, nn = (t[np.ix_(at, at)] for t in sums)
    i, j = np.triu_indices(len(at), 1)
    i, j = (v[(yy + yn + yn.T + nn)[i, j] > 0] for v in (i, j))
    o, m = np.array([k[0] for k in order], dtype=np.int32), pa.array([k[1] for k in order], pa.string())
    yield pa.RecordBatch.from_arrays([pa.array(o[i]), pa.array(o[j]), m.take(pa.array(i)), m.take(pa.array(j)),
                                      *[pa.array(v) for v in (yy[i, j], yn[i, j], yn[j, i], nn[i, j])]],
                                     names=["_oa", "_ob", "model_a", "model_b", "both_yes", "only_a", "only_b", "neither"])


def _model_pairs(hits: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    """Joint counts for every pair of models over shared keys.

    ``hits`` holds (key, model, yes, no) with the number of true and false
    outcomes. Keys are brought together once; each task counts all pairs on its
    keys, and only these counts are shuffled. Repeated rows of a key multiply, as
    in a join.
    """
    one = F.struct(order.cast("int").alias("o"), F.col("model"), F.col("yes"), F.col("no"))
    lists = hits.groupBy(*key).agg(F.collect_list(one).alias("_p")).where(F.size("_p") > 1).select("_p")
    names = ["_oa", "_ob", "model_a", "model_b"]
    return lists.mapInArrow(_count_pairs, _PAIRS).groupBy(*names).agg(*[F.sum(c).alias(c) for c in ("both_yes", "only_a", "only_b", "neither")])


def _order(models: Sequence[str] | None) -> Column:
    if models is None:
        return F.lit(0)
    return F.coalesce(lookup({m: i for i, m in enumerate(models)}, F.col("model")), F.lit(-1))


def paired_correctness(df: DataFrame, models: Sequence[str] | None = None, with_p: bool = True) -> DataFrame:
    """McNemar table of correctness for each pair of models on shared (event, true label).

    Pairs follow the order of ``models`` (by name if not given). A listed pair
    without shared events gets a row with n_common 0.
    """
    d = df.where(F.col("model").isin(list(models))) if models is not None else df
    ok = F.coalesce(F.col("pred_label") == F.col("true_label"), F.lit(False))
    hits = d.groupBy("event_id", "true_label", "model").agg(
        F.sum(ok.cast("bigint")).alias("yes"), F.sum((~ok).cast("bigint")).alias("no"))
    t = _model_pairs(hits, ["event_id", "true_label"], _order(models)).drop("_oa", "_ob")
    if models is not None:
        listed = [(a, b) for i, a in enumerate(models) for b in models[i + 1:]]
        grid = df.sparkSession.createDataFrame(listed, "model_a string, model_b string")
        t = grid.join(t, ["model_a", "model_b"], "left").fillna(0, ["both_yes", "only_a", "only_b", "neither"])
    out = t.select("model_a", "model_b", (F.col("both_yes") + F.col("only_a") + F.col("only_b") + F.col("neither")).alias("n_common"),
                   F.col("both_yes").alias("both_correct"), F.col("only_a").alias("a_correct_b_wrong"),
                   F.col("only_b").alias("a_wrong_b_correct"), F.col("neither").alias("both_wrong"),
                   mcnemar_statistic(F.col("only_a"), F.col("only_b")).alias("mcnemar_stat"))
    return out.withColumn("mcnemar_p", chi2_p("mcnemar_stat")) if with_p else out


def paired_flips(flips: DataFrame, first: str, second: str, types: Sequence[str] = PAIRED_FLIP_TYPES,
                 min_pairs: int = 5, with_p: bool = True) -> DataFrame:
    """McNemar test on flips of exactly two models, per perturbation type with more than five pairs."""
    d = flips.where(F.col("success") & F.col("label_flipped").isNotNull() & F.col("type").isin(list(types))
                    & F.col("model").isin(first, second))
    f = F.col("label_flipped")
    per = d.groupBy("type", "event_id", "pert_idx").agg(
        F.max(F.when(F.col("model") == first, f.cast("int"))).alias("f1"),
        F.max(F.when(F.col("model") == second, f.cast("int"))).alias("f2")).where("f1 is not null and f2 is not null")
    cell = {f"n{i}{j}": F.sum(F.when((F.col("f1") == i) & (F.col("f2") == j), 1).otherwise(0)) for i in (0, 1) for j in (0, 1)}
    t = per.groupBy("type").agg(F.count(F.lit(1)).alias("n_pairs"), *[v.alias(k) for k, v in cell.items()])
    t = t.where(F.col("n_pairs") > min_pairs).withColumn("statistic", mcnemar_statistic(F.col("n01"), F.col("n10")))
    return t.withColumn("p_value", chi2_p("statistic")) if with_p else t


def requested_fl_fi(df: DataFrame, models: Sequence[str]) -> DataFrame:
    """FL/FI counts of the requested models; a model without rows gets zeros."""
    want = df.sparkSession.createDataFrame([(m,) for m in models], "model string")
    stats = fl_fi_counts(df.where(F.col("model").isin(list(models))))
    return want.join(stats, "model", "left").fillna(0, ["total", "fl", "fi"]).orderBy("model")


def publication_table(core: DataFrame, fairness: DataFrame, harm: DataFrame) -> DataFrame:
    """Core metrics with fairness and harm columns, joined left on (model, country)."""
    keys = ["model", "country"]
    out = core
    for part, suffix in ((fairness, "_fair"), (harm, "_harm")):
        for c in part.columns:
            if c not in keys and c in out.columns:
                part = part.withColumnRenamed(c, c + suffix)
        out = out.join(part, keys, "left")
    return out


def add_robustness(core: DataFrame, flip_rates: DataFrame, rfc_by_tier: DataFrame,
                   keys: Sequence[str] = ("model", "country")) -> DataFrame:
    """Mean flip rate and mean low-tier discordance next to the core table, four decimals."""
    cfr = flip_rates.groupBy(*keys).agg(F.round(F.avg("flip_rate"), 4).alias("cfr_mean_optional"))
    rfc = rfc_by_tier.where(F.col("ambiguity_tier") == "Low").groupBy(*keys).agg(
        F.round(F.avg("discordant_rate"), 4).alias("rfc_low_discord_optional"))
    return core.join(cfr, list(keys), "left").join(rfc, list(keys), "left")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Drop old rows whose key occurs in the new rows, append the new rows, align columns."""
    kept = old.join(control_table(new.select(*keys).distinct()), list(keys), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def upsert_document(old: DataFrame, new: DataFrame, key: str, entry: Sequence[str], value: str) -> DataFrame:
    """Upsert of a keyed document kept as a long table; returns one map per key, entries sorted."""
    rows = upsert(old, new, [key])
    name = F.concat_ws("|", *entry)
    return rows.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, F.col(value))))).alias("document"))
