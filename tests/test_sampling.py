"""Quotas, rank cuts and splits against plain Python, with hot groups."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tiltmeter.operators import disagreement as D, ranking as R, sampling as S


def md5(seed, i):
    return hashlib.md5(f"{seed}|{i}".encode()).hexdigest()


def events(spark, sizes):
    rows, i = [], 0
    for g, n in sizes.items():
        for _ in range(n):
            rows.append((i, g))
            i += 1
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "event_id bigint, event_type string").repartition(5), rows


def test_sample_is_the_smallest_hashes(spark):
    df, rows = events(spark, {"hot": 6000, "b": 300, "c": 1})
    got = S.cap_per_class(df, 250, seed=7).collect()
    want = set()
    for g in ("hot", "b", "c"):
        want |= {i for i in sorted((i for i, x in rows if x == g), key=lambda i: (md5(7, i), i))[:250]}
    assert {r["event_id"] for r in got} == want


def test_bands_follow_several_cuts(spark):
    df, rows = events(spark, {"hot": 3000, "b": 10})
    cuts = spark.createDataFrame([("hot", 0, 5), ("hot", 1, 5), ("hot", 2, 2000), ("b", 0, 0), ("b", 1, 99)], "event_type string, cut_no int, need int")
    h = df.withColumn("_h", R.sample_hash(1, "event_id"))
    got = {r["event_id"]: r["band"] for r in R.mark_bands(h, ["event_type"], cuts, [F.col("_h"), F.col("event_id")], R.hash_levels("_h")).collect()}
    order = sorted((i for i, x in rows if x == "hot"), key=lambda i: (md5(1, i), i))
    for pos, i in enumerate(order, 1):
        assert got[i] == (0 if pos <= 5 else 2 if pos <= 2000 else 3)
    assert all(got[i] == 1 for i, x in rows if x == "b")


def largest_remainder(counts, n):
    total = sum(counts.values())
    if not total or n <= 0:
        return {g: 0 for g in counts}
    ideal = {g: c / total * n for g, c in counts.items()}
    out = {g: math.floor(v) for g, v in ideal.items()}
    order = sorted(counts, key=lambda g: (-(ideal[g] - math.floor(ideal[g])), -counts[g], g))
    for g in order[:n - sum(out.values())]:
        out[g] += 1
    return out


@pytest.mark.parametrize("n", [0, 1, 7, 100, 1000])
def test_largest_remainder(spark, n):
    counts = {"a": 50, "b": 31, "c": 19, "d": 19, "e": 1}
    df = spark.createDataFrame(list(counts.items()), "g string, n bigint")
    got = {r["g"]: r["alloc"] for r in S.largest_remainder(df, F.lit(n), "g").collect()}
    assert got == largest_remainder(counts, n)
    assert sum(got.values()) == n


@pytest.mark.parametrize("n_total,share", [(100, 0.5), (99, 0.61), (10 ** 6, 0.2)])
def test_stratified_quota_fills_up(spark, n_total, share):
    sizes = {"P": 40, "x": 70, "y": 3, "z": 1}
    df, _ = events(spark, sizes)
    q = {r["event_type"]: r["quota"] for r in S.stratified_quota(df, "event_type", n_total, "P", share).collect()}
    want = min(n_total, sum(sizes.values()))
    prim = min(math.floor(want * share), 40)
    assert q["P"] == prim
    assert all(q[g] <= sizes[g] for g in sizes)
    assert sum(q.values()) == min(want, prim + 74)
    assert S.stratified_sample(df, "event_type", n_total, "P", share).count() == sum(q.values())


def test_draws_with_replacement(spark):
    df, rows = events(spark, {"P": 5, "x": 200})
    got = S.stratified_sample(df, "event_type", 100, "P", 0.05, replace=True).collect()
    by = Counter(r["event_type"] for r in got)
    assert by == {"P": 5, "x": 95}
    assert {r["event_id"] for r in got} <= {i for i, _ in rows}
    again = S.stratified_sample(df.repartition(3), "event_type", 100, "P", 0.05, replace=True).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_balanced_actor_sample(spark):
    rows = [(i, ["V", "B", "P"][i % 3], 1 if i % 7 == 0 else 2) for i in range(2100)] + [(9000 + i, "rare", 1) for i in range(4)]
    names = {"V": "Violence against civilians", "B": "Battles", "P": "Protests", "rare": "Riots"}
    df = spark.createDataFrame([(a, names[b], c) for a, b, c in rows], "event_id bigint, event_type string, inter1 int")
    s = S.balanced_actor_sample(df, "event_type", "inter1", 200, primary_share=0.6).collect()
    assert Counter(r["actor_type"] for r in s) == {"state": 100, "non-state": 100}
    assert Counter((r["actor_type"], r["gold_label"]) for r in s)[("state", "V")] == 60
    assert "Riots" not in {r["event_type"] for r in s}


def std(spark, n=1500):
    rows = [(i, "text", ["Battles", "Riots", "Protests"][0 if i % 3 == 0 else i % 2 + 1], ["Cameroon", "nigeria", "Chad", "Mali"][i % 4]) for i in range(n)]
    return spark.createDataFrame(rows, "event_id bigint, notes string, event_type string, country string").repartition(4)


def test_split_bundle_is_disjoint(spark):
    b = S.split_bundle(std(spark), ["cmr", "nga"], balance_train=True, balance_dev=True, balance_test=True, test_max_per_country=50)
    S.assert_no_leakage(b)
    per = defaultdict(Counter)
    for r in b.collect():
        per[r["split"]][r["event_type"]] += 1
        assert (r["split"] == "test_cmr") == (r["country"] == "Cameroon")
    assert len(set(per["train"].values())) == 1 and len(set(per["dev"].values())) == 1
    assert sum(per["test_cmr"].values()) == 50
    assert set(per) == {"train", "dev", "test_cmr", "test_nga"}


def test_split_bundle_keeps_everything_without_caps(spark):
    b = S.split_bundle(std(spark), ["cmr"])
    assert b.count() == 1500
    dev = b.where("split = 'dev'").groupBy("event_type").count().collect()
    n = {r["event_type"]: r["count"] for r in b.where("split <> 'test_cmr'").groupBy("event_type").count().collect()}
    assert all(r["count"] == round(n[r["event_type"]] * 0.1) for r in dev)


def test_balanced_dev_ignores_classes_without_dev_rows(spark):
    rows = [(i, "Battles" if i < 40 else "Riots" if i < 60 else "Protests", "Mali") for i in range(61)]
    df = spark.createDataFrame(rows, "event_id bigint, event_type string, country string")
    c = Counter((r["split"], r["event_type"]) for r in S.split_bundle(df, ["cmr"], balance_dev=True).collect())
    assert c == {("dev", "Battles"): 2, ("dev", "Riots"): 2, ("train", "Battles"): 36, ("train", "Riots"): 18, ("train", "Protests"): 1}


def test_evaluation_countries_in_training_leak(spark):
    b = S.split_bundle(std(spark), ["cmr"], include_eval_in_train=True)
    with pytest.raises(ValueError, match="leakage"):
        S.assert_no_leakage(b)
    with pytest.raises(ValueError, match="unsupported"):
        S.split_bundle(std(spark), ["xyz"])


def test_dedup_with_a_hot_key(spark):
    rows = [("m", 0 if i % 3 == 0 else i, i, f"v{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "model string, event_id int, seq int, v string").repartition(6)
    last = {r["event_id"]: r["v"] for r in R.keep_one(df, ["model", "event_id"], ["seq"], last=True).collect()}
    first = {r["event_id"]: r["v"] for r in R.keep_one(df, ["model", "event_id"], ["seq"]).collect()}
    assert last[0] == "v2997" and first[0] == "v0" and len(last) == 2001


def test_top_percent_with_one_score_for_a_third(spark):
    rows = [(i, 0.9 if i % 3 == 0 else (i % 100) / 1000.0) for i in range(900)]
    df = spark.createDataFrame(rows, "event_id bigint, max_confidence double").repartition(4)
    for pct in (0.01, 10, 33.4, 100):
        got = {r["event_id"] for r in D.top_percent(df, pct).collect()}
        n = max(1, math.ceil(900 * pct / 100))
        want = sorted(rows, key=lambda r: (-r[1], md5(0, r[0]), r[0]))[:n]
        assert got == {i for i, _ in want}
    with pytest.raises(ValueError):
        D.top_percent(df, 0)


def test_calibration_split_of_tiny_models(spark):
    df = spark.createDataFrame([("one", 1)] + [("many", i) for i in range(2, 13)], "model string, event_id bigint")
    got = S.calibration_split(df).collect()
    one = [r for r in got if r["model"] == "one"][0]
    assert one["is_test"] and one["is_train"]
    assert sum(r["is_test"] for r in got if r["model"] == "many") == 3
    assert all(r["is_test"] != r["is_train"] for r in got if r["model"] == "many")


def test_error_cases_cap(spark):
    rows = [(f"m{i % 3}", i, "V", "B") for i in range(900)] + [("m0", 5000 + i, "B", "V") for i in range(4)]
    df = spark.createDataFrame(rows, "model string, event_id bigint, true_label string, pred_label string")
    c = Counter((r["error_kind"], r["model"]) for r in D.error_cases(df, 200).collect())
    assert c[("false_legitimization", "m0")] == 67 and sum(v for k, v in c.items() if k[0] == "false_legitimization") == 200
    assert c[("false_illegitimization", "m0")] == 4
