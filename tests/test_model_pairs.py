"""Joint counts of model pairs, against every pair spelled out."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tiltmeter.operators import compare as M

SCHEMA = "model string, event_id int, true_label string, pred_label string"


def brute(rows):
    by_key = {}
    for model, event, true, pred in rows:
        by_key.setdefault((event, true), {}).setdefault(model, [0, 0])[0 if pred == true and pred is not None else 1] += 1
    out = Counter()
    for models in by_key.values():
        names = sorted(models, key=lambda m: (m is not None, m or ""))
        for i, a in enumerate(names):
            for b in names[i + 1:]:
                for x, what in enumerate("yn"):
                    for y, other in enumerate("yn"):
                        out[a, b, what + other] += models[a][x] * models[b][y]
    pairs = {k[:2] for k in out}
    return {p: tuple(out[(*p, w)] for w in ("yy", "yn", "ny", "nn")) for p in pairs}


def counted(df, **kw):
    return {(r["model_a"], r["model_b"]): (r["both_correct"], r["a_correct_b_wrong"], r["a_wrong_b_correct"], r["both_wrong"])
            for r in M.paired_correctness(df, with_p=False, **kw).collect()}


def some_rows(seed, n_models, n_events, copies=1):
    rnd = random.Random(seed)
    names = [f"m{i}" for i in range(n_models)] + [None, "é", "\U0001f600", ""]
    return [(m, e, rnd.choice("VB"), rnd.choice(["V", "B", None])) for m in names for e in range(n_events) if rnd.random() < 0.7 for _ in range(rnd.randint(1, copies))]


@pytest.mark.parametrize("copies", [1, 4])
@pytest.mark.parametrize("cells", [8, 1 << 21])
def test_against_all_pairs(spark, monkeypatch, copies, cells):
    monkeypatch.setattr(M, "CELLS", cells)
    rows = some_rows(copies, 9, 60, copies)
    assert counted(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


def test_many_copies_of_one_event_stay_whole_numbers(spark):
    n = 3_000_000
    df = spark.range(2 * n).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("model"), F.lit(1).alias("event_id"), F.lit("V").alias("true_label"), F.lit("V").alias("pred_label"))
    df = df.unionByName(df.withColumn("event_id", F.lit(2)).limit(0))
    assert counted(df) == {("a", "b"): (n * n, 0, 0, 0)}
    big = spark.createDataFrame([(1, "a", 2 ** 30 + 1, 1), (1, "b", 2 ** 30 + 3, 0)], "k int, model string, yes long, no long")
    r = M._model_pairs(big, ["k"], F.lit(0)).first()
    assert r["both_yes"] == (2 ** 30 + 1) * (2 ** 30 + 3) and r["only_b"] == 2 ** 30 + 3


def test_listed_models_and_empty_tables(spark):
    rows = [("b", 1, "V", "V"), ("a", 1, "V", "B"), ("c", 2, "V", "V")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert counted(df, models=["b", "a", "z"]) == {("b", "a"): (0, 1, 0, 0), ("b", "z"): (0, 0, 0, 0), ("a", "z"): (0, 0, 0, 0)}
    assert counted(df.where("event_id > 9")) == {}


def test_sixty_models_cost_little_more_than_their_rows(spark):
    """Six times the models are six times the rows and 36 times the pairs."""
    def seconds(models):
        df = spark.range(20_000 * models).select(F.concat(F.lit("m"), F.col("id") % models).alias("model"), F.floor(F.col("id") / models).alias("event_id"),
                                                 F.lit("V").alias("true_label"), F.when(F.xxhash64("id") % 3 == 0, "V").otherwise("B").alias("pred_label")).repartition(8).cache()
        df.count()
        times = []
        for _ in range(2):
            t0 = time.time()
            assert len(counted(df)) == models * (models - 1) // 2
            times.append(time.time() - t0)
        df.unpersist()
        return min(times)
    assert seconds(60) < 5 * seconds(10)
