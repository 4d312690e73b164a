"""Answers are asked for once per distinct prompt, over broken runs too."""

import glob

import pytest
from pyspark.sql import functions as F

from tiltmeter.operators.ledger import answered, fill_ledger, read_ledger
from tiltmeter.operators.scoring import collect_rationales, score_events, score_variants


def counting(folder, fails=lambda p: False, stops=lambda: False):
    """A predictor that writes down what it answers; ``fails`` picks prompts without an answer, ``stops`` kills the task."""
    def factory():
        def predict(prompts):
            if stops():
                raise SystemExit("the executor is gone")
            if any(fails(p) for p in prompts):
                raise RuntimeError("no answer")
            import uuid
            for p in prompts:
                with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                    f.write(p)
            return ['{"label": "riots", "confidence": 0.5, "reasoning": ["%d"]}' % len(p) for p in prompts]
        return predict
    return factory


def asked(folder):
    return sorted(open(p).read() for p in glob.glob(f"{folder}/*"))


@pytest.fixture
def calls(tmp_path):
    (tmp_path / "calls").mkdir()
    return str(tmp_path / "calls")


def prompts(spark, n):
    """n rows, a third of them with one prompt, every other prompt twice."""
    return spark.range(n, numPartitions=5).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), (F.col("id") / 2).cast("int"))).alias("p"))


def test_each_distinct_prompt_once(spark, tmp_path, calls):
    df = prompts(spark, 300)
    want = sorted({r["p"] for r in df.collect()})
    for _ in range(2):
        got = answered(df, F.col("p"), {"m": counting(calls)}, str(tmp_path / "ledger")).collect()
        assert len(got) == 300 and all(r["raw_response"] for r in got)
        assert asked(calls) == want
    more = prompts(spark, 330)
    assert answered(more, F.col("p"), {"m": counting(calls)}, str(tmp_path / "ledger")).where("raw_response is null").count() == 0
    assert asked(calls) == sorted({r["p"] for r in more.collect()})


def test_failed_prompts_are_asked_again(spark, tmp_path, calls):
    df, ledger = prompts(spark, 200), str(tmp_path / "ledger")
    want = sorted({r["p"] for r in df.collect()})
    half = counting(calls, lambda p: p == "hot" or int(p[1:]) > 50)
    first = answered(df, F.col("p"), {"m": half}, ledger)
    assert first.where("raw_response is null").select("p").distinct().count() == sum(p == "hot" or int(p[1:]) > 50 for p in want)
    assert answered(df, F.col("p"), {"m": counting(calls)}, ledger).where("raw_response is null").count() == 0
    assert asked(calls) == want


def test_a_run_that_breaks_off_is_taken_up(spark, tmp_path, calls):
    df, ledger = prompts(spark, 200), str(tmp_path / "ledger")
    want = sorted({r["p"] for r in df.collect()})

    def gone():
        import glob
        return len(glob.glob(f"{calls}/*")) > 60

    with pytest.raises(Exception):
        fill_ledger(df, F.col("p"), {"m": counting(calls, stops=gone)}, ledger, rounds=8)
    kept = {r["prompt_key"] for r in read_ledger(spark, ledger).collect()}
    assert 0 < len(kept) < len(want)
    before = len(asked(calls))
    fill_ledger(df, F.col("p"), {"m": counting(calls)}, ledger, rounds=8)
    assert len(asked(calls)) - before == len(want) - len(kept)
    assert read_ledger(spark, ledger).count() == len(want)


def test_models_nulls_and_empty_tables(spark, tmp_path, calls):
    ledger = str(tmp_path / "ledger")
    df = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (2, "b", None)], "event_id int, text string, model string")
    got = score_variants(df.drop("model"), {"m": counting(calls), "n": counting(calls)}, ledger=ledger)
    assert sorted((r["event_id"], r["model"], r["label"], r["success"]) for r in got.collect()) == sorted(
        [(1, "m", "R", True), (1, "n", "R", True)] * 2 + [(2, "m", "R", True), (2, "n", "R", True)])
    assert len(asked(calls)) == 4
    none = answered(df.where("event_id > 5"), F.col("text"), {"m": counting(calls)}, str(tmp_path / "other"))
    assert none.count() == 0 and set(none.columns) == {"event_id", "text", "model", "raw_response", "latency_sec"}


def test_the_same_rows_with_and_without(spark, tmp_path, calls):
    df = spark.range(40).select(F.col("id").alias("event_id"), F.concat(F.lit("note "), F.col("id") % 7).alias("notes"))
    columns = ["event_id", "notes", "model", "pred_label", "pred_conf", "logits", "reasoning"]
    plain = score_events(df, "m", counting(calls)).select(*columns)
    kept = score_events(df, "m", counting(calls), ledger=str(tmp_path / "l")).select(*columns)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, kept.collect()))
    t = df.select("event_id", F.lit(0).alias("pert_idx"), F.col("notes").alias("text"))
    a, b = collect_rationales(t, "m", counting(calls)), collect_rationales(t, "m", counting(calls), ledger=str(tmp_path / "l"))
    assert a.columns == b.columns and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
