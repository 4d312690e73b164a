"""Models get few prompts at a time, however many rows and bytes an Arrow batch has."""

import json

import pytest
from pyspark.sql import functions as F

from tiltmeter.operators import ledger as L
from tiltmeter.operators.scoring import ask, ask_all, collect_rationales


def sizes():
    def factory():
        return lambda prompts: [f"{len(prompts)} {sum(len(p or '') for p in prompts)}" for p in prompts]
    return factory


@pytest.fixture(scope="module")
def rows(spark):
    text = F.when(F.col("id") % 50 == 7, F.lit(None)).when(F.col("id") % 1000 == 5, F.repeat(F.lit("é "), 400_000)).otherwise(F.repeat(F.lit("word "), 100))
    return spark.range(4000).select(F.col("id").alias("event_id"), text.alias("notes")).coalesce(1)


def within(found):
    got = [tuple(map(int, r.split())) for r in found]
    return all(n <= L.MOST_PROMPTS and (n == 1 or chars <= L.MOST_BYTES) for n, chars in got)


def test_ask(rows):
    got = ask(rows, F.col("notes"), sizes()).collect()
    assert sorted(r["event_id"] for r in got) == list(range(4000))
    assert all((r["notes"] is None) == (r["event_id"] % 50 == 7) for r in got)
    assert within(r["raw_response"] for r in got)


def test_ask_all(rows):
    got = ask_all(rows, F.col("notes"), {"a": sizes(), "b": sizes()}).collect()
    assert sorted((r["model"], r["event_id"]) for r in got) == [(m, i) for m in "ab" for i in range(4000)]
    assert within(r["raw_response"] for r in got)


def test_ledger(rows, tmp_path):
    folder = str(tmp_path / "ledger")
    d = rows.withColumn("notes", F.concat(F.col("event_id").cast("string"), F.lit(" "), F.substring("notes", 1, 50)))
    L.fill_ledger(d, F.col("notes"), {"a": sizes(), "b": sizes()}, folder, rounds=1)
    got = L.read_ledger(rows.sparkSession, folder).collect()
    assert len(got) == 2 * (4000 - 80 + 1) and within(r["raw_response"] for r in got)


def test_rationales(rows):
    def factory():
        return lambda prompts: [json.dumps({"reasoning": [str(len(prompts))], "label": "V"}) for _ in prompts]

    t = rows.where("notes IS NOT NULL").select("event_id", F.lit(-1).alias("pert_idx"), F.col("notes").alias("text"))
    got = collect_rationales(t, "m", factory).collect()
    assert len(got) == 3920 and max(int(r["reasoning"][0]) for r in got) <= L.MOST_PROMPTS
