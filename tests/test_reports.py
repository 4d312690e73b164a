"""Nested reports, one document a file, read from files that several tasks share."""

import json
import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tiltmeter.sources import readers as R
from tiltmeter.sources.records import read_lines
from tiltmeter.sources.reports import read_objects


@pytest.fixture
def small_blocks(spark):
    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
    yield use
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


ODD = ["x", "}", "{", "]", "[", '"', "\\", "\\\"", ":", ",", "\n", "é", '"detailed_results": [{', "}}", " "]


def event(rnd, i):
    word = lambda: "".join(rnd.choices(ODD, k=rnd.randrange(6)))
    result = lambda: {"label": rnd.choice("VBEP"), "confidence": rnd.random(), "success": True, "label_flipped": rnd.random() < .5, "confidence_delta": 0.5}
    return {"event_id": f"E{i}", "original_text": word(), "true_label": "V", "ambiguity_score": 0.25, "ambiguity_tier": "Low",
            "perturbations": [{"perturbation": {"type": "negation", "text": word()}, "model_results": {f"m{word()}": result(), "n": result()}} for _ in range(rnd.randrange(3))]}


def document(n, seed):
    rnd = random.Random(seed)
    return {"metadata": {"country": "c}\"mr", "models": ["m", "]"], "more": {"detailed_results": [{"event_id": "no"}]}}, "a}b": [[{"x": 1}]],
            "detailed_results": [event(rnd, i) for i in range(n)], "summary": {"detailed_results": 3, "rows": [{"event_id": "no"}]}}


def rows(df, *drop):
    return sorted(json.dumps(r.asDict(True), sort_keys=True) for r in df.drop("source_file", "folder", "place", *drop).collect())


def one_task(spark, path):
    return R.read_counterfactuals(spark, path).select(F.explode("detailed_results").alias("e")).select("e.*")


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("size", [700, 3000, 1 << 20])
def test_as_one_task_reads_it(spark, tmp_path, small_blocks, size, indent):
    (tmp_path / "r.json").write_text(json.dumps(document(60, size), indent=indent, ensure_ascii=False) + "\n" * (size % 2), encoding="utf-8")
    small_blocks(size)
    got = R.read_report_events(spark, str(tmp_path / "r.json"))
    assert rows(got) == rows(one_task(spark, str(tmp_path / "r.json")))
    assert [r["event_id"] for r in got.orderBy("place").collect()] == [f"E{i}" for i in range(60)]
    meta = R.read_report_metadata(spark, str(tmp_path / "r.json")).collect()
    assert [(m["country"], m["models"]) for m in meta] == [('c}"mr', ["m", "]"])]


def test_every_place_of_a_border(spark, tmp_path, small_blocks):
    body = json.dumps(document(3, 4))
    (tmp_path / "r.json").write_text(body)
    want = rows(one_task(spark, str(tmp_path / "r.json")))
    for size in range(len(body) // 40, len(body) + 2, max(1, len(body) // 7)):
        small_blocks(size)
        assert rows(R.read_report_events(spark, str(tmp_path / "r.json"))) == want, size


def test_one_report_is_read_by_several_tasks(spark, tmp_path, small_blocks):
    (tmp_path / "r.json").write_text(json.dumps(document(300, 2)))
    small_blocks(2000)
    assert read_lines(spark, str(tmp_path / "r.json"), end="}").select("block_start").distinct().count() > 8
    got = R.read_report_events(spark, str(tmp_path / "r.json"))
    assert got.select(F.spark_partition_id()).distinct().count() > 8
    assert rows(got) == rows(one_task(spark, str(tmp_path / "r.json")))


def test_one_event_over_many_blocks(spark, tmp_path, small_blocks):
    doc = document(3, 1)
    doc["detailed_results"][1]["original_text"] = "}\\\"{" * 20_000
    (tmp_path / "r.json").write_text(json.dumps(doc))
    small_blocks(1000)
    assert rows(R.read_report_events(spark, str(tmp_path / "r.json"))) == rows(one_task(spark, str(tmp_path / "r.json")))


def test_first_file_of_each_folder(spark, tmp_path, small_blocks):
    for i, name in enumerate(("m1/a.json", "m1/b.json", "m2/c.json", "m3/d.json", "m3/e.json")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("" if name == "m3/d.json" else json.dumps(document(20 + i, i), indent=i or None))
    small_blocks(700)
    got = R.read_report_events(spark, str(tmp_path / "m[12]"))
    assert rows(got) == rows(one_task(spark, str(tmp_path / "m[12]")))
    assert {r["folder"].rsplit("/", 1)[1]: r["n"] for r in got.groupBy("folder").agg(F.count("*").alias("n")).collect()} == {"m1": 20, "m2": 22}
    flat = R.flatten_counterfactuals(got)
    assert flat.count() == R.flips_from_reports(R.read_counterfactuals(spark, str(tmp_path / "m[12]"))).count()


@pytest.mark.parametrize("body", ["{}", '{"detailed_results": []}', '{"detailed_results": null, "a": {"b": [{}]}}', "", "\n", '{"other": [{"event_id": "1"}]}'])
def test_nothing_in_it(spark, tmp_path, body):
    (tmp_path / "r.json").write_text(body)
    assert R.read_report_events(spark, str(tmp_path / "r.json")).collect() == []


def test_values_that_are_no_objects_are_left_out(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"k" : [null, {"a": 1}, 5, "}{", {"a": 2} , {} ] }')
    assert [r["record"] for r in read_objects(spark, str(tmp_path / "r.json"), "k").orderBy("place").collect()] == ['{"a": 1}', '{"a": 2}', "{}"]


def test_a_table_of_blocks_that_is_too_large(spark, tmp_path, small_blocks, monkeypatch):
    from tiltmeter.sources import records
    monkeypatch.setattr(records, "sized_table", lambda df: (df, False))
    (tmp_path / "r.json").write_text(json.dumps(document(80, 8)))
    small_blocks(900)
    assert rows(R.read_report_events(spark, str(tmp_path / "r.json"))) == rows(one_task(spark, str(tmp_path / "r.json")))


def test_what_is_refused(spark, tmp_path):
    whole = json.dumps(document(4, 3))
    for name, body, message in (("cut", whole[:len(whole) // 2], "no whole JSON"), ("open", whole[:-2], "no whole JSON"), ("string", whole + '"', "no whole JSON"),
                                ("array", '{"detailed_results": [[{"a": 1}]]}', "else than objects"), ("object", '{"detailed_results": {"a": {"b": 1}}}', "else than objects")):
        (tmp_path / f"{name}.json").write_text(body)
        with pytest.raises(Exception, match=message):
            R.read_report_events(spark, str(tmp_path / f"{name}.json")).collect()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.dictionaries(st.text('ab"}{[]\\:,', max_size=4), st.one_of(st.text('"\\}{]:', max_size=8), st.lists(st.integers(0, 9), max_size=2)), max_size=3), max_size=6), st.integers(1, 50))
def test_random_objects(spark, tmp_path, small_blocks, values, size):
    (tmp_path / "r.json").write_text(json.dumps({"a": {"k": values}, "k": values, "b": values}))
    small_blocks(size)
    got = [json.loads(r["record"]) for r in read_objects(spark, str(tmp_path / "r.json"), "k").orderBy("place").collect()]
    assert got == values
