"""Files in, files out, scoring errors and whole jobs."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tiltmeter.operators import cleaning as C, compare as M, sampling as S
from tiltmeter.operators.scoring import collect_rationales, score_events
from tiltmeter.plans import audits, baselines, experiment
from tiltmeter.sources import readers as R, schemas, sinks as W


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


HEAD = "model,event_id,true_label,pred_label,pred_conf,logits,reasoning,latency_sec,actor_norm,notes\n"


def test_raw_csv_with_line_breaks(spark, tmp_path):
    write(str(tmp_path / "raw.csv"), 'event_id_cnty,notes,event_type,country,actor1,inter1,source,source_scale,fatalities\nE1,"two\nlines, ""quoted""",Battles,Cameroon,A,1,S,N,3\n')
    r = R.read_raw_events(spark, str(tmp_path / "raw.csv")).collect()
    assert len(r) == 1 and r[0]["notes"] == 'two\nlines, "quoted"' and r[0]["fatalities"] == 3


def test_model_files(spark, tmp_path):
    root = str(tmp_path / "results" / "cmr" / "zero_shot" / "1000")
    write(f"{root}/m_7b/results_m-7b_cmr.csv", HEAD + "m:7b,1,V,B,0.5,,,1,A,n\nm:7b,1,V,V,0.6,,,1,A,n\nm:7b,2,V,V,0.7,,,1,A,n\n")
    write(f"{root}/k/results_k_cmr.csv", HEAD + "k,1,V,S,0.5,,,1,A,n\n")
    write(f"{root}/k/other.csv", HEAD + "k,1,V,S,0.5,,,1,A,n\n")
    files = R.read_model_results(spark, root, r"results_(.+)_cmr\.csv")
    assert {r["slug"] for r in files.collect()} == {"m-7b", "k"}
    only = R.read_model_results(spark, root, r"results_(.+)_cmr\.csv", ["m:7b"])
    assert only.count() == 3
    combined = {(r["model"], r["event_id"]): r["pred_label"] for r in R.combine_model_results(files).collect()}
    assert combined == {("m:7b", "1"): "V", ("m:7b", "2"): "V", ("k", "1"): "S"}
    tagged = R.tag_from_path(files).select("country", "sample_size").distinct().collect()
    assert [tuple(r) for r in tagged] == [("cmr", 1000)]


def test_newer_file_wins(spark, tmp_path):
    write(str(tmp_path / "a" / "results_m_cmr.csv"), HEAD + "m,1,V,B,0.5,,,1,A,n\n")
    write(str(tmp_path / "b" / "results_m_cmr.csv"), HEAD + "m,1,V,V,0.5,,,1,A,n\n")
    os.utime(tmp_path / "a" / "results_m_cmr.csv", (2e9, 2e9))
    out = R.combine_model_results(R.read_model_results(spark, str(tmp_path), r"results_(.+)_cmr\.csv")).collect()
    assert [r["pred_label"] for r in out] == ["B"]


def report(event_id, flipped):
    result = {"label": "B", "confidence": 0.4, "success": True, "label_flipped": flipped, "confidence_delta": -0.1}
    return {"metadata": {"country": "cmr", "models": ["m"]}, "detailed_results": [{
        "event_id": event_id, "original_text": "t", "true_label": "V", "ambiguity_score": 0.2, "ambiguity_tier": "Low",
        "perturbations": [{"perturbation": {"type": "negation", "text": "x"}, "model_results": {"m": result}}] * 2}]}


def test_counterfactual_reports(spark, tmp_path):
    for name, rep in (("m1/a.json", report("E1", True)), ("m1/b.json", report("E9", True)), ("m2/a.json", report("E2", False))):
        write(str(tmp_path / name), json.dumps(rep, indent=1))
    f = R.flips_from_reports(R.read_counterfactuals(spark, str(tmp_path / "*")))
    got = {(r["event_id"], r["pert_idx"], r["model"], r["type"], r["label_flipped"]) for r in f.collect()}
    assert got == {("E1", 0, "m", "negation", True), ("E1", 1, "m", "negation", True), ("E2", 0, "m", "negation", False), ("E2", 1, "m", "negation", False)}


def test_training_tables(spark, tmp_path):
    write(str(tmp_path / "a.csv"), "event_id_cnty,event_type_full\n1,Riots\n")
    write(str(tmp_path / "b.csv"), "event_id,event_type\n2,Battles\n")
    a = schemas._struct(event_id_cnty=schemas._S, event_type_full=schemas._S)
    b = schemas._struct(event_id=schemas._S, event_type=schemas._S)
    u = R.read_training_tables(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], [a, b])
    assert sorted(tuple(r) for r in u.collect()) == [("1", "Riots"), ("2", "Battles")]


def test_partition_layout(spark, tmp_path):
    df = spark.createDataFrame([("m:7b", 1, "V")], "model string, event_id int, pred_label string")
    root = str(tmp_path / "out")
    W.write_results(W.with_condition(df, "cmr", "few_shot", 1000, 3), root)
    W.write_results(W.with_condition(df, "cmr", "zero_shot", 1000, 3), root)
    assert os.path.isdir(f"{root}/country=cmr/strategy=few_shot/sample_size=1000/num_examples=3/model_dir=m_7b")
    back = spark.read.parquet(root)
    assert back.where("strategy = 'zero_shot'").first()["num_examples"] is None
    assert W.with_condition(df, "cmr", "few_shot", 1, 9).first()["num_examples"] is None


def test_upsert_and_tables(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "model string, n int")
    new = spark.createDataFrame([("b", 5, "x"), ("c", 6, "y")], "model string, n int, extra string")
    W.write_upsert(old, new, str(tmp_path / "v2"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "v2")).collect()) == [("a", 1, None), ("b", 5, "x"), ("c", 6, "y")]
    with pytest.raises(Exception):
        W.write_upsert(old, new, str(tmp_path / "v2"))
    for fmt in ("csv", "json"):
        W.write_table(old, str(tmp_path / fmt), fmt)
        assert spark.read.format(fmt).option("header", True).load(str(tmp_path / fmt)).count() == 2


def test_split_bundle_files(spark, tmp_path):
    rows = [(i, f"note {i}", "Riots" if i % 2 else "Battles", "Cameroon" if i % 5 == 0 else "Mali", "a") for i in range(100)]
    std = spark.createDataFrame(rows, "event_id int, notes string, event_type string, country string, actor_norm string")
    W.write_split_bundle(S.split_bundle(std, ["cmr"]), str(tmp_path), {"seed": 42})
    assert spark.read.parquet(str(tmp_path / "rows")).groupBy("split").count().count() == 3
    m = {r["split"]: r for r in spark.read.json(str(tmp_path / "manifest")).collect()}
    assert m["test_cmr"]["n_rows"] == 20 and json.loads(m["dev"]["params"]) == {"seed": 42}
    overlapping = std.withColumn("split", F.lit("a")).unionByName(std.withColumn("split", F.lit("b")))
    with pytest.raises(ValueError, match="leakage"):
        W.write_split_bundle(overlapping, str(tmp_path / "bad"))
    W.write_training_jsonl(std, str(tmp_path / "sft"))
    lines = [json.loads(x["value"]) for x in spark.read.text(str(tmp_path / "sft")).collect()]
    assert len(lines) == 100 and set(lines[0]) == {"prompt", "response"}


def test_missing_columns(spark):
    df = spark.createDataFrame([(1,)], "x int")
    for fn in (lambda: C.standardize(df), lambda: C.extract_country(df, "x"), lambda: C.distinct_values(df, "actor1")):
        with pytest.raises(ValueError):
            fn()


def test_notes_limit(spark):
    df = spark.createDataFrame([("E1", "x " * 400, "Battles", "Police Forces of Nigeria (2015-)")], "event_id_cnty string, notes string, event_type string, actor1 string")
    assert C.usable_state_rows(df, "Nigeria").first()["notes"] == "x " * 400
    assert C.usable_state_rows(df, "Nigeria", notes_limit=400).first()["notes"] == "x " * 200


def test_scoring_errors(spark):
    def factory():
        def predict(prompts):
            if len(prompts) > 1 or "bad" in prompts[0]:
                raise RuntimeError("model failed")
            return ['{"label": "riots", "confidence": 0.5, "scores": [1], "reasoning": ["a", "b"]}']
        return predict
    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "fine")], "event_id int, notes string").coalesce(1)
    got = {r["event_id"]: r for r in score_events(df, "m", factory).collect()}
    assert (got[1]["pred_label"], got[1]["pred_conf"], got[1]["logits"], got[1]["reasoning"]) == ("R", 0.5, "[1]", '["a","b"]')
    assert (got[2]["pred_label"], got[2]["pred_conf"]) == ("ERROR", 0.0)
    assert got[3]["model"] == "m" and got[3]["latency_sec"] >= 0
    r = {x["event_id"]: x["reasoning"] for x in collect_rationales(df.select("event_id", F.lit(-1).alias("pert_idx"), F.col("notes").alias("text")), "m", factory).collect()}
    assert r == {1: ["a", "b"], 2: None, 3: ["a", "b"]}


def test_whole_jobs(spark):
    from tiltmeter.registry.inputs import calibrated, events, predictions, raw_events
    sf = "/root/testdata/sf0.001"
    out = experiment.evaluate(calibrated(spark, sf))
    assert {"metrics", "harm", "thresholds", "top_disagreements", "fairness", "brier"} <= set(out)
    assert out["metrics"].count() == 4 and out["top_disagreements"].count() <= 20
    b = baselines.publication(predictions(spark, sf).withColumn("country", F.lit("cmr")))
    assert b["publication"].count() == 4 and "SPD" in b["publication"].columns
    split = baselines.splits(raw_events(spark, sf), ["cmr"])
    S.assert_no_leakage(split)

    def factory():
        return lambda prompts: ['{"label": "%s", "confidence": 0.%d, "reasoning": ["the military", "security forces"]}' % ("VBEPRS"[len(p) % 6], len(p) % 10) for p in prompts]
    preds = predictions(spark, sf).withColumn("pred_conf_temp", F.col("pred_conf")).where("model in ('model_a','model_b')")
    a = audits.counterfactual_audit(preds, {"model_a": factory, "model_b": factory}, top=10)
    assert a["counters"].first()["n_events"] == 10
    assert a["flip_rates"].count() > 0 and a["rfc"].count() > 0 and a["word_impact"].count() > 0
    assert M.upsert(a["summary"], a["summary"]).count() == a["summary"].count()
