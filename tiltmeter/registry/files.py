"""Registered queries: files written and read again, and tables with given labels and conversations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import responses as RS
from ..functions.tables import shared_folder
from ..operators import classification as K, fairness as A, harm as H
from ..sources import readers, schemas, sinks, versions
from .evaluate import BOTH, _harm_sql, _rate, cnt
from .inputs import CTE, events, flips, predictions, r6, rich_events, rounded, table

Q: dict = {}
O: dict = {}


def q(name, oracle=None):
    def add(fn):
        Q[name] = fn
        if oracle is not None:
            O[name] = CTE + oracle
        return fn
    return add


def new_folder(spark) -> str:
    """A folder of its own in the one that all executors share."""
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


# Files ----------------------------------------------------------------------------------------

@q("raw_events_file", "SELECT CAST(event_id AS STRING) AS event_id_cnty, md5(body) AS notes_md5, event_type, country, actor_norm AS actor1, CAST(1+sn%8 AS INT) AS inter1, source, source_scale, CAST(fatalities AS INT) AS fatalities FROM rich")
def _(spark, d):
    path = new_folder(spark)
    raw = rich_events(spark, d).select(F.col("event_id").cast("string").alias("event_id_cnty"), F.col("body").alias("notes"), "event_type", "country",
                                       F.col("actor_norm").alias("actor1"), F.expr("CAST(1+sn%8 AS INT)").alias("inter1"), F.expr("nullif(source, '')").alias("source"),
                                       "source_scale", "fatalities")
    sinks.write_table(raw, path, "csv")
    read = readers.read_raw_events(spark, path)
    return read.select("event_id_cnty", F.md5(F.col("notes").cast("binary")).alias("notes_md5"), "event_type", "country", "actor1", "inter1", "source", "source_scale", "fatalities")


O["raw_events_file"] = O["raw_events_file"].replace("source, source_scale,", "nullif(source, '') AS source, source_scale,")


@q("partitioned_results", f"""SELECT 'cmr' AS country, 'few_shot' AS strategy, 500 AS sample_size, 3 AS num_examples, model AS model_dir, CAST(count(*) AS BIGINT) AS n, {r6('sum(pred_conf)')} AS conf, CAST(sum(event_id) AS BIGINT) AS ids FROM preds GROUP BY model""")
def _(spark, d):
    path = new_folder(spark)
    sinks.write_results(sinks.with_condition(predictions(spark, d).drop("country"), "cmr", "few_shot", 500, 3), path)
    back = spark.read.parquet(path)
    return rounded(back.groupBy("country", "strategy", "sample_size", "num_examples", "model_dir").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pred_conf").alias("conf"), F.sum("event_id").alias("ids")))


@q("combined_results", """, f AS (SELECT model, event_id, pred_label, k AS run FROM preds CROSS JOIN (VALUES (0),(1),(2)) AS t(k) WHERE k=0 OR (event_id+mi+k)%3=0),
r AS (SELECT *, row_number() OVER (PARTITION BY model, event_id ORDER BY run DESC) AS rn FROM f) SELECT model, event_id, CAST(run AS INT) AS run, pred_label FROM r WHERE rn=1""")
def _(spark, d):
    runs = predictions(spark, d).withColumn("run", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where("run = 0 or (event_id + mi + run) % 3 = 0")
    files = runs.select("model", "event_id", "run", "pred_label", F.timestamp_seconds(F.col("run") * 100).alias("file_time"),
                        F.concat(F.lit("results_"), "model", F.lit("_"), F.col("run").cast("string")).alias("source_file"),
                        F.col("event_id").alias("row_in_run"), F.col("model").alias("slug"))
    return readers.combine_model_results(files)


def nested_events(spark, d):
    """Event results of all flips, with the report they go to: one for every 20,000 ids."""
    f = flips(spark, d)
    variant = F.struct("type", "original", "replacement", "modifier", "phrase")
    result = F.struct("label", "confidence", "success", "label_flipped", "confidence_delta")
    per = f.groupBy("event_id", "pert_idx").agg(F.min(variant).alias("perturbation"), F.map_from_entries(F.collect_list(F.struct(F.col("model"), result))).alias("model_results"))
    nested = per.groupBy("event_id").agg(F.collect_list(F.struct("pert_idx", "perturbation", F.map_entries("model_results").alias("m"))).alias("_p"))
    ordered = F.transform(F.array_sort("_p", lambda x, y: x["pert_idx"] - y["pert_idx"]), lambda x: F.struct(x["perturbation"].alias("perturbation"), F.map_from_entries(x["m"]).alias("model_results")))
    report = F.concat(F.lit("r"), F.expr("event_id div 20000").cast("string"))
    return nested.select(report.alias("report"), F.col("event_id").cast("string").alias("event_id"), F.lit("").alias("original_text"), F.lit("").alias("true_label"), F.lit("Low").alias("ambiguity_tier"),
                         ordered.alias("perturbations"))


@q("event_result_lines", f"SELECT CAST(event_id AS STRING) AS event_id, pert_idx, type, original, replacement, model, label, {r6('confidence')} AS confidence, success, label_flipped FROM flips")
def _(spark, d):
    path = new_folder(spark)
    nested_events(spark, d).drop("report").write.json(path)
    flat = readers.flatten_counterfactuals(readers.read_event_results(spark, path))
    return rounded(flat.select("event_id", "pert_idx", "type", "original", "replacement", "model", "label", "confidence", "success", "label_flipped"))


@q("event_reports", f"SELECT concat('r', event_id//20000) AS report, 'all' AS country, CAST(event_id AS STRING) AS event_id, pert_idx, type, original, replacement, model, label, {r6('confidence')} AS confidence, success, label_flipped FROM flips")
def _(spark, d):
    """Nested reports of up to 20,000 events, each read by as many tasks as its size asks for."""
    path = new_folder(spark)
    sinks.write_reports(nested_events(spark, d), path, "report", {"country": "all", "models": ["}", "]"]})
    files = f"{path}/report=*"
    told = readers.read_report_metadata(spark, files).select("folder", "country")
    flat = readers.flatten_counterfactuals(readers.read_report_events(spark, files).select("folder", *schemas.EVENT_RESULT.names), "folder")
    report = F.regexp_extract("folder", "report=([^/]*)$", 1)
    return rounded(flat.join(told, "folder").select(report.alias("report"), "country", "event_id", "pert_idx", "type", "original", "replacement", "model", "label", "confidence", "success", "label_flipped"))


@q("upsert_versions", f"""SELECT model, event_id, true_label, pred_label, {r6('pred_conf')} AS pred_conf, CAST(NULL AS STRING) AS run FROM preds WHERE model IN ('model_a','model_b')
UNION ALL SELECT model, event_id, true_label, pred_label, {r6('pred_conf')}, 'new' FROM preds WHERE model IN ('model_c','model_d') AND country='en'""")
def _(spark, d):
    """Three models are written, then two, one of them again; the newest version is read."""
    root = new_folder(spark)
    p = predictions(spark, d).select("model", "event_id", "true_label", "pred_label", "pred_conf", "country")
    versions.upsert_version(p.where("model <> 'model_d'").drop("country"), root)
    versions.upsert_version(p.where("model in ('model_c', 'model_d') and country = 'en'").drop("country").withColumn("run", F.lit("new")), root)
    return rounded(versions.read_version(spark, root).select("model", "event_id", "true_label", "pred_label", "pred_conf", "run"))


@q("model_files", f"""SELECT replace(replace(model, ':', '-'), '/', '_') AS slug, model, CAST(event_id AS STRING) AS event_id, true_label, pred_label, {r6('pred_conf')} AS pred_conf,
 md5(concat(model, chr(10), '"', actor_norm, '",', chr(10))) AS notes_md5 FROM preds""")
def _(spark, d):
    """Files of all models in one folder tree, found by their names; every note has line breaks and quotes."""
    path = new_folder(spark)
    slug = F.replace(F.replace("model", F.lit(":"), F.lit("-")), F.lit("/"), F.lit("_"))
    note = F.concat("model", F.lit('\n"'), "actor_norm", F.lit('",\n'))
    none = F.lit(None).cast("string")
    rows = predictions(spark, d).select(F.concat(F.lit("results_"), slug, F.lit("_cmr.csv")).alias("file"), "model", F.col("event_id").cast("string"), "true_label", "pred_label", "pred_conf",
                                        none.alias("logits"), none.alias("reasoning"), F.lit(0.0).alias("latency_sec"), "actor_norm", note.alias("notes"))
    sinks.csv_writer(rows).partitionBy("file").save(path)
    files = readers.read_model_results(spark, path, r"file=results_(.+)_cmr\.csv")
    return rounded(files.select("slug", "model", "event_id", "true_label", "pred_label", "pred_conf", F.md5(F.col("notes").cast("binary")).alias("notes_md5")))


# Given labels and conversations ------------------------------------------------------------------

# A toxic document stands for violence, a good one for battles, any other for protests.
_GIVEN = "CASE WHEN toxic=1 THEN 'V' WHEN quality=1 THEN 'B' ELSE 'P' END"
_LABELLED = f"given AS (SELECT preds.* REPLACE ({_GIVEN} AS true_label) FROM preds JOIN labels ON labels.doc_id=preds.event_id)"


def labelled(spark, d):
    """Predictions of the labelled documents, held against the given labels."""
    given = table(spark, d, "labels").select(F.col("doc_id").alias("event_id"), F.expr(_GIVEN).alias("true_label"))
    return predictions(spark, d).drop("true_label").join(given, "event_id")


@q("labelled_core_metrics", f""", {_LABELLED} SELECT model, country, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(true_label=pred_label AS INT)),4) AS accuracy FROM given WHERE {BOTH} GROUP BY 1,2""")
def _(spark, d):
    return K.core_table(labelled(spark, d)).select("model", "country", "n", "accuracy")


@q("labelled_harm_rates", f""", {_LABELLED} {_harm_sql('model', 'given')}""")
def _(spark, d):
    return rounded(H.harm_rates(labelled(spark, d)))


@q("labelled_parity", f""", {_LABELLED}, f AS (SELECT *, CASE WHEN regexp_matches(lower(actor_norm),'state forces|military|police|government|gendarmerie') THEN 'state' ELSE 'non-state' END AS g FROM given)
SELECT model, 'V' AS target_label, {cnt("g='state'")} AS n_state, {cnt("g='non-state'")} AS n_nonstate, {r6(_rate('state', '') + '-' + _rate('non-state', ''))} AS "SPD" FROM f GROUP BY 1
HAVING {cnt("g='state'")}>0 AND {cnt("g='non-state'")}>0""")
def _(spark, d):
    return rounded(A.parity(labelled(spark, d)))


# Every turn of a conversation as an answer: its text, then an object; system turns end without one.
_TURN = "concat(text, chr(10), CASE WHEN role='system' THEN '' ELSE concat('{\"label\": \"', substring('VBEPRS', CAST((conv_id+turn)%6+1 AS INT), 1), '\", \"confidence\": 0.', CAST(turn%10 AS STRING), '}') END)"


@q("conversation_answers", f"""SELECT conv_id, turn, CASE WHEN role='system' THEN NULL ELSE substring('VBEPRS', CAST((conv_id+turn)%6+1 AS INT), 1) END AS label,
 CASE WHEN role<>'system' THEN CAST(turn%10 AS DOUBLE)/10 END AS confidence, role<>'system' AS found FROM conversations""")
def _(spark, d):
    r = table(spark, d, "conversations").withColumn("r", RS.parse_response(F.expr(_TURN)))
    return rounded(r.select("conv_id", "turn", "r.label", "r.confidence", "r.found"))
