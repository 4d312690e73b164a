"""Registered queries: raw tables, labels, actors, samples, splits, unions and prompts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import actors as A, labels as L, prompts as P
from ..operators import cleaning as C, sampling as S
from ..functions.tables import shared_folder
from ..operators.scoring import score_events
from ..sources.readers import path_country, path_sample_size
from .inputs import CTE, VALID, events, predictions, raw_events, rich_events, rounded, spread

Q: dict = {}
O: dict = {}


def q(name, oracle=None):
    def add(fn):
        Q[name] = fn
        if oracle is not None:
            O[name] = CTE + oracle
        return fn
    return add


CLASSES = "(" + ",".join(f"'{c}'" for c in L.CLASSES) + ")"


def actor_case(c):
    n = f"lower(trim(regexp_replace(coalesce({c},''),'\\s*\\([^)]*\\)','','g')))"
    return f"""CASE WHEN contains({n},'communal militia') THEN 'Communal Militia' WHEN contains({n},'ambazon') THEN 'Ambazonia'
 WHEN contains({n},'boko haram') OR contains({n},'iswap') OR contains({n},'islamic state west africa') THEN 'Boko Haram / ISWAP'
 WHEN contains({n},'military forces of cameroon') OR contains({n},'police forces of cameroon') THEN 'State forces (Cameroon)'
 WHEN contains({n},'protest') OR contains({n},'riot') OR contains({n},'civilian') THEN 'Protesters/Rioters/Civilians'
 WHEN contains({n},'mnjtf') OR contains({n},'multinational joint task force') THEN 'MNJTF' WHEN contains({n},'pirate') THEN 'Pirates' ELSE 'Other Actors' END"""


STD = f"""std0 AS (SELECT event_id_cnty AS event_id, seq, trim(regexp_replace(coalesce("NOTES",''),'\\s+',' ','g')) AS notes, "EVENT_TYPE" AS event_type,
 trim(coalesce("COUNTRY",'')) AS country, {actor_case('"ACTOR1"')} AS actor_norm FROM raw),
std AS (SELECT event_id, notes, event_type, country, actor_norm FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY seq) AS rn FROM std0
 WHERE event_type IN {CLASSES} AND length(notes)>=10) WHERE rn=1)"""

H42 = "md5(concat('42|', CAST(event_id AS STRING))), event_id"


def std(spark, d):
    return C.standardize(spread(raw_events(spark, d)), order=["seq"])


# Raw to standard ---------------------------------------------------------------

@q("country_rows", """SELECT event_id_cnty, seq, "COUNTRY" FROM raw WHERE lower(trim(coalesce("COUNTRY",'')))='cameroon'""")
def _(spark, d):
    return C.extract_country(raw_events(spark, d), "cameroon ").select("event_id_cnty", "seq", "COUNTRY")


@q("standard_events", f", {STD} SELECT * FROM std")
def _(spark, d):
    return std(spark, d)


@q("usable_state_rows", f""",
u AS (SELECT event_id_cnty, seq, regexp_replace("NOTES",'\\s+',' ','g') AS notes, "EVENT_TYPE" AS event_type, {actor_case('"ACTOR1"')} AS actor_norm FROM raw
 WHERE regexp_matches(lower(coalesce("ACTOR1",'')),'(military|police) forces of cameroon') AND "NOTES" IS NOT NULL AND "EVENT_TYPE" IN {CLASSES})
SELECT event_id_cnty, notes, event_type, actor_norm FROM (SELECT *, row_number() OVER (PARTITION BY event_id_cnty ORDER BY seq) rn FROM u) WHERE rn=1""")
def _(spark, d):
    return C.usable_state_rows(spread(raw_events(spark, d)), "Cameroon", order=["seq"])


@q("resolved_columns", """SELECT event_id_cnty AS event_id, "EVENT_TYPE" AS event_type, "INTER1" AS inter1 FROM raw""")
def _(spark, d):
    return C.require(raw_events(spark, d), event_id=["event_id", "event_id_cnty"], event_type=["event_type"], inter1=["inter1"])


@q("distinct_actors", """SELECT DISTINCT trim(coalesce("ACTOR1",'')) AS value FROM raw""")
def _(spark, d):
    return C.distinct_values(raw_events(spark, d), "actor1")


@q("enriched_notes", """, n AS (SELECT DISTINCT event_id_cnty AS event_id, "NOTES" AS notes FROM raw WHERE "INTER1"<>3)
SELECT p.model, p.event_id, md5(coalesce(n.notes,'none')) AS notes_md5 FROM preds p LEFT JOIN n USING (event_id)""")
def _(spark, d):
    notes = raw_events(spark, d).where("INTER1 <> 3").select("event_id_cnty", "NOTES")
    j = C.enrich_notes(predictions(spark, d).select("model", "event_id"), notes)
    return j.select("model", "event_id", F.md5(F.coalesce("notes", F.lit("none")).cast("binary")).alias("notes_md5"))


@q("enriched_metadata", """SELECT p.model, p.event_id, r.source, r.source_scale, r.fatalities, md5(r.body) AS notes_md5 FROM preds p JOIN rich r USING (event_id)""")
def _(spark, d):
    raw = rich_events(spark, d).select("event_id", F.col("body").alias("NOTES"), F.col("source").alias("SOURCE"),
                                       F.col("source_scale").alias("SOURCE_SCALE"), F.col("fatalities").alias("FATALITIES"))
    j = C.enrich_metadata(predictions(spark, d).select("model", "event_id", "notes"), raw)
    return j.select("model", "event_id", "source", "source_scale", "fatalities", F.md5(F.col("notes").cast("binary")).alias("notes_md5"))


# Labels, actors, names -------------------------------------------------------------

_RAW_LABEL = """CASE event_id%10 WHEN 0 THEN event_type WHEN 1 THEN lower(true_label) WHEN 2 THEN concat(' ', true_label, ' ')
 WHEN 3 THEN upper(event_type) WHEN 4 THEN '' WHEN 5 THEN NULL WHEN 6 THEN 'riots' WHEN 7 THEN true_label WHEN 8 THEN 'none' ELSE lower(event_type) END"""
_MAP = "CASE {} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.CLASS_CODES.items()) + " END"


@q("label_columns", f""", x AS (SELECT event_id, {_RAW_LABEL} AS raw_label, event_type FROM e), y AS (SELECT *, trim(coalesce(raw_label,'')) AS t FROM x)
SELECT event_id, {_MAP.format('raw_label')} AS code,
 CASE WHEN upper(t) IN {VALID} THEN upper(t) ELSE coalesce({_MAP.format('t')}, CASE lower(t) WHEN 'battles' THEN 'B' WHEN 'protests' THEN 'P' WHEN 'riots' THEN 'R' END, 'ERROR') END AS clean,
 CASE WHEN upper(t) IN {VALID} THEN upper(t) ELSE 'INVALID' END AS strict,
 CAST(CASE raw_label {' '.join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(L.CLASSES))} END AS INT) AS class_index FROM y""")
def _(spark, d):
    x = events(spark, d).withColumn("raw_label", F.expr(_RAW_LABEL))
    return x.select("event_id", L.class_code("raw_label").alias("code"), L.clean_label("raw_label").alias("clean"),
                    L.strict_label("raw_label").alias("strict"), L.class_index("raw_label").alias("class_index"))


@q("valid_label_rows", f"""SELECT model, CAST(count(*) FILTER (WHERE t IN {VALID}) AS BIGINT) AS true_valid, CAST(count(*) FILTER (WHERE t IN {VALID} AND p IN {VALID}) AS BIGINT) AS both_valid
 FROM (SELECT model, CASE WHEN event_id%7=0 THEN NULL WHEN event_id%11=0 THEN 'X' ELSE true_label END AS t, CASE WHEN event_id%13=0 THEN 'ERROR' ELSE pred_label END AS p FROM preds) GROUP BY 1""")
def _(spark, d):
    p = predictions(spark, d).select("model", F.expr("CASE WHEN event_id%7=0 THEN NULL WHEN event_id%11=0 THEN 'X' ELSE true_label END").alias("t"),
                                     F.expr("CASE WHEN event_id%13=0 THEN 'ERROR' ELSE pred_label END").alias("p"))
    return p.groupBy("model").agg(F.count(F.when(L.is_valid("t"), 1)).alias("true_valid"),
                                  F.count(F.when(L.is_valid("t") & L.is_valid("p"), 1)).alias("both_valid"))


_STRIP = "trim(regexp_replace(coalesce({},''),'\\s*\\([^)]*\\)','','g'))"


@q("actor_columns", f"""SELECT event_id_cnty, seq, {_STRIP.format('"ACTOR1"')} AS stripped, regexp_matches(lower({_STRIP.format('"ACTOR1"')}),'(military|police) forces of nigeria') AS is_state,
 {actor_case('"ACTOR1"')} AS actor_norm, CASE WHEN "INTER1"=1 THEN 'state' ELSE 'non-state' END AS actor_type, coalesce(contains(lower("ACTOR1"),'police'),false) AS police,
 CASE WHEN "ACTOR1" IS NULL THEN 'unknown' WHEN regexp_matches(lower("ACTOR1"),'state forces|military|police|government|gendarmerie') THEN 'state' ELSE 'non-state' END AS actor_group FROM raw""")
def _(spark, d):
    a = F.coalesce("ACTOR1", F.lit(""))
    return raw_events(spark, d).select("event_id_cnty", "seq", A.strip_parens(a).alias("stripped"), A.is_state_by_name("ACTOR1", "nigeria").alias("is_state"),
                                       A.normalize_actor("ACTOR1").alias("actor_norm"), L.actor_type("INTER1").alias("actor_type"),
                                       A.mentions_actor("ACTOR1", "Police").alias("police"), A.actor_group("ACTOR1").alias("actor_group"))


@q("custom_actor_groups", """SELECT event_id, CASE WHEN contains(lower(actor_norm),'armed') THEN 'Armed' WHEN length(trim(regexp_replace(actor_norm,'\\s*\\([^)]*\\)','','g')))<11 THEN 'Short' ELSE 'Other Actors' END AS grp FROM e""")
def _(spark, d):
    groups = [("Armed", ["armed"]), ("Short", lambda name: F.length(name) < 11)]
    return events(spark, d).select("event_id", A.normalize_actor("actor_norm", groups).alias("grp"))


@q("note_length_bins", """SELECT CASE WHEN n_chars>0 AND n_chars<=100 THEN 'very_short' WHEN n_chars>100 AND n_chars<=200 THEN 'short' WHEN n_chars>200 AND n_chars<=300 THEN 'medium'
 WHEN n_chars>300 AND n_chars<=500 THEN 'long' WHEN n_chars>500 THEN 'very_long' END AS length_bin, CAST(count(*) AS BIGINT) AS n, CAST(max(n_chars) AS BIGINT) AS longest FROM e GROUP BY 1""")
def _(spark, d):
    return events(spark, d).groupBy(L.note_length_bin("n_chars").alias("length_bin")).agg(F.count(F.lit(1)).alias("n"), F.max("n_chars").alias("longest"))


_NAME = "concat(CASE sn%3 WHEN 0 THEN 'Family-' WHEN 1 THEN 'org/mod' ELSE 'base' END, CAST(sn AS STRING), CASE event_id%3 WHEN 0 THEN ':7b' WHEN 1 THEN ':1.7B' ELSE ' x' END)"


@q("model_names", f""", n AS (SELECT DISTINCT {_NAME} AS model FROM e)
SELECT model, regexp_replace(model,'[^a-zA-Z0-9._]','_','g') AS dir_slug, replace(replace(model,':','-'),'/','_') AS file_slug,
 regexp_replace(replace(replace(model,':','-'),'/','_'),'(?i)^(.+)-(\\d+\\.?\\d*b)$','\\1:\\2') AS back, CASE WHEN lower(model) LIKE 'family%' THEN 'family' ELSE model END AS family FROM n""")
def _(spark, d):
    n = events(spark, d).select(F.expr(_NAME).alias("model")).distinct()
    return n.select("model", L.model_dir_slug("model").alias("dir_slug"), L.model_file_slug("model").alias("file_slug"),
                    L.slug_to_model(L.model_file_slug("model")).alias("back"), L.collapse_family("model", "family").alias("family"))


@q("models_exact", "SELECT model, event_id FROM preds WHERE model IN ('model_a','model_c')")
def _(spark, d):
    return L.select_models(predictions(spark, d), ["model_a", "model_c", "_d"]).select("model", "event_id")


@q("models_by_substring", "SELECT model, event_id FROM preds WHERE contains(model,'_d') OR contains(model,'l_b')")
def _(spark, d):
    return L.select_models(predictions(spark, d), ["_d", "l_b"]).select("model", "event_id")


@q("significance_stars", f"""SELECT event_id, CASE WHEN p<0.001 THEN '***' WHEN p<0.01 THEN '**' WHEN p<0.05 THEN '*' ELSE 'n.s.' END AS stars
 FROM (SELECT event_id, CAST(event_id%97 AS DOUBLE)/1000 AS p FROM e)""")
def _(spark, d):
    return events(spark, d).select("event_id", L.significance_stars(F.expr("CAST(event_id%97 AS DOUBLE)/1000")).alias("stars"))


_COND = "CASE event_id%5 WHEN 0 THEN 'zero_shot' WHEN 1 THEN 'few_shot_1' WHEN 2 THEN 'few_shot_3' WHEN 3 THEN 'few_shot_5' ELSE 'other' END"


@q("condition_ranks", f"""SELECT condition, CAST(CASE condition WHEN 'zero_shot' THEN 0 WHEN 'few_shot_1' THEN 1 WHEN 'few_shot_3' THEN 2 WHEN 'few_shot_5' THEN 3 END AS INT) AS rank,
 CAST(count(*) AS BIGINT) AS n FROM (SELECT {_COND} AS condition FROM e) GROUP BY 1""")
def _(spark, d):
    c = events(spark, d).select(F.expr(_COND).alias("condition")).groupBy("condition").agg(F.count(F.lit(1)).alias("n"))
    return c.select("condition", L.condition_rank("condition").alias("rank"), "n")


@q("country_names", "SELECT event_id, CASE WHEN event_id%2=0 THEN 'Cameroon' ELSE 'Nigeria' END AS country FROM e")
def _(spark, d):
    return events(spark, d).select("event_id", L.country_name(F.expr("CASE WHEN event_id%2=0 THEN 'CMR ' ELSE 'nga' END")).alias("country"))


_PATH = "concat('/out/results/', CASE sn%3 WHEN 0 THEN 'x' ELSE CAST(100*sn AS STRING) END, '/', CAST(event_id AS STRING), '/pred_', CASE event_id%3 WHEN 0 THEN 'cmr' WHEN 1 THEN 'Nigeria' ELSE 'tcd' END, '_7.csv')"


@q("path_tags", """SELECT event_id, CASE event_id%3 WHEN 0 THEN 'cmr' WHEN 1 THEN 'nga' ELSE 'unknown' END AS country,
 CAST(CASE sn%3 WHEN 0 THEN event_id ELSE 100*sn END AS INT) AS sample_size FROM e""")
def _(spark, d):
    p = events(spark, d).withColumn("path", F.expr(_PATH))
    return p.select("event_id", path_country(F.col("path")).alias("country"), path_sample_size(F.col("path")).alias("sample_size"))


# Samples and splits -------------------------------------------------------------------

def rk(part, src="e", order=H42, name="rk"):
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {order}) AS rn, count(*) OVER (PARTITION BY {part}) AS cnt FROM {src})"


@q("cap_per_class", f", {rk('event_type')} SELECT event_id, event_type FROM rk WHERE rn<=25")
def _(spark, d):
    return S.cap_per_class(events(spark, d).select("event_id", "event_type"), 25)


@q("balanced_classes", f", {rk('event_type')} SELECT event_id, event_type FROM rk WHERE rn<=(SELECT min(cnt) FROM rk)")
def _(spark, d):
    return S.balance_classes(events(spark, d).select("event_id", "event_type"))


_NDEV = "CASE WHEN cnt>1 THEN least(greatest(round_even(cnt*0.1::DOUBLE,0),1),cnt-1) ELSE 0 END"


@q("train_dev_split", f", {rk('event_type')} SELECT event_id, event_type, CASE WHEN rn<={_NDEV} THEN 'dev' ELSE 'train' END AS split FROM rk")
def _(spark, d):
    return S.train_dev_split(events(spark, d).select("event_id", "event_type"))


_BUNDLE = f""", {STD}, pool AS (SELECT * FROM std WHERE lower(country) NOT IN ('cameroon','nigeria')), {rk('event_type', 'pool')},
tr AS (SELECT event_id, event_type, country, CASE WHEN rn<={_NDEV} THEN 'dev' ELSE 'train' END AS split FROM rk), {rk('event_type', "(SELECT * FROM tr WHERE split='train')", name='trk')},
{rk('event_type', "(SELECT * FROM tr WHERE split='dev')", name='dvk')}, {rk('1', "(SELECT * FROM std WHERE lower(country)='cameroon')", name='cmk')},
bundle AS (SELECT event_id, event_type, country, split FROM trk WHERE rn<=(SELECT min(cnt) FROM trk) UNION ALL SELECT event_id, event_type, country, split FROM dvk WHERE rn<=5
 UNION ALL SELECT event_id, event_type, country, 'test_cmr' FROM cmk WHERE rn<=60 UNION ALL SELECT event_id, event_type, country, 'test_nga' FROM rnk WHERE rn<=60)"""
_BUNDLE = _BUNDLE.replace("bundle AS", rk('1', "(SELECT * FROM std WHERE lower(country)='nigeria')", name='rnk') + ",\nbundle AS")


def _bundle(spark, d):
    return S.split_bundle(std(spark, d).select("event_id", "event_type", "country"), ["cmr", "nga"], balance_train=True, dev_max_per_class=5, test_max_per_country=60)


@q("split_bundle", _BUNDLE + " SELECT * FROM bundle")
def _(spark, d):
    return _bundle(spark, d)


# The same with the other options: held-out events stay in the pool, and every split is balanced before its cap.
_ROUNDS = f""", {STD}, {rk('event_type', 'std')}, sp AS (SELECT event_id, event_type, country, CASE WHEN rn<={_NDEV} THEN 'dev' ELSE 'train' END AS split FROM rk),
un AS (SELECT * FROM sp UNION ALL SELECT event_id, event_type, country, CASE lower(country) WHEN 'cameroon' THEN 'test_cmr' ELSE 'test_nga' END FROM std WHERE lower(country) IN ('cameroon','nigeria')),
un2 AS (SELECT *, row_number() OVER (PARTITION BY split, event_type ORDER BY {H42}) AS k, count(*) OVER (PARTITION BY split, event_type) AS size FROM un),
un3 AS (SELECT *, min(size) OVER (PARTITION BY split) AS smallest FROM un2),
un4 AS (SELECT * FROM un3 WHERE split='train' AND k<=least(size, 7) OR split='dev' AND k<=smallest OR split LIKE 'test%' AND k<=smallest),
un5 AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY {H42}) AS pos FROM un4)"""


@q("split_bundle_balanced", _ROUNDS + " SELECT event_id, event_type, country, split FROM un5 WHERE split NOT LIKE 'test%' OR pos<=40")
def _(spark, d):
    return S.split_bundle(std(spark, d).select("event_id", "event_type", "country"), ["cmr", "nga"], include_eval_in_train=True, balance_dev=True, balance_test=True,
                          train_max_per_class=7, test_max_per_country=40)


@q("split_manifest", _BUNDLE + """, c AS (SELECT split, event_type, count(*) n FROM bundle GROUP BY 1,2)
SELECT split, CAST(sum(n) AS BIGINT) AS n_rows, string_agg(concat(event_type,'=',n), ',' ORDER BY event_type) AS classes FROM c GROUP BY 1""")
def _(spark, d):
    m = S.manifest(_bundle(spark, d))
    return m.select("split", "n_rows", F.array_join(F.transform(F.map_entries("classes"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",").alias("classes"))


@q("class_distribution", "SELECT country AS split, event_type, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY 1,2")
def _(spark, d):
    return S.class_distribution(events(spark, d).withColumn("split", F.col("country")))


@q("event_actor_crosstab", """SELECT "EVENT_TYPE", CAST(count(*) FILTER (WHERE "INTER1"=1) AS BIGINT) AS state, CAST(count(*) FILTER (WHERE "INTER1"<>1) AS BIGINT) AS non_state
 FROM raw GROUP BY 1 HAVING count(*) FILTER (WHERE "INTER1"=1)>=5 AND count(*) FILTER (WHERE "INTER1"<>1)>=5""")
def _(spark, d):
    return S.event_actor_crosstab(raw_events(spark, d), "EVENT_TYPE", "INTER1", 5)


# Splits that overlap on purpose: every event in one by class, some also by country.
@q("leakage", """, s AS (SELECT event_id, event_type AS split FROM e UNION ALL SELECT event_id, country FROM e WHERE event_id%3=0)
SELECT least(a.split,b.split) AS split_a, greatest(a.split,b.split) AS split_b, CAST(count(DISTINCT a.event_id) AS BIGINT) AS n_shared FROM s a JOIN s b ON a.event_id=b.event_id AND a.split<b.split GROUP BY 1,2""")
def _(spark, d):
    e = events(spark, d)
    s = e.select("event_id", F.col("event_type").alias("split")).unionByName(e.where("event_id%3=0").select("event_id", F.col("country").alias("split")))
    return S.leakage(s)


@q("remaining_pool", "SELECT event_id, event_type FROM e WHERE event_id NOT IN (SELECT event_id FROM e WHERE country='en' AND ti<3)")
def _(spark, d):
    e = events(spark, d).select("event_id", "event_type", "country", "ti")
    return S.without_ids(e, e.where("country = 'en' and ti < 3")).select("event_id", "event_type")


def lr(name, src, part="1", n="n", grp="grp", out="alloc"):
    """Largest remainder in SQL over (grp, n, slots)."""
    return f"""{name} AS (SELECT * EXCLUDE (tot, ideal, fl, rn, lft), CAST(fl + CASE WHEN rn<=lft AND tot>0 AND slots>0 THEN 1 ELSE 0 END AS BIGINT) AS {out} FROM (
 SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY ideal-fl DESC, {n} DESC, {grp}) AS rn, slots-sum(fl) OVER (PARTITION BY {part}) AS lft FROM (
 SELECT *, CAST(floor(ideal) AS BIGINT) AS fl FROM (SELECT *, CASE WHEN tot>0 AND slots>0 THEN CAST({n} AS DOUBLE)/CAST(tot AS DOUBLE)*CAST(slots AS DOUBLE) ELSE 0 END AS ideal FROM (
 SELECT *, sum({n}) OVER (PARTITION BY {part}) AS tot FROM {src})))))"""


_COUNTS = "c0 AS (SELECT source AS grp, count(*) AS n, 137 AS slots FROM (SELECT concat('s', sn, country) AS source FROM e) GROUP BY 1)"


@q("largest_remainder", f", {_COUNTS}, {lr('a', 'c0')} SELECT grp, CAST(n AS BIGINT) AS n, alloc FROM a")
def _(spark, d):
    c = S.class_counts(events(spark, d).select(F.expr("concat('s', cast(sn as string), country)").alias("grp")), "grp")
    return S.largest_remainder(c, F.lit(137), "grp")


_STRAT = f"""c AS (SELECT event_type AS grp, count(*) AS n FROM e GROUP BY 1), w AS (SELECT least(200, sum(n)) AS want FROM c),
pr AS (SELECT coalesce(max(CASE WHEN grp='Battles' THEN least(floor((SELECT want FROM w)*0.3::DOUBLE), n) END),0) AS prim FROM c),
o0 AS (SELECT grp, n, (SELECT want FROM w)-(SELECT prim FROM pr) AS slots FROM c WHERE grp<>'Battles'), {lr('o1', 'o0')},
o2 AS (SELECT grp, n, alloc, greatest(0,n-alloc) AS spare, sum(greatest(0,alloc-n)) OVER () AS slots FROM o1), {lr('o3', 'o2', n='spare', out='extra')},
quota AS (SELECT grp, CAST(n AS BIGINT) AS n, CAST(least(alloc,n)+least(extra,spare) AS BIGINT) AS quota FROM o3 UNION ALL SELECT 'Battles', n, CAST((SELECT prim FROM pr) AS BIGINT) FROM c WHERE grp='Battles')"""


@q("stratified_quota", f", {_STRAT} SELECT grp AS event_type, n, quota FROM quota")
def _(spark, d):
    return S.stratified_quota(events(spark, d), "event_type", 200, "Battles", 0.3)


@q("stratified_sample", f", {_STRAT}, {rk('event_type')} SELECT event_id, event_type FROM rk JOIN quota ON grp=event_type WHERE rn<=quota")
def _(spark, d):
    return S.stratified_sample(events(spark, d).select("event_id", "event_type"), "event_type", 200, "Battles", 0.3)


# Drawing again is random, its numbers are not: rows per class, and how many of them are distinct at most.
@q("stratified_sample_replace", f""", n0 AS (SELECT event_type AS grp, count(*) AS n FROM e GROUP BY 1), want AS (SELECT least(200, sum(n)) AS w FROM n0),
pr AS (SELECT least(floor(w*0.3::DOUBLE), n) AS prim FROM n0, want WHERE grp='Battles'), o0 AS (SELECT grp, n, w-prim AS slots, 1 AS part FROM n0, want, pr WHERE grp<>'Battles'), {lr('o1', 'o0', 'part')},
q AS (SELECT grp, n, CAST(alloc AS BIGINT) AS quota FROM o1 UNION ALL SELECT grp, n, CAST(prim AS BIGINT) FROM n0, pr WHERE grp='Battles')
SELECT grp AS event_type, quota AS n, true AS distinct_fits FROM q WHERE quota>0""")
def _(spark, d):
    s = S.stratified_sample(events(spark, d).select("event_id", "event_type"), "event_type", 200, "Battles", 0.3, replace=True)
    counts = s.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"))
    again = F.col("event_type") == "Battles"
    return counts.select("event_type", "n", F.when(again, F.col("ids") <= F.col("n")).otherwise(F.col("ids") == F.col("n")).alias("distinct_fits"))


@q("renamed_legacy_columns", "SELECT event_id, n_chars AS new_chars, ti AS new_ti FROM e")
def _(spark, d):
    old = events(spark, d).select("event_id", F.col("n_chars").alias("old_chars"), F.col("ti").alias("old_ti"))
    return L.rename_legacy_columns(old, "old_", "new_")


_CELLS = f"""x AS (SELECT *, CASE WHEN 1+sn%8=1 THEN 'state' ELSE 'non-state' END AS actor_type FROM e),
t AS (SELECT event_type, count(*) FILTER (WHERE actor_type='state') AS st, count(*) FILTER (WHERE actor_type<>'state') AS ns FROM x GROUP BY 1),
cell AS (SELECT event_type AS grp, 'state' AS actor_type, st AS n, 80 AS half FROM t WHERE st>=3 AND ns>=3 UNION ALL SELECT event_type, 'non-state', ns, 120 FROM t WHERE st>=3 AND ns>=3),
pr AS (SELECT actor_type, coalesce(max(CASE WHEN grp='Violence against civilians' THEN least(floor(half*0.25::DOUBLE), n) END),0) AS prim FROM cell GROUP BY 1),
o0 AS (SELECT cell.*, half-prim AS slots FROM cell JOIN pr USING (actor_type) WHERE grp<>'Violence against civilians'), {lr('o1', 'o0', 'actor_type')},
quota AS (SELECT grp, actor_type, CAST(n AS BIGINT) AS n, CAST(least(alloc,n) AS BIGINT) AS quota FROM o1
 UNION ALL SELECT grp, cell.actor_type, n, CAST(prim AS BIGINT) FROM cell JOIN pr USING (actor_type) WHERE grp='Violence against civilians')"""


def _coded(spark, d):
    return events(spark, d).withColumn("inter1", F.expr("cast(1+sn%8 as int)")).select("event_id", "event_type", "inter1")


_CELL_ARGS = {"balance_ratio": 0.4, "min_per_cell": 3, "primary": "Violence against civilians", "primary_share": 0.25}


@q("balanced_actor_quota", f", {_CELLS} SELECT grp AS event_type, actor_type, n, quota FROM quota")
def _(spark, d):
    return S.balanced_actor_quota(_coded(spark, d), "event_type", "inter1", 200, **_CELL_ARGS)


@q("balanced_actor_sample", f", {_CELLS}, {rk('event_type, actor_type', 'x')} SELECT event_id, event_type, rk.actor_type, true_label AS gold_label FROM rk JOIN quota ON grp=event_type AND quota.actor_type=rk.actor_type WHERE rn<=quota")
def _(spark, d):
    return S.balanced_actor_sample(_coded(spark, d), "event_type", "inter1", 200, **_CELL_ARGS).select("event_id", "event_type", "actor_type", "gold_label")


_SCORE = "CASE WHEN n_chars BETWEEN 80 AND 600 THEN 2 WHEN n_chars BETWEEN 40 AND 79 OR n_chars BETWEEN 601 AND 1200 THEN 1 ELSE 0 END + CASE WHEN sn%4>0 THEN 1 ELSE 0 END"


@q("few_shot_picks", f""", z AS (SELECT event_id, event_type, CAST({_SCORE} AS INT) AS quality_score, n_chars AS notes_len FROM e),
{rk('event_type', 'z', 'quality_score DESC, notes_len DESC, ' + H42)} SELECT event_id, event_type, quality_score, CAST(notes_len AS BIGINT) AS notes_len, CASE WHEN rn<=5 THEN 'train' ELSE 'val' END AS split FROM rk WHERE rn<=8""")
def _(spark, d):
    e = events(spark, d).select("event_id", "event_type", "notes", F.col("n_chars").alias("notes_len"), F.expr("CASE WHEN sn%4>0 THEN actor_norm ELSE ' ' END").alias("actor_norm"))
    return S.few_shot_picks(e, 5, 3).select("event_id", "event_type", "quality_score", "notes_len", "split")


@q("first_rows", "SELECT event_id, event_type FROM e ORDER BY event_id LIMIT 10")
def _(spark, d):
    return S.head(events(spark, d).select("event_id", "event_type").orderBy("event_id"), 10)


# Set operations -----------------------------------------------------------------------------

@q("union_aligned", """SELECT model, event_id, pred_conf, CAST(NULL AS STRING) AS country FROM preds WHERE mi=0 UNION ALL SELECT model, event_id, NULL, country FROM preds WHERE mi=1""")
def _(spark, d):
    p = predictions(spark, d)
    return C.union_aligned(p.where("mi=0").select("model", "event_id", "pred_conf"), p.where("mi=1").select("country", "event_id", "model"))


@q("union_training_tables", """SELECT event_id, event_type, notes FROM e WHERE country='en' UNION ALL SELECT event_id, event_type, notes FROM e WHERE country<>'en'""")
def _(spark, d):
    e = events(spark, d).select("event_id", "event_type", "notes", "country")
    old = e.where("country = 'en'").drop("country").withColumnsRenamed({"event_id": "event_id_cnty", "event_type": "event_type_full"})
    return C.union_training_tables(old, e.where("country <> 'en'").drop("country"))


@q("distinct_pairs", "SELECT DISTINCT event_id, actor_norm FROM preds")
def _(spark, d):
    return predictions(spark, d).select("event_id", "actor_norm").distinct()


@q("shared_ids", "SELECT event_id FROM preds WHERE model='model_a' AND pred_label='V' INTERSECT SELECT event_id FROM preds WHERE model='model_b' AND pred_label='V'")
def _(spark, d):
    p = predictions(spark, d).where("pred_label = 'V'")
    return p.where("model = 'model_a'").select("event_id").intersect(p.where("model = 'model_b'").select("event_id"))


@q("other_models", "SELECT model, event_id FROM preds EXCEPT SELECT model, event_id FROM preds WHERE model IN ('model_b','model_d')")
def _(spark, d):
    p = predictions(spark, d).select("model", "event_id")
    return p.join(p.where("model in ('model_b','model_d')").select("model").distinct(), "model", "left_anti")


# Prompts and training records --------------------------------------------------------------

def lit(s):
    return "'" + s.replace("'", "''") + "'"


def prompt_sql(name, n, note, wrapped=True):
    s = P.strategy(name, n)
    before, after = s.template.split("<<NOTE>>")
    user = f"concat({lit(before)}, {note}, {lit(after)})"
    if not wrapped:
        return user
    head = lit(f"### System\n{s.system}\n\n### User\n") if s.system else lit("### User\n")
    return f"concat({head}, {user}, {lit(chr(10) * 2 + '### Assistant' + chr(10))})"


@q("prompts", f"SELECT event_id, md5({prompt_sql('zero_shot', 1, 'body', False)}) AS zero_shot, md5({prompt_sql('few_shot', 3, 'body')}) AS few_shot, md5({prompt_sql('explainable', 1, 'body')}) AS explainable FROM rich")
def _(spark, d):
    def h(c):
        return F.md5(c.cast("binary"))
    few, exp = P.strategy("few_shot", 3), P.strategy("explainable")
    body = F.col("body")
    return spread(rich_events(spark, d)).select(
        "event_id", h(P.strategy("zero_shot").prompt(body)).alias("zero_shot"),
        h(P.generation_prompt(few.prompt(body), few.system)).alias("few_shot"),
        h(P.generation_prompt(exp.prompt(body), exp.system)).alias("explainable"))


_HOT = "concat(" + ", ', ', ".join(f"'\"{x}\": ', CASE WHEN true_label='{x}' THEN '1.0' ELSE '0.0' END" for x in "VBEPRS") + ")"
_MEAN = "CASE true_label WHEN 'V' THEN 'direct harm to civilians' WHEN 'B' THEN 'armed clash between organized actors' WHEN 'E' THEN 'explosive or remote attack' WHEN 'P' THEN 'organized demonstration' WHEN 'R' THEN 'violent crowd action' ELSE 'strategic operation without direct battle' END"


@q("training_records", f""", t AS (SELECT event_id, true_label, trim(body) AS note FROM rich WHERE event_id%11<>0)
SELECT event_id, md5({prompt_sql('explainable', 1, 'note')}) AS prompt_md5, concat('{{"label": "', true_label, '", "confidence": 1.0, "logits": {{', {_HOT}, '}}, "reasoning": [',
 CAST(to_json(concat('Actors: inferred from event text snippet ''', replace(substring(note,1,120),chr(10),' '), '''.')) AS STRING), ', "Actions: identify core conflict behavior and event dynamics.", ',
 CAST(to_json(concat('Rationale: label ', true_label, ' best matches ', {_MEAN}, '.')) AS STRING), ']}}') AS response FROM t""")
def _(spark, d):
    e = rich_events(spark, d).select("event_id", F.col("body").alias("notes"), F.expr("CASE WHEN event_id%11=0 THEN 'Other' WHEN event_id%2=0 THEN true_label ELSE event_type END").alias("event_type"))
    r = P.training_records(spread(e), "explainable", keep=("event_id",))
    return r.select("event_id", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"), "response")


def _stub():
    """A predictor that answers by the length of the prompt and fails on some."""
    def predict(prompts):
        out = []
        for p in prompts:
            n = len(p)
            if n % 17 == 0:
                raise ValueError("no answer")
            out.append('{"label": "%s", "confidence": 0.%d}' % ("VBEPRS"[n % 6], n % 10))
        return out
    return predict


_STUB_LEN = len(P.strategy("zero_shot").template) - len("<<NOTE>>") + len("### User\n\n\n### Assistant\n")


_SCORED = f""", x AS (SELECT event_id, length(body)+{_STUB_LEN} AS n FROM rich)
SELECT event_id, 'stub' AS model, CASE WHEN n%17=0 THEN 'ERROR' ELSE substring('VBEPRS', CAST(n%6 AS INT)+1, 1) END AS pred_label, CASE WHEN n%17=0 THEN CAST(0 AS DOUBLE) ELSE CAST(n%10 AS DOUBLE)/10 END AS pred_conf FROM x"""


@q("score_events", _SCORED)
def _(spark, d):
    e = spread(rich_events(spark, d).select("event_id", F.col("body").alias("notes")))
    return rounded(score_events(e, "stub", _stub).select("event_id", "model", "pred_label", "pred_conf"))


@q("score_events_ledger", _SCORED)
def _(spark, d):
    """Through a ledger that half of the events have filled before."""
    ledger = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    e = rich_events(spark, d).select("event_id", F.col("body").alias("notes"))
    score_events(e.where("event_id % 2 = 0"), "stub", _stub, ledger=ledger)
    return rounded(score_events(e, "stub", _stub, ledger=ledger).select("event_id", "model", "pred_label", "pred_conf"))
