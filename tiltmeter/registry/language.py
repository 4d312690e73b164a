"""Registered queries on texts: annotations, ambiguity, disagreements, error cases, responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ambiguity as AM, annotate as AN, fluency as FL, responses as RS, text_patterns as P
from ..operators import classification as K, disagreement as D
from .evaluate import _LG, _VEC, _temp_sql, temp
from .inputs import CTE, MODELS, RAW_RESPONSE, VALID, calibrated, predictions, r6, rich_events, rounded, spread

Q: dict = {}
O: dict = {}


def q(name, oracle=None):
    def add(fn):
        Q[name] = fn
        if oracle is not None:
            O[name] = CTE + oracle
        return fn
    return add


def asc(text):
    """The text with letters outside ASCII as an underscore, which is a word character for both engines."""
    return f"regexp_replace({text}, '[^\\x00-\\x7F]', '_', 'g')"


def esc(p):
    return p.replace("'", "''")


def any_sql(text, patterns, flags="(?i)"):
    return f"regexp_matches({text}, '{flags}(?:{esc('|'.join(patterns))})')"


def count_sql(text, patterns, flags="(?i)"):
    return "(" + " + ".join(f"CAST(regexp_matches({text}, '{flags}{esc(p)}') AS INT)" for p in patterns) + ")"


_T = f"t AS (SELECT event_id, {asc('body')} AS x, lower({asc('body')}) AS lx, source, source_scale, fatalities, actor_norm FROM rich)"


def text(spark, d):
    return spread(rich_events(spark, d))


_PROV = f"""p AS (SELECT event_id, lower(coalesce(source_scale,'')) AS sc, concat(coalesce(source,''), CASE WHEN coalesce(source,'')<>'' THEN ' ' ELSE '' END, x) AS y FROM t),
f AS (SELECT *, {any_sql('y', P.STATE_MEDIA)} st, {any_sql('y', P.INTERNATIONAL_MEDIA)} intl, {any_sql('y', P.NIGERIA_MEDIA)} nga, {any_sql('y', P.CAMEROON_MEDIA)} cmr,
 {any_sql('y', P.NORTH_AFRICA_MEDIA)} na, {any_sql('y', P.LOCAL_MEDIA)} loc, {any_sql('y', P.SOCIAL_MEDIA)} soc, {any_sql('y', P.SECURITY_FIRMS)} sec FROM p),
prov AS (SELECT event_id, CASE WHEN st AND NOT (intl OR nga OR cmr) THEN 'State-affiliated' WHEN sec THEN 'Security-Analysis' WHEN intl THEN 'Independent-International'
 WHEN nga OR cmr OR na THEN 'Independent-National' WHEN soc THEN 'Social-Media' WHEN loc THEN 'Local/Community' WHEN contains(sc,'international') THEN 'Independent-International'
 WHEN contains(sc,'national') THEN 'Independent-National' WHEN contains(sc,'regional') THEN 'Regional' WHEN contains(sc,'local') THEN 'Local/Community'
 WHEN contains(sc,'new media') THEN 'Social-Media' ELSE 'Unknown' END AS provenance FROM f)"""


@q("provenance", f", {_T}, {_PROV} SELECT * FROM prov")
def _(spark, d):
    return text(spark, d).select("event_id", AN.provenance(F.col("source"), F.col("source_scale"), F.col("body")).alias("provenance"))


_VERB = f"""CASE WHEN {any_sql('lx', P.HIGH_VERBS, '')} THEN 'High' WHEN {any_sql('lx', P.MEDIUM_VERBS, '')} THEN 'Medium' WHEN {any_sql('lx', P.LOW_VERBS, '')} THEN 'Low' ELSE 'Unknown' END"""


@q("verb_intensity", f", {_T} SELECT event_id, {_VERB} AS verb_intensity FROM t")
def _(spark, d):
    return text(spark, d).select("event_id", AN.verb_intensity(F.col("body")).alias("verb_intensity"))


_HIT = "coalesce(" + ", ".join(f"nullif(regexp_extract(lx, '{esc(p)}', 0), '')" for p in P.CASUALTIES) + ")"
_CAS = f"""CASE WHEN coalesce(fatalities,0)>0 THEN concat('Yes (', CAST(fatalities AS STRING), ')') WHEN {_HIT} IS NULL THEN 'No'
 WHEN regexp_extract({_HIT},'\\d+',0)<>'' THEN concat('Yes (', regexp_extract({_HIT},'\\d+',0), ')') ELSE 'Yes (unspecified)' END"""


@q("casualties", f", {_T} SELECT event_id, {_CAS} AS casualties FROM t")
def _(spark, d):
    return text(spark, d).select("event_id", AN.casualties(F.col("fatalities"), F.col("body")).alias("casualties"))


_VOICE = f"""v AS (SELECT event_id, {count_sql('x', P.PASSIVE)} + {count_sql('x', P.AGENT_OBSCURING)}*1.5 + {count_sql('x', P.PASSIVE_HEDGES)} + {count_sql('x', P.NOMINALIZATIONS)} AS pas,
 {count_sql('x', P.ACTIVE)}*1.5 AS act FROM t), voice AS (SELECT event_id, CASE WHEN pas>0 AND act>0 THEN CASE WHEN pas>act*1.5 THEN 'Yes' WHEN act>pas*1.5 THEN 'No' ELSE 'Mixed' END
 WHEN pas>=1 THEN 'Yes' WHEN act>=1 THEN 'No' ELSE 'Unknown' END AS passive_voice FROM v)"""


@q("passive_voice", f", {_T}, {_VOICE} SELECT * FROM voice")
def _(spark, d):
    return text(spark, d).select("event_id", AN.passive_voice(F.col("body")).alias("passive_voice"))


_AMB = f"""CASE WHEN {count_sql('lx', P.AMBIGUOUS_ACTOR, '')}>=2 OR regexp_matches(lower(actor_norm),'unknown|unidentified|suspected|generic') THEN 'Yes'
 WHEN {count_sql('lx', P.AMBIGUOUS_ACTOR, '')}=1 THEN 'Partial' ELSE 'No' END"""


@q("ambiguous_actor", f", {_T} SELECT event_id, {_AMB} AS ambiguous_actor FROM t")
def _(spark, d):
    return text(spark, d).select("event_id", AN.ambiguous_actor(F.col("body"), F.col("actor_norm")).alias("ambiguous_actor"))


# Some events come with a voice already annotated; those stay.
@q("annotated_events", f""", {_T}, {_PROV}, {_VOICE}
SELECT event_id, provenance AS annotation_provenance, {_AMB} AS annotation_ambiguous_actor, {_VERB} AS annotation_verb_intensity, {_CAS} AS annotation_casualty_counts,
 CASE WHEN event_id%4=0 THEN 'kept' ELSE passive_voice END AS annotation_passive_voice, '[auto-generated]' AS annotation_notes FROM t JOIN prov USING (event_id) JOIN voice USING (event_id)""")
def _(spark, d):
    r = text(spark, d)
    e = r.select("event_id", F.col("body").alias("notes"), "actor_norm", F.expr("CASE event_id%4 WHEN 0 THEN 'kept' WHEN 1 THEN '' END").alias("annotation_passive_voice"))
    return AN.annotate(e, rich_events(spark, d).select("event_id", "source", "source_scale", "fatalities")).select("event_id", *AN.ANNOTATIONS)


_TEXT_AMB = f"""(least(1.0::DOUBLE, {count_sql('lx', P.BOUNDARY_CUES)}/3.0::DOUBLE)*0.5 + least(1.0::DOUBLE, {count_sql('lx', P.SCORE_HEDGES)}/2.0::DOUBLE)*0.25
 + CASE WHEN regexp_matches(lower(actor_norm),'unknown|unidentified|suspected|generic|armed group') THEN 0.25 ELSE 0 END)"""


@q("text_ambiguity", f", {_T} SELECT event_id, {r6(f'least(1.0::DOUBLE, {_TEXT_AMB})')} AS text_ambiguity FROM t")
def _(spark, d):
    return rounded(text(spark, d).select("event_id", AM.text_ambiguity(F.col("body"), F.col("actor_norm")).alias("text_ambiguity")))


_GRAM = """(1.0::DOUBLE - CASE WHEN length(trim(x))<10 THEN 0.3 ELSE 0 END - CASE WHEN x<>'' AND NOT regexp_matches(x,'^\\p{Lu}') THEN 0.1 ELSE 0 END
 - CASE WHEN x<>'' AND right(x,1) NOT IN ('.','!','?') THEN 0.1 ELSE 0 END - CASE WHEN contains(x,'  ') THEN 0.2 ELSE 0 END
 - CASE WHEN length(replace(x,'(',''))<>length(replace(x,')','')) THEN 0.2 ELSE 0 END)"""
_ROUGH = "CASE event_id%5 WHEN 0 THEN concat(text, '  (open') WHEN 1 THEN lower(text) WHEN 2 THEN substring(notes, 1, 8) WHEN 3 THEN '' ELSE text END"


@q("grammaticality", f", g AS (SELECT event_id, {_ROUGH} AS x FROM rich) SELECT event_id, {r6(f'greatest(0::DOUBLE, {_GRAM})')} AS fluency FROM g")
def _(spark, d):
    return rounded(text(spark, d).select("event_id", FL.grammaticality(F.expr(_ROUGH)).alias("fluency")))


# Disagreements ---------------------------------------------------------------------------

# model_d is missing for some events, and some notes or actors are null.
_GAPS = "(mi=3 AND event_id%10=0)"
_HOLES = f"""gap AS (SELECT * REPLACE (CASE WHEN event_id%14=0 THEN NULL ELSE notes END AS notes), {_temp_sql()} AS pred_conf_temp FROM preds WHERE NOT {_GAPS})"""
_VOTES = f"""{_HOLES}, votes AS (SELECT event_id, any_value(true_label) AS true_label, any_value(actor_norm) AS actor_norm, any_value(notes) AS notes,
 CAST(count(DISTINCT pred_label) AS INT) AS disagreement_count, max(pred_conf_temp) AS mc FROM gap GROUP BY 1 HAVING count(*)=4 AND any_value(notes) IS NOT NULL)"""


def gaps(spark, d):
    return temp(predictions(spark, d).where(f"not {_GAPS}")).withColumn("notes", F.expr("CASE WHEN event_id%14=0 THEN NULL ELSE notes END"))


@q("event_votes", f", {_VOTES} SELECT event_id, true_label, actor_norm, notes, disagreement_count, {r6('mc')} AS max_confidence FROM votes")
def _(spark, d):
    return rounded(D.event_votes(gaps(spark, d)))


@q("wide_predictions", f""", {_HOLES} SELECT event_id, {', '.join(f"max(pred_label) FILTER (model='{m}') AS pred_label_{m}, {r6(f'''max(pred_conf_temp) FILTER (model='{m}')''')} AS pred_prob_{m}" for m in MODELS)} FROM gap GROUP BY 1""")
def _(spark, d):
    return rounded(D.widen(gaps(spark, d), models=MODELS))


_BEHAVE = f"""lc AS (SELECT event_id, pred_label, count(*) n FROM src GROUP BY 1,2), tot AS (SELECT event_id, sum(n) t FROM lc GROUP BY 1),
en AS (SELECT event_id, -sum((n/t)*log2(n/t))/log2(6) AS ent FROM lc JOIN tot USING (event_id) GROUP BY 1),
co AS (SELECT event_id, 1-avg(pred_conf_temp) AS unc, least(1.0::DOUBLE, stddev_pop(pred_conf_temp)/0.5::DOUBLE) AS dis, any_value(lower(notes)) lx, any_value(actor_norm) actor_norm FROM src GROUP BY 1),
eas AS (SELECT event_id, ent, unc, dis, least(1.0::DOUBLE, {_TEXT_AMB}) AS txt FROM en JOIN co USING (event_id)),
score AS (SELECT *, 0.35::DOUBLE*ent+0.25::DOUBLE*unc+0.20::DOUBLE*dis+0.20::DOUBLE*txt AS s FROM eas)"""
_SCORE_COLS = f"""round(s,4) AS ambiguity_score, CASE WHEN s>=0.6 THEN 'High' WHEN s>=0.3 THEN 'Medium' ELSE 'Low' END AS ambiguity_tier, round(ent,4)+0::DOUBLE AS eas_label_entropy,
 round(unc,4) AS eas_conf_uncertainty, round(dis,4) AS eas_conf_dispersion, round(txt,4) AS eas_text_ambiguity"""


@q("event_ambiguity", f", src AS (SELECT *, {_temp_sql()} AS pred_conf_temp FROM preds), {_BEHAVE} SELECT event_id, {_SCORE_COLS} FROM score")
def _(spark, d):
    return rounded(D.event_ambiguity(temp(predictions(spark, d))))


@q("behavioural_ambiguity", f", src AS (SELECT *, {_temp_sql()} AS pred_conf_temp FROM preds), {_BEHAVE} SELECT event_id, {r6('ent')} AS label_entropy, {r6('unc')} AS conf_uncertainty, {r6('dis')} AS conf_dispersion FROM eas")
def _(spark, d):
    return rounded(D.behavioural_ambiguity(temp(predictions(spark, d))))


@q("top_disagreements", f""", {_VOTES}, topn AS (SELECT * FROM votes WHERE disagreement_count>1 ORDER BY mc DESC, event_id LIMIT 20), src AS (SELECT gap.* FROM gap SEMI JOIN topn USING (event_id)), {_BEHAVE}
SELECT event_id, true_label, topn.actor_norm, notes, disagreement_count, {r6('mc')} AS max_confidence, {_SCORE_COLS} FROM topn JOIN score USING (event_id)""")
def _(spark, d):
    return rounded(D.top_disagreements(gaps(spark, d), 20))


@q("top_percent", f""", {_VOTES}, r AS (SELECT *, row_number() OVER (ORDER BY round(mc,6) DESC, md5(concat('0|', CAST(event_id AS STRING))), event_id) AS rn, count(*) OVER () AS n FROM votes WHERE disagreement_count>1)
SELECT event_id, {r6('mc')} AS max_confidence FROM r WHERE rn<=greatest(1, ceil(n*(12.5/100)::DOUBLE))""")
def _(spark, d):
    e = D.disagreements(gaps(spark, d)).withColumn("max_confidence", F.round("max_confidence", 6))
    return rounded(D.top_percent(e, 12.5).select("event_id", "max_confidence"))


_ERR = "CASE WHEN true_label='V' AND pred_label IN ('B','S') THEN 'false_legitimization' WHEN true_label IN ('B','S') AND pred_label='V' THEN 'false_illegitimization' END"
_ERRORS = f"""er AS (SELECT *, md5(concat('42|', CAST(event_id AS STRING))) AS h FROM (SELECT *, {_ERR} AS error_kind FROM preds) WHERE error_kind IS NOT NULL),
lim AS (SELECT error_kind, CASE WHEN count(*)>20 THEN 20//(SELECT count(DISTINCT model) FROM preds)+1 ELSE 20 END AS cap FROM er GROUP BY 1),
r1 AS (SELECT er.*, row_number() OVER (PARTITION BY er.error_kind, model ORDER BY h, event_id) AS rn FROM er),
r2 AS (SELECT r1.*, row_number() OVER (PARTITION BY r1.error_kind ORDER BY model, h, event_id) AS rn2 FROM r1 JOIN lim ON lim.error_kind=r1.error_kind WHERE rn<=cap),
cases AS (SELECT * FROM r2 WHERE rn2<=20)"""


@q("error_cases", f", {_ERRORS} SELECT error_kind, model, event_id, true_label, pred_label FROM cases")
def _(spark, d):
    return D.error_cases(predictions(spark, d), 20).select("error_kind", "model", "event_id", "true_label", "pred_label")


@q("annotated_error_cases", f""", {_ERRORS}, {_T}, {_PROV}, {_VOICE}, an AS (SELECT event_id, provenance, {_AMB} AS amb, {_VERB} AS verb, {_CAS} AS cas, passive_voice FROM t JOIN prov USING (event_id) JOIN voice USING (event_id))
SELECT error_kind, model, event_id, provenance AS annotation_provenance, amb AS annotation_ambiguous_actor, verb AS annotation_verb_intensity, cas AS annotation_casualty_counts, passive_voice AS annotation_passive_voice FROM cases JOIN an USING (event_id)""")
def _(spark, d):
    raw = rich_events(spark, d).select("event_id", F.col("body").alias("notes"), "source", "source_scale", "fatalities")
    return D.annotated_error_cases(predictions(spark, d), raw, 20).select("error_kind", "model", "event_id", *AN.ANNOTATIONS[:5])


# Model answers ----------------------------------------------------------------------------------

_ANSWER = f"a AS (SELECT model, event_id, {RAW_RESPONSE} AS x FROM preds)"
_PARSE = """b AS (SELECT *, trim(x) AS y, regexp_extract(x, '\\{[^{}]*"label"\\s*:\\s*"[VBEPRS]"[^{}]*\\}', 0) AS part, regexp_extract(x, '"label"\\s*:\\s*"([VBEPRS])"', 1) AS lab,
 regexp_extract(x, '"confidence"\\s*:\\s*([0-9.]+)', 1) AS num, regexp_extract(x, '(?s)\\{.*\\}', 0) AS lo FROM a),
c AS (SELECT *, CASE WHEN y<>'' AND json_valid(y) THEN y WHEN part<>'' AND json_valid(part) THEN part WHEN lab<>'' THEN concat('{"label":"',lab,'","confidence":',CASE WHEN num='' THEN '0.5' ELSE num END,'}')
 WHEN lo<>'' AND json_valid(lo) THEN lo ELSE '{}' END AS js FROM b)"""


def answers(spark, d):
    return predictions(spark, d).select("model", "event_id", F.expr(RAW_RESPONSE).alias("raw"))


@q("parsed_responses", f""", {_ANSWER}, {_PARSE} SELECT model, event_id, json_extract_string(js,'$.label') AS label, {r6("json_extract_string(js,'$.confidence')")} AS confidence, js<>'{{}}' AS found FROM c""")
def _(spark, d):
    return rounded(answers(spark, d).withColumn("r", RS.parse_response(F.col("raw"))).select("model", "event_id", "r.label", "r.confidence", "r.found"))


# Answers of three shapes around one object with scores and reasons: bare, in prose, and in a code fence; some without an object.
_RICH = """CASE (event_id+mi)%5 WHEN 0 THEN obj WHEN 1 THEN concat('Sure: ', obj, ' ok') WHEN 2 THEN concat('```json', chr(10), obj, chr(10), '```')
    WHEN 3 THEN concat('I would say "label": "', pred_label, '", "confidence": 0.75 or so') ELSE 'no idea {' END"""
_RICH_OBJECT = """concat('{"label":"', lower(pred_label), '","confidence":', CAST((event_id+mi)%10 AS STRING), '.5', CASE event_id%4 WHEN 0 THEN ',"scores":[1,2.5]'
    WHEN 1 THEN concat(',"logits":{"V":', CAST(event_id%7 AS STRING), ',"B":0.25}') WHEN 2 THEN ',"log_probs":null,"scores":[3]' ELSE '' END,
    CASE event_id%3 WHEN 0 THEN concat(',"reasoning":["actors","', CAST(event_id AS STRING), ' rows"]') WHEN 1 THEN ',"reasoning":"one reason"' ELSE '' END, '}')"""
_RICH_CTE = f"ro AS (SELECT *, {_RICH_OBJECT} AS obj FROM preds), ra AS (SELECT *, {_RICH} AS x FROM ro)"
_RICH_SCORES = """CASE event_id%4 WHEN 0 THEN '[1,2.5]' WHEN 1 THEN concat('{"B":0.25,"V":', CAST(event_id%7 AS STRING), '}') END"""
_RICH_REASONS = """CASE event_id%3 WHEN 0 THEN concat('["actors","', CAST(event_id AS STRING), ' rows"]') WHEN 1 THEN '"one reason"' END"""


_TAKEN = "((event_id+mi)%5=0 OR (event_id+mi)%5 IN (1,2) AND event_id%4<>1)"


def rich_answers(spark, d):
    return predictions(spark, d).withColumn("obj", F.expr(_RICH_OBJECT.replace("lower(pred_label)", "pred_label"))).withColumn("raw", F.expr(_RICH))


def _read_sql(kind):
    """What each parser reads: label, confidence, found, scores, reasons. A structured answer's label must be one of the codes to be found in prose."""
    has = "(event_id+mi)%5 IN (0,1,2)"
    # An object in prose that holds another object is not taken by a structured server's parser; its label and number are.
    read = _TAKEN if kind == "structured" else has
    nothing = {"structured": ("NULL", "NULL", "false"), "generated": ("'ERROR'", "0", "false"), "generated_loose": ("NULL", "NULL", "false")}[kind]
    return f"""CASE WHEN {has} THEN pred_label WHEN (event_id+mi)%5=3 THEN pred_label ELSE {nothing[0]} END AS label,
 CAST(CASE WHEN {has} THEN (event_id+mi)%10+0.5 WHEN (event_id+mi)%5=3 THEN 0.75 ELSE {nothing[1]} END AS DOUBLE) AS confidence,
 CASE WHEN (event_id+mi)%5=4 THEN {nothing[2]} ELSE true END AS found, CASE WHEN {read} THEN {_RICH_SCORES} END AS scores, CASE WHEN {read} THEN {_RICH_REASONS} END AS reasoning,
 CASE WHEN {read} AND event_id%3=0 THEN concat('actors|', CAST(event_id AS STRING), ' rows') END AS items"""


def _parser_query(kind):
    @q(f"parsed_{kind}_answers", f" SELECT model, event_id, {_read_sql(kind)} FROM preds")
    def _(spark, d):
        r = rich_answers(spark, d).withColumn("r", RS.PARSERS[kind](F.col("raw")))
        return rounded(r.select("model", "event_id", "r.label", "r.confidence", "r.found", "r.scores", "r.reasoning", F.array_join("r.items", "|").alias("items")))


for _kind in RS.PARSERS:
    _parser_query(_kind)


# The first object of each answer by position: whole answers and those with one object after a brace-free beginning.
@q("parsed_balanced", f""", {_ANSWER}, o AS (SELECT *, CASE WHEN event_id%7 IN (0,5) THEN json_valid(substring(x, CAST(strpos(x,'{{') AS BIGINT))) ELSE event_id%7=1 END AS ok,
 regexp_extract(x, '"label"\\s*:\\s*"([VBEPRS])"', 1) AS lab, regexp_extract(x, '"confidence"\\s*:\\s*([0-9]*\\.?[0-9]+)', 1) AS num FROM a)
SELECT model, o.event_id, CASE WHEN ok THEN CASE event_id%7 WHEN 1 THEN json_extract_string(concat(substring(x, CAST(strpos(x,'{{') AS BIGINT), CAST(strpos(x,'}}')-strpos(x,'{{')+1 AS BIGINT))), '$.label')
  ELSE json_extract_string(substring(x, CAST(strpos(x,'{{') AS BIGINT)), '$.label') END WHEN lab<>'' THEN lab ELSE 'ERROR' END AS label,
 CAST(CASE WHEN ok THEN CASE event_id%7 WHEN 1 THEN json_extract_string(concat(substring(x, CAST(strpos(x,'{{') AS BIGINT), CAST(strpos(x,'}}')-strpos(x,'{{')+1 AS BIGINT))), '$.confidence')
  ELSE json_extract_string(substring(x, CAST(strpos(x,'{{') AS BIGINT)), '$.confidence') END WHEN num<>'' THEN num ELSE '0' END AS DOUBLE) AS confidence FROM o""")
def _(spark, d):
    return rounded(answers(spark, d).withColumn("r", RS.parse_balanced(F.col("raw"))).select("model", "event_id", "r.label", "r.confidence"))


@q("prediction_columns", f""", {_ANSWER}, {_PARSE}, u AS (SELECT model, event_id, upper(json_extract_string(js,'$.label')) AS l, json_extract_string(js,'$.confidence') AS n FROM c)
SELECT model, event_id, CASE WHEN l IN {VALID} THEN l ELSE 'ERROR' END AS pred_label, {r6('coalesce(CAST(n AS DOUBLE),0)')} AS pred_conf,
 CAST(NULL AS STRING) AS logits, CAST(NULL AS STRING) AS reasoning, 'plain' AS answers FROM u
UNION ALL SELECT model, event_id, CASE WHEN (event_id+mi)%5=4 THEN 'ERROR' ELSE pred_label END, CAST(CASE (event_id+mi)%5 WHEN 3 THEN 0.75 WHEN 4 THEN 0 ELSE (event_id+mi)%10+0.5 END AS DOUBLE),
 CASE WHEN {_TAKEN} THEN {_RICH_SCORES} END, CASE WHEN {_TAKEN} THEN {_RICH_REASONS} END, 'rich' FROM preds""")
def _(spark, d):
    plain = answers(spark, d).select("model", "event_id", "raw", F.lit("plain").alias("answers"))
    rich = rich_answers(spark, d).select("model", "event_id", "raw", F.lit("rich").alias("answers"))
    read = plain.unionByName(rich).withColumn("r", RS.prediction(F.col("raw")))
    return rounded(read.select("model", "event_id", "r.pred_label", "r.pred_conf", "r.logits", "r.reasoning", "answers"))


_SCORES = "concat('{', CASE event_id%4 WHEN 0 THEN '\"scores\": [1], \"logits\": [2]' WHEN 1 THEN '\"label_scores\": [3]' WHEN 2 THEN '\"log_probs\": [4], \"scores\": [5]' ELSE '\"other\": 1' END, '}')"


@q("first_scores", "SELECT model, event_id, CASE event_id%4 WHEN 0 THEN '[2]' WHEN 1 THEN '[3]' WHEN 2 THEN '[4]' END AS scores FROM preds")
def _(spark, d):
    return predictions(spark, d).select("model", "event_id", RS.first_scores(F.expr(_SCORES)).alias("scores"))


_BEST = "CASE " + " ".join(f"WHEN z{x}=zmax THEN '{x}'" for x in "VBEPRS") + " END"


@q("labels_from_logits", f""", {_LG}, v AS (SELECT *, {_VEC} FROM lg), w AS (SELECT *, greatest(zV,zB,zE,zP,zR,zS) AS zmax FROM v WHERE zV IS NOT NULL)
SELECT model, event_id, {_BEST} AS pred_label, {r6('1/(' + '+'.join(f'exp(z{x}-zmax)' for x in 'VBEPRS') + ')')} AS pred_conf, {_BEST}=true_label AS correct FROM w""")
def _(spark, d):
    from ..operators.calibration import logits_vector
    c = calibrated(spark, d).select("model", "event_id", "true_label", logits_vector(F.col("logits")).alias("z")).where("z is not null")
    return rounded(K.labels_from_logits(c, "z").select("model", "event_id", "pred_label", "pred_conf", "correct"))


# model_a lists its classes in reverse, model_b two classes only, model_c nothing usable, model_d nothing.
@q("class_names", f"""SELECT model, event_id, CASE model WHEN 'model_a' THEN substring('SRPEBV', ti+1, 1) WHEN 'model_b' THEN CASE ti WHEN 1 THEN 'P' WHEN 4 THEN 'E' ELSE 'INVALID' END ELSE substring('VBEPRS', ti+1, 1) END AS pred_label FROM preds""")
def _(spark, d):
    from ..functions.labels import CLASSES
    rows = [("model_a", i, c) for i, c in enumerate(reversed(CLASSES))] + [("model_b", 1, "Protests"), ("model_b", 4, "E"), ("model_b", 2, "?"), ("model_c", 0, "LABEL_0")]
    id2label = spark.createDataFrame(rows, "model string, idx int, label string")
    return RS.class_names(predictions(spark, d), id2label, "ti").select("model", "event_id", "pred_label")
