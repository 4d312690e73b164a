"""Registered queries: text variants, flips and their effects, rationale and attribution tracing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import perturbation_rules as R
from ..functions.rationale import STOP_WORDS
from ..operators import classification as K, compare as M, counterfactual as CF, perturb as PB, trace as T
from ..operators.scoring import collect_rationales, score_variants
from ..sources.readers import flatten_counterfactuals
from .inputs import CTE, erfc_sql, events, flips, predictions, r6, rich_events, rounded, spread, t_p_sql

Q: dict = {}
O: dict = {}


def q(name, oracle=None):
    def add(fn):
        Q[name] = fn
        if oracle is not None:
            O[name] = CTE + oracle
        return fn
    return add


# Variants of whole texts ---------------------------------------------------------------------

SHOWN = ["type", "subtype", "original", "replacement", "modifier", "action", "phrase", "source", "target", "pattern", "description"]


def ascii_only(c):
    return F.regexp_replace(c, r"[^\x00-\x7F]", "_")


def variants(spark, d, name):
    v = PB.explode_variants(spread(rich_events(spark, d)), [name], "body")
    return v.select("event_id", "gen_idx", *[ascii_only(F.col(c)).alias(c) for c in SHOWN],
                    F.md5(ascii_only(F.col("text")).cast("binary")).alias("text_md5"))


def lit(v):
    return "CAST(NULL AS STRING)" if v is None else "'" + v.replace("'", "''") + "'"


_X = "tx AS (SELECT event_id, regexp_replace(body, '[^\\x00-\\x7F]', '_', 'g') AS x FROM rich)"
_CAP = "concat(upper(left(x,1)), lower(substring(x,2)))"


def made_sql(rows, new_text, guard="contains(lower(x), needle)", order="no", one_per=None):
    """Variants as rows: rules crossed with texts, kept when the text changed, numbered in rule order."""
    cols = SHOWN + ["needle", "rx", "sw"]
    values = ", ".join(f"({i}, " + ", ".join(lit(r.get(c)) for c in cols) + ")" for i, r in enumerate(rows))
    pick = f"WHERE nth=1" if one_per else ""
    nth = f", row_number() OVER (PARTITION BY event_id, {one_per} ORDER BY no) AS nth" if one_per else ""
    shown = ", ".join(f"regexp_replace({c}, '[^\\x00-\\x7F]', '_', 'g') AS {c}" for c in SHOWN)
    return f""", {_X}, rules AS (SELECT * FROM (VALUES {values}) AS t(no, {', '.join(cols)})),
v0 AS (SELECT *, {new_text} AS txt FROM tx CROSS JOIN rules WHERE {guard}), v1 AS (SELECT * {nth} FROM v0 WHERE txt<>x)
SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY {order})-1 AS INT) AS gen_idx, {shown}, md5(txt) AS text_md5 FROM v1 {pick}"""


def swap_all(w, s):
    return {"type": "", "original": w, "replacement": s, "needle": w, "rx": rf"(?i)\b{w}\b", "sw": s, "description": f'Replace "{w}" with "{s}"'}


_ALL = "regexp_replace(x, rx, sw, 'g')"
_FIRST = "regexp_replace(x, rx, sw)"


@q("variants_actor", made_sql([swap_all(w, s) | {"type": "actor_substitution"} for w, ss in R.ACTORS.items() for s in ss], _ALL))
def _(spark, d):
    return variants(spark, d, "actor")


@q("variants_intensity", made_sql([{"type": f"intensity_{k}", "modifier": m, "action": v, "needle": v, "rx": rf"(?i)\b{v}", "sw": f"{m} {v}",
                                    "description": f'Add "{m}" before "{v}"'} for k, ms in R.INTENSITY.items() for m in ms for v in R.INTENSITY_VERBS], _FIRST))
def _(spark, d):
    return variants(spark, d, "intensity")


@q("variants_action", made_sql([swap_all(w, s) | {"type": "action_substitution"} for w, ss in R.ACTIONS.items() for s in ss], _ALL))
def _(spark, d):
    return variants(spark, d, "action")


@q("variants_negation", made_sql([{"type": "negation", "target": w, "needle": w, "rx": rf"(?i)\b{w}", "sw": f"did not {b}", "description": f'Negate "{w}" → "did not {b}"'}
                                  for w, b in R.NEGATION.items()], _FIRST))
def _(spark, d):
    return variants(spark, d, "negation")


@q("variants_sufficiency", made_sql([{"type": "sufficiency", "pattern": f"pattern_{i}", "rx": "(?i)" + p} for i, p in enumerate(R.SUFFICIENCY)],
                                    "regexp_extract(x, rx, 0)", "regexp_matches(x, rx)")
   .replace("regexp_replace(description, '[^\\x00-\\x7F]', '_', 'g') AS description", "concat('Keep only key elements: \"', txt, '\"') AS description"))
def _(spark, d):
    return variants(spark, d, "sufficiency")


@q("variants_legitimation", made_sql(
    [{"type": "legitimation_add", "phrase": R.LEGITIMIZING[0], "description": f'Add legitimizing phrase: "{R.LEGITIMIZING[0]}"'}]
    + [{"type": "delegitimation_add", "phrase": p, "description": f'Add delegitimizing phrase: "{p}"'} for p in R.DELEGITIMIZING],
    f"CASE type WHEN 'legitimation_add' THEN concat(rtrim(x,'.!?'), ' ', phrase, '.') ELSE concat(upper(left(phrase,1)), substring(phrase,2), ', ', {_CAP}) END", "true"))
def _(spark, d):
    return variants(spark, d, "legitimation")


@q("variants_provenance", made_sql(
    [{"type": "provenance_add", "source": s, "needle": "", "description": f'Add source attribution: "{s}"'} for s in R.SOURCES]
    + [{"type": "provenance_remove", "source": s, "needle": s.lower(), "rx": rf"(?i)^\Q{s}\E\s*", "sw": "", "description": f'Remove source attribution: "{s}"'} for s in R.SOURCES],
    f"CASE type WHEN 'provenance_add' THEN concat(source, ' ', {_CAP}) ELSE regexp_replace(x, rx, '') END"))
def _(spark, d):
    return variants(spark, d, "provenance")


_A, _B = R.PLACE_PATTERNS
_FOUND = f"CASE WHEN regexp_matches(x,'{_A}') THEN regexp_extract(x,'{_A}',0) ELSE regexp_extract(x,'{_B}',0) END"


@q("variants_decontextualization", made_sql([{"type": "decontextualization", "replacement": p} for p in R.PLACES],
                                            f"CASE WHEN regexp_matches(x,'{_A}') THEN regexp_replace(x,'{_A}',replacement) ELSE regexp_replace(x,'{_B}',replacement) END",
                                            f"{_FOUND}<>''")
   .replace("regexp_replace(original, '[^\\x00-\\x7F]', '_', 'g') AS original", f"{_FOUND} AS original")
   .replace("regexp_replace(description, '[^\\x00-\\x7F]', '_', 'g') AS description", f"concat('Replace location \"', {_FOUND}, '\" with \"', replacement, '\"') AS description"))
def _(spark, d):
    return variants(spark, d, "decontextualization")


_FAMILIES = [("reporting_verb", "verb", R.REPORTING_VERBS), ("day_of_week", "day", R.WEEKDAYS), ("temporal_connective", "connective", R.CONNECTIVES),
             ("cardinal_numeral", "numeral", R.NUMERALS)]


@q("variants_control", made_sql([{"type": "neutral_control", "subtype": f, "original": w, "replacement": s, "rx": rf"(?i)\b{w}\b", "sw": s,
                                  "description": f'Neutral {what} swap: "{w}" → "{s}"'} for f, what, sw in _FAMILIES for w, s in sw.items()],
                                _FIRST, "regexp_matches(x, rx)", one_per="subtype"))
def _(spark, d):
    return variants(spark, d, "control")


def _valid(spark, d):
    return PB.valid_variants(spread(rich_events(spark, d).select("event_id", "body")), "body")


@q("valid_variants")
def _(spark, d):
    return rounded(_valid(spark, d).select("event_id", "pert_idx", "generator", "type", "text", "edit_distance_ratio", "fluency_score"))


@q("perturbation_quality")
def _(spark, d):
    return rounded(CF.perturbation_quality(_valid(spark, d)))


@q("validated_pairs")
def _(spark, d):
    e = spread(rich_events(spark, d).select("event_id", "body"))
    e = e.withColumn("text", F.expr("""CASE event_id%4 WHEN 0 THEN body WHEN 1 THEN concat(body, ' Then it was over.') WHEN 2 THEN left(body, CAST(length(body)*9/10 AS INT))
        ELSE left(body, CAST(length(body)/2 AS INT)) END"""))
    return rounded(PB.validate(e, "body").drop("body", "text"))


def _by_length():
    return lambda prompts: ['{"label": "%s", "confidence": 0.%d}' % ("VBEPRS"[len(p) % 6], len(p) % 10) for p in prompts]


def _by_vowels():
    return lambda prompts: ['{"label": "%s", "confidence": 0.5}' % "VBEPRS"[p.count("e") % 6] for p in prompts]


@q("rescored_variants")
def _(spark, d):
    v = _valid(spark, d).select("event_id", "pert_idx", "type", "text")
    scored = score_variants(v, {"model_a": _by_length, "model_b": _by_vowels}, keep=["event_id", "pert_idx", "type"])
    return rounded(PB.compare_with_original(scored, predictions(spark, d)))




def _answers_by_number():
    """A stub that finds the event's number in its prompt and answers bare, in prose, in a code fence, with a text for reasons, or without any."""
    import re

    def answer(p):
        n = int(re.search(r"\[#(\d+)\]", p).group(1))
        obj = '{"reasoning": ["actors", "number %d"], "label": "%s", "confidence": 0.5}' % (n, "VBEPRS"[n % 6])
        return [obj, "Well: " + obj + " done", "```json\n" + obj + "\n```", '{"reasoning": "because", "label": "V"}', "no reasons"][n % 5]
    return lambda prompts: [answer(p) for p in prompts]


@q("collected_rationales", "SELECT 'model_a' AS model, event_id, -1 AS pert_idx, CASE WHEN event_id%5<3 THEN concat('actors|number ', CAST(event_id AS STRING)) END AS reasoning FROM e")
def _(spark, d):
    t = spread(rich_events(spark, d)).select("event_id", F.lit(-1).alias("pert_idx"), F.expr("concat('[#', event_id, '] ', body)").alias("text"))
    got = collect_rationales(t, "model_a", _answers_by_number)
    return got.select("model", "event_id", "pert_idx", F.when(F.col("reasoning").isNotNull(), F.array_join("reasoning", "|")).alias("reasoning"))


# Flips ------------------------------------------------------------------------------------------

@q("compared_predictions", """SELECT event_id, model, pert_idx, label_flipped, """ + r6("confidence_delta") + """ AS confidence_delta,
 CASE WHEN success AND label<>orig_label THEN concat(orig_label,' -> ',label) END AS flip_direction FROM flips""")
def _(spark, d):
    f = flips(spark, d).select("event_id", "model", "pert_idx", "label", "confidence", "success")
    return rounded(PB.compare_with_original(f, predictions(spark, d)).select("event_id", "model", "pert_idx", "label_flipped", "confidence_delta", "flip_direction"))


_RATES = f"""{r6('avg(CAST(label_flipped AS INT))')} AS flip_rate, CAST(count(*) AS BIGINT) AS n_perturbations, {r6('avg(confidence_delta)')} AS mean_confidence_delta,
 {r6('stddev_pop(confidence_delta)')} AS std_confidence_delta, {r6('avg(abs(confidence_delta))')} AS mean_abs_confidence_delta"""


@q("flip_rates", f"SELECT type, model, {_RATES} FROM flips WHERE success GROUP BY 1,2")
def _(spark, d):
    return rounded(CF.flip_rates(flips(spark, d)))


@q("flip_rates_by_tier", f"SELECT ambiguity_tier AS tier, type, model, {_RATES} FROM flips WHERE success GROUP BY 1,2,3 UNION ALL SELECT 'all', type, model, {_RATES} FROM flips WHERE success GROUP BY type, model")
def _(spark, d):
    return rounded(CF.flip_rates_by_tier(flips(spark, d)))


@q("tier_event_counts", "SELECT ambiguity_tier AS tier, CAST(count(DISTINCT event_id) AS BIGINT) AS n_events FROM flips GROUP BY 1 UNION ALL SELECT 'all', CAST(count(DISTINCT event_id) AS BIGINT) FROM flips")
def _(spark, d):
    return CF.tier_event_counts(flips(spark, d))


@q("differential_effect", f""", x AS (SELECT type, model, confidence_delta AS v FROM flips WHERE success),
z AS (SELECT type, model, v, rank() OVER (PARTITION BY type, model ORDER BY abs(v)) + (count(*) OVER (PARTITION BY type, model, abs(v))-1)/2.0::DOUBLE AS r FROM x WHERE v<>0),
w AS (SELECT type, model, least(coalesce(sum(r) FILTER (v>0),0), coalesce(sum(r) FILTER (v<0),0)) AS w FROM z GROUP BY 1,2)
SELECT x.type, x.model, CAST(count(*) AS BIGINT) AS n_samples, {r6('avg(v)')} AS "CDE_mean", {r6('stddev_pop(v)')} AS "CDE_std", {r6('median(v)')} AS "CDE_median",
 {r6('avg(v)*sqrt(count(*))/stddev_samp(v)')} AS t_statistic, {r6('any_value(w)')} AS wilcoxon_statistic FROM x LEFT JOIN w ON w.type=x.type AND w.model=x.model GROUP BY 1,2 HAVING count(*)>1""")
def _(spark, d):
    return rounded(CF.differential_effect(flips(spark, d), with_p=False))


# Two groups have equal changes: model_d's intensity changes are all 0.3 (sums of which are not), its delegitimation changes 0.
_CONSTANT = "CASE WHEN model='model_d' AND type='intensity_high' THEN 0.3::DOUBLE WHEN model='model_d' AND type='delegitimation_add' THEN 0::DOUBLE ELSE confidence_delta END"


def constant(spark, d):
    return flips(spark, d).withColumn("confidence_delta", F.when(F.col("success"), F.expr(_CONSTANT.replace("::DOUBLE", "D"))))


_EFFECT = f"""fx AS (SELECT *, {_CONSTANT} AS v FROM flips WHERE success),
rk AS (SELECT type, model, v, rank() OVER (PARTITION BY type, model ORDER BY abs(v)) + (count(*) OVER (PARTITION BY type, model, abs(v))-1)/2.0::DOUBLE AS r FROM fx WHERE v<>0),
wx AS (SELECT type, model, least(coalesce(sum(r) FILTER (v>0),0), coalesce(sum(r) FILTER (v<0),0)) AS w, count(*) AS nr FROM rk GROUP BY 1,2),
ti AS (SELECT type, model, sum(c*c*c-c) AS ties, count(*) FILTER (c>1) AS nt FROM (SELECT type, model, abs(v) AS a, CAST(count(*) AS DOUBLE) AS c FROM rk GROUP BY 1,2,3) GROUP BY 1,2),
ba AS (SELECT type, model, count(*) AS n, avg(v) AS m, stddev_pop(v) AS sp, median(v) AS md, CASE WHEN min(v)=max(v) THEN CASE WHEN min(v)>0 THEN 'inf'::DOUBLE WHEN min(v)<0 THEN '-inf'::DOUBLE END ELSE avg(v)*sqrt(count(*))/stddev_samp(v) END AS t
 FROM fx GROUP BY 1,2 HAVING count(*)>1),
ef AS (SELECT ba.*, w, nr, ties, nt, coalesce(nr,0)<=50 AND coalesce(nt,0)=0 AND n=coalesce(nr,0) AS exact,
 CASE WHEN nr>0 THEN (w-nr*(nr+1.0)/4)/sqrt(nr*(nr+1.0)*(2.0*nr+1)/24-ties/48) END AS zz FROM ba LEFT JOIN wx ON wx.type=ba.type AND wx.model=ba.model LEFT JOIN ti ON ti.type=ba.type AND ti.model=ba.model)"""
_EFFECT_P = f"{r6(t_p_sql('t', '(n-1)'))} AS t_pvalue, {r6(erfc_sql('abs(zz)/sqrt(2.0::DOUBLE)'))} AS wilcoxon_pvalue"


@q("differential_effect_test", f""", {_EFFECT} SELECT type, model, CAST(n AS BIGINT) AS n_samples, {r6('m')} AS "CDE_mean", {r6('sp')} AS "CDE_std", {r6('md')} AS "CDE_median", {r6('t')} AS t_statistic,
 {r6('w')} AS wilcoxon_statistic, {_EFFECT_P}, CASE WHEN exact THEN 'exact' ELSE 'normal' END AS wilcoxon_method FROM ef""")
def _(spark, d):
    return rounded(CF.differential_effect(constant(spark, d)))


@q("flip_summary", f""", {_EFFECT}, ra AS (SELECT type, model, avg(CAST(label_flipped AS INT)) AS fr, count(*) AS np, avg(v) AS md0, avg(abs(v)) AS ma FROM fx GROUP BY 1,2)
SELECT ra.type, ra.model, {r6('fr')} AS flip_rate, CAST(np AS BIGINT) AS n_perturbations, {r6('md0')} AS mean_confidence_delta, {r6('ma')} AS mean_abs_confidence_delta, {r6('m')} AS "CDE_mean", {r6('md')} AS "CDE_median",
 {_EFFECT_P} FROM ra LEFT JOIN ef ON ef.type=ra.type AND ef.model=ra.model""")
def _(spark, d):
    f = constant(spark, d)
    return rounded(CF.flip_summary(CF.flip_rates(f), CF.differential_effect(f)))


@q("sensitivity_clusters", """, f AS (SELECT event_id, type, pert_idx, success AND event_id%50<>0 AS ok, label_flipped FROM flips),
p AS (SELECT event_id, type, pert_idx, avg(CAST(label_flipped AS INT)) FILTER (ok) AS share FROM f GROUP BY 1,2,3), t AS (SELECT event_id, type, avg(share) AS rate FROM p GROUP BY 1,2),
b AS (SELECT event_id, max(rate) AS mx FROM t GROUP BY 1)
SELECT b.event_id, CASE WHEN any_value(mx) IS NULL THEN 'robust' WHEN count(*) FILTER (abs(rate-mx)<0.001)>1 THEN 'mixed' ELSE max(type) FILTER (abs(rate-mx)<0.001) END AS cluster FROM b JOIN t ON t.event_id=b.event_id GROUP BY 1""")
def _(spark, d):
    f = flips(spark, d).withColumn("success", F.expr("success AND event_id%50<>0"))
    return CF.sensitivity_clusters(f)


_WORD = """CASE WHEN original IS NOT NULL AND replacement IS NOT NULL THEN replacement WHEN coalesce(phrase,source,modifier) IS NOT NULL
 THEN array_to_string(list_filter(string_split(coalesce(phrase,source,modifier),' '), lambda w: w<>'')[1:5], ' ') ELSE trim(split_part(description,',',1)) END"""
# Some variants carry only a description.
_BARE = "SELECT * REPLACE (CASE WHEN event_id%6=0 THEN NULL ELSE modifier END AS modifier, CASE WHEN event_id%10=0 THEN NULL ELSE original END AS original) FROM flips"


def bare(spark, d):
    return flips(spark, d).withColumns({"modifier": F.expr("CASE WHEN event_id%6=0 THEN NULL ELSE modifier END"), "original": F.expr("CASE WHEN event_id%10=0 THEN NULL ELSE original END")})


@q("word_rows", f", b AS ({_BARE}) SELECT {_WORD} AS word, type AS category, {r6('confidence_delta')} AS confidence_delta, label_flipped, event_id, model FROM b WHERE success")
def _(spark, d):
    return rounded(CF.word_rows(bare(spark, d)))


_IMPACT = f"""b AS ({_BARE}), w AS (SELECT {_WORD} AS word, type AS category, confidence_delta AS v, label_flipped FROM b WHERE success),
im AS (SELECT word, category, avg(v) AS dm, coalesce(stddev_samp(v),0) AS ds, count(*) AS n, avg(CAST(label_flipped AS INT)) AS fr FROM w GROUP BY 1,2)"""
_IMPACT_COLS = f"""word, category, {r6('dm')} AS delta_mean, {r6('ds')} AS delta_std, CAST(n AS BIGINT) AS count, {r6('fr')} AS flip_rate, CAST(n AS BIGINT) AS n_total, {r6('dm*100')} AS score_shift_pct, {r6('abs(dm*100)*sqrt(n)')} AS impact_magnitude"""


@q("word_impact", f", {_IMPACT} SELECT {_IMPACT_COLS} FROM im")
def _(spark, d):
    return rounded(CF.word_impact(CF.word_rows(bare(spark, d)), with_p=False))


# Words with few rows, and words whose changes are all equal: 'severely' always 0.3, 'unprovoked' always 0.
_RARE_CTE = f"""b0 AS ({_BARE}), b AS (SELECT * REPLACE (CASE WHEN modifier='severely' THEN 0.3::DOUBLE WHEN phrase='unprovoked' THEN 0::DOUBLE ELSE confidence_delta END AS confidence_delta,
 CASE WHEN pert_idx=3 THEN concat('said ', CAST(event_id%60 AS STRING)) ELSE replacement END AS replacement) FROM b0)"""


def rare(spark, d):
    return bare(spark, d).withColumns({
        "confidence_delta": F.when(F.col("success"), F.expr("CASE WHEN modifier='severely' THEN 0.3D WHEN phrase='unprovoked' THEN 0D ELSE confidence_delta END")),
        "replacement": F.expr("CASE WHEN pert_idx=3 THEN concat('said ', CAST(event_id%60 AS STRING)) ELSE replacement END")})


_TESTED = f"""{_RARE_CTE}, w AS (SELECT {_WORD} AS word, type AS category, confidence_delta AS v, label_flipped FROM b WHERE success),
im AS (SELECT word, category, avg(v) AS dm, CASE WHEN min(v)=max(v) THEN 0 ELSE stddev_samp(v) END AS ds, count(*) AS n, avg(CAST(label_flipped AS INT)) AS fr,
 CASE WHEN count(*)>1 THEN CASE WHEN min(v)=max(v) THEN CASE WHEN min(v)>0 THEN 'inf'::DOUBLE WHEN min(v)<0 THEN '-inf'::DOUBLE END ELSE avg(v)*sqrt(count(*))/stddev_samp(v) END END AS t FROM w GROUP BY 1,2),
ip AS (SELECT *, CASE WHEN n>1 THEN {t_p_sql('t', '(n-1)')} ELSE 1 END AS p FROM im)"""


@q("word_impact_test", f", {_TESTED} SELECT {_IMPACT_COLS}, {r6('p')} AS p_value, coalesce(p<0.05, false) AS significant FROM ip im")
def _(spark, d):
    return rounded(CF.word_impact(CF.word_rows(rare(spark, d))))


@q("word_types", """, w AS (SELECT coalesce(modifier,source,phrase,replacement) AS word, type, event_id, pert_idx FROM flips WHERE coalesce(modifier,source,phrase,replacement)<>''),
z AS (SELECT word, type, row_number() OVER (PARTITION BY word ORDER BY event_id DESC, pert_idx DESC) AS rn FROM w) SELECT word, type AS perturbation_type FROM z WHERE rn=1""")
def _(spark, d):
    return CF.word_types(flips(spark, d))


@q("ranked_words", f""", {_TESTED}, ww AS (SELECT coalesce(modifier,source,phrase,replacement) AS word, type, event_id, pert_idx FROM flips WHERE coalesce(modifier,source,phrase,replacement)<>''),
z AS (SELECT word, type, row_number() OVER (PARTITION BY word ORDER BY event_id DESC, pert_idx DESC) AS rn FROM ww)
SELECT im.word, category, type AS perturbation_type, CAST(n AS BIGINT) AS n_total, {r6('fr')} AS flip_rate, {r6('p')} AS p_value,
 CASE WHEN p<0.001 THEN '***' WHEN p<0.01 THEN '**' WHEN p<0.05 THEN '*' ELSE 'n.s.' END AS stars
FROM ip im LEFT JOIN (SELECT * FROM z WHERE rn=1) z ON z.word=im.word WHERE (n>=10 OR p<0.05) AND NOT contains(lower(im.word),'did not')""")
def _(spark, d):
    r = CF.ranked_words(CF.word_impact(CF.word_rows(rare(spark, d))), CF.word_types(flips(spark, d)))
    return rounded(r.select("word", "category", "perturbation_type", "n_total", "flip_rate", "p_value", "stars"))


@q("report_counters", """SELECT CAST(count(DISTINCT event_id) AS BIGINT) AS n_events, CAST(count(DISTINCT concat(event_id,'-',pert_idx)) AS BIGINT) AS n_perturbations_total,
 CAST(count(DISTINCT event_id) FILTER (ambiguity_tier='High') AS BIGINT) AS n_high, CAST(count(DISTINCT event_id) FILTER (ambiguity_tier='Medium') AS BIGINT) AS n_medium,
 CAST(count(DISTINCT event_id) FILTER (ambiguity_tier='Low') AS BIGINT) AS n_low, CAST(count(DISTINCT event_id) FILTER (label_flipped) AS BIGINT) AS n_flip_events FROM flips""")
def _(spark, d):
    return CF.report_counters(flips(spark, d))


@q("most_sensitive", f"SELECT type, model, {r6('avg(CAST(label_flipped AS INT))')} AS flip_rate FROM flips WHERE success GROUP BY 1,2 ORDER BY avg(CAST(label_flipped AS INT)) DESC, type, model LIMIT 1")
def _(spark, d):
    return rounded(CF.most_sensitive(CF.flip_rates(flips(spark, d))))


@q("flattened_reports", f"SELECT event_id, pert_idx, type, original, replacement, phrase, model, label, {r6('confidence')} AS confidence, success, label_flipped FROM flips")
def _(spark, d):
    f = flips(spark, d)
    variant = F.struct("type", "original", "replacement", "phrase")
    result = F.struct("label", "confidence", "success", "label_flipped", "confidence_delta")
    per = f.groupBy("event_id", "ambiguity_tier", "pert_idx").agg(
        F.min(variant).alias("perturbation"), F.map_from_entries(F.collect_list(F.struct(F.col("model"), result))).alias("model_results"))
    nested = per.groupBy("event_id", "ambiguity_tier").agg(F.array_sort(F.collect_list(F.struct("pert_idx", "perturbation", F.map_entries("model_results").alias("m")))).alias("_p"))
    nested = nested.select("event_id", "ambiguity_tier", F.lit("").alias("original_text"), F.lit("").alias("true_label"), F.transform(
        "_p", lambda x: F.struct(x["perturbation"].alias("perturbation"), F.map_from_entries(x["m"]).alias("model_results"))).alias("perturbations"))
    return rounded(flatten_counterfactuals(nested).select("event_id", "pert_idx", "type", "original", "replacement", "phrase", "model", "label", "confidence", "success", "label_flipped"))


# Tracing -------------------------------------------------------------------------------------------

@q("flipped_events", """, r AS (SELECT model, event_id, row_number() OVER (PARTITION BY model ORDER BY event_id) AS rn FROM (SELECT DISTINCT model, event_id FROM flips WHERE label_flipped))
SELECT f.model, f.event_id, f.pert_idx FROM flips f JOIN r ON r.model=f.model AND r.event_id=f.event_id WHERE label_flipped AND rn<=50""")
def _(spark, d):
    return T.flipped_events(flips(spark, d), 50).select("model", "event_id", "pert_idx")


_BEFORE = """CASE WHEN (event_id+mi)%9=0 THEN NULL ELSE concat('Actors: the military and the civilians|Actions: ', notes, '|Rationale: label ', pred_label, ' fits the event') END"""
_AFTER = """CASE WHEN (event_id+mi+pert_idx)%13=0 THEN NULL ELSE concat('Actors: the ', CASE WHEN (event_id+pert_idx)%3=0 THEN coalesce(replacement, phrase, 'military') ELSE 'military' END, ' and the civilians',
 CASE WHEN event_id%4=0 THEN '' ELSE '|Actions: as before' END, '|Rationale: label ', label, ' fits') END"""


def rationales(spark, d):
    p = predictions(spark, d).select("model", "event_id", F.lit(-1).alias("pert_idx"), F.split(F.expr(_BEFORE), r"\|").alias("reasoning"))
    f = flips(spark, d).select("model", "event_id", "pert_idx", F.split(F.expr(_AFTER), r"\|").alias("reasoning"))
    return spread(p.unionByName(f))


_STOP = "[" + ",".join(f"'{w}'" for w in STOP_WORDS) + "]"


def _words(x):
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '\\b[a-z]+\\b'), lambda w: NOT list_contains({_STOP}, w)))"


_RFC = f"""bef AS (SELECT model, event_id, string_split({_BEFORE},'|') AS b FROM preds), aft AS (SELECT *, string_split({_AFTER},'|') AS a FROM flips WHERE label_flipped),
j AS (SELECT aft.*, b FROM aft LEFT JOIN bef ON bef.model=aft.model AND bef.event_id=aft.event_id),
it AS (SELECT model, event_id, pert_idx, unnest(b[1:least(len(a),len(b))]) AS bi, unnest(a[1:least(len(a),len(b))]) AS ai FROM j WHERE a IS NOT NULL AND b IS NOT NULL),
js AS (SELECT model, event_id, pert_idx, {_words('bi')} AS bw, {_words('ai')} AS aw FROM it),
ch AS (SELECT model, event_id, pert_idx, max(CASE WHEN len(list_distinct(bw||aw))=0 THEN 1.0 ELSE 1.0 END)>0 AS k, bool_or(CASE WHEN len(list_distinct(bw||aw))=0 THEN false ELSE len(list_intersect(bw,aw))/len(list_distinct(bw||aw))::DOUBLE<0.85 END) AS changed FROM js GROUP BY 1,2,3),
rec AS (SELECT j.model, j.event_id, j.pert_idx, ambiguity_tier, type AS perturbation_type, original AS original_word, coalesce(replacement, phrase) AS replacement_word, changed AS rationale_changed,
 CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN coalesce(replacement, phrase, original) IS NULL THEN false ELSE len(list_filter(a, lambda x: contains(lower(x), lower(coalesce(replacement, phrase, original)))))>0 END END AS mentions_change
 FROM j LEFT JOIN ch ON ch.model=j.model AND ch.event_id=j.event_id AND ch.pert_idx=j.pert_idx),
rfc AS (SELECT *, rationale_changed AND mentions_change AS concordant FROM rec)"""


def records(spark, d):
    return T.rfc_records(flips(spark, d).where("label_flipped"), rationales(spark, d))


@q("rfc_records", f", {_RFC} SELECT *, CAST(CAST(concordant AS INT) AS DOUBLE) AS rfc_score FROM rfc")
def _(spark, d):
    return records(spark, d)


def _rfc_agg(scope, t, a, by):
    return f"""SELECT model, '{scope}' AS scope, {t} AS perturbation_type, {a} AS ambiguity_tier, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(concordant AS INT)),4) AS concordant_rate,
 round(1-avg(CAST(concordant AS INT)),4) AS discordant_rate FROM rfc WHERE concordant IS NOT NULL GROUP BY {by}"""


_RFC_RATES = " UNION ALL ".join([_rfc_agg("all", "CAST(NULL AS STRING)", "CAST(NULL AS STRING)", "model"), _rfc_agg("type", "perturbation_type", "CAST(NULL AS STRING)", "model, perturbation_type"),
                                 _rfc_agg("tier", "CAST(NULL AS STRING)", "ambiguity_tier", "model, ambiguity_tier")])


@q("rfc_rates", f", {_RFC} {_RFC_RATES}")
def _(spark, d):
    return T.rfc_rates(records(spark, d))


@q("core_with_robustness", f""", {_RFC}, co AS (SELECT model, CAST(count(*) AS BIGINT) AS n FROM preds GROUP BY 1),
fr AS (SELECT model, type, avg(CAST(label_flipped AS INT)) AS r FROM flips WHERE success AND model<>'model_d' GROUP BY 1,2), cf AS (SELECT model, round(avg(r),4) AS cfr_mean_optional FROM fr GROUP BY 1),
rt AS (SELECT model, round(1-avg(CAST(concordant AS INT)),4) AS rfc_low_discord_optional FROM rfc WHERE concordant IS NOT NULL AND ambiguity_tier='Low' GROUP BY 1)
SELECT model, n, cfr_mean_optional, rfc_low_discord_optional FROM co LEFT JOIN cf USING (model) LEFT JOIN rt USING (model)""")
def _(spark, d):
    core = K.core_table(predictions(spark, d).withColumn("country", F.lit("all"))).select("model", "n")
    rates = CF.flip_rates(flips(spark, d).where("model <> 'model_d'"))
    return M.add_robustness(core, rates, T.rfc_rates(records(spark, d)).where("scope = 'tier'"), ["model"])


# Word pieces of each note: words of seven letters and more are split, sentence marks added.
_PIECES = "regexp_replace(regexp_replace(lower(notes), '([a-z]{{5}})([a-z]{{2,}})', '{one}1 ##{one}2'{g}), '([,.;])', ' {one}1'{g})"
_TOKENS = "concat('[CLS] ▁', " + _PIECES + ", ' [SEP]')"
_SCORE = "CAST(({i}*7+event_id*3+mi+pert_idx*5)%41-20 AS DOUBLE)/8"


def attributions(spark, d):
    tok = F.split(F.expr(_TOKENS.format(one="$", g="")), " ")

    def scored(df):
        return df.withColumn("tokens", tok).withColumn("scores", F.expr(f"transform(tokens, (t, i) -> {_SCORE.format(i='i')})")).select("model", "event_id", "pert_idx", "tokens", "scores")

    p = spread(predictions(spark, d).select("model", "event_id", "mi", "notes")).withColumn("pert_idx", F.lit(-1))
    f = spread(flips(spark, d).where("label_flipped").select("model", "event_id", "pert_idx", "mi"))
    n = events(spark, d).select("event_id", F.concat("notes", F.lit(" Extra wording here")).alias("notes"))
    return scored(p).unionByName(scored(f.join(n, "event_id")))


_SRC = """src AS (SELECT model, event_id, mi, -1 AS pert_idx, notes FROM preds UNION ALL SELECT model, f.event_id, mi, pert_idx, concat(e.notes,' Extra wording here') FROM flips f JOIN e ON e.event_id=f.event_id WHERE label_flipped)"""
_ATTR = f"""{_SRC}, tk AS (SELECT model, event_id, mi, pert_idx, string_split({_TOKENS.format(one=chr(92), g=", 'g'")},' ') AS toks FROM src),
u AS (SELECT model, event_id, mi, pert_idx, unnest(toks) AS t, unnest(range(len(toks))) AS i FROM tk),
s AS (SELECT *, {_SCORE.format(i='i')} AS sc FROM u WHERE t NOT IN ('[CLS]','[SEP]')),
g AS (SELECT *, sum(CASE WHEN t LIKE '##%' THEN 0 ELSE 1 END) OVER (PARTITION BY model, event_id, pert_idx ORDER BY i) AS wid FROM s),
w0 AS (SELECT model, event_id, pert_idx, wid, string_agg(CASE WHEN t LIKE '##%' THEN substring(t,3) ELSE ltrim(t,'▁') END, '' ORDER BY i) AS word, sum(sc) AS score FROM g GROUP BY 1,2,3,4),
w AS (SELECT *, row_number() OVER (PARTITION BY model, event_id, pert_idx ORDER BY abs(score) DESC, wid) AS rk FROM w0 WHERE word<>'')"""


def shown(c, a, b):
    return F.array_join(F.transform(c, lambda x: F.concat(x[a], F.lit(":"), (F.round(x[b] * 1000) + 0.0).cast("bigint").cast("string"))), ",")


@q("attribution_words", f", {_ATTR} SELECT model, event_id, pert_idx, string_agg(concat(word,':',CAST(round(score*1000) AS BIGINT)), ',' ORDER BY rk) AS words FROM w WHERE rk<=10 GROUP BY 1,2,3")
def _(spark, d):
    t = T.top_tokens(T.attribution_words(attributions(spark, d)))
    return t.select("model", "event_id", "pert_idx", shown(F.col("words"), "word", "score").alias("words"))


@q("attribution_deltas", f""", {_ATTR}, lastw AS (SELECT model, event_id, pert_idx, word, score, row_number() OVER (PARTITION BY model, event_id, pert_idx, word ORDER BY rk DESC) AS k FROM w),
aw AS (SELECT * FROM lastw WHERE k=1 AND pert_idx>=0), bw AS (SELECT * FROM lastw WHERE k=1 AND pert_idx=-1),
keys AS (SELECT DISTINCT model, event_id, pert_idx FROM aw),
bx AS (SELECT keys.model, keys.event_id, keys.pert_idx, word, score FROM keys JOIN bw ON bw.model=keys.model AND bw.event_id=keys.event_id),
fo AS (SELECT coalesce(aw.model,bx.model) AS model, coalesce(aw.event_id,bx.event_id) AS event_id, coalesce(aw.pert_idx,bx.pert_idx) AS pert_idx, coalesce(aw.word,bx.word) AS word, coalesce(aw.score,0)-coalesce(bx.score,0) AS dl
 FROM aw FULL OUTER JOIN bx ON aw.model=bx.model AND aw.event_id=bx.event_id AND aw.pert_idx=bx.pert_idx AND aw.word=bx.word),
rd AS (SELECT *, row_number() OVER (PARTITION BY model, event_id, pert_idx ORDER BY abs(dl) DESC, word) AS rk FROM fo)
SELECT model, event_id, pert_idx, string_agg(concat(word,':',CAST(round(dl*1000) AS BIGINT)), ',' ORDER BY rk) AS top_delta FROM rd WHERE rk<=10 GROUP BY 1,2,3""")
def _(spark, d):
    t = T.attribution_deltas(flips(spark, d), attributions(spark, d))
    return t.select("model", "event_id", "pert_idx", shown(F.col("top_delta"), "token", "delta").alias("top_delta"))


_EVT = "ev AS (SELECT event_id, CASE WHEN event_id%5=0 THEN NULL ELSE 'High' END AS ambiguity_tier, CASE WHEN event_id%8=6 THEN ' ' ELSE notes END AS notes FROM e)"


def _traced(spark, d):
    ev = events(spark, d).select("event_id", F.expr("CASE WHEN event_id%5=0 THEN NULL ELSE 'High' END").alias("ambiguity_tier"), F.expr("CASE WHEN event_id%8=6 THEN ' ' ELSE notes END").alias("notes"))
    a = attributions(spark, d).where("pert_idx = -1")
    return T.attributions_from_disagreements(ev, a)


@q("attributions_from_disagreements", f""", {_ATTR}, {_EVT} SELECT model, w.event_id, any_value(coalesce(ev.ambiguity_tier,'Unknown')) AS ambiguity_tier, string_agg(concat(word,':',CAST(round(score*1000) AS BIGINT)), ',' ORDER BY rk) AS words
 FROM w JOIN ev ON ev.event_id=w.event_id WHERE rk<=10 AND pert_idx=-1 AND trim(ev.notes)<>'' GROUP BY 1, 2""")
def _(spark, d):
    return _traced(spark, d).select("model", "event_id", "ambiguity_tier", shown(F.col("words"), "word", "score").alias("words"))


@q("trace_summary", f""", {_RFC}, {_ATTR}, {_EVT}, lig AS (SELECT model, w.event_id, coalesce(ev.ambiguity_tier,'Unknown') AS tier, word FROM w JOIN ev ON ev.event_id=w.event_id WHERE rk=1 AND pert_idx=-1 AND trim(ev.notes)<>'')
SELECT 'rfc' AS source, model, event_id, ambiguity_tier, perturbation_type, coalesce(original_word,'') AS original_word, coalesce(replacement_word,'') AS replacement_word, coalesce(CAST(concordant AS STRING),'') AS concordant,
 coalesce(CAST(rationale_changed AS STRING),'') AS rationale_changed, coalesce(CAST(mentions_change AS STRING),'') AS mentions_change, CASE WHEN concordant THEN '1.0' WHEN NOT concordant THEN '0.0' ELSE '' END AS rfc_score, '' AS top_attributed_token FROM rfc
UNION ALL SELECT 'lig', model, event_id, tier, '', '', '', '', '', '', '', word FROM lig""")
def _(spark, d):
    return T.trace_summary(records(spark, d), _traced(spark, d)).drop("attribution_score")
