"""Registered queries: classification, harm, fairness, calibration, thresholds, model comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibration as C, classification as K, compare as M, fairness as A, harm as H, sampling as S
from ..operators import ranking as R
from .inputs import CTE, MODELS, VALID, calibrated, erfc_sql, flips, predictions, r6, rounded, spread, t_p_sql

Q: dict = {}
O: dict = {}


def q(name, oracle=None):
    def add(fn):
        Q[name] = fn
        if oracle is not None:
            O[name] = CTE + oracle
        return fn
    return add


def ratio(a, b, default="CAST(0 AS DOUBLE)"):
    return f"(CASE WHEN ({b}) > 0 THEN CAST({a} AS DOUBLE)/CAST({b} AS DOUBLE) ELSE {default} END)"


def cnt(cond):
    return f"CAST(count(*) FILTER (WHERE {cond}) AS BIGINT)"


BOTH = f"true_label IN {VALID} AND pred_label IN {VALID}"
LABS = "(SELECT * FROM (VALUES ('V'),('B'),('E'),('P'),('R'),('S')) AS t(label))"

# Some predictions carry labels that are not codes, and some true labels are missing.
MESSY = """messy AS (SELECT * REPLACE (CASE WHEN event_id%29=0 THEN 'ERROR' WHEN event_id%31=0 THEN NULL ELSE pred_label END AS pred_label,
  CASE WHEN event_id%37=0 THEN NULL WHEN event_id%41=0 THEN 'X' ELSE true_label END AS true_label) FROM preds)"""


def messy(spark, d):
    return predictions(spark, d).withColumns({
        "pred_label": F.expr("CASE WHEN event_id%29=0 THEN 'ERROR' WHEN event_id%31=0 THEN NULL ELSE pred_label END"),
        "true_label": F.expr("CASE WHEN event_id%37=0 THEN NULL WHEN event_id%41=0 THEN 'X' ELSE true_label END")})


# Classification ------------------------------------------------------------

@q("confusion_matrix", f""", {MESSY}
SELECT g.model, g.t AS true_label, g.p AS pred_label, CAST(count(x.event_id) AS BIGINT) AS n
FROM (SELECT mm.model, a.label AS t, b.label AS p FROM (SELECT DISTINCT model FROM messy) mm, {LABS} a, {LABS} b) g
LEFT JOIN messy x ON x.model=g.model AND x.true_label=g.t AND x.pred_label=g.p GROUP BY 1,2,3""")
def _(spark, d):
    return K.confusion_matrix(messy(spark, d))


@q("overall_metrics", f""", {MESSY},
b AS (SELECT * FROM messy WHERE {BOTH}),
s AS (SELECT mm.model, l.label, (SELECT count(*) FROM b WHERE b.model=mm.model AND true_label=l.label AND pred_label=l.label) tp,
  (SELECT count(*) FROM b WHERE b.model=mm.model AND true_label=l.label) t, (SELECT count(*) FROM b WHERE b.model=mm.model AND pred_label=l.label) p
  FROM (SELECT DISTINCT model FROM messy) mm, {LABS} l)
SELECT model, (SELECT CAST(count(*) AS BIGINT) FROM messy z WHERE z.model=s.model AND z.true_label IN {VALID}) AS N,
 round(CAST(sum(tp) AS DOUBLE)/sum(t),3) AS accuracy, round(avg({ratio('tp','p')}),3) AS precision_macro,
 round(avg({ratio('tp','t')}),3) AS recall_macro FROM s GROUP BY model""")
def _(spark, d):
    return K.overall_metrics(messy(spark, d))


@q("per_class_report", f""", {MESSY},
s AS (SELECT mm.model, l.label, (SELECT count(*) FROM messy b WHERE b.model=mm.model AND true_label=l.label AND pred_label=l.label) tp,
  (SELECT count(*) FROM messy b WHERE b.model=mm.model AND true_label=l.label) t, (SELECT count(*) FROM messy b WHERE b.model=mm.model AND pred_label=l.label) p
  FROM (SELECT DISTINCT model FROM messy) mm, (SELECT DISTINCT true_label AS label FROM messy WHERE true_label IS NOT NULL) l)
SELECT model, label, {r6(ratio('tp','p'))} AS precision, {r6(ratio('tp','t'))} AS recall, {r6(ratio('2*tp','p+t'))} AS f1,
 CAST(t AS BIGINT) AS support FROM s""")
def _(spark, d):
    return rounded(K.per_class_report(messy(spark, d)))


@q("core_table", f""", {MESSY},
b AS (SELECT * FROM messy WHERE {BOTH}),
g AS (SELECT model, country, count(*) n, {cnt('true_label=pred_label')} hit FROM b GROUP BY 1,2),
s AS (SELECT g.model, g.country, l.label, (SELECT count(*) FROM b WHERE b.model=g.model AND b.country=g.country AND true_label=l.label AND pred_label=l.label) tp,
  (SELECT count(*) FROM b WHERE b.model=g.model AND b.country=g.country AND true_label=l.label) t,
  (SELECT count(*) FROM b WHERE b.model=g.model AND b.country=g.country AND pred_label=l.label) p FROM g, {LABS} l),
f AS (SELECT model, country, label, {ratio('2*tp','t+p')} AS f1 FROM s)
SELECT g.model, g.country, CAST(any_value(n) AS BIGINT) AS n, round(CAST(any_value(hit) AS DOUBLE)/any_value(n),4) AS accuracy,
 round((max(f1) FILTER (label='V')+max(f1) FILTER (label='B')+max(f1) FILTER (label='E')+max(f1) FILTER (label='P')+max(f1) FILTER (label='R')+max(f1) FILTER (label='S'))/6.0::DOUBLE,4) AS macro_f1,
 {', '.join(f"round(max(f1) FILTER (label='{x}'),4) AS f1_{x}" for x in 'VBEPRS')}
FROM g JOIN f ON g.model=f.model AND g.country=f.country GROUP BY 1,2""")
def _(spark, d):
    return K.core_table(messy(spark, d))


@q("f1_matrix", f""",
s AS (SELECT model, l.label, {cnt('true_label=l.label AND pred_label=l.label')} tp, {cnt('true_label=l.label')} t, {cnt('pred_label=l.label')} p
 FROM preds, {LABS} l GROUP BY 1,2), f AS (SELECT model, label, {ratio('2*tp','t+p')} f1 FROM s)
SELECT label, {', '.join(f"{r6(f'''max(f1) FILTER (model='{m}')''')} AS {m}" for m in MODELS)} FROM f GROUP BY 1""")
def _(spark, d):
    return rounded(K.f1_matrix(K.per_class_report(predictions(spark, d)), MODELS))


_BIN = """CASE WHEN n_chars>0 AND n_chars<=100 THEN 'very_short' WHEN n_chars>100 AND n_chars<=200 THEN 'short' WHEN n_chars>200 AND n_chars<=300 THEN 'medium'
 WHEN n_chars>300 AND n_chars<=500 THEN 'long' WHEN n_chars>500 THEN 'very_long' END"""


@q("length_error_rates", f""",
x AS (SELECT model, {_BIN} AS length_bin, CAST(true_label<>pred_label AS INT) AS err, avg(CAST(true_label<>pred_label AS INT)) OVER (PARTITION BY model) AS o FROM preds WHERE {BOTH})
SELECT model, length_bin, CAST(count(*) AS BIGINT) AS n_samples, {r6('avg(err)')} AS error_rate, {r6('avg(err)-any_value(o)')} AS error_rate_diff_from_overall
FROM x WHERE length_bin IS NOT NULL GROUP BY 1,2""")
def _(spark, d):
    return rounded(K.length_error_rates(predictions(spark, d), "n_chars"))


_RHO = f""",
x AS (SELECT model, n_chars, CAST(true_label<>pred_label AS INT) AS err FROM preds WHERE {BOTH}),
y AS (SELECT model, rank() OVER (PARTITION BY model ORDER BY n_chars) + (count(*) OVER (PARTITION BY model, n_chars) - 1)/2.0::DOUBLE AS rx,
 rank() OVER (PARTITION BY model ORDER BY err) + (count(*) OVER (PARTITION BY model, err) - 1)/2.0::DOUBLE AS ry FROM x)
SELECT model, CAST(count(*) AS BIGINT) AS n_samples, {r6('corr(rx,ry)')} AS correlation FROM y GROUP BY 1 HAVING count(*)>10"""


@q("length_error_correlation", _RHO)
def _(spark, d):
    return rounded(K.length_error_correlation(predictions(spark, d), "n_chars", with_p=False))


@q("length_error_correlation_test", _RHO.replace("SELECT model, CAST(count(*) AS BIGINT) AS n_samples, " + r6('corr(rx,ry)') + " AS correlation FROM y GROUP BY 1 HAVING count(*)>10",
                                                 "c AS (SELECT model, count(*) AS n, corr(rx,ry) AS r FROM y GROUP BY 1 HAVING count(*)>10)")
   .replace("FROM x)\nc AS", "FROM x),\nc AS") + f""",
t AS (SELECT *, r*sqrt((n-2)/(1-r*r)) AS t FROM c) SELECT model, CAST(n AS BIGINT) AS n_samples, {r6('r')} AS correlation, {r6(t_p_sql('t', '(n-2)'))} AS p_value FROM t""")
def _(spark, d):
    return rounded(K.length_error_correlation(predictions(spark, d), "n_chars"))


# Harm ------------------------------------------------------------------------

_FL = "true_label='V' AND pred_label IN ('B','S')"
_FI = "true_label IN ('B','S') AND pred_label='V'"


@q("fl_fi_counts", f""", {MESSY}
SELECT model, country, CAST(count(*) AS BIGINT) AS total, {cnt(_FL)} AS fl, {cnt(_FI)} AS fi FROM messy GROUP BY 1,2""")
def _(spark, d):
    return H.fl_fi_counts(messy(spark, d), ["model", "country"])


def _harm_sql(by, src="preds"):
    leg, ill = cnt("true_label IN ('B','S')"), cnt("true_label='V'")
    return f"""SELECT {by}, {r6(ratio(cnt(_FL), ill))} AS "false_legitimization_rate_FLR", {cnt(_FL)} AS "false_legitimization_count_FL", {ill} AS n_illegit_events,
 {r6(ratio(cnt(_FI), leg))} AS "false_illegitimization_rate_FIR", {cnt(_FI)} AS "false_illegitimization_count_FI", {leg} AS n_legit_events,
 CAST(count(*) AS BIGINT) AS total_events, {r6(ratio(cnt(_FL), cnt(_FI), "CAST('inf' AS DOUBLE)"))} AS "harm_ratio_FL_to_FI" FROM {src} GROUP BY {by}"""


@q("harm_rates", f", {MESSY} " + _harm_sql("model", "messy"))
def _(spark, d):
    return rounded(H.harm_rates(messy(spark, d)))


@q("harm_rates_by_country", _harm_sql("model, country"))
def _(spark, d):
    return rounded(H.harm_rates(predictions(spark, d), ["model", "country"]))


@q("binary_harm", f""", {MESSY}
SELECT model, {cnt("true_label='V'")} AS n_violence, {cnt("true_label<>'V'")} AS n_non_violence, {cnt("true_label='V' AND pred_label<>'V'")} AS false_legitimization_count,
 {cnt("true_label<>'V' AND pred_label='V'")} AS false_illegitimization_count,
 round({ratio(cnt("true_label='V' AND pred_label<>'V'"), cnt("true_label='V'"))},4) AS false_legitimization_rate,
 round({ratio(cnt("true_label<>'V' AND pred_label='V'"), cnt("true_label<>'V'"))},4) AS false_illegitimization_rate
FROM messy WHERE {BOTH} GROUP BY 1""")
def _(spark, d):
    return H.binary_harm(messy(spark, d))


_CONDITION = "CASE event_id%4 WHEN 0 THEN 'zero_shot' WHEN 1 THEN 'few_shot_1' WHEN 2 THEN 'few_shot_3' ELSE 'few_shot_5' END"


def _wilson(k, n, side, z="1.96"):
    z2 = f"(CAST({z} AS DOUBLE)*CAST({z} AS DOUBLE))"
    p = f"(CAST({k} AS DOUBLE)/{n})"
    center = f"(({p}+{z2}/(2*{n}))/(1+{z2}/{n}))"
    margin = f"(CAST({z} AS DOUBLE)*sqrt(({p}*(1-{p})+{z2}/(4*{n}))/{n})/(1+{z2}/{n}))"
    v = f"greatest(CAST(0 AS DOUBLE),{center}-{margin})" if side == "lo" else f"least(CAST(1 AS DOUBLE),{center}+{margin})"
    return r6(f"CASE WHEN {n}>0 THEN {v}*100 ELSE 0 END")


_STEP_P = """CASE WHEN n_fl+n_fi=0 THEN CAST(1 AS DOUBLE) WHEN n_fl+n_fi>20 THEN
 CASE WHEN abs(n_fl-(n_fl+n_fi)/2)/sqrt((n_fl+n_fi)/4)>3 THEN 0.001 WHEN abs(n_fl-(n_fl+n_fi)/2)/sqrt((n_fl+n_fi)/4)>2.576 THEN 0.01
 WHEN abs(n_fl-(n_fl+n_fi)/2)/sqrt((n_fl+n_fi)/4)>1.96 THEN 0.05 WHEN abs(n_fl-(n_fl+n_fi)/2)/sqrt((n_fl+n_fi)/4)>1 THEN 0.2 ELSE 1 END
 WHEN abs(n_fl-(n_fl+n_fi)/2)<2 THEN 1 ELSE 0.05 END"""

_PAIR_COUNTS = (f"""{cnt("true_label='V'")} AS true_v, {cnt("true_label='B'")} AS true_b, {cnt("true_label='V' AND pred_label='B'")} AS n_fl,
 {cnt("true_label='B' AND pred_label='V'")} AS n_fi""")
_PCT = f"{ratio('n_fl*100','true_v')} AS fl_pct, {ratio('n_fi*100','true_b')} AS fi_pct"
_CI = f"""{_wilson('n_fl','true_v','lo')} AS fl_ci_lower, {_wilson('n_fl','true_v','hi')} AS fl_ci_upper,
 {_wilson('n_fi','true_b','lo')} AS fi_ci_lower, {_wilson('n_fi','true_b','hi')} AS fi_ci_upper"""


@q("pair_summary_by_condition", f""",
c AS (SELECT model, {_CONDITION} AS condition, {_PAIR_COUNTS} FROM preds GROUP BY 1,2), p AS (SELECT *, {_PCT} FROM c)
SELECT model, condition, true_v, true_b, n_fl, n_fi, {r6('fl_pct')} AS fl_pct, {r6('fi_pct')} AS fi_pct, {_CI}, {r6('fi_pct-fl_pct')} AS delta_lb,
 CAST({_STEP_P} AS DOUBLE) AS p_value FROM p""")
def _(spark, d):
    return rounded(H.order_by_condition(H.pair_summary(predictions(spark, d).withColumn("condition", F.expr(_CONDITION)))))


_ACTORS = f"""a AS (SELECT 'Police' AS actor UNION ALL SELECT 'Military' UNION ALL SELECT 'Total'),
c AS (SELECT model, actor, {_PAIR_COUNTS} FROM preds JOIN a ON actor='Total' OR contains(lower(actor_norm), lower(actor)) GROUP BY 1,2),
p AS (SELECT *, {_PCT} FROM c)"""


@q("actor_summary", f""", {_ACTORS}
SELECT model, actor, true_v, true_b, n_fl, n_fi, {r6('fl_pct')} AS fl_pct, {r6('fi_pct')} AS fi_pct, {_CI}, {r6('fi_pct-fl_pct')} AS delta_lb,
 CAST({_STEP_P} AS DOUBLE) AS p_value FROM p""")
def _(spark, d):
    return rounded(H.actor_summary(predictions(spark, d)))


_CI_EXACT = ", ".join(f"{_wilson(k, n, s, '1.959963984540054')} AS {x}_ci_{e}" for k, n, x in (("n_fl", "true_v", "fl"), ("n_fi", "true_b", "fi"))
                      for s, e in (("lo", "lower"), ("hi", "upper")))
_BIAS = f"""w AS (SELECT model, actor, true_v, true_b, n_fl, n_fi, fl_pct, fi_pct, {_CI_EXACT}, fi_pct-fl_pct AS delta,
 {ratio('fi_pct-fl_pct','fi_pct+fl_pct')} AS nbs, CASE WHEN fl_pct>0 THEN fi_pct/fl_pct WHEN fi_pct>0 THEN CAST('inf' AS DOUBLE) ELSE 1 END AS rr FROM p)"""
_TOTAL = "CASE WHEN actor='Total' THEN {} END AS {}"


@q("bias_table", f""", {_ACTORS}, {_BIAS}
SELECT model, actor, true_v, true_b, n_fl, n_fi, {r6('fl_pct')} AS fl_pct, {r6('fi_pct')} AS fi_pct,
 {', '.join(_TOTAL.format(c, c) for c in ('fl_ci_lower','fl_ci_upper','fi_ci_lower','fi_ci_upper'))}, {_TOTAL.format(r6('delta'),'delta_lb')},
 {r6('nbs')} AS nbs, {_TOTAL.format(r6('rr'),'risk_ratio')} FROM w""")
def _(spark, d):
    return rounded(H.bias_table(predictions(spark, d), with_p=False))


# Exact two-sided p at one half is twice the smaller tail; the tail is summed in log space.
@q("bias_significance", f""", {_ACTORS}, {_BIAS},
z AS (SELECT model, actor, rr, n_fl+n_fi AS n, least(n_fl,n_fi) AS k FROM w WHERE actor='Total'),
v AS (SELECT model, rr, CASE WHEN n=0 OR 2*k=n THEN CAST(1 AS DOUBLE) ELSE least(CAST(1 AS DOUBLE), 2*list_sum(list_transform(range(k+1), lambda i: exp(lgamma(n+1)-lgamma(i+1)-lgamma(n-i+1)-n*ln(2))))) END AS p FROM z)
SELECT model, {r6('p')} AS p_value, CASE WHEN p>=0.05 THEN 'No bias' WHEN rr>1.5 THEN 'Strong Deleg.' WHEN rr>1.1 THEN 'Weak Deleg.'
 WHEN rr<0.67 THEN 'Strong Legit.' WHEN rr<0.91 THEN 'Weak Legit.' ELSE 'No bias' END AS interpretation FROM v""")
def _(spark, d):
    return rounded(H.bias_table(predictions(spark, d)).where("actor = 'Total'").select("model", "p_value", "interpretation"))


# Fairness --------------------------------------------------------------------

_GROUPS = f""", {MESSY},
f AS (SELECT model, country, true_label, pred_label, CASE WHEN actor_norm IS NULL THEN 'unknown' WHEN regexp_matches(lower(actor_norm),'state forces|military|police|government|gendarmerie')
 THEN 'state' ELSE 'non-state' END AS g FROM messy WHERE {BOTH})"""


def _rate(g, cond):
    return f"coalesce(avg(CAST(pred_label='V' AS INT)) FILTER (WHERE g='{g}'{cond}),0)"


@q("parity", _GROUPS + f"""
SELECT model, country, 'V' AS target_label, {cnt("g='state'")} AS n_state, {cnt("g='non-state'")} AS n_nonstate,
 {r6(_rate('state', '') + '-' + _rate('non-state', ''))} AS "SPD" FROM f GROUP BY 1,2 HAVING {cnt("g='state'")}>0 AND {cnt("g='non-state'")}>0""")
def _(spark, d):
    return rounded(A.parity(messy(spark, d), by=["model", "country"]))


_POS, _NEG = " AND true_label='V'", " AND true_label<>'V'"


@q("equalized_odds", _GROUPS + f"""
SELECT model, {r6(_rate('state', _POS))} AS "TPR_state", {r6(_rate('non-state', _POS))} AS "TPR_nonstate", {r6(_rate('state', _POS)+'-'+_rate('non-state', _POS))} AS "TPR_diff",
 {r6(_rate('state', _NEG))} AS "FPR_state", {r6(_rate('non-state', _NEG))} AS "FPR_nonstate", {r6(_rate('state', _NEG)+'-'+_rate('non-state', _NEG))} AS "FPR_diff"
FROM f GROUP BY 1 HAVING {cnt("g='state'")}>0 AND {cnt("g='non-state'")}>0""")
def _(spark, d):
    return rounded(A.equalized_odds(messy(spark, d)))


def _fair_sql(by):
    """The fixed columns by value; interval and p values, which are drawn, have passed the checks of ``_fair``."""
    pos, neg = "true_label='V'", "true_label<>'V'"
    sizes = {"state": "g='state'", "non-state": "g='non-state'"}
    return f""", g AS (SELECT *, CASE WHEN regexp_matches(lower(actor_norm),'state forces|military|police|government|gendarmerie') THEN 'state' ELSE 'non-state' END AS g FROM preds)
SELECT {by}, 'V' AS target_label, {cnt(sizes['state'])} AS n_state, {cnt(sizes['non-state'])} AS n_nonstate, {r6(_rate('state', '') + '-' + _rate('non-state', ''))} AS "SPD",
 {r6(_rate('state', f' AND {pos}'))} AS "TPR_state", {r6(_rate('non-state', f' AND {pos}'))} AS "TPR_nonstate", {r6(_rate('state', f' AND {pos}') + '-' + _rate('non-state', f' AND {pos}'))} AS "TPR_diff",
 {r6(_rate('state', f' AND {neg}'))} AS "FPR_state", {r6(_rate('non-state', f' AND {neg}'))} AS "FPR_nonstate", {r6(_rate('state', f' AND {neg}') + '-' + _rate('non-state', f' AND {neg}'))} AS "FPR_diff",
 'hypergeometric' AS permutation_draws, true AS interval_fits, {cnt(pos)}<=10 OR {cnt(pos + " AND g='state'")}=0 OR {cnt(pos + " AND g='non-state'")}=0 AS "TPR_untested",
 {cnt(neg)}<=10 OR {cnt(neg + " AND g='state'")}=0 OR {cnt(neg + " AND g='non-state'")}=0 AS "FPR_untested", true AS p_fits
FROM g GROUP BY {by} HAVING {cnt(sizes['state'])}>0 AND {cnt(sizes['non-state'])}>0"""


def _fair(table, groups, by, draws):
    """Drawn columns held against their normal forms.

    The interval must hold the parity's normal interval's middle and have about its
    width; a permutation p must lie within five standard errors of the draws (plus
    the width of the largest step) around the normal p with and without correction.
    """
    g = groups.select(*by, *[c for c in groups.columns if c not in by])
    t = table.join(g, by)
    rate = lambda k, n: F.col(k) / F.greatest(F.col(n), F.lit(1))
    spread_ = F.sqrt(rate("s_hit", "s_all") * (1 - rate("s_hit", "s_all")) / F.col("s_all") + rate("n_hit", "n_all") * (1 - rate("n_hit", "n_all")) / F.col("n_all"))
    width = F.col("SPD_CI_upper") - F.col("SPD_CI_lower")
    step = 1.0 / F.least(F.col("s_all"), F.col("n_all"))
    t = t.withColumn("interval_fits", (F.col("SPD_CI_lower") <= F.col("SPD") + step) & (F.col("SPD") <= F.col("SPD_CI_upper") + step)
                     & (F.abs(width - 3.92 * spread_) <= 0.25 * 3.92 * spread_ + 2 * step))
    fits = F.lit(True)
    for side, a, k, b, m in (("TPR", "s_pos", "s_tp", "n_pos", "n_tp"), ("FPR", "s_neg", "s_fp", "n_neg", "n_fp")):
        p, n = F.col(f"{side}_pvalue"), (F.col(a) + F.col(b)).cast("double")
        share = (F.col(k) + F.col(m)) / F.greatest(n, F.lit(1.0))
        deviation = F.sqrt(share * (1 - share) * n * n / F.greatest(n - 1, F.lit(1.0)) / F.greatest(F.col(a) * F.col(b), F.lit(1)))
        gap = F.abs(rate(k, a) - rate(m, b))
        tick = n / F.greatest(F.col(a) * F.col(b), F.lit(1))
        # The normal two-sided p by a logistic form that is within 0.02 of it everywhere.
        two = lambda z: 2 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))
        z = lambda d: F.greatest(d, F.lit(0.0)) / F.greatest(deviation, F.lit(1e-9))
        slack = 5 * F.sqrt(F.lit(0.25) / draws) + 0.02
        fits = fits & F.coalesce((p >= two(z(gap + tick)) - slack) & (p <= two(z(gap - tick)) + slack), F.lit(True))
        t = t.withColumn(f"{side}_untested", p.isNull())
    return rounded(t.withColumn("p_fits", fits).select(*[c for c in table.columns if c not in ("SPD_CI_lower", "SPD_CI_upper", "TPR_pvalue", "FPR_pvalue")],
                                                       "interval_fits", "TPR_untested", "FPR_untested", "p_fits"))


@q("fairness_table", _fair_sql("model"))
def _(spark, d):
    p = predictions(spark, d)
    return _fair(A.fairness_table(p), A.group_counts(p), ["model"], 1000)


@q("fairness_by_country", _fair_sql("model, country"))
def _(spark, d):
    p, by = predictions(spark, d), ["model", "country"]
    return _fair(A.fairness_table(p, by=by, n_bootstrap=300), A.group_counts(p, by=by), by, 300)


def _choose(n, k):
    return f"(lgamma({n}+1)-lgamma({k}+1)-lgamma({n}-{k}+1))"


def _odds_sql(by):
    """Every count that a shuffle can give, with its hypergeometric weight."""
    return f""", o AS (SELECT {by}, CASE WHEN true_label='V' THEN 'TPR' ELSE 'FPR' END AS side, CAST(pred_label='V' AS BIGINT) AS hit,
 CAST(regexp_matches(lower(actor_norm),'state forces|military|police|government|gendarmerie') AS BIGINT) AS st FROM preds),
c AS (SELECT {by}, side, count(*) AS n, CAST(sum(hit) AS BIGINT) AS k, CAST(sum(st) AS BIGINT) AS na, CAST(sum(hit*st) AS BIGINT) AS ka FROM o GROUP BY ALL),
x AS (SELECT *, unnest(range(greatest(0, na-(n-k)), least(k, na)+1)) AS x FROM c),
w AS (SELECT {by}, side, n, k, na, ka, sum(CASE WHEN abs(x*n-k*na)>=abs(ka*n-k*na) THEN exp({_choose('k', 'x')}+{_choose('(n-k)', '(na-x)')}-{_choose('n', 'na')}) ELSE 0 END) AS p FROM x GROUP BY ALL),
v AS (SELECT {by}, side, CASE WHEN na>0 THEN ka/na ELSE 0 END - CASE WHEN n>na THEN (k-ka)/(n-na) ELSE 0 END AS gap, CASE WHEN n>10 AND na>0 AND na<n THEN least(p, 1) END AS p FROM w),
b AS (SELECT {by} FROM o GROUP BY {by} HAVING sum(st)>0 AND sum(1-st)>0)
SELECT {by}, {r6("coalesce(max(CASE WHEN side='TPR' THEN gap END), 0)")} AS "TPR_diff", {r6("max(CASE WHEN side='TPR' THEN p END)")} AS "TPR_pvalue",
 {r6("coalesce(max(CASE WHEN side='FPR' THEN gap END), 0)")} AS "FPR_diff", {r6("max(CASE WHEN side='FPR' THEN p END)")} AS "FPR_pvalue" FROM v JOIN b USING ({by}) GROUP BY {by}"""


@q("equalized_odds_exact", _odds_sql("model"))
def _(spark, d):
    return rounded(A.equalized_odds_test(predictions(spark, d)))


@q("equalized_odds_exact_by_country", _odds_sql("model, country"))
def _(spark, d):
    return rounded(A.equalized_odds_test(predictions(spark, d), by=["model", "country"]))


def _interval_sql(by):
    """Every pair of resampled counts with its weight, added up along the difference of the shares."""
    def law(n, k, x):
        return f"CASE WHEN {k}=0 THEN CAST({x}=0 AS DOUBLE) WHEN {k}={n} THEN CAST({x}={n} AS DOUBLE) ELSE exp({_choose(n, x)}+{x}*ln({k}/{n})+({n}-{x})*ln(1-{k}/{n})) END"
    return f""", o AS (SELECT {by}, CAST(pred_label='V' AS BIGINT) AS hit, regexp_matches(lower(actor_norm),'state forces|military|police|government|gendarmerie') AS st FROM preds),
c AS (SELECT {by}, count(*) FILTER (st) AS na, count(*) FILTER (st AND hit=1) AS ka, count(*) FILTER (NOT st) AS nb, count(*) FILTER (NOT st AND hit=1) AS kb FROM o GROUP BY ALL HAVING na>0 AND nb>0),
xs AS (SELECT *, {law('na', 'ka', 'x')} AS px FROM (SELECT *, unnest(range(0, na+1)) AS x FROM c)),
ys AS (SELECT {by}, y, {law('nb', 'kb', 'y')} AS py FROM (SELECT *, unnest(range(0, nb+1)) AS y FROM c)),
g AS (SELECT {by}, na, ka, nb, kb, x*nb-y*na AS t, sum(px*py) AS p FROM xs JOIN ys USING ({by}) WHERE px>1e-18 AND py>1e-18 GROUP BY ALL),
f AS (SELECT *, sum(p) OVER (PARTITION BY {by} ORDER BY t) AS upto FROM g),
i AS (SELECT {by}, na, ka, nb, kb, min(t) FILTER (upto>=0.025::DOUBLE)/(na*nb) AS lo, min(t) FILTER (upto>=0.975::DOUBLE)/(na*nb) AS hi FROM f GROUP BY {by}, na, ka, nb, kb)
SELECT {by}, 'V' AS target_label, na AS n_state, nb AS n_nonstate, {r6('ka/na-kb/nb')} AS "SPD", {r6('lo')} AS "SPD_CI_lower", {r6('hi')} AS "SPD_CI_upper", (lo>0 OR hi<0) AS significant FROM i"""


@q("parity_interval_exact", _interval_sql("model"))
def _(spark, d):
    return rounded(A.parity_interval(predictions(spark, d)))


@q("parity_interval_exact_by_country", _interval_sql("model, country"))
def _(spark, d):
    return rounded(A.parity_interval(predictions(spark, d), by=["model", "country"]))


# Each country stands for one fairness file; its interval is the parity plus or minus a tenth.
@q("parity_rollup", _GROUPS + f""",
t AS (SELECT model, country, {_rate('state', '')}-{_rate('non-state', '')} AS spd, {cnt("g='state'")} AS n_state FROM f GROUP BY 1,2
 HAVING {cnt("g='state'")}>0 AND {cnt("g='non-state'")}>0),
a AS (SELECT model, avg(spd) s, avg(spd-0.1::DOUBLE) lo, avg(spd+0.1::DOUBLE) hi, avg(n_state) n FROM t GROUP BY 1)
SELECT model, {r6('s')} AS "SPD_mean", {r6('lo')} AS "SPD_ci_low", {r6('hi')} AS "SPD_ci_high", {r6('n')} AS n_state, {r6('s-lo')} AS err_low, {r6('hi-s')} AS err_high,
 (lo>0 OR hi<0) AS significant FROM a""")
def _(spark, d):
    t = A.parity(messy(spark, d), by=["model", "country"])
    t = t.withColumns({"SPD_CI_lower": F.col("SPD") - 0.1, "SPD_CI_upper": F.col("SPD") + 0.1})
    return rounded(A.parity_rollup(t))


# Calibration -------------------------------------------------------------------

_TEMP = "(CASE WHEN {p}<1e-12 THEN 1e-12::DOUBLE WHEN {p}>1-1e-12 THEN 1-1e-12::DOUBLE ELSE {p} END)"


def _temp_sql(p="pred_conf", t="(1+mi/2)"):
    c = _TEMP.format(p=p)
    return f"(1/(1+exp(-ln({c}/(1-{c}))/{t})))"


def temp(df):
    return df.withColumn("pred_conf_temp", C.temperature_scale(C.confidence("pred_conf"), 1.0 + F.col("mi") / 2.0))


@q("temperature_scaling", f"SELECT model, event_id, {r6(_temp_sql())} AS pred_conf_temp FROM preds")
def _(spark, d):
    return rounded(temp(predictions(spark, d)).select("model", "event_id", "pred_conf_temp"))


_LG = "lg AS (SELECT *, CASE WHEN json_valid(logits) THEN logits ELSE 'null' END AS js FROM cal)"
_VEC = ", ".join(f"CASE json_type(js) WHEN 'OBJECT' THEN coalesce(CAST(json_extract_string(js,'$.{x}') AS DOUBLE),0) "
                 f"WHEN 'ARRAY' THEN CASE WHEN json_array_length(js)=6 THEN CAST(json_extract_string(js,'$[{i}]') AS DOUBLE) END END AS z{x}"
                 for i, x in enumerate("VBEPRS"))
_PROBS = f"""{_LG}, v AS (SELECT *, {_VEC} FROM lg), w AS (SELECT *, greatest(zV,zB,zE,zP,zR,zS)/2 AS zmax FROM v),
ex AS (SELECT *, {', '.join(f'exp(z{x}/2-zmax) AS e{x}' for x in 'VBEPRS')} FROM w),
pr AS (SELECT *, {', '.join(f'e{x}/(eV+eB+eE+eP+eR+eS+1e-12::DOUBLE) AS prob_{x}' for x in 'VBEPRS')} FROM ex)"""


@q("class_probabilities", f""", {_PROBS} SELECT model, event_id, {', '.join(f'{r6(f"prob_{x}")} AS "prob_{x}"' for x in 'VBEPRS')} FROM pr""")
def _(spark, d):
    p = spread(calibrated(spark, d)).withColumn("_p", C.class_probabilities(F.col("logits"), F.lit(2.0)))
    return rounded(p.select("model", "event_id", *[F.get("_p", F.lit(i)).alias(f"prob_{x}") for i, x in enumerate("VBEPRS")]))


@q("logits_vector", f""", {_LG}, v AS (SELECT *, {_VEC} FROM lg) SELECT model, event_id, CASE WHEN zV IS NOT NULL THEN concat_ws(',', zV, zB, zE, zP, zR, zS) END AS logits FROM v""")
def _(spark, d):
    v = C.logits_vector(F.col("logits"))
    return calibrated(spark, d).select("model", "event_id", F.when(v.isNotNull(), F.concat_ws(",", F.transform(v, lambda x: x.cast("string")))).alias("logits"))


def _split(spark, d):
    return S.calibration_split(spread(calibrated(spark, d)))


_RANKED = "z AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY md5(concat('42|', CAST(event_id AS STRING))), event_id) AS rn, count(*) OVER (PARTITION BY model) AS n FROM cal)"


@q("calibration_split", f""", {_RANKED} SELECT model, event_id, rn<=ceil(n*0.2::DOUBLE) AS is_test, rn>ceil(n*0.2::DOUBLE) OR n<2 AS is_train FROM z""")
def _(spark, d):
    return _split(spark, d).select("model", "event_id", "is_test", "is_train")


# The isotonic fit at a point is the largest, over starts up to it, of the smallest mean of a stretch from there over it.
_ISO = f"""{_RANKED}, pts AS (SELECT model, pred_conf AS x, sum(CAST(true_label=pred_label AS INT)) AS s, count(*) AS n FROM z WHERE (rn>ceil(n*0.2::DOUBLE) OR n<2) AND {BOTH} GROUP BY 1,2),
cum AS (SELECT model, x, s, n, sum(s) OVER w AS cs, sum(n) OVER w AS cn, row_number() OVER w AS i FROM pts WINDOW w AS (PARTITION BY model ORDER BY x)),
stretch AS (SELECT a.model, a.i AS a, b.i AS b, (b.cs-a.cs+a.s)/CAST(b.cn-a.cn+a.n AS DOUBLE) AS mean FROM cum a JOIN cum b ON a.model=b.model AND a.i<=b.i),
least_ AS (SELECT model, a, b, min(mean) OVER (PARTITION BY model, a ORDER BY b DESC) AS v FROM stretch),
fit AS (SELECT model, b AS i, max(v) AS y FROM least_ GROUP BY 1,2), fx AS (SELECT fit.model, x, y FROM fit JOIN cum ON cum.model=fit.model AND cum.i=fit.i),
grid AS (SELECT model, k, k/100.0::DOUBLE AS g FROM (SELECT DISTINCT model FROM fx) CROSS JOIN (SELECT unnest(range(101)) AS k)),
near_ AS (SELECT grid.model, k, g, max(x) FILTER (x<=g+1e-9) AS x0, min(x) FILTER (x>=g-1e-9) AS x1 FROM grid JOIN fx ON fx.model=grid.model GROUP BY 1,2,3),
iso AS (SELECT n.model, k, g AS x, CASE WHEN x0 IS NULL THEN b.y WHEN x1 IS NULL OR x1-x0<1e-9 THEN a.y ELSE a.y+(b.y-a.y)*(g-x0)/(x1-x0) END AS y
 FROM near_ n LEFT JOIN fx a ON a.model=n.model AND a.x=x0 LEFT JOIN fx b ON b.model=n.model AND b.x=x1)"""


@q("isotonic_maps", f", {_ISO} SELECT model, {r6('x')} AS x, {r6('y')} AS y FROM iso")
def _(spark, d):
    m = C.isotonic_maps(_split(spark, d).where("is_train"))
    return rounded(m.select("model", F.explode(F.arrays_zip("x", "y")).alias("p")).select("model", "p.x", "p.y"))


def _calibrated_test(spark, d):
    s = _split(spark, d)
    maps = C.isotonic_maps(s.where("is_train"))
    params = spark.createDataFrame([(m, 1.0 + i / 2.0, 2.0) for i, m in enumerate(MODELS)], "model string, T double, T_multiclass double")
    return C.apply_calibration(s.where("is_test"), maps, params)


_ISO_TEST = f"""{_ISO}, ct AS (SELECT z.*, iso.y AS pred_conf_iso, {_temp_sql()} AS pred_conf_temp FROM z JOIN iso ON iso.model=z.model AND iso.k=CAST(round(pred_conf*100) AS BIGINT) WHERE rn<=ceil(n*0.2::DOUBLE))"""


@q("calibrated_predictions", f""", {_ISO_TEST}, {_PROBS} SELECT ct.model, ct.event_id, {r6('pred_conf_iso')} AS pred_conf_iso, {r6('pred_conf_temp')} AS pred_conf_temp,
 {', '.join(f'{r6(f"prob_{x}")} AS "prob_{x}"' for x in 'VBEPRS')} FROM ct JOIN pr ON pr.model=ct.model AND pr.event_id=ct.event_id""")
def _(spark, d):
    return rounded(_calibrated_test(spark, d).select("model", "event_id", "pred_conf_iso", "pred_conf_temp", *[f"prob_{x}" for x in "VBEPRS"]))




# A monotone stand-in for the isotonic column lets the scores be checked in SQL.
_THREE = f"three AS (SELECT *, pred_conf*pred_conf AS pred_conf_iso, {_temp_sql()} AS pred_conf_temp FROM preds)"


def three(spark, d):
    return temp(predictions(spark, d)).withColumn("pred_conf_iso", F.col("pred_conf") * F.col("pred_conf"))


def _bs(c):
    return f"avg(({c}-CAST(true_label=pred_label AS INT))*({c}-CAST(true_label=pred_label AS INT)))"


def _brier_sql(table):
    return f"""b AS (SELECT model, count(*) n, {_bs('pred_conf')} r, {_bs('pred_conf_iso')} i, {_bs('pred_conf_temp')} t FROM {table} WHERE {BOTH} GROUP BY 1)
SELECT model, CAST(n AS BIGINT) AS n_samples, {r6('r')} AS brier_score_raw, {r6('i')} AS brier_score_isotonic, {r6('t')} AS brier_score_temperature,
 {r6('CASE WHEN r<>0 AND i<>0 THEN r-i END')} AS brier_improvement_iso, {r6('CASE WHEN r<>0 AND t<>0 THEN r-t END')} AS brier_improvement_temp FROM b"""


@q("brier_scores_calibrated", f", {_ISO_TEST}, {_brier_sql('ct')}")
def _(spark, d):
    return rounded(C.brier_scores(_calibrated_test(spark, d)))


@q("brier_scores", f""", {_THREE}, b AS (SELECT model, count(*) n, {_bs('pred_conf')} r, {_bs('pred_conf_iso')} i, {_bs('pred_conf_temp')} t FROM three WHERE {BOTH} GROUP BY 1)
SELECT model, CAST(n AS BIGINT) AS n_samples, {r6('r')} AS brier_score_raw, {r6('i')} AS brier_score_isotonic, {r6('t')} AS brier_score_temperature,
 {r6('CASE WHEN r<>0 AND i<>0 THEN r-i END')} AS brier_improvement_iso, {r6('CASE WHEN r<>0 AND t<>0 THEN r-t END')} AS brier_improvement_temp FROM b""")
def _(spark, d):
    return rounded(C.brier_scores(three(spark, d)))


_LONG = "long AS (" + " UNION ALL ".join(f"SELECT model, event_id, true_label, pred_label, '{c}' AS prob_col, {c} AS p FROM three" for c in C.CONFIDENCES) + ")"


@q("reliability_curve", f""", {_THREE}, {_LONG},
b AS (SELECT *, CAST((p>0.1::DOUBLE)::INT+(p>0.2::DOUBLE)::INT+(p>0.1::DOUBLE*3)::INT+(p>0.4::DOUBLE)::INT+(p>0.5::DOUBLE)::INT+(p>0.1::DOUBLE*6)::INT+(p>0.1::DOUBLE*7)::INT+(p>0.8::DOUBLE)::INT+(p>0.9::DOUBLE)::INT AS INT) AS bin FROM long WHERE {BOTH})
SELECT model, prob_col, bin, CAST(count(*) AS BIGINT) AS n, {r6('avg(p)')} AS mean_predicted, {r6('avg(CAST(true_label=pred_label AS INT))')} AS fraction_correct FROM b GROUP BY 1,2,3""")
def _(spark, d):
    return rounded(C.reliability_curve(three(spark, d)))


_SWEEP = f"""{_THREE}, {_LONG}, th AS (SELECT CAST(unnest([0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,0.95,0.99]) AS DOUBLE) AS threshold),
sweep AS (SELECT model, prob_col, threshold, {cnt(f'p>=threshold AND {BOTH}')} AS accepted, {cnt(f'p>=threshold AND {BOTH} AND true_label=pred_label')} AS correct,
 {cnt(f'true_label IN {VALID}')} AS total_valid FROM long, th GROUP BY 1,2,3)"""


@q("threshold_sweep", f""", {_SWEEP}
SELECT model, prob_col, threshold, accepted, {r6(ratio('accepted','total_valid'))} AS coverage, correct, round({ratio('correct','accepted','NULL')},3) AS accuracy, total_valid FROM sweep""")
def _(spark, d):
    return rounded(C.threshold_sweep(three(spark, d)))


@q("global_thresholds", f""", {_SWEEP}, s2 AS (SELECT *, {ratio('accepted','total_valid')} AS coverage, round({ratio('correct','accepted','NULL')},3) AS accuracy FROM sweep),
s3 AS (SELECT *, max(coverage>=0.5) OVER (PARTITION BY model) AS anyok FROM s2),
s4 AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY accuracy DESC NULLS LAST, CASE prob_col WHEN 'pred_conf' THEN 1 WHEN 'pred_conf_iso' THEN 2 ELSE 3 END, threshold) AS rn
 FROM s3 WHERE coverage>=0.5 OR NOT anyok)
SELECT model, prob_col, threshold, {r6('coverage')} AS coverage, accuracy FROM s4 WHERE rn=1""")
def _(spark, d):
    return rounded(C.global_thresholds(C.threshold_sweep(three(spark, d))))


def _with_probs(spark, d):
    p = spread(calibrated(spark, d)).withColumn("_p", C.class_probabilities(F.col("logits"), F.lit(2.0)))
    return p.withColumns({f"prob_{x}": F.get("_p", F.lit(i)) for i, x in enumerate("VBEPRS")})


_CAND = "[0,0.1::DOUBLE,0.2::DOUBLE,0.1::DOUBLE*3,0.4::DOUBLE,0.5::DOUBLE,0.1::DOUBLE*6,0.1::DOUBLE*7,0.8::DOUBLE,0.9::DOUBLE,0.95::DOUBLE,0.97::DOUBLE,0.99::DOUBLE]"
_OWN = "CASE true_label " + " ".join(f"WHEN '{x}' THEN prob_{x}" for x in "VBEPRS") + " END"
_CLASS_T = f"""{_PROBS}, ca AS (SELECT unnest({_CAND}) AS t),
ok AS (SELECT model, true_label AS label, t, count(*) n, {cnt('pred_label=true_label')} kk FROM pr, ca WHERE {BOTH} AND {_OWN}>=t GROUP BY 1,2,3),
best AS (SELECT model, label, max(t) t FROM ok WHERE CAST(kk AS DOUBLE)/n>=0.6 GROUP BY 1,2),
thr AS (SELECT mm.model, l.label, coalesce(best.t,0) AS threshold FROM m mm CROSS JOIN {LABS} l LEFT JOIN best ON best.model=mm.model AND best.label=l.label)"""


@q("class_thresholds", f", {_CLASS_T} SELECT model, label, {r6('threshold')} AS threshold FROM thr")
def _(spark, d):
    return rounded(C.class_thresholds(_with_probs(spark, d), target=0.6))


@q("class_thresholds_default", f", {_CLASS_T.replace('n>=0.6', 'n>=0.8')} SELECT model, label, {r6('threshold')} AS threshold FROM thr")
def _(spark, d):
    return rounded(C.class_thresholds(_with_probs(spark, d)))


@q("apply_class_thresholds", f""", {_CLASS_T},
x AS (SELECT pr.model, true_label, pred_label, CASE pred_label {' '.join(f"WHEN '{x}' THEN coalesce(prob_{x},0)" for x in 'VBEPRS')} END>=threshold AS inn FROM pr JOIN thr ON thr.model=pr.model AND thr.label=pred_label)
SELECT model, {cnt('inn')} AS accepted, {r6(ratio(cnt('inn'), 'count(*)'))} AS coverage, {r6(ratio(cnt('inn AND true_label=pred_label'), cnt('inn'), 'NULL'))} AS accuracy, CAST(count(*) AS BIGINT) AS total_valid FROM x GROUP BY 1""")
def _(spark, d):
    p = _with_probs(spark, d)
    return rounded(C.apply_class_thresholds(p, C.class_thresholds(p, target=0.6)))


@q("apply_single_threshold", f""", t AS (SELECT model, CAST(0.3 AS DOUBLE)+CAST(mi AS DOUBLE)/10 AS th FROM m), x AS (SELECT preds.*, pred_conf>=th AS inn FROM preds JOIN t USING (model))
SELECT model, {cnt('inn')} AS accepted, {r6(ratio(cnt('inn'), 'count(*)'))} AS coverage, {r6(ratio(cnt('inn AND true_label=pred_label'), cnt('inn'), 'NULL'))} AS accuracy, CAST(count(*) AS BIGINT) AS total_valid FROM x GROUP BY 1""")
def _(spark, d):
    t = spark.createDataFrame([(m, 0.3 + i / 10.0) for i, m in enumerate(MODELS)], "model string, threshold double")
    return rounded(C.apply_single_threshold(predictions(spark, d), t))


# Model against model --------------------------------------------------------------

_MC = "CASE WHEN {b}+{c}>0 THEN (abs({b}-{c})-1)*(abs({b}-{c})-1)/CAST({b}+{c} AS DOUBLE) END"


@q("paired_correctness", f""", {MESSY},
x AS (SELECT a.model AS model_a, b.model AS model_b, coalesce(a.pred_label=a.true_label,false) ca, coalesce(b.pred_label=b.true_label,false) cb
 FROM messy a JOIN messy b ON a.event_id=b.event_id AND a.true_label IS NOT DISTINCT FROM b.true_label AND a.model<b.model),
s AS (SELECT model_a, model_b, CAST(count(*) AS BIGINT) AS n_common, {cnt('ca AND cb')} AS both_correct, {cnt('ca AND NOT cb')} AS a_correct_b_wrong, {cnt('NOT ca AND cb')} AS a_wrong_b_correct,
 {cnt('NOT ca AND NOT cb')} AS both_wrong FROM x GROUP BY 1,2)
SELECT *, {r6(_MC.format(b='a_correct_b_wrong', c='a_wrong_b_correct'))} AS mcnemar_stat FROM s""")
def _(spark, d):
    return rounded(M.paired_correctness(messy(spark, d), with_p=False))


@q("paired_correctness_test", f""", want AS (SELECT * FROM (VALUES ('model_a','model_b'),('model_a','model_c'),('model_a','model_z'),('model_b','model_c'),('model_b','model_z'),('model_c','model_z')) AS t(model_a,model_b)),
x AS (SELECT a.model AS model_a, b.model AS model_b, a.pred_label=a.true_label AS ca, b.pred_label=b.true_label AS cb FROM preds a JOIN preds b ON a.event_id=b.event_id AND a.model<b.model),
s0 AS (SELECT model_a, model_b, CAST(count(*) AS BIGINT) AS n_common, {cnt('ca AND cb')} AS both_correct, {cnt('ca AND NOT cb')} AS a_correct_b_wrong, {cnt('NOT ca AND cb')} AS a_wrong_b_correct,
 {cnt('NOT ca AND NOT cb')} AS both_wrong FROM x GROUP BY 1,2),
s AS (SELECT want.model_a, want.model_b, {', '.join(f'coalesce({c},0) AS {c}' for c in ('n_common', 'both_correct', 'a_correct_b_wrong', 'a_wrong_b_correct', 'both_wrong'))} FROM want LEFT JOIN s0 ON s0.model_a=want.model_a AND s0.model_b=want.model_b),
mm AS (SELECT *, {_MC.format(b='a_correct_b_wrong', c='a_wrong_b_correct')} AS mc FROM s)
SELECT model_a, model_b, n_common, both_correct, a_correct_b_wrong, a_wrong_b_correct, both_wrong, {r6('mc')} AS mcnemar_stat, {r6(erfc_sql('sqrt(mc/2)'))} AS mcnemar_p FROM mm""")
def _(spark, d):
    return rounded(M.paired_correctness(predictions(spark, d), MODELS[:3] + ["model_z"]))


@q("paired_flips", f""",
x AS (SELECT type, event_id, pert_idx, max(CAST(label_flipped AS INT)) FILTER (model='model_a') f1, max(CAST(label_flipped AS INT)) FILTER (model='model_b') f2
 FROM flips WHERE success AND type IN ('actor_substitution','intensity_high','action_substitution') GROUP BY 1,2,3),
s AS (SELECT type, CAST(count(*) AS BIGINT) AS n_pairs, {cnt('f1=0 AND f2=0')} AS n00, {cnt('f1=0 AND f2=1')} AS n01, {cnt('f1=1 AND f2=0')} AS n10, {cnt('f1=1 AND f2=1')} AS n11
 FROM x WHERE f1 IS NOT NULL AND f2 IS NOT NULL GROUP BY 1 HAVING count(*)>5)
SELECT *, {r6(_MC.format(b='n01', c='n10'))} AS statistic FROM s""")
def _(spark, d):
    return rounded(M.paired_flips(flips(spark, d), "model_a", "model_b", with_p=False))


@q("requested_fl_fi", f"""
SELECT r.model, coalesce(s.total,0) AS total, coalesce(s.fl,0) AS fl, coalesce(s.fi,0) AS fi FROM (VALUES ('model_a'),('model_c'),('model_z')) AS r(model)
LEFT JOIN (SELECT model, CAST(count(*) AS BIGINT) AS total, {cnt(_FL)} AS fl, {cnt(_FI)} AS fi FROM preds GROUP BY 1) s ON s.model=r.model""")
def _(spark, d):
    return M.requested_fl_fi(predictions(spark, d), ["model_a", "model_c", "model_z"])


@q("publication_table", f""",
co AS (SELECT model, country, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(true_label=pred_label AS INT)),4) AS accuracy FROM preds WHERE {BOTH} GROUP BY 1,2),
g AS (SELECT model, country, true_label, pred_label, CASE WHEN regexp_matches(lower(actor_norm),'state forces|military|police|government|gendarmerie') THEN 'state' ELSE 'non-state' END AS g FROM preds WHERE model<>'model_d'),
fa AS (SELECT model, country, {r6(_rate('state', '') + '-' + _rate('non-state', ''))} AS "SPD", {cnt("g='state'")} AS n_state FROM g GROUP BY 1,2 HAVING {cnt("g='state'")}>0 AND {cnt("g='non-state'")}>0),
ha AS ({_harm_sql('model, country')})
SELECT co.*, "SPD", n_state, "false_legitimization_rate_FLR", "false_illegitimization_rate_FIR", "harm_ratio_FL_to_FI" FROM co LEFT JOIN fa USING (model, country) LEFT JOIN ha USING (model, country)""")
def _(spark, d):
    p = predictions(spark, d)
    core = K.core_table(p).select("model", "country", "n", "accuracy")
    fair = A.parity(p.where("model <> 'model_d'"), by=["model", "country"]).select("model", "country", "SPD", "n_state")
    harm = H.harm_rates(p, ["model", "country"]).select("model", "country", "false_legitimization_rate_FLR", "false_illegitimization_rate_FIR", "harm_ratio_FL_to_FI")
    return rounded(M.publication_table(core, fair, harm))


# Upserts: last run's metrics of three models meet this run's of two ----------------

@q("upsert_by_model", f"""
SELECT model, CAST(count(*) AS BIGINT) AS total, {cnt(_FL)} AS fl, {cnt(_FI)} AS fi, CAST(NULL AS STRING) AS run FROM preds WHERE model IN ('model_a','model_b','model_c') AND model NOT IN ('model_c','model_d') GROUP BY 1
UNION ALL SELECT model, CAST(count(*) AS BIGINT), {cnt(_FL)}, {cnt(_FI)}, 'new' FROM preds WHERE model IN ('model_c','model_d') AND country='en' GROUP BY 1""")
def _(spark, d):
    p = predictions(spark, d)
    old = H.fl_fi_counts(p.where("model <> 'model_d'"))
    new = H.fl_fi_counts(p.where("model in ('model_c','model_d') and country = 'en'")).withColumn("run", F.lit("new"))
    return M.upsert(old, new)


@q("upsert_document", f"""
, o AS (SELECT model, true_label, pred_label, count(*) n FROM preds WHERE model IN ('model_a','model_b') AND model NOT IN ('model_b') GROUP BY 1,2,3
 UNION ALL SELECT model, true_label, pred_label, count(*) n FROM preds WHERE model='model_b' AND country='en' GROUP BY 1,2,3)
SELECT model, string_agg(concat(true_label,'|',pred_label,'=',n), ',' ORDER BY concat(true_label,'|',pred_label)) AS document FROM o GROUP BY 1""")
def _(spark, d):
    p = predictions(spark, d)
    old = K.pair_counts(p.where("model in ('model_a','model_b')"), ["model"])
    new = K.pair_counts(p.where("model = 'model_b' and country = 'en'"), ["model"])
    doc = M.upsert_document(old, new, "model", ["true_label", "pred_label"], "n")
    return doc.select("model", F.array_join(F.transform(F.map_entries("document"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",").alias("document"))


# The row-level set operators on predictions -----------------------------------------

@q("dedup_keep_last", """
, r AS (SELECT preds.*, s.seq, concat(pred_label, CAST(s.seq AS STRING)) AS answer FROM preds CROSS JOIN (VALUES (0),(1),(2)) AS s(seq) WHERE s.seq<=event_id%3),
z AS (SELECT *, row_number() OVER (PARTITION BY model, event_id ORDER BY seq DESC) AS rn FROM r) SELECT model, event_id, seq, answer FROM z WHERE rn=1""")
def _(spark, d):
    p = predictions(spark, d).withColumn("seq", F.explode(F.expr("sequence(0, cast(event_id%3 as int))")))
    p = p.withColumn("answer", F.concat("pred_label", F.col("seq").cast("string"))).select("model", "event_id", "seq", "answer")
    return R.keep_one(p, ["model", "event_id"], ["seq"], last=True)


@q("dedup_keep_first", """
, r AS (SELECT preds.*, s.seq, concat(pred_label, CAST(s.seq AS STRING)) AS answer FROM preds CROSS JOIN (VALUES (0),(1),(2)) AS s(seq) WHERE s.seq<=event_id%3),
z AS (SELECT *, row_number() OVER (PARTITION BY model, event_id ORDER BY seq) AS rn FROM r) SELECT model, event_id, seq, answer FROM z WHERE rn=1""")
def _(spark, d):
    p = predictions(spark, d).withColumn("seq", F.explode(F.expr("sequence(0, cast(event_id%3 as int))")))
    p = p.withColumn("answer", F.concat("pred_label", F.col("seq").cast("string"))).select("model", "event_id", "seq", "answer")
    return R.keep_one(p, ["model", "event_id"], ["seq"])
