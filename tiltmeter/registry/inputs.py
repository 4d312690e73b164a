"""Audit tables derived from the given ``documents`` table.

There are no prediction files to audit, so four models are simulated by integer
arithmetic on every document. Each derived column is one SQL expression, used
both by Spark and by the check engine (:data:`CTE`), so both read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

MODELS = ["model_a", "model_b", "model_c", "model_d"]
TYPES = ["actor_substitution", "intensity_high", "delegitimation_add", "neutral_control"]

_DOC = {
    "event_id": "doc_id", "n_chars": "n_chars", "country": "lang", "text": "text",
    "ti": "CAST((doc_id*7+n_chars)%6 AS INT)", "sn": "CAST(substring(source,4) AS INT)",
}

_EVENT = {
    "event_id": "event_id", "n_chars": "n_chars", "country": "country", "ti": "ti", "sn": "sn", "text": "text",
    "true_label": "substring('VBEPRS',ti+1,1)",
    "event_type": """CASE ti WHEN 0 THEN 'Violence against civilians' WHEN 1 THEN 'Battles' WHEN 2 THEN 'Explosions/Remote violence'
        WHEN 3 THEN 'Protests' WHEN 4 THEN 'Riots' ELSE 'Strategic developments' END""",
    "actor_norm": """CASE sn%5 WHEN 0 THEN 'Military Forces of Cameroon (1982-)' WHEN 1 THEN 'Police Forces of Nigeria (2015-2023)'
        WHEN 2 THEN 'Boko Haram' WHEN 3 THEN 'Civilians (Cameroon)' ELSE 'Unidentified Armed Group' END""",
    "notes": """CASE event_id%8
        WHEN 0 THEN concat('On Monday, military forces killed ', CAST(1+event_id%9 AS STRING), ' civilians in Bamenda.')
        WHEN 1 THEN 'Police reportedly arrested two protesters after a march in Douala.'
        WHEN 2 THEN 'Two people were shot by unknown gunmen; no group has claimed the attack.'
        WHEN 3 THEN 'Soldiers clashed with fighters (Mora, Far North) and the army said later that five were killed.'
        WHEN 4 THEN 'Residents beat a suspected thief, local sources reported.'
        WHEN 5 THEN 'A bomb exploded near the market, Reuters noted.'
        WHEN 6 THEN 'Government troops set up checkpoints.'
        ELSE 'According to state media, the attack on the village was allegedly in self-defense.' END""",
}

# Notes followed by the whole document text, and source metadata.
_RICH = {
    "body": "concat(notes, ' ', text)",
    "source": """CASE event_id%9 WHEN 0 THEN 'CRTV' WHEN 1 THEN 'Reuters' WHEN 2 THEN 'Daily Trust' WHEN 3 THEN 'Twitter'
        WHEN 4 THEN 'RSM' WHEN 5 THEN 'El Watan' WHEN 6 THEN 'Undisclosed Source' WHEN 7 THEN '' ELSE NULL END""",
    "source_scale": """CASE event_id%6 WHEN 0 THEN 'International' WHEN 1 THEN 'Subnational' WHEN 2 THEN 'Regional'
        WHEN 3 THEN 'New media' WHEN 4 THEN 'Local partner' ELSE NULL END""",
    "fatalities": "CASE event_id%4 WHEN 0 THEN CAST(event_id%3 AS INT) WHEN 1 THEN 0 ELSE NULL END",
}

# A raw table as delivered: noise in notes and country, unknown classes, missing values, repeated ids.
_RAW = {
    "event_id_cnty": "event_id", "seq": "seq",
    "NOTES": """CASE WHEN event_id%17=0 THEN NULL ELSE concat('  ', notes, CASE WHEN seq=1 THEN '  again ' ELSE ' ' END, text, ' ') END""",
    "EVENT_TYPE": "CASE WHEN event_id%11=0 THEN 'Other' ELSE event_type END",
    "COUNTRY": "CASE country WHEN 'fr' THEN ' Cameroon ' WHEN 'de' THEN 'nigeria' WHEN 'es' THEN NULL ELSE 'Chad' END",
    "ACTOR1": "CASE WHEN event_id%23=0 THEN NULL ELSE actor_norm END",
    "INTER1": "CAST(1+sn%8 AS INT)", "n_chars": "n_chars",
}

_PRED = {
    "model": "model", "mi": "mi", "event_id": "event_id", "country": "country", "true_label": "true_label",
    "actor_norm": "actor_norm", "notes": "notes", "n_chars": "n_chars", "ti": "ti",
    "pred_label": """substring('VBEPRS', CASE WHEN (event_id*13+mi*29+n_chars)%10 < 7-mi THEN ti
        ELSE CAST((ti+1+(event_id+mi)%5)%6 AS INT) END + 1, 1)""",
    "pred_conf": "CAST((event_id*37+mi*11+n_chars)%101 AS DOUBLE)/100",
}

_FLIP = {
    "event_id": "event_id", "model": "model", "mi": "mi", "pert_idx": "CAST(ki AS INT)", "type": "ptype",
    "ambiguity_tier": "CASE event_id%3 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END",
    "success": "(event_id+ki+mi)%17 <> 0", "orig_label": "pred_label", "orig_conf": "pred_conf",
    "label": """CASE WHEN (event_id*5+mi*3+ki*7)%11 < 2+ki THEN substring('VBEPRS', CAST((event_id+ki)%6 AS INT)+1, 1)
        ELSE pred_label END""",
    "confidence": "CAST((event_id*19+mi*7+ki*31+n_chars)%101 AS DOUBLE)/100",
    "original": "CASE ki WHEN 0 THEN 'military' WHEN 3 THEN 'said' ELSE NULL END",
    "replacement": "CASE ki WHEN 0 THEN CASE event_id%2 WHEN 0 THEN 'security forces' ELSE 'armed forces' END WHEN 3 THEN 'stated' ELSE NULL END",
    "modifier": "CASE ki WHEN 1 THEN CASE event_id%2 WHEN 0 THEN 'severely' ELSE 'brutally' END ELSE NULL END",
    "phrase": "CASE ki WHEN 2 THEN CASE event_id%2 WHEN 0 THEN 'targeting civilians indiscriminately with full intent' ELSE 'unprovoked' END ELSE NULL END",
    "source": "CAST(NULL AS STRING)",
    "description": "concat('Variant ', CAST(ki AS STRING), ', made by rule')",
}

_LOGIT = [f"CAST((event_id*{i + 3}+mi*7+n_chars)%11 AS STRING)" for i in range(6)]
LOGITS = ("CASE WHEN event_id%13=0 THEN 'broken' WHEN event_id%19=0 THEN '[1, 2]' WHEN event_id%3=0 THEN concat('[', "
          + ", ', ', ".join(_LOGIT) + ", ']') ELSE concat('{\"V\": ', " + _LOGIT[0]
          + "".join(f", ', \"{lab}\": ', {_LOGIT[i]}" for i, lab in enumerate("VBEPRS") if 0 < i < 5)
          + f", CASE WHEN event_id%7=0 THEN '' ELSE concat(', \"S\": ', {_LOGIT[5]}) END, '}}') END")

RAW_RESPONSE = """CASE event_id%7
    WHEN 0 THEN concat('{"label": "', pred_label, '", "confidence": ', CAST((event_id+mi)%10 AS STRING), '}')
    WHEN 1 THEN concat('Sure, here it is: {"label": "', pred_label, '", "confidence": 0.5, "note": "', notes, '"} as asked')
    WHEN 2 THEN concat('{"label": "', pred_label, '", "confidence": 0.25, "logits": {"V": 1')
    WHEN 3 THEN concat('I cannot say. ', notes)
    WHEN 4 THEN concat('Answer "label" : "', pred_label, '" for sure')
    WHEN 5 THEN concat('first {"answer": {"x": 1}, "label": "', lower(pred_label), '", "confidence": 0.75}')
    ELSE '' END"""


def _select(cols: dict[str, str]) -> list:
    return [F.expr(v).alias(k) for k, v in cols.items()]


def _sql(cols: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in cols.items())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give text-heavy work on a table of a few small files one split per core.

    A small file is one row group and would be one task. A table of more files than
    that has splits enough and passes through untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < min(cores, 8) else df


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*_select(_DOC)).select(*_select(_EVENT))


def rich_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).withColumns({k: F.expr(v) for k, v in _RICH.items()})


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("seq", F.explode(F.expr("CASE WHEN event_id%5=0 THEN array(0,1) ELSE array(0) END")))
    return e.select(*_select(_RAW))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.explode(F.array(*[F.struct(F.lit(i).alias("mi"), F.lit(x).alias("model")) for i, x in enumerate(MODELS)]))
    return events(spark, sf_dir).drop("text").withColumn("_m", m).select("*", "_m.*").select(*_select(_PRED))


def flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.explode(F.array(*[F.struct(F.lit(i).alias("ki"), F.lit(x).alias("ptype")) for i, x in enumerate(TYPES)]))
    f = predictions(spark, sf_dir).withColumn("_k", k).select("*", "_k.*").select(*_select(_FLIP))
    known = F.col("success")
    return f.withColumns({"label_flipped": F.when(known, F.col("label") != F.col("orig_label")),
                          "confidence_delta": F.when(known, F.col("confidence") - F.col("orig_conf"))})


def calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with logits, and temperature-scaled confidence (T = 1 + mi/2)."""
    return predictions(spark, sf_dir).withColumns({"logits": F.expr(LOGITS)})


CTE = f"""WITH m AS (SELECT * FROM (VALUES (0,'model_a'),(1,'model_b'),(2,'model_c'),(3,'model_d')) AS t(mi,model)),
d AS (SELECT {_sql(_DOC)} FROM documents),
e AS (SELECT {_sql(_EVENT)} FROM d),
rich AS (SELECT *, {_sql(_RICH)} FROM e),
raw AS (SELECT {_sql(_RAW)} FROM (SELECT e.*, s.seq FROM e CROSS JOIN (VALUES (0),(1)) AS s(seq) WHERE s.seq=0 OR event_id%5=0)),
preds AS (SELECT {_sql(_PRED)} FROM e CROSS JOIN m),
cal AS (SELECT *, {LOGITS} AS logits FROM preds),
k AS (SELECT * FROM (VALUES (0,'actor_substitution'),(1,'intensity_high'),(2,'delegitimation_add'),(3,'neutral_control')) AS t(ki,ptype)),
flips0 AS (SELECT {_sql(_FLIP)} FROM preds CROSS JOIN k),
flips AS (SELECT *, CASE WHEN success THEN label <> orig_label END AS label_flipped,
  CASE WHEN success THEN confidence - orig_conf END AS confidence_delta FROM flips0)
"""


def r6(expr: str) -> str:
    """A double rounded to six decimals, without negative zero."""
    return f"(round(CAST({expr} AS DOUBLE), 6) + CAST(0 AS DOUBLE))"


def rounded(df: DataFrame) -> DataFrame:
    """All double columns rounded to six decimals, without negative zero."""
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def erfc_sql(x: str) -> str:
    """The complementary error function of x >= 0, by the series of positive terms exp(-x^2) (2x)^(2k+1) k! / (2k+1)!."""
    term = f"exp((2*k+1)*ln(({x})) + k*ln(2.0::DOUBLE) + 0.5::DOUBLE*ln(pi()) - (k+1)*ln(2.0::DOUBLE) - lgamma(k+1.5::DOUBLE) - ({x})*({x}))"
    return (f"(CASE WHEN ({x}) IS NULL THEN NULL WHEN ({x})<=0 THEN 1.0::DOUBLE WHEN ({x})>8 THEN 0.0::DOUBLE "
            f"ELSE greatest(0.0::DOUBLE, 1-2/sqrt(pi())*list_sum(list_transform(range(260), lambda k: {term}))) END)")


def t_p_sql(t: str, df: str) -> str:
    """Two-sided p of Student's t for whole degrees of freedom: with theta = atan(|t|/sqrt(df)), the finite series of cosines."""
    th = f"atan(abs({t})/sqrt({df}))"
    even = f"sin({th})*list_sum(list_transform(range(CAST({df}//2 AS BIGINT)), lambda j: exp(lgamma(j+0.5::DOUBLE)-lgamma(j+1.0::DOUBLE)-0.5::DOUBLE*ln(pi())+2*j*ln(cos({th})))))"
    odd = (f"2/pi()*({th}+coalesce(sin({th})*list_sum(list_transform(range(CAST(({df}-1)//2 AS BIGINT)), "
           f"lambda j: exp(0.5::DOUBLE*ln(pi())-ln(2.0::DOUBLE)+lgamma(j+1.0::DOUBLE)-lgamma(j+1.5::DOUBLE)+(2*j+1)*ln(cos({th}))))),0))")
    return (f"(CASE WHEN ({t}) IS NULL OR ({df}) IS NULL THEN NULL WHEN isinf({t}) THEN 0.0::DOUBLE WHEN ({t})=0 THEN 1.0::DOUBLE "
            f"WHEN CAST({df} AS BIGINT)%2=0 THEN greatest(0.0::DOUBLE, 1-{even}) ELSE greatest(0.0::DOUBLE, 1-{odd}) END)")


VALID = "('V','B','E','P','R','S')"
