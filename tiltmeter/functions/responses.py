"""From a model's raw answer to label, confidence, logits and reasoning."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import let, lookup, strip
from .labels import CLASS_CODES, LABELS, clean_label, strict_label
from .tables import control_table

# Names under which a model may return its scores, in order.
SCORE_KEYS = ["logits", "log_probs", "scores", "label_scores"]

_LABEL = r'"label"\s*:\s*"([VBEPRS])"'
_CONFIDENCE = r'"confidence"\s*:\s*([0-9.]+)'
_OBJECT_WITH_LABEL = r'\{[^{}]*"label"\s*:\s*"[VBEPRS]"[^{}]*\}'


def _parsed(text: Column) -> Column:
    """Variant with the value at $.v of a text that is one whole JSON value, else null.

    The parser stops after the first value, so the text is set into an object
    with a closing field that must be seen too.
    """
    v = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit(', "closing_field":1}')))
    return F.when(F.try_variant_get(v, "$.closing_field", "int") == 1, v)


def _read(v: Column, root: str) -> Column:
    """Everything a parsed answer object says: label, confidence, scores, reasoning and its items.

    Scores come from the first score field that is there, even if it is null.
    """
    fields = F.coalesce(*[F.try_variant_get(v, f"{root}.{k}", "variant") for k in SCORE_KEYS])
    reasoning = F.try_variant_get(v, f"{root}.reasoning", "variant")

    def text(x: Column) -> Column:
        return F.when(~F.is_variant_null(x), F.to_json(x))

    return F.struct(F.try_variant_get(v, f"{root}.label", "string").alias("label"),
                    F.try_variant_get(v, f"{root}.confidence", "double").alias("confidence"), F.lit(True).alias("found"),
                    text(fields).alias("scores"), text(reasoning).alias("reasoning"),
                    F.try_variant_get(v, f"{root}.reasoning", "array<string>").alias("items"))


def _bare(label: Column, confidence: Column, found: Column) -> Column:
    """An answer of which only the label and the number could be read."""
    text = F.lit(None).cast("string")
    return F.struct(label.alias("label"), confidence.alias("confidence"), found.alias("found"), text.alias("scores"), text.alias("reasoning"),
                    F.lit(None).cast("array<string>").alias("items"))


def parse_response(raw: Column) -> Column:
    """struct<label, confidence, found, scores, reasoning, items> of an answer.

    Tried in order: the whole answer as JSON, an object with a label in it, the
    label by itself (confidence .5 if absent), any {...} from first to last brace.
    All fields come from the one object that was chosen.
    """
    text = strip(F.coalesce(raw, F.lit("")))
    whole = _parsed(text)
    part = _parsed(F.nullif(F.regexp_extract(text, _OBJECT_WITH_LABEL, 0), F.lit("")))
    label = F.nullif(F.regexp_extract(text, _LABEL, 1), F.lit(""))
    number = F.coalesce(F.nullif(F.regexp_extract(text, _CONFIDENCE, 1), F.lit("")).try_cast("double"), F.lit(0.5))
    loose = _parsed(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")))
    only = F.coalesce(whole, part)
    chosen = F.coalesce(only, F.when(label.isNull(), loose))
    fallback = F.when(label.isNotNull(), _bare(label, number, F.lit(True))).otherwise(
        _bare(F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(False)))
    return let(chosen, lambda v: F.when(v.isNotNull(), _read(v, "$.v")).otherwise(fallback))


def _first_object(text: str | None) -> str | None:
    """The answer's first {...} as JSON text, if what starts at its first brace is an object."""
    text = (text or "").strip()
    start = text.find("{")
    if start < 0:
        return None
    try:
        return text[start:json.JSONDecoder().raw_decode(text, start)[1]]
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def first_json_object(text: pd.Series) -> pd.Series:
    return text.map(_first_object)


def parse_balanced(raw: Column, strict: bool = True) -> Column:
    """The same struct by the first object of an answer, else label and number by pattern.

    ``strict`` accepts only the six codes in the fallback and fills ERROR / 0;
    otherwise any word is taken and what is missing stays null.
    """
    v = F.try_parse_json(first_json_object(raw))
    text = F.coalesce(raw, F.lit(""))
    label = F.nullif(F.regexp_extract(text, _LABEL if strict else r'"label"\s*:\s*"([^"\s]+)"', 1), F.lit(""))
    number = F.nullif(F.regexp_extract(text, r'"confidence"\s*:\s*([0-9]*\.?[0-9]+)', 1), F.lit("")).try_cast("double")
    found = label.isNotNull() | number.isNotNull()
    if strict:
        label, number = F.coalesce(label, F.lit("ERROR")), F.coalesce(number, F.lit(0.0))
    return F.when(v.isNotNull(), _read(v, "$")).otherwise(_bare(label, number, found))


def parse_loose(raw: Column) -> Column:
    return parse_balanced(raw, strict=False)


#: How each kind of back-end's answers are read.
PARSERS = {"structured": parse_response, "generated": parse_balanced, "generated_loose": parse_loose}


def first_scores(raw: Column) -> Column:
    """JSON text of the first score field present in an answer that is one JSON object."""
    return F.coalesce(*[F.get_json_object(raw, f"$.{k}") for k in SCORE_KEYS])


def prediction(raw: Column, clean=clean_label, parser: str = "structured") -> Column:
    """struct<pred_label, pred_conf, logits, reasoning, items> of an answer, ERROR / 0 when nothing was found.

    One column, so that the answer is parsed once whatever is read from it.
    """
    return let(PARSERS[parser](raw), lambda r: F.struct(
        clean(F.coalesce(r["label"], F.lit("ERROR"))).alias("pred_label"), F.coalesce(r["confidence"], F.lit(0.0)).alias("pred_conf"),
        r["scores"].alias("logits"), r["reasoning"].alias("reasoning"), r["items"].alias("items")))


def normalized_label(raw_label: Column) -> Column:
    return strict_label(raw_label)


def class_names(df: DataFrame, id2label: DataFrame, idx: str = "class_id", unmapped: str = "INVALID",
                fallback: list[str] | None = None) -> DataFrame:
    """Class index to code through the model's own label list, else the canonical order.

    ``id2label``: model, idx, label (a class name or a code).
    """
    own = id2label.select("model", F.col("idx").alias("_i"), F.coalesce(
        lookup(CLASS_CODES, F.col("label")), F.when(F.col("label").isin(LABELS), F.col("label"))).alias("_code"))
    lists = own.where(F.col("_code").isNotNull()).groupBy("model").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("_i").cast("int"), "_code"))).alias("_map"))
    default = F.map_from_entries(F.array(*[F.struct(F.lit(i), F.lit(c)) for i, c in enumerate(fallback or LABELS)]))
    d = df.join(control_table(lists), "model", "left")
    return d.withColumn("pred_label", F.coalesce(F.try_element_at(
        F.coalesce("_map", default), F.col(idx).cast("int")), F.lit(unmapped))).drop("_map")
