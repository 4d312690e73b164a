"""Label, model-name and condition columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import col, let, lit_array, lookup, strip
from .tables import control_table

# The six event classes, their codes in canonical order, and the
# harm groups used by the set definition of false (il)legitimization.
CLASS_CODES = {
    "Violence against civilians": "V",
    "Battles": "B",
    "Explosions/Remote violence": "E",
    "Protests": "P",
    "Riots": "R",
    "Strategic developments": "S",
}
CLASSES = list(CLASS_CODES)
LABELS = ["V", "B", "E", "P", "R", "S"]
LEGITIMATE = ["B", "S"]
ILLEGITIMATE = ["V"]
COUNTRIES = {"cmr": "Cameroon", "nga": "Nigeria"}
CONDITION_ORDER = {"zero_shot": 0, "few_shot_1": 1, "few_shot_3": 2, "few_shot_5": 3}
LENGTH_BINS = [("very_short", 0, 100), ("short", 100, 200), ("medium", 200, 300),
               ("long", 300, 500), ("very_long", 500, None)]


def is_valid(c: str | Column) -> Column:
    """True for one of the six codes, false (never null) otherwise."""
    return F.coalesce(col(c).isin(LABELS), F.lit(False))


def class_code(c: str | Column) -> Column:
    """Full class name to its code, unknown to null."""
    return lookup(CLASS_CODES, col(c))


def clean_label(c: str | Column) -> Column:
    """Code in any case, or a class name as written or in title case; otherwise ERROR."""
    return let(strip(F.coalesce(col(c), F.lit(""))), lambda raw: F.coalesce(
        F.when(F.upper(raw).isin(LABELS), F.upper(raw)), lookup(CLASS_CODES, raw), lookup(CLASS_CODES, F.initcap(raw)), F.lit("ERROR")))


def strict_label(c: str | Column) -> Column:
    """Code in any case, otherwise INVALID."""
    up = F.upper(strip(col(c)))
    return F.when(up.isin(LABELS), up).otherwise(F.lit("INVALID"))


def class_index(c: str | Column, classes: list[str] = CLASSES) -> Column:
    """Zero-based position in a fixed class list, unknown to null."""
    pos = F.array_position(lit_array(classes), col(c))
    return F.when(pos > 0, (pos - 1).cast("int"))


def actor_type(code: str | Column) -> Column:
    return F.when(col(code) == 1, "state").otherwise("non-state")


def note_length_bin(length: str | Column, top: int | None = None) -> Column:
    """Right-closed bins; a length of 0 is null, and so is one above ``top`` if that is given."""
    n, out = col(length), None
    for name, lo, hi in LENGTH_BINS:
        last = top if hi is None else hi
        cond = (n > lo) & (n <= last) if last is not None else n > lo
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def example_quality(length: str | Column, actor: str | Column) -> Column:
    """Score of a note as a few-shot example: preferred length, known actor."""
    n, a = col(length), col(actor)
    by_length = (F.when((n >= 80) & (n <= 600), 2)
                 .when(((n >= 40) & (n < 80)) | ((n > 600) & (n <= 1200)), 1).otherwise(0))
    return by_length + F.when(F.length(strip(a)) > 0, 1).otherwise(0)


def model_dir_slug(c: str | Column) -> Column:
    return F.regexp_replace(col(c), r"[^a-zA-Z0-9._]", "_")


def model_file_slug(c: str | Column) -> Column:
    return F.replace(F.replace(col(c), F.lit(":"), F.lit("-")), F.lit("/"), F.lit("_"))


def slug_to_model(c: str | Column) -> Column:
    """Turn the dash before a size suffix (7b, 1.7b) back into a colon."""
    return F.regexp_replace(col(c), r"(?i)^(.+)-(\d+\.?\d*b)$", "$1:$2")


def collapse_family(c: str | Column, prefix: str) -> Column:
    """Every model name that starts with ``prefix`` becomes ``prefix``."""
    return F.when(F.lower(col(c)).startswith(prefix.lower()), prefix).otherwise(col(c))


def rename_legacy_columns(df: DataFrame, token: str, replacement: str) -> DataFrame:
    return df.toDF(*[c.replace(token, replacement) for c in df.columns])


def significance_stars(p: str | Column) -> Column:
    v = col(p)
    return F.when(v < 0.001, "***").when(v < 0.01, "**").when(v < 0.05, "*").otherwise("n.s.")


def condition_rank(c: str | Column) -> Column:
    return lookup(CONDITION_ORDER, col(c))


def country_name(code: str | Column) -> Column:
    """Country code to name; an unsupported code fails the job."""
    key = F.lower(strip(col(code)))
    return F.coalesce(lookup(COUNTRIES, key),
                      F.raise_error(F.concat(F.lit("unsupported country code: "), F.coalesce(key, F.lit("null"))))
                      .cast("string"))


def select_models(df: DataFrame, wanted: list[str], model: str = "model") -> DataFrame:
    """Rows of the wanted models: exact names if any exist, else substring hits, else everything.

    The decision is taken on the distinct model names, so the rows are only
    filtered by a semi join on that short list.
    """
    everyone = Window.partitionBy(F.lit(0))
    exact = F.col(model).isin(wanted)
    partial = F.lit(False)
    for w in wanted:
        partial = partial | F.col(model).contains(w)
    names = (df.select(model).where(F.col(model).isNotNull()).distinct()
             .select(model, F.coalesce(exact, F.lit(False)).alias("_e"), F.coalesce(partial, F.lit(False)).alias("_p"))
             .select(model, "_e", "_p", F.max("_e").over(everyone).alias("_any_e"),
                     F.max("_p").over(everyone).alias("_any_p"))
             .where(F.when(F.col("_any_e"), F.col("_e")).when(F.col("_any_p"), F.col("_p")).otherwise(True))
             .select(model))
    return df.join(control_table(names), model, "left_semi")
