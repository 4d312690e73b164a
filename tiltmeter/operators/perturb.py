"""Counterfactual variants of a text.

Each generator is one Column: an array of variants built by filtering and
mapping a fixed rule array over the text. Variants stay in the row of their
event until they are exploded, so generation needs no join and no shuffle, and
the cap per generator needs no window. Valid variants are made in Python by the
same rules (``functions/edits.py``), where they are compared.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import edits as E, fluency, perturbation_rules as R
from ..functions.common import capitalize, let
from ..functions.edits import FIELDS, MAKERS as EDITS, OTHERS, Text
from ..functions.fluency import MAX_DISTANCE, MIN_FLUENCY, Variants, first_valid_similarities, grammatical

# Order of the generators.
GENERATORS = ["actor", "intensity", "action", "negation", "sufficiency", "legitimation", "provenance",
              "decontextualization", "control"]


def _rules(rows: list[dict]) -> Column:
    """A constant array of rules; every rule has needle, regex and swap next to the variant fields."""
    fields = ", ".join(f"{f}: string" for f in [*FIELDS, "needle", "regex", "swap"])
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")


def _variant(rule: Column, text: Column, **over: Column) -> Column:
    got = {f: rule[f] for f in FIELDS if f != "text"} | {"text": text} | over
    return F.struct(*[got[f].cast("string").alias(f) for f in FIELDS])


def _every(text: Column, rules: Column, make: Callable[[Column], Column]) -> Column:
    """The variants of all rules that change the text."""
    return F.filter(F.transform(rules, make), lambda v: v["text"] != text)


def _first(text: Column, rules: Column, make: Callable[[Column], Column]) -> Column:
    """The first variant of :func:`_every`; none is made of the rules after it."""
    none = F.array().cast("array<struct<" + ", ".join(f"{f}: string" for f in FIELDS) + ">>")
    return F.aggregate(rules, none, lambda got, r: F.when(F.size(got) > 0, got).otherwise(F.filter(F.array(make(r)), lambda v: v["text"] != text)))


#: How the variants of a list of rules are taken; a third way is in :func:`_first_plausible`.
Take = Callable[[Column, Column, Callable[[Column], Column]], Column]


def _apply(text: Column, rows: list[dict], take: Take = _every) -> Column:
    """Variants of the rules whose needle is in the text and whose edit changes it."""
    needles = F.array(*[F.lit(n) for n in dict.fromkeys(r["needle"] for r in rows)])
    here = let(F.lower(text), lambda low: F.filter(needles, lambda n: F.contains(low, n)))
    open_ = let(here, lambda found: F.filter(_rules(rows), lambda r: F.array_contains(found, r["needle"])))
    return take(text, open_, lambda r: _variant(r, F.regexp_replace(text, r["regex"], r["swap"])))


def actor_variants(text: Column, take: Take = _every) -> Column:
    return _apply(text, E.ACTOR, take)


def intensity_variants(text: Column, take: Take = _every) -> Column:
    """A modifier before the first occurrence of a verb (the verb may be the start of a longer word)."""
    return _apply(text, E.INTENSITY, take)


def action_variants(text: Column, take: Take = _every) -> Column:
    return _apply(text, E.ACTION, take)


def negation_variants(text: Column, take: Take = _every) -> Column:
    return _apply(text, E.NEGATION, take)


def sufficiency_variants(text: Column) -> Column:
    """Only the span from actor over action to object."""
    spans = F.array(*[F.struct(F.lit(f"pattern_{i}").alias("pattern"), F.regexp_extract(text, "(?iUd)" + p, 0).alias("text"))
                      for i, p in enumerate(R.SUFFICIENCY)])
    none = F.lit(None).cast("string")

    def variant(s):
        got = {f: none for f in FIELDS} | {"type": F.lit("sufficiency"), "pattern": s["pattern"], "text": s["text"],
                                           "description": F.concat(F.lit('Keep only key elements: "'), s["text"], F.lit('"'))}
        return F.struct(*[got[f].cast("string").alias(f) for f in FIELDS])

    return F.transform(F.filter(spans, lambda s: s["text"] != ""), variant)


def legitimation_variants(text: Column, take: Take = _every) -> Column:
    """The first legitimizing phrase at the end; each delegitimizing phrase in front."""
    rules = _rules(E.LEGITIMATION + E.DELEGITIMATION)
    ended = F.rtrim(text, F.lit(".!?"))
    return let(capitalize(text), lambda body: take(text, rules, lambda r: _variant(r, F.when(
        r["type"] == "legitimation_add", F.concat(ended, F.lit(" "), r["phrase"], F.lit("."))).otherwise(F.concat(r["swap"], body)))))


def provenance_variants(text: Column, take: Take = _every) -> Column:
    """Each attribution in front; an attribution the text starts with taken away."""
    front, cut = _rules(E.PROVENANCE), _rules(E.NO_PROVENANCE)
    away = let(F.lower(text), lambda low: F.filter(cut, lambda r: F.contains(low, r["needle"])))

    def taken(body: Column) -> Column:
        def make(r):
            return _variant(r, F.when(r["type"] == "provenance_add", F.concat(r["source"], F.lit(" "), body))
                            .otherwise(F.regexp_replace(text, r["regex"], r["swap"])))

        if take is _every:  # an addition always changes the text; a null text has its additions too
            return F.concat(F.transform(front, make), _every(text, away, make))
        return take(text, F.concat(front, away), make)

    return let(capitalize(text), taken)


def decontextualization_variants(text: Column) -> Column:
    """The first bracketed place, else the first "in <Place>", swapped for a placeholder."""
    in_brackets, in_place = ["(?U)" + p for p in R.PLACE_PATTERNS]
    first_brackets, first_place = [F.lit(E.replace_first(p, "sU")) for p in R.PLACE_PATTERNS]
    rules = _rules(E.DECONTEXTUALIZATION)

    def made(place: Column) -> Column:
        found, first = place["found"], place["first"]
        return _every(text, F.filter(rules, lambda r: found != ""), lambda r: _variant(
            r, F.regexp_replace(text, first, r["swap"]), original=found,
            description=F.concat(F.lit('Replace location "'), found, F.lit('" with "'), r["replacement"], F.lit('"'))))

    return let(F.regexp_extract(text, in_brackets, 0), lambda a: let(
        F.when(a != "", F.struct(a.alias("found"), first_brackets.alias("first")))
        .otherwise(F.struct(F.regexp_extract(text, in_place, 0).alias("found"), first_place.alias("first"))), made))


def control_variants(text: Column) -> Column:
    """At most one neutral swap per family."""
    return F.concat(*[_apply(text, rows, _first) for rows in E.CONTROL])


MAKERS = dict(zip(GENERATORS, [
    actor_variants, intensity_variants, action_variants, negation_variants, sufficiency_variants, legitimation_variants,
    provenance_variants, decontextualization_variants, control_variants]))


#: Generators with more rules than a text mostly needs: their variants can be taken one rule after the other.
STEPWISE = {"actor", "intensity", "action", "negation", "legitimation", "provenance"}


def _row(name: str, v: Column, i: Column, *extra) -> Column:
    return F.struct(F.lit(name).alias("generator"), i.alias("gen_idx"), *[v[f].alias(f) for f in FIELDS], *[e(v) for e in extra])


def _tagged(name: str, text: Column, *extra) -> Column:
    """Variants of one generator with its name and their position; ``extra`` adds columns made from a variant."""
    return F.transform(MAKERS[name](text), lambda v, i: _row(name, v, i, *extra))


def _fluent(v: Column) -> Column:
    return fluency.grammaticality(v["text"]).alias("fluency_score")


def _plausible(text: Column) -> Callable[[Column], Column]:
    return lambda x: (x["fluency_score"] >= fluency.MIN_FLUENCY) & (fluency.similarity_bound(text, x["text"]) > 1.0 - fluency.MAX_DISTANCE)


def _all_plausible(name: str, text: Column) -> Column:
    return F.filter(_tagged(name, text, _fluent), _plausible(text))


def _first_plausible(name: str, text: Column, most: int) -> Column:
    """The first ``most`` of :func:`_all_plausible`; no variant is made of the rules after them."""
    if name not in STEPWISE:
        return F.slice(_all_plausible(name, text), 1, most)
    fields = ["generator: string", "gen_idx: int", *[f"{f}: string" for f in FIELDS], "fluency_score: double"]

    def take(text: Column, rules: Column, make) -> Column:
        def step(got, rule):
            def tried(v):
                here = F.filter(F.array(_row(name, v, got["made"], _fluent)), _plausible(text))
                return F.when(v["text"] != text, F.struct((got["made"] + 1).alias("made"), F.concat(got["kept"], here).alias("kept"))).otherwise(got)

            return F.when(F.size(got["kept"]) >= most, got).otherwise(let(make(rule), tried))

        none = F.struct(F.lit(0).alias("made"), F.array().cast(f"array<struct<{', '.join(fields)}>>").alias("kept"))
        return F.aggregate(rules, none, step, lambda got: got["kept"])

    return MAKERS[name](text, take)


def explode_variants(df: DataFrame, names: list[str] | None = None, text: str = "notes", keep: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """All variants of the chosen generators, unvalidated: generator, gen_idx and the variant fields."""
    tagged = [_tagged(n, F.col(text)) for n in (names or GENERATORS)]
    return df.select(*keep, F.explode(F.concat(*tagged)).alias("_v")).select(*keep, "_v.*")


#: Texts that are Python strings at a time, and letters of variants in a batch that goes back.
TEXTS = 64
LETTERS = 4 << 20

Row = tuple[str, int, tuple, str, float, float]


def _valid_of(text: str, most: int) -> Iterator[Row]:
    """(generator, gen_idx, fields but the text, text, fluency, similarity) of the first ``most`` valid variants of each generator."""
    t, low = Text(text), 1.0 - MAX_DISTANCE
    same = Variants(text, t.body)
    for name in GENERATORS:
        kept = 0
        for k, (fields, variant, *edit) in enumerate(EDITS[name](t)):
            fluent = grammatical(variant)
            if fluent >= MIN_FLUENCY:
                ratio = same.ratio(variant, *edit, low)
                if ratio is not None and low < ratio < 1.0:
                    yield name, k, fields, variant, fluent, ratio
                    kept += 1
                    if kept == most:
                        break


def _valid_of_lists(text: str, lists: list[list[dict]], most: int) -> Iterator[Row]:
    """The same where the plausible variants are made already."""
    ratios = first_valid_similarities(text, [[v["text"] for v in one] for one in lists], most)
    for v, r in zip((v for one in lists for v in one), (r for one in ratios for r in one)):
        if r is not None:
            yield v["generator"], v["gen_idx"], tuple(v[f] for f in OTHERS), v["text"], v["fluency_score"], r


def valid_variants(df: DataFrame, text: str = "notes", max_per_generator: int | None = 3,
                   keep: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """Validated variants with their validation flags, the first ``max_per_generator`` of each generator (None: all), numbered by pert_idx.

    Variants are made and compared in Python one rule after the other until a
    generator has enough (``functions/edits.py``): only a text goes there, only its
    valid variants come back. The rare texts for which Java's letters may differ
    from Python's bring their variants along, made as Columns. Nothing is shuffled.
    """
    t, most = F.col("_text"), max_per_generator if max_per_generator is not None else 2147483647
    rare = (F.octet_length(t) != F.length(t)) & F.rlike(t, F.lit(E.RARE))
    d = df.where(F.col(text).isNotNull()).select(*keep, F.col(text).alias("_text"))
    d = d.withColumn("_lists", F.when(rare, F.array(*[_all_plausible(n, t) for n in GENERATORS])))
    names = ["generator", "gen_idx", *FIELDS, "fluency_score", "edit_distance_ratio"]
    types = [T.StringType(), T.IntegerType(), *[T.StringType()] * len(FIELDS), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField("pert_idx", T.IntegerType()), *map(T.StructField, names, types)])
    kinds = [pa.int32(), pa.string(), pa.int32(), *[pa.string()] * len(FIELDS), pa.float64(), pa.float64()]
    others = [FIELDS.index(f) for f in OTHERS]

    def batch_of(batch: pa.RecordBatch, rows: list[tuple[int, int, Row]]) -> pa.RecordBatch:
        came, numbers, made = zip(*rows)
        generators, places, fields, texts, fluent, ratios = zip(*made)
        by_field = dict(zip(others, zip(*fields))) | {FIELDS.index("text"): texts}
        values = [numbers, generators, places, *[by_field[i] for i in range(len(FIELDS))], fluent, ratios]
        kept = batch.select(list(keep)).take(pa.array(came, pa.int64())).columns
        return pa.RecordBatch.from_arrays([*kept, *map(pa.array, values, kinds)], [f.name for f in schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, letters = [], 0
            for at in range(0, len(batch), TEXTS):
                texts, lists = (batch.column(c).slice(at, TEXTS) for c in ("_text", "_lists"))
                for i, (one, made) in enumerate(zip(texts.to_pylist(), lists), at):
                    found = _valid_of_lists(one, made.as_py(), most) if made.is_valid else _valid_of(one, most)
                    for n, row in enumerate(found):
                        rows.append((i, n, row))
                        letters += len(row[3])
                        if letters >= LETTERS:
                            yield batch_of(batch, rows)
                            rows, letters = [], 0
            if rows:
                yield batch_of(batch, rows)

    out = d.mapInArrow(run, schema)
    return out.withColumns(fluency.validity(F.col("edit_distance_ratio"), F.col("fluency_score")))


def validate(df: DataFrame, original: str = "original", perturbed: str = "text") -> DataFrame:
    """Similarity, fluency and the validity flags of given pairs."""
    d = df.withColumns({"edit_distance_ratio": fluency.similarity(original, perturbed),
                        "fluency_score": fluency.grammaticality(F.col(perturbed))})
    return d.withColumns(fluency.validity(F.col("edit_distance_ratio"), F.col("fluency_score")))


def compare_with_original(perturbed: DataFrame, original: DataFrame) -> DataFrame:
    """Flip flag, confidence change and direction against the original prediction.

    ``perturbed``: event_id, model, label, confidence, success and any more;
    ``original``: event_id, model, pred_label, pred_conf. Failed rows and rows
    without an original keep null results.
    """
    o = original.select("event_id", "model", F.col("pred_label").alias("orig_label"), F.col("pred_conf").alias("orig_conf"))
    d = perturbed.join(o, ["event_id", "model"], "left")
    known = F.col("success") & F.col("orig_label").isNotNull()
    flipped = F.col("label") != F.col("orig_label")
    return d.withColumns({
        "label_flipped": F.when(known, flipped),
        "confidence_delta": F.when(known, F.col("confidence") - F.col("orig_conf")),
        "flip_direction": F.when(known & flipped, F.concat("orig_label", F.lit(" -> "), "label"))})
