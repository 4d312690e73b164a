"""Annotation columns over event notes: provenance, verbs, casualties, voice, actor ambiguity.

Every annotator is one Column over the whole text. Most patterns need some
literal word, and a text without it is spared the regular expression. A single
annotator looks for each word by itself; ``annotate`` runs one automaton over
the text that finds all words of all annotators in one pass (:func:`word_bits`),
and the annotators test their bits.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import text_patterns as P
from .actors import any_contains
from .common import col, has_column, let

ANNOTATIONS = ["annotation_provenance", "annotation_ambiguous_actor", "annotation_verb_intensity",
               "annotation_casualty_counts", "annotation_passive_voice", "annotation_notes"]


def _longest_run(plain: str) -> str:
    """The longest run of letters that is not cut short by an optional last letter."""
    runs = [r[:-2] if r[-1] in "?*{" else r for r in re.findall(r"[A-Za-z]+[?*{]?", plain)]
    return max(runs, key=len, default="").lower()


def _needed_words(pattern: str) -> tuple[str, ...]:
    """Words of which every match contains one, in lower case; empty if none can be told.

    That is the longest word outside brackets, or, where it is short, the words
    of the bracket whose alternatives are longest. Optional parts do not count.
    """
    plain = re.sub(r"\\[^A-Za-z]|\\[A-Za-z][+*?]?|\[[^\]]*\][+*?]?", " ", pattern).replace("(?:", "(")
    choices = [tuple(_longest_run(x) for x in g.split("|")) for g in re.findall(r"\(([^()]*)\)(?![?*])", plain)]
    while "(" in plain:
        plain = re.sub(r"\([^()]*\)[+*?]?", " ", plain)
    word = _longest_run(plain)
    best = max(choices, key=lambda words: min(map(len, words)), default=())
    if len(word) < 3 and best and min(map(len, best)) >= 3:
        return tuple(dict.fromkeys(best))
    return (word,) if word else ()


def _letters_first(pattern: str) -> str:
    """The same pattern with the boundary before its opening letters tested after them.

    Java then compares letters at each position, and looks at the boundary only
    where they are found.
    """
    m = re.match(r"\\b([A-Za-z]+)", pattern)
    optional = m and pattern[m.end():m.end() + 1] in ("?", "*", "{")
    word = (m.group(1)[:-1] if optional else m.group(1)) if m else ""
    return f"{word}(?<!\\w{word}){pattern[2 + len(word):]}" if word else pattern


def both_cases(text: Column) -> Column:
    """The text and its lower-cased form, to be bound once by ``let``."""
    return F.struct(text.alias("x"), F.lower(text).alias("low"))


def _hit(t: Column, pattern: str, field: str, flags: str) -> Column:
    return F.rlike(t[field], F.lit(f"(?{flags})" + _letters_first(pattern)))


@lru_cache(maxsize=1)
def _places() -> dict[str, int]:
    """The bit of each word that some pattern needs."""
    families = [P.STATE_MEDIA, P.INTERNATIONAL_MEDIA, P.NIGERIA_MEDIA, P.CAMEROON_MEDIA, P.NORTH_AFRICA_MEDIA, P.LOCAL_MEDIA, P.SOCIAL_MEDIA, P.SECURITY_FIRMS,
                P.HIGH_VERBS, P.MEDIUM_VERBS, P.LOW_VERBS, P.CASUALTIES, P.PASSIVE, P.AGENT_OBSCURING, P.PASSIVE_HEDGES, P.NOMINALIZATIONS, P.ACTIVE, P.AMBIGUOUS_ACTOR]
    return {w: i for i, w in enumerate(sorted({w for f in families for p in f for w in _needed_words(p)}))}


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, i in _places().items():
        found.add_word(word, 1 << i)
    found.make_automaton()
    return found


def _bits_of(low: pa.Array) -> pa.Array:
    words, automaton, full = -(-len(_places()) // 63), _automaton(), (1 << 63) - 1
    out = []
    for text in low.to_pylist():
        seen = 0
        for bit in {bit for _, bit in automaton.iter(text or "")}:
            seen |= bit
        out.append([seen >> (63 * k) & full for k in range(words)])
    return pa.array(out, pa.list_(pa.int64()))


def word_bits(text: Column) -> Column:
    """Which of the words that patterns need occur in a text, 63 to a number: one pass over it for all of them."""
    return F.arrow_udf(_bits_of, "array<bigint>")(F.lower(F.coalesce(text, F.lit(""))))


def _any_word(t: Column, words: tuple[str, ...], bits: Column | None) -> Column:
    if bits is None:
        return reduce(lambda a, b: a | b, [F.contains(t["low"], F.lit(w)) for w in words])
    masks: dict[int, int] = {}
    for i in (_places()[w] for w in words):
        masks[i // 63] = masks.get(i // 63, 0) | 1 << i % 63
    return reduce(lambda a, b: a | b, [bits[k].bitwiseAND(F.lit(mask).cast("bigint")) != 0 for k, mask in masks.items()])


def _guarded(t: Column, patterns: list[str], field: str, flags: str, bits: Column | None) -> list[tuple[Column, list[Column]]]:
    """Patterns grouped by the words they need: (a needed word occurs, pattern tests)."""
    groups: dict[tuple[str, ...], list[Column]] = {}
    for p in patterns:
        groups.setdefault(_needed_words(p), []).append(_hit(t, p, field, flags))
    return [(_any_word(t, words, bits) if words else F.lit(True), hits) for words, hits in groups.items()]


def any_match(t: Column, patterns: list[str], field: str = "x", flags: str = "iU", bits: Column | None = None) -> Column:
    """Any pattern occurs in a text bound by :func:`both_cases`; ``bits`` are those of the text or of a longer one that holds it."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for p in patterns:
        groups.setdefault(_needed_words(p), []).append(_letters_first(p))
    hits = {words: F.rlike(t[field], F.lit(f"(?{flags})" + "|".join(f"(?:{p})" for p in same))) for words, same in groups.items()}
    return reduce(lambda a, b: a | b, [_any_word(t, words, bits) & hit if words else hit for words, hit in hits.items()])


def match_count(t: Column, patterns: list[str], field: str = "x", flags: str = "iU", bits: Column | None = None) -> Column:
    """How many of the patterns occur at least once."""
    def count(hits):
        return reduce(lambda a, b: a + b, [F.when(h, 1).otherwise(0) for h in hits])

    return reduce(lambda a, b: a + b, [F.when(guard, count(hits)).otherwise(0)
                                       for guard, hits in _guarded(t, patterns, field, flags, bits)])


def _told_text(source: Column, notes: Column) -> Column:
    s, n = F.coalesce(source, F.lit("")), F.coalesce(notes, F.lit(""))
    return F.concat(s, F.when((s != "") & (n != ""), " ").otherwise(""), n)


def provenance(source: Column, scale: Column, notes: Column, bits: Column | None = None) -> Column:
    """Kind of source by pattern family, with the declared scale as fallback.

    A missing source counts as empty. "subnational" contains "national" and so
    falls in the national branch.
    """
    text = _told_text(source, notes)
    families = {"state": P.STATE_MEDIA, "intl": P.INTERNATIONAL_MEDIA, "nga": P.NIGERIA_MEDIA, "cmr": P.CAMEROON_MEDIA,
                "north": P.NORTH_AFRICA_MEDIA, "local": P.LOCAL_MEDIA, "social": P.SOCIAL_MEDIA, "security": P.SECURITY_FIRMS}

    def kind(h):
        return (F.when(h["state"] & ~(h["intl"] | h["nga"] | h["cmr"]), "State-affiliated")
                .when(h["security"], "Security-Analysis").when(h["intl"], "Independent-International")
                .when(h["nga"] | h["cmr"] | h["north"], "Independent-National")
                .when(h["social"], "Social-Media").when(h["local"], "Local/Community"))

    by_text = let(both_cases(text), lambda t: let(F.struct(*[any_match(t, v, bits=bits).alias(k) for k, v in families.items()]), kind))
    sc = F.lower(F.coalesce(scale, F.lit("")))
    by_scale = (F.when(sc.contains("international"), "Independent-International")
                .when(sc.contains("national"), "Independent-National").when(sc.contains("regional"), "Regional")
                .when(sc.contains("local"), "Local/Community").when(sc.contains("new media"), "Social-Media"))
    return F.coalesce(by_text, by_scale, F.lit("Unknown"))


def verb_intensity(notes: Column, bits: Column | None = None) -> Column:
    def level(t):
        return (F.when(any_match(t, P.HIGH_VERBS, "low", "U", bits), "High").when(any_match(t, P.MEDIUM_VERBS, "low", "U", bits), "Medium")
                .when(any_match(t, P.LOW_VERBS, "low", "U", bits), "Low").otherwise("Unknown"))

    return let(both_cases(F.coalesce(notes, F.lit(""))), level)


def casualties(fatalities: Column, notes: Column, bits: Column | None = None) -> Column:
    """Yes (n) from the fatality count, else from the first matching pattern, else No."""
    def mention(t):
        found = [F.when(_hit(t, p, "low", "U"), F.regexp_extract(t["low"], "(?U)" + p, 0)) for p in P.CASUALTIES]
        return F.when(any_match(t, P.CASUALTIES, "low", "U", bits), F.coalesce(*found))

    def said(found):
        number = F.regexp_extract(found, r"(?U)\d+", 0)
        return (F.when(found.isNull(), "No").when(number != "", F.concat(F.lit("Yes ("), number, F.lit(")")))
                .otherwise("Yes (unspecified)"))

    deaths = F.nanvl(F.coalesce(fatalities.try_cast("double"), F.lit(0.0)), F.lit(0.0)).cast("bigint")
    in_text = let(let(both_cases(F.coalesce(notes, F.lit(""))), mention), said)
    return F.when(deaths > 0, F.concat(F.lit("Yes ("), deaths.cast("string"), F.lit(")"))).otherwise(in_text)


def passive_voice(notes: Column, bits: Column | None = None) -> Column:
    """Yes / No / Mixed / Unknown from weighted counts of passive and active patterns."""
    def weigh(t):
        passive = (match_count(t, P.PASSIVE, bits=bits) + match_count(t, P.AGENT_OBSCURING, bits=bits) * F.lit(1.5)
                   + match_count(t, P.PASSIVE_HEDGES, bits=bits) + match_count(t, P.NOMINALIZATIONS, bits=bits))
        return F.struct(passive.cast("double").alias("p"), (match_count(t, P.ACTIVE, bits=bits) * F.lit(1.5)).cast("double").alias("a"))

    def verdict(w):
        p, a = w["p"], w["a"]
        both = (p > 0) & (a > 0)
        return (F.when(both & (p > a * 1.5), "Yes").when(both & (a > p * 1.5), "No").when(both, "Mixed")
                .when(p >= 1, "Yes").when(a >= 1, "No").otherwise("Unknown"))

    return let(let(both_cases(F.coalesce(notes, F.lit(""))), weigh), verdict)


def ambiguous_actor(notes: Column, actor: Column, bits: Column | None = None) -> Column:
    text, who = F.coalesce(notes, F.lit("")), F.lower(F.coalesce(actor, F.lit("")))
    n = let(both_cases(text), lambda t: match_count(t, P.AMBIGUOUS_ACTOR, "low", "U", bits))
    by_text = let(n, lambda c: F.when(c >= 2, "Yes").when(c == 1, "Partial").otherwise("No"))
    return F.when(text == "", "Unknown").when(any_contains(who, P.AMBIGUOUS_ACTOR_TERMS), "Yes").otherwise(by_text)


def annotate(df: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Add the annotation columns, filling only cells that are missing or empty.

    ``metadata`` (event_id plus any of source, source_scale, fatalities) is
    joined on event_id after keeping one row per event.
    """
    if metadata is not None:
        extra = [c for c in ("source", "source_scale", "fatalities") if c in metadata.columns]
        one = metadata.groupBy("event_id").agg(F.min(F.struct(*extra)).alias("_m")).select("event_id", "_m.*")
        df = df.drop(*extra).join(one, "event_id", "left")

    def opt(name):
        return F.col(name) if has_column(df, name) else F.lit(None).cast("string")

    notes = opt("notes")
    had = df.columns
    df = df.withColumn("_words", word_bits(_told_text(opt("source"), notes)))
    bits = F.col("_words")
    new = {
        "annotation_provenance": provenance(opt("source"), opt("source_scale"), notes, bits),
        "annotation_ambiguous_actor": ambiguous_actor(notes, opt("actor_norm"), bits),
        "annotation_verb_intensity": verb_intensity(notes, bits),
        "annotation_casualty_counts": casualties(opt("fatalities"), notes, bits),
        "annotation_passive_voice": passive_voice(notes, bits),
        "annotation_notes": F.lit("[auto-generated]"),
    }
    filled = {c: F.coalesce(F.nullif(col(c), F.lit("")), v) if has_column(df, c) else v for c, v in new.items()}
    return df.select(*[filled.pop(c).alias(c) if c in filled else col(c) for c in had], *[v.alias(c) for c, v in filled.items()])
