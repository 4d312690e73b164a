"""From raw event tables to standard events: column resolution, normalising, filters, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.actors import is_state_by_name, normalize_actor
from ..functions.common import col, collapse_blanks, strip
from ..functions.labels import CLASSES
from .ranking import keep_one


def resolve_columns(df: DataFrame, names: list[str]) -> dict[str, str | None]:
    """Wanted name to the actual column, matched without regard to case."""
    have = {c.lower(): c for c in df.columns}
    return {n: have.get(n.lower()) for n in names}


def require(df: DataFrame, **wanted: list[str]) -> DataFrame:
    """Select and rename: each keyword lists alternative source names, first hit wins."""
    out, missing = [], []
    for target, names in wanted.items():
        found = next((c for c in resolve_columns(df, names).values() if c), None)
        if found is None:
            missing.append(target)
        else:
            out.append(F.col(f"`{found}`").alias(target))
    if missing:
        raise ValueError(f"missing required columns: {missing}; found {df.columns}")
    return df.select(*out)


def extract_country(df: DataFrame, country: str, country_col: str = "country") -> DataFrame:
    """Rows of one country; blanks and case do not matter."""
    found = resolve_columns(df, [country_col, "country"])
    name = found[country_col] or found["country"]
    if name is None:
        raise ValueError(f"no column {country_col!r} in {df.columns}")
    return df.where(F.lower(strip(F.coalesce(F.col(name), F.lit("")))) == country.strip().lower())


def standardize(df: DataFrame, min_notes_len: int = 10, order: list[str] | None = None) -> DataFrame:
    """Standard events: blanks collapsed, six classes only, one row per id, actor group added.

    Of several rows with one id the first by ``order`` stays (default: by the
    remaining columns, so the choice does not depend on file order).
    """
    cols = resolve_columns(df, ["event_id_cnty", "event_id", "notes", "event_type", "country", "actor1"])
    base = require(df, event_id=["event_id_cnty", "event_id"], notes=["notes"], event_type=["event_type"],
                   country=["country"], **({"actor1": ["actor1"]} if cols["actor1"] else {}),
                   **{c: [c] for c in order or []})
    out = base.withColumns({"notes": strip(collapse_blanks("notes")),
                            "country": strip(F.coalesce("country", F.lit("")))})
    out = out.where(F.col("event_type").isin(CLASSES) & (F.length("notes") >= min_notes_len))
    out = keep_one(out, ["event_id"], order or [c for c in out.columns if c != "event_id"])
    actor = normalize_actor("actor1") if cols["actor1"] else F.lit("")
    return out.withColumn("actor_norm", actor).select("event_id", "notes", "event_type", "country", "actor_norm")


def usable_state_rows(df: DataFrame, country: str, notes_limit: int | None = None,
                      order: list[str] | None = None) -> DataFrame:
    """State-actor rows with notes and a known class, one per id.

    Notes are kept whole; ``notes_limit=400`` gives the shortened notes that
    small prompts were built from.
    """
    base = require(df, event_id_cnty=["event_id_cnty", "event_id"], notes=["notes"], event_type=["event_type"],
                   actor1=["actor1"], **{c: [c] for c in order or []})
    rows = base.where(is_state_by_name("actor1", country.lower()) & F.col("notes").isNotNull()
                      & F.col("event_type").isin(CLASSES))
    notes = collapse_blanks("notes")
    rows = rows.withColumns({"notes": F.substring(notes, 1, notes_limit) if notes_limit else notes,
                             "actor_norm": normalize_actor("actor1")})
    rows = keep_one(rows, ["event_id_cnty"], order or [c for c in rows.columns if c != "event_id_cnty"])
    return rows.select("event_id_cnty", "notes", "event_type", "actor_norm")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct trimmed values, missing as empty text."""
    name = resolve_columns(df, [column])[column]
    if name is None:
        raise ValueError(f"no column {column!r} in {df.columns}")
    return (df.select(strip(F.coalesce(F.col(name).cast("string"), F.lit(""))).alias("value"))
            .distinct().orderBy("value"))


def enrich_notes(df: DataFrame, sample: DataFrame) -> DataFrame:
    """Left join of the distinct (event_id, notes) pairs onto predictions."""
    notes = require(sample, event_id=["event_id", "event_id_cnty"], notes=["notes"]).distinct()
    return df.drop("notes").join(notes, "event_id", "left")


def enrich_metadata(df: DataFrame, raw: DataFrame) -> DataFrame:
    """Left join of one raw row per event; raw notes take the place of the notes in ``df``."""
    have = resolve_columns(raw, ["notes", "source", "source_scale", "fatalities"])
    extra = {k: [v] for k, v in have.items() if v}
    meta = require(raw, event_id=["event_id_cnty", "event_id"], **extra)
    one = keep_one(meta, ["event_id"], [c for c in meta.columns if c != "event_id"])
    return df.drop(*extra).join(one, "event_id", "left")


def dedup_results(df: DataFrame, order: list[str | Column], keep: str = "last") -> DataFrame:
    """One row per (model, event_id): ``last`` for re-runs, ``first`` when comparing files."""
    return keep_one(df, ["model", "event_id"], [col(c) for c in order], last=keep == "last")


def union_aligned(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Union by name; a column one side lacks is null there."""
    for o in others:
        first = first.unionByName(o, allowMissingColumns=True)
    return first


def union_training_tables(*tables: DataFrame) -> DataFrame:
    """Union of training tables whose id or class column goes by an older name."""
    renamed = []
    for t in tables:
        for old, new in (("event_id_cnty", "event_id"), ("event_type_full", "event_type")):
            if old in t.columns and new not in t.columns:
                t = t.withColumnRenamed(old, new)
        renamed.append(t)
    return union_aligned(*renamed)
