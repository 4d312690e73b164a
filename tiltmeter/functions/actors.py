"""Actor names: three separate ideas of a state actor, and ordered actor groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .common import col, let

# Terms that mark a state actor in the fairness groups.
STATE_TERMS = ["state forces", "military", "police", "government", "gendarmerie"]

# Ordered actor groups, first hit wins. The state-forces entry is
# built from the country name and stands fourth.
GROUPS_BEFORE_STATE = [
    ("Communal Militia", ["communal militia"]),
    ("Ambazonia", ["ambazon", "ambazonia"]),
    ("Boko Haram / ISWAP", ["boko haram", "iswap", "islamic state west africa"]),
]
GROUPS_AFTER_STATE = [
    ("Protesters/Rioters/Civilians", ["protest", "riot", "civilian"]),
    ("MNJTF", ["mnjtf", "multinational joint task force"]),
    ("Pirates", ["pirate"]),
]
OTHER_ACTORS = "Other Actors"


def any_contains(c: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(t) for t in terms])


def strip_parens(c: str | Column) -> Column:
    return F.btrim(F.regexp_replace(col(c), r"(?U)\s*\([^)]*\)", ""), F.lit(" \t\n\r\x0b\x0c"))


def _state_terms(country: str) -> list[str]:
    return [f"military forces of {country}", f"police forces of {country}"]


def is_state_by_name(c: str | Column, country: str) -> Column:
    """"Military/Police Forces of <country>" in the name; country is given in lower case."""
    name = F.lower(strip_parens(F.coalesce(col(c), F.lit(""))))
    return let(name, lambda n: any_contains(n, _state_terms(country)))


def actor_group(c: str | Column) -> Column:
    """state / non-state by keyword, unknown when missing."""
    a = col(c)
    return (F.when(a.isNull(), "unknown").when(any_contains(F.lower(a), STATE_TERMS), "state")
            .otherwise("non-state"))


def mentions_actor(c: str | Column, name: str) -> Column:
    """Case-insensitive contains, false when missing."""
    return F.coalesce(F.lower(col(c)).contains(name.lower()), F.lit(False))


def default_groups(country: str = "Cameroon") -> list[tuple[str, list[str]]]:
    return (GROUPS_BEFORE_STATE + [(f"State forces ({country})", _state_terms(country.lower()))]
            + GROUPS_AFTER_STATE)


def normalize_actor(c: str | Column, groups=None, country: str = "Cameroon") -> Column:
    """First matching group label, else "Other Actors".

    ``groups`` is an ordered list of (label, terms) or (label, function from the
    lower-cased name Column to a boolean Column).
    """
    def first_group(name):
        out = None
        for label, matcher in (default_groups(country) if groups is None else groups):
            cond = matcher(name) if callable(matcher) else any_contains(name, matcher)
            cond = F.coalesce(cond, F.lit(False))
            out = F.when(cond, label) if out is None else out.when(cond, label)
        return F.lit(OTHER_ACTORS) if out is None else out.otherwise(OTHER_ACTORS)

    return let(F.lower(strip_parens(F.coalesce(col(c), F.lit("")))), first_group)
