"""Small Column helpers shared by every module.

Sessions run with ANSI semantics by default, so nothing here divides by zero,
indexes past an array or casts text that may not parse.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Trim every kind of blank, not only spaces."""
    return F.btrim(col(c), F.lit(BLANKS))


def collapse_blanks(c: str | Column) -> Column:
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)\s+", " ")


def ratio(num: Column, den: Column, default=0.0) -> Column:
    """num/den as double, ``default`` where den is 0 or null."""
    d = F.lit(default).cast("double") if default is not None else F.lit(None).cast("double")
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(d)


def count_where(cond: Column) -> Column:
    """Rows where cond is true, as bigint (0 on an empty group)."""
    return F.coalesce(F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))), F.lit(0)).cast("bigint")


def literal_map(pairs: Mapping[str, object]) -> Column:
    items = []
    for k, v in pairs.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def lookup(pairs: Mapping[str, object], key: Column) -> Column:
    """Value of a small fixed mapping, null for an unknown or null key."""
    return F.try_element_at(literal_map(pairs), key)


def lit_array(values: Iterable) -> Column:
    return F.array(*[F.lit(v) for v in values])


def capitalize(c: Column) -> Column:
    """First character upper-case, everything else lower-case."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2147483647)))


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns


def let(value: Column, body) -> Column:
    """``body(value)`` with value computed once per row.

    An expression used inside a lambda would otherwise be computed again for
    every array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
