"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, compared by subtracting and peeling.

Everything here is DataFrame expressions. The cells of all sketches of a task are
rows of one aggregation; a peeling step is one more aggregation over them, on the
partitioning they already have, so a whole comparison moves nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.common import let
from .common import narrow

#: A paragraph: a line, or of a longer line 30 characters and more up to the end of a sentence or of a long word, whichever comes
#: first. Counting starts anew with every line, so an edit changes the paragraphs of its own line only.
PARAGRAPH = r"[^\n]{30,}?(?:(?<=[.!?])|(?<=\S{14}))\s+|[^\n]+"
#: Cells per subtable in the printed fingerprint. Cell numbers are low bits, so it is the fold of any larger sketch.
PRINTED = 4
TABLES = 3
#: Peeling steps (one subtable each) of the first sketch, of the retry and of the second retry, and how much larger they are.
ATTEMPTS = ((9, 1), (6, 8), (6, 64))
MAX_CELLS = 1 << 20
ROWS_PER_BUCKET = 500
MAX_BUCKETS = 1 << 16
COARSE = 256


def paragraph_digests(text: Column) -> Column:
    """64-bit digests of the distinct paragraphs of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(F.rtrim(p))))


def cell_of(digest: Column, table: Column | int, cells: Column | int) -> Column:
    """Cell of a digest in one subtable; ``cells`` is a power of two up to 2^20 and each subtable reads bits of its own."""
    shift = F.lit(20 * table) if isinstance(table, int) else 20 * table
    moved = F.call_function("shiftrightunsigned", digest, shift.cast("int"))
    return moved.bitwiseAND((F.lit(cells) if isinstance(cells, int) else cells).cast("bigint") - 1)


def _printed_cell(digests: Column, table: int, cell: int) -> Column:
    inside = F.filter(digests, lambda d: cell_of(d, table, PRINTED) == cell)
    shown = lambda x: F.concat(F.lpad(F.hex(F.size(x).cast("bigint")), 4, "0"),
                               F.lpad(F.hex(F.aggregate(x, F.lit(0).cast("bigint"), lambda a, d: a.bitwiseXOR(d))), 16, "0"))
    return let(inside, shown)


def printed(digests: Column) -> Column:
    """Count and XOR of the digests in each cell of the printed sketch, as hexadecimal text."""
    return F.concat(*[_printed_cell(digests, t, c) for t in range(TABLES) for c in range(PRINTED)])


# The next document ---------------------------------------------------------------------------

def _bucketed(rows: DataFrame) -> DataFrame:
    """Adds ``bucket``, which never falls as ``key`` grows, with about equally many rows each."""
    n, low, high = rows.agg(F.count("*"), F.min("key"), F.max("key")).first()
    wanted = max(1, min(MAX_BUCKETS, n // ROWS_PER_BUCKET))
    coarse = min(COARSE, wanted)
    cuts = rows.agg(F.percentile_approx("key", [i / coarse for i in range(1, coarse)], 10_000)).first()[0] if coarse > 1 else []
    cuts = sorted(set(cuts))
    edges = [low, *[c + 1 for c in cuts], (high or 0) + 1] if n else [0, 1]
    inner = max(1, wanted // coarse)
    part = F.size(F.filter(F.lit(cuts).cast("array<bigint>"), lambda c: c < F.col("key"))) if cuts else F.lit(0)
    # In doubles: a step may be a little off for ids beyond 2^53, but it still never falls as the key grows.
    lows, widths = F.lit([float(a) for a in edges[:-1]]), F.lit([float(max(1, b - a)) for a, b in zip(edges, edges[1:])])
    rows = rows.withColumn("part", part)
    step = F.floor((F.col("key").cast("double") - F.get(lows, F.col("part"))) * inner / F.get(widths, F.col("part")))
    return rows.withColumn("bucket", (F.col("part") * inner + F.least(F.greatest(step, F.lit(0)), F.lit(inner - 1))).cast("int")).drop("part")


def with_next(rows: DataFrame, carried: list[str]) -> DataFrame:
    """Each (key, tie, …) row with ``next_<column>`` of the row after it in descending (key, tie) order, the first one after the last.

    Rows go to buckets of neighbouring keys once. The top row of each bucket also
    goes to the end of the bucket above it, so that no window spans the table.
    """
    rows = _bucketed(rows)
    tops = rows.groupBy("bucket").agg(F.max(F.struct("key", "tie")).alias("top"))
    order = Window.orderBy("bucket")  # one row a bucket: at most MAX_BUCKETS rows
    above = tops.select("bucket", "top", F.lead("bucket").over(order).alias("above"), F.min("bucket").over(Window.partitionBy()).alias("lowest"))
    above = F.broadcast(above.select(F.col("bucket").alias("b0"), F.col("top.key").alias("k0"), F.col("top.tie").alias("t0"),
                                     F.coalesce("above", "lowest").alias("to"), F.col("above").isNull().cast("int").alias("wraps")))
    moved = (rows.join(above, (rows["bucket"] == above["b0"]) & (rows["key"] == above["k0"]) & (rows["tie"] == above["t0"]))
             .select(*[rows[c] for c in rows.columns if c != "bucket"], F.col("to").alias("bucket"), F.lit(1).alias("guest"), "wraps"))
    every = rows.withColumns({"guest": F.lit(0), "wraps": F.lit(0)}).unionByName(moved)
    place = Window.partitionBy("bucket").orderBy("wraps", F.desc("key"), F.desc("tie"), "guest")
    return (every.withColumns({f"next_{c}": F.lead(c).over(place) for c in carried} | {"rid": F.row_number().over(place)})
            .filter("guest = 0").drop("guest", "wraps"))


# Subtract and peel ---------------------------------------------------------------------------

KEYS = ["bucket", "rid", "pair", "cells", "sub", "cell", "payload"]
FOUND, INFO = 8, 9


def _signed(pair: int, here: Column, there: Column) -> Column:
    item = lambda sign: lambda d: F.struct(F.lit(pair).alias("pair"), d.alias("x"), F.lit(sign).cast("bigint").alias("n"))
    return F.concat(F.transform(here, item(1)), F.transform(there, item(-1)))


def _cells(rows: DataFrame, pairs: list[tuple[Column, Column, Column, Column]]) -> DataFrame:
    """Cells of the difference of two sketches for each (wanted, here, there, cells per subtable) pair, and one info row a document."""
    empty = F.expr("cast(array() as array<struct<pair:int,x:bigint,n:bigint>>)")
    parts = [F.when(wanted, _signed(p, here, there)).otherwise(empty) for p, (wanted, here, there, _) in enumerate(pairs)]
    info = F.array(F.struct(F.lit(-1).alias("pair"), F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("n")))
    items = rows.select("bucket", "rid", "payload", *[m.cast("int").alias(f"m{p}") for p, (*_, m) in enumerate(pairs)],
                        F.explode(F.concat(info, *parts)).alias("i"))
    cells = reduce(lambda out, p: F.when(F.col("i.pair") == p, F.col(f"m{p}")).otherwise(out), range(len(pairs)), F.lit(0))
    items = items.select("bucket", "rid", F.col("i.pair").alias("pair"), cells.alias("cells"), F.col("i.x").alias("x"), F.col("i.n").alias("n"),
                         F.xxhash64("i.x").alias("check"), F.when(F.col("i.pair") < 0, F.col("payload")).alias("payload"))
    items = items.withColumn("sub", F.explode(F.when(F.col("pair") < 0, F.array(F.lit(INFO))).otherwise(F.array(*[F.lit(t) for t in range(TABLES)]))))
    items = items.withColumns({"cell": F.when(F.col("sub") == INFO, F.lit(0).cast("bigint")).otherwise(cell_of(F.col("x"), F.col("sub"), F.col("cells"))),
                               "check": F.when(F.col("sub") == INFO, F.lit(0).cast("bigint")).otherwise(F.col("check"))})
    return _merged(items)


def _merged(items: DataFrame) -> DataFrame:
    out = items.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("check").alias("check"))
    return out.filter((F.col("sub") >= FOUND) | (F.col("n") != 0) | (F.col("x") != 0) | (F.col("check") != 0))


def _peel(state: DataFrame, table: int) -> DataFrame:
    """Takes the digests that are alone in a cell of one subtable out of the other subtables, and counts them.

    A digest has one cell in each subtable, so none is taken out twice in a step.
    """
    pure = (F.col("sub") == table) & (F.abs("n") == 1) & (F.xxhash64("x") == F.col("check"))
    fields = lambda sub, cell, n, x, check: F.struct(F.lit(sub).cast("int").alias("sub") if isinstance(sub, int) else sub.alias("sub"), cell.cast("bigint").alias("cell"),
                                                     n.cast("bigint").alias("n"), x.cast("bigint").alias("x"), check.cast("bigint").alias("check"))
    zero = F.lit(0)
    gone = [fields(t, cell_of(F.col("x"), t, F.col("cells")), -F.col("n"), F.col("x"), F.col("check")) for t in range(TABLES) if t != table]
    found = fields(FOUND, zero, F.lit(1), zero, zero)
    same = fields(F.col("sub"), F.col("cell"), F.col("n"), F.col("x"), F.col("check"))
    moved = state.select("bucket", "rid", "pair", "cells", "payload", F.explode(F.when(pure, F.array(*gone, found)).otherwise(F.array(same))).alias("e"))
    return _merged(moved.select("bucket", "rid", "pair", "cells", "payload", "e.*"))


def _difference(rows: DataFrame, pairs, steps: int) -> DataFrame:
    """bucket, rid, payload, and per pair ``d<p>``: how many digests were peeled, null if some are left."""
    state = _cells(rows, pairs)
    for k in range(steps):
        state = _peel(state, k % TABLES)
    sums = [F.first("payload", ignorenulls=True).alias("payload")]
    for p in range(len(pairs)):
        mine = F.col("pair") == p
        left = F.coalesce(F.sum(F.when(mine & (F.col("sub") < TABLES), 1)), F.lit(0))
        peeled = F.coalesce(F.sum(F.when(mine & (F.col("sub") == FOUND), F.col("n"))), F.lit(0))
        sums.append(F.when(left == 0, peeled).alias(f"d{p}"))
    return state.groupBy("bucket", "rid").agg(*sums)


def _power_of_two(n: Column) -> Column:
    return F.least(F.greatest(F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(n.cast("double"), F.lit(1.0))))), F.lit(float(PRINTED))), F.lit(float(MAX_CELLS))).cast("int")


def differing(rows: DataFrame, here: str, others: list[str]) -> DataFrame:
    """bucket, rid, payload and ``d<p>``: the size of the symmetric difference of ``here`` and each of ``others``.

    ``payload`` is a struct with these digest arrays. The first sketch has cells for
    twice as many digests as there are; what cannot be peeled is tried
    again with 8 and then 64 times as many. What even that leaves (digests that
    share all three cells) is settled by comparing the digests.
    """
    own = lambda c: F.col(f"payload.{c}")
    for k, (steps, factor) in enumerate(ATTEMPTS):
        pairs = []
        for p, o in enumerate(others):
            size = _power_of_two((F.size(own(here)) + F.size(own(o))) * F.lit(2.0 / TABLES)) * factor
            open_ = F.lit(True) if k == 0 else F.col(f"payload.d{p}").isNull()
            pairs.append((open_, own(here), own(o), F.least(size, F.lit(MAX_CELLS))))
        got = _difference(rows, pairs, steps)
        known = [F.col(f"d{p}") if k == 0 else F.coalesce(F.col(f"payload.d{p}"), F.col(f"d{p}")) for p in range(len(others))]
        if k > 0:  # a pair that was not open has peeled nothing
            known = [F.when(F.col(f"payload.d{p}").isNotNull(), F.col(f"payload.d{p}")).otherwise(F.col(f"d{p}")) for p in range(len(others))]
        payload = F.col("payload")
        for p, d in enumerate(known):
            payload = payload.withField(f"d{p}", d.cast("bigint"))
        rows = got.select("bucket", "rid", payload.alias("payload"))
    plain = [F.coalesce(own(f"d{p}"), (F.size(F.array_except(own(here), own(o))) + F.size(F.array_except(own(o), own(here)))).cast("bigint"))
             for p, o in enumerate(others)]
    return rows.select("payload", *[d.alias(f"d{p}") for p, d in enumerate(plain)])


def likeness(here: Column, there: Column, difference: Column) -> Column:
    """Shared paragraphs over all paragraphs of two texts; 1 if neither has any."""
    both = F.size(here) + F.size(there)
    return F.when(both + difference == 0, F.lit(1.0)).otherwise((both - difference).cast("double") / (both + difference).cast("double"))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited version, and their likeness to each other and to the next document's.

    The edited text has its last floor(n_chars / 2) code points replaced by the first
    as many (or all) of the next document, in descending order of id; the first
    document follows the last. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    Ids are integers; a null id sorts last. A null text is empty; without paragraphs a
    fingerprint is all zeros. Rows of one id are ordered by a hash of the text, so equal
    rows follow each other. A single row is its own next one. An empty table gives an
    empty result. Other columns are not read.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    key = F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(-(1 << 63)))
    rows = with_next(narrow(df, doc_id=id_col, key=key, tie=F.xxhash64(text), text=text, own=paragraph_digests(text)), ["text", "own"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.select("bucket", "rid", "doc_id", n.cast("bigint").alias("n_chars"), "own", F.col("next_own").alias("following"),
                       F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited_text"))
    rows = rows.withColumn("edited", paragraph_digests(F.col("edited_text")))
    none = F.lit(None).cast("bigint")
    payload = F.struct("doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), "own", "edited", "following",
                       none.alias("d0"), none.alias("d1"))
    got = differing(rows.select("bucket", "rid", payload.alias("payload")), "own", ["edited", "following"])
    p = lambda c: F.col(f"payload.{c}")
    return got.select(p("doc_id").alias("doc_id"), p("n_chars").alias("n_chars"), p("edited_sha256").alias("edited_sha256"),
                      printed(p("own")).alias("fingerprint"), printed(p("edited")).alias("edited_fingerprint"),
                      likeness(p("own"), p("edited"), F.col("d0")).alias("near_edited"), likeness(p("own"), p("following"), F.col("d1")).alias("near_next"))
