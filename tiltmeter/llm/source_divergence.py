"""Source divergence: how far the term shares of a language's sources are apart, pair by pair, and which terms a source overuses."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.tables import control_table
from .common import filled, narrow, release, stored, words

#: A term is kept if so many documents of its language have it.
LEAST_DOCS = 30
#: Ranks of overused terms per source.
TOP_TERMS = 50
#: Shares are whole parts of this scale, after SMOOTH occurrences are added to each term.
SCALE, SMOOTH = 1_000_000_000, 5
#: Terms of a language are dealt into blocks of about so many, sources into tiles; a pair task holds two tiles of one block.
BLOCK = 1 << 15
TILE = 8
SLICE = 8 << 20
#: Rows of term counts that a task merges before it lets them go.
MERGED = 1 << 20
#: Bytes as they are matched: capital letters become small ones, every other ASCII byte but a small letter a blank.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of letters and of characters beyond ASCII, only A-Z lower-cased: flat, and the offsets of each text's terms."""
    texts = filled(texts)
    texts = pa.concat_arrays([texts]) if texts.offset else texts
    _, offsets, data = texts.buffers()
    data = pa.py_buffer((data.to_pybytes() if data is not None else b"").translate(_LETTERS))
    return words(pa.StringArray.from_buffers(len(texts), offsets, data))


def _counted(part: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs) of a few rows; a row without a term per group says that it occurs."""
    lang, source = (part.column(c).dictionary_encode() for c in ("lang", "source"))
    found, offsets = terms(part.column("text"))
    coded = found.dictionary_encode()
    n_terms = max(len(coded.dictionary), 1)
    row = np.repeat(np.arange(len(part)), np.diff(offsets))
    key, times = np.unique(row * n_terms + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(source.dictionary) + source.indices.to_numpy(zero_copy_only=False)
    pair, at = np.unique(group[key // n_terms] * n_terms + key % n_terms, return_inverse=True)
    n, docs = np.bincount(at, weights=times, minlength=len(pair)).astype(np.int64), np.bincount(at, minlength=len(pair)).astype(np.int64)
    here = np.unique(group)
    of = np.concatenate([pair // n_terms, here])
    term = pa.concat_arrays([coded.dictionary.take(pa.array(pair % n_terms)), pa.array([""] * len(here), pa.string())])
    zero = np.zeros(len(here), np.int64)
    return pa.table([lang.dictionary.take(pa.array(of // len(source.dictionary))), source.dictionary.take(pa.array(of % len(source.dictionary))), term,
                     np.concatenate([n, zero]), np.concatenate([docs, zero])], names=["lang", "source", "term", "n", "docs"])


def _task_counts(batches):
    """Term counts of a task, merged as far as ``MERGED`` rows allow."""
    held, rows = [], 0

    def merged():
        made = pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
        return made.rename_columns(["lang", "source", "term", "n", "docs"])

    for batch in batches:
        size = np.cumsum(pa.compute.binary_length(filled(batch.column("text"))).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE, "right")))
            held.append(_counted(batch.slice(at, to - at)))
            rows, at = rows + len(held[-1]), to
            if rows > 2 * MERGED:
                held = [merged()]
                rows = len(held[0])
                if rows > MERGED:
                    yield from held.pop().to_batches(max_chunksize=1 << 16)
                    rows = 0
    if held:
        yield from merged().to_batches(max_chunksize=1 << 16)
    release()


def kept_counts(df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n): occurrences of every kept term, and one row with an empty term for every group there is.

    Tasks count before anything moves, and all that is said of a term of a language meets
    in one place, so its documents are added up without a second shuffle.
    """
    text = {k: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for k, c in (("lang", lang_col), ("source", source_col), ("text", text_col))}
    counts = narrow(df, **text).mapInArrow(_task_counts, "lang string, source string, term string, n bigint, docs bigint").repartition("lang", "term")
    counts = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    in_lang = F.sum("docs").over(Window.partitionBy("lang", "term"))
    return counts.withColumn("in_lang", in_lang).filter((F.col("term") == "") | (F.col("in_lang") >= least_docs)).select("lang", "source", "term", "n")


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * kept)), exact."""
    whole = (count + SMOOTH).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    over = (total + SMOOTH * kept).cast("decimal(19,0)")
    return (F.floor((whole - whole % over) / over) + 1).cast("bigint")


def shares(count: np.ndarray, over: int) -> np.ndarray:
    """:func:`share` of many counts, by long division one digit at a time: exact as long as ``over`` has 17 digits."""
    out, rest = np.divmod(count + SMOOTH, over)
    for _ in range(9):
        more, rest = np.divmod(rest * 10, over)
        out = out * 10 + more
    return out + 1


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each sorted id in ``short`` its place in sorted ``long``, -1 if absent.

    Every id starts where its share of the way suggests, strides out in doubling
    steps until it is bracketed, and halves the bracket.
    """
    if not len(short) or not len(long):
        return np.full(len(short), -1)
    start = np.arange(len(short)) * len(long) // len(short)
    low, high, step = start.copy(), start.copy(), 1
    down, up = np.flatnonzero(long[start] > short), np.flatnonzero(long[start] < short)
    while len(down) or len(up):
        high[down], low[up] = low[down], high[up]
        low[down], high[up] = np.maximum(low[down] - step, -1), np.minimum(high[up] + step, len(long))
        down = down[low[down] >= 0]
        down = down[long[low[down]] > short[down]]
        up = up[high[up] < len(long)]
        up = up[long[high[up]] < short[up]]
        step *= 2
    open_ = np.flatnonzero(high - low > 1)
    while len(open_):
        mid = (low[open_] + high[open_]) // 2
        right = long[mid] <= short[open_]
        low[open_] = np.where(right, mid, low[open_])
        high[open_] = np.where(right, high[open_], mid)
        open_ = open_[high[open_] - low[open_] > 1]
    for edge in (low, high):
        fine = (edge >= 0) & (edge < len(long))
        hit = np.zeros(len(short), bool)
        hit[fine] = long[edge[fine]] == short[fine]
        low = np.where(hit, edge, low)
    fine = (low >= 0) & (low < len(long))
    return np.where(fine & (long[np.clip(low, 0, len(long) - 1)] == short), low, -1)


def merge_price(a_ids, a_shares, a_none: int, b_ids, b_shares, b_none: int) -> tuple[int, int]:
    """(sum of the differences over all terms that a or b has, number of those terms); ``none`` is the share of a term without occurrences."""
    if len(a_ids) > len(b_ids):
        a_ids, a_shares, a_none, b_ids, b_shares, b_none = b_ids, b_shares, b_none, a_ids, a_shares, a_none
    at = gallop(a_ids, b_ids)
    both = at >= 0
    price = int(np.abs(a_shares[both] - b_shares[at[both]]).sum()) + int(np.abs(a_shares[~both] - b_none).sum())
    # One-sided terms of the longer array: all of it, less what was met.
    price += int(np.abs(b_shares - a_none).sum()) - int(np.abs(b_shares[at[both]] - a_none).sum())
    return price, len(a_ids) + len(b_ids) - int(both.sum())


PAIRS = "lang string, a string, b string, price bigint, terms bigint, gap bigint, kept bigint"


def _pair_task(left: pa.Table, right: pa.Table) -> pa.Table:
    """Every unordered pair of a source on the left and a later one on the right, over one block of terms."""
    def side(t):
        out = []
        for r in t.to_pylist():
            over = r["total"] + SMOOTH * r["kept"]
            ids, counts = np.array(r["ids"], np.int64), np.array(r["counts"], np.int64)
            out.append((r["number"], r["source"], ids, shares(counts, over) if over else counts, int(shares(np.zeros(1, np.int64), over)[0]) if over else 0, r))
        return sorted(out, key=lambda x: x[0])
    rows, right = [], side(right)
    for number, name, ids, priced, none, r in side(left):
        for other, other_name, other_ids, other_priced, other_none, _ in right:
            if number < other:
                price, n = merge_price(ids, priced, none, other_ids, other_priced, other_none)
                rows.append((r["lang"], name, other_name, price, n, abs(none - other_none), r["kept"]))
    kinds = [pa.string()] * 3 + [pa.int64()] * 4
    return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["lang", "a", "b", "price", "terms", "gap", "kept"])


def divergence(df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS,
               top_terms: int = TOP_TERMS, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value, rank.

    Terms are runs of ASCII letters and of characters beyond ASCII, with A-Z
    lower-cased. A language keeps the terms that at least ``least_docs`` of its
    documents have. A group (lang, source) gives each kept term a share of SCALE,
    with SMOOTH occurrences added, so no share is nothing.

    Part ``pair``: every other source of the language, by the sum of the
    differences of their shares over all kept terms. Part ``term``: the terms whose
    share is above that of the language, by the difference, ``top_terms`` of them.
    Ranks go by value downward, then by item in byte order.

    Null text, lang and source count as empty ones, so documents of no language
    make up a language of their own. A group without any term still is a group; a
    language that keeps no term has pairs of value 0. Repeated rows are documents
    of their own. An empty table gives an empty result; other columns are not read.

    Arrays of (term id, count) are cut into blocks of terms, so no task holds a
    whole vocabulary, and sources into tiles. A pair of tiles meets once per block.
    """
    counts = stored(kept_counts(df, lang_col, source_col, text_col, least_docs))
    found = counts.filter(F.col("term") != "")
    by_term = found.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"))
    by_lang = by_term.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("in_lang").alias("lang_total"))
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("total")).join(by_lang, "lang", "left").withColumns(
        {"kept": F.coalesce("kept", F.lit(0)), "lang_total": F.coalesce("lang_total", F.lit(0)),
         "number": F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1})
    groups = groups.withColumns({"blocks": F.greatest(F.lit(1), F.ceil(F.col("kept") / block)).cast("int"), "tile": F.floor(F.col("number") / tile).cast("int")})
    groups = control_table(groups.withColumn("tiles", F.max("tile").over(Window.partitionBy("lang")) + 1))

    numbered = by_term.join(groups.groupBy("lang").agg(F.max("blocks").alias("blocks")), "lang").select(
        "lang", "term", "in_lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"))
    numbered = numbered.withColumn("id", F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")))
    each = found.join(numbered, ["lang", "term"]).join(groups.select("lang", "source", "total", "kept", "lang_total"), ["lang", "source"])

    entries = each.select("lang", "source", "block", F.struct("id", "n").alias("entry")).unionByName(
        groups.select("lang", "source", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("struct<id:int,n:bigint>").alias("entry")))
    arrays = entries.groupBy("lang", "source", "block").agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    arrays = arrays.join(groups.drop("blocks", "lang_total"), ["lang", "source"]).select(
        "lang", "source", "block", "number", "tile", "tiles", "total", "kept", F.col("entries.id").alias("ids"), F.col("entries.n").alias("counts"))
    left = arrays.withColumns({"t1": F.col("tile"), "t2": F.explode(F.sequence("tile", F.col("tiles") - 1))})
    right = arrays.select([F.col(c).alias(c) for c in arrays.columns]).withColumns({"t1": F.explode(F.sequence(F.lit(0), F.col("tile"))), "t2": F.col("tile")})
    task = ["lang", "block", "t1", "t2"]
    tasks = left.groupBy(*task).cogroup(right.groupBy(*task)).applyInArrow(_pair_task, PAIRS)
    pairs = tasks.groupBy("lang", "a", "b").agg(F.sum("price").alias("price"), F.sum("terms").alias("terms"), F.max("gap").alias("gap"), F.max("kept").alias("kept"))
    value = F.col("price") + (F.col("kept") - F.col("terms")) * F.col("gap")  # terms that neither has differ alike
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("w")
    pairs = pairs.select("lang", ways, value.cast("bigint").alias("value")).select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")

    over = share(F.col("n"), F.col("total"), F.col("kept")) - share(F.col("in_lang"), F.col("lang_total"), F.col("kept"))
    used = each.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), over.alias("value")).filter("value > 0")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(used.withColumn("rank", rank).filter(F.col("rank") <= top_terms))
