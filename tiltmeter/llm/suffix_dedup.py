"""Exact removal of repeated byte strings over a whole corpus, by sparse suffix sorting.

Every string of ``LENGTH`` bytes has one *anchor*: of the short grams inside it,
the one whose hash is smallest. Equal strings have equal anchors at equal places,
so it is enough to look at occurrences of the same anchor gram together. An
anchor occurrence stands for the run of neighbouring strings that it is the
anchor of, and its *context* is what these strings cover.

1. Anchors are found where the texts lie. Only hashes and places are moved.
2. Sorted by (gram, context), every context but the first of its kind is a repeat
   as a whole. A gram with a single context is settled by that.
3. Where a gram has several contexts, their bytes are fetched and sorted: to the
   right and, reversed, to the left of the gram. Two contexts share the string
   that begins ``a`` bytes before the gram if they agree on a bytes to the
   left and on the rest to the right, which the longest common extensions of
   neighbours in both orders tell for every a.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import INNER, filled, mix64, narrow, ranges, stored, tidy, worker_cache

LENGTH = 100
GRAM = 32
#: Contexts of one gram that one task sorts; grams with more are compared string by string, in as many tasks as needed.
HOT = 250_000
CHUNK_ROWS = 20_000
SLICE = 1 << 20
#: Longest stretch of one text that is handled at once; longer texts are handled in stretches that overlap by a string.
STRETCH = 8 << 20
PLACE_BITS = np.uint64(24)
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
LOWEST = -(1 << 63)


# Prefix hashes -------------------------------------------------------------------------------

class Prefix:
    """Prefix sums of byte · base^place (mod 2^64), so that any substring's hash is one difference."""

    def __init__(self, data: np.ndarray, base: int):
        up, down = self.tables(len(data) + 1, base)
        self.down = down
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=self.sums[1:])

    @classmethod
    def tables(cls, n: int, base: int):
        """base^i and base^-i; the base is odd, so it has an inverse mod 2^64."""
        def make(size):
            tables = []
            for b in (base, pow(base, -1, 1 << 64)):
                t = np.full(size, b, np.uint64)
                t[0] = 1
                tables.append(np.multiply.accumulate(t))
            return tables

        usual = SLICE + (SLICE >> 4)
        return worker_cache(f"powers:{base}", lambda: make(usual)) if n <= usual else make(n)

    def hashes(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]


# 1. Anchors ----------------------------------------------------------------------------------

def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of strings by their anchor: text, gram hash, context hash, start of the first string, anchor - start, strings - 1.

    Ties go to the leftmost of equal grams. Starts count from the text's own start.
    """
    n = len(data)
    empty = [np.empty(0, np.int64)] * 6
    if n < length:
        return empty
    prefix = Prefix(data, BASES[0])
    grams = mix64(prefix.hashes(np.arange(n - gram + 1), gram))
    place = np.arange(len(grams), dtype=np.uint64)
    best = _sliding_min((grams >> PLACE_BITS << PLACE_BITS) | place, length - gram + 1)
    doc = np.repeat(np.arange(len(offsets) - 1), np.maximum(np.diff(offsets) - length + 1, 0))
    starts = ranges(offsets[:-1], np.maximum(np.diff(offsets) - length + 1, 0))
    if not len(starts):
        return empty
    at = (best[starts] & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    more = np.diff(np.concatenate([first, [len(starts)]])) - 1
    begin, at, doc = starts[first], at[first], doc[first]
    context = Prefix(data, BASES[1]).hashes(begin, more + length)
    shape = ((at - begin) * 256 + more).astype(np.uint64)
    return [doc, grams[at].view(np.int64), mix64(context ^ mix64(shape + np.uint64(7))).view(np.int64), begin - offsets[:-1][doc], at - begin, more]


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and each text's offsets, without copying."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def _stretches(offsets: np.ndarray, length: int, limit: int = SLICE, stretch: int = STRETCH):
    """(first text, texts, from byte, to byte): groups of short texts, and overlapping stretches of long ones."""
    at, n = 0, len(offsets) - 1
    while at < n:
        size = offsets[at + 1] - offsets[at]
        if size > stretch:
            for a in range(offsets[at], offsets[at + 1] - length + 1, stretch):
                yield at, 1, a, min(a + stretch + length - 1, offsets[at + 1])
            at += 1
            continue
        to = at + 1
        while to < n and offsets[to + 1] - offsets[at] <= limit:
            to += 1
        yield at, to - at, offsets[at], offsets[to]
        at = to


def _find_anchors(length: int, gram: int):
    def run(batches):
        for batch in batches:
            data, offsets = _bytes_of(filled(batch.column("text")))
            doc, tie = batch.column("doc").to_numpy(), batch.column("tie").to_numpy()
            for first, many, a, b in _stretches(offsets, length):
                inside = offsets[first:first + many + 1] - a if many > 1 or offsets[first] == a and offsets[first + many] == b else np.array([0, b - a])
                moved = 0 if many > 1 else a - offsets[first]
                d, g, c, begin, lead, more = anchors(data[a:b], inside, length, gram)
                if len(d):
                    place = (begin + moved << 14) | (lead << 7) | more
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g, c, doc[first + d], tie[first + d], place)], ["gram", "context", "doc", "tie", "place"])
    return run


# 2. Whole contexts ---------------------------------------------------------------------------

def _settle(length: int):
    """From rows sorted by (gram, context, doc, tie, place): repeats as byte ranges, and first contexts of grams that have several.

    A first context waits until the next one is seen, so at most one row is held back.
    """
    names = ["gram", "context", "doc", "tie", "place"]

    def out(rows, is_range):
        if is_range:
            start, more = rows["place"] >> 14, rows["place"] & 127
            a, b = start, start + more + length
        else:
            a, b = rows["place"], np.full(len(rows["place"]), -1)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (rows["gram"], rows["doc"], rows["tie"], a, b)], ["gram", "doc", "tie", "a", "b"])

    def run(batches):
        first = None  # the first row of the last context
        held = None  # that row too, and whether the context before it has the same gram
        for batch in batches:
            if not len(batch):
                continue
            x = {c: batch.column(c).to_numpy() for c in names}
            if first is not None:
                x = {c: np.concatenate([[first[c]], x[c]]) for c in names}
            new = np.ones(len(x["gram"]), bool)
            new[1:] = (x["gram"][1:] != x["gram"][:-1]) | (x["context"][1:] != x["context"][:-1])
            heads = np.flatnonzero(new)
            owner = heads[np.cumsum(new) - 1]
            again = ~new & ((x["doc"] != x["doc"][owner]) | (x["tie"] != x["tie"][owner]) | (x["place"] != x["place"][owner]))
            if again.any():
                yield out({c: x[c][again] for c in names}, True)
            gram = x["gram"][heads]
            with_next = np.concatenate([gram[1:] == gram[:-1], [False]])
            with_last = np.concatenate([[held if held is not None else False], gram[1:] == gram[:-1]])
            unsettled = heads[:-1][(with_next | with_last)[:-1]]
            if len(unsettled):
                yield out({c: x[c][unsettled] for c in names}, False)
            first = {c: x[c][heads[-1]] for c in names}
            held = bool(with_last[-1])
        if held:
            yield out({c: np.array([first[c]]) for c in names}, False)
    return run


# 3. Suffix sort ------------------------------------------------------------------------------

class Suffixes:
    """Suffixes of a buffer, compared by binary search on prefix hashes, and sorted inside their groups by merging."""

    def __init__(self, data: np.ndarray, group: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.data, self.group, self.start, self.length = data, group, start, length
        self.prefix = Prefix(data, BASES[0])
        self.padded = np.concatenate([data, np.zeros(1, np.uint8)])

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common extension of suffixes i and j, in as many steps as its bound has bits."""
        si, sj = self.start[i], self.start[j]
        low, high = np.zeros(len(i), np.int64), np.minimum(self.length[i], self.length[j])
        for _ in range(int(high.max(initial=0)).bit_length()):
            half = (low + high + 1) >> 1
            same = self.prefix.hashes(si, half) == self.prefix.hashes(sj, half)
            low, high = np.where(same, half, low), np.where(same, high, np.maximum(half - 1, low))
        return low

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i sorts before j; equal ones in order of their numbers, a prefix before what it begins."""
        n = self.common(i, j)
        ended_i, ended_j = n >= self.length[i], n >= self.length[j]
        byte = self.padded[np.minimum(self.start[i] + n, len(self.data))] < self.padded[np.minimum(self.start[j] + n, len(self.data))]
        inside = np.where(ended_i & ended_j, i < j, np.where(ended_i, True, np.where(ended_j, False, byte)))
        return (self.group[i] < self.group[j]) | ((self.group[i] == self.group[j]) & inside)

    def order(self) -> np.ndarray:
        """Sorted order. Groups must be in order already; all merges of a level are done at once."""
        n = len(self.start)
        order, width = np.arange(n), 1
        while width < n:
            at = np.arange(n)
            block = at // (2 * width) * (2 * width)
            middle, end = np.minimum(block + width, n), np.minimum(block + 2 * width, n)
            left = at < middle
            # Only items of a group that lies on both sides of the middle can change their place.
            last_left, first_right = self.group[order[middle - 1]], self.group[order[np.minimum(middle, n - 1)]]
            moves = (middle < end) & (last_left == first_right) & (self.group[order] == last_left)
            act = np.flatnonzero(moves)
            if len(act):
                own = order[act]
                low = np.where(left[act], middle[act], block[act])
                base = low.copy()
                high = np.where(left[act], end[act], middle[act])
                while True:
                    busy = np.flatnonzero(low < high)
                    if not len(busy):
                        break
                    half = (low[busy] + high[busy]) >> 1
                    smaller = self.before(order[half], own[busy])
                    low[busy] = np.where(smaller, half + 1, low[busy])
                    high[busy] = np.where(smaller, high[busy], half)
                to = block[act] + (act - np.where(left[act], block[act], middle[act])) + (low - base)
                moved = order.copy()
                moved[to] = own
                order = moved
            width *= 2
        return order

    def sorted_extensions(self) -> tuple[np.ndarray, np.ndarray]:
        """Order, and the common extension of each suffix with the one before it (-1 across groups), verified byte by byte.

        If a hash has lied anywhere, neighbours differ inside their claimed extension,
        agree after it, or stand the wrong way round; then bytes are sorted instead.
        """
        order = self.order()
        n = len(order)
        ext = np.full(n, -1, np.int64)
        if n > 1:
            i, j = order[:-1], order[1:]
            same = np.flatnonzero(self.group[i] == self.group[j])
            i, j = i[same], j[same]
            k = self.common(i, j)
            a, b = ranges(self.start[i], k), ranges(self.start[j], k)
            end_i, end_j = k >= self.length[i], k >= self.length[j]
            next_i, next_j = self.padded[np.minimum(self.start[i] + k, len(self.data))], self.padded[np.minimum(self.start[j] + k, len(self.data))]
            fine = bool((self.data[a] == self.data[b]).all()) and bool((end_i | (~end_j & (next_i < next_j))).all())
            if not fine:
                return self.plain()
            ext[1 + same] = k
        return order, ext

    def plain(self) -> tuple[np.ndarray, np.ndarray]:
        raw = [self.data[s:s + k].tobytes() for s, k in zip(self.start.tolist(), self.length.tolist())]
        order = np.array(sorted(range(len(raw)), key=lambda i: (self.group[i], raw[i], i)), np.int64)
        ext = np.full(len(raw), -1, np.int64)
        for p in range(1, len(raw)):
            i, j = order[p - 1], order[p]
            if self.group[i] == self.group[j]:
                x, y = raw[i], raw[j]
                ext[p] = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
        return order, ext


def repeated_starts(group: np.ndarray, contexts: list[bytes], lead: np.ndarray, more: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each context (in order of place inside its group), which of its strings an earlier context of the group has.

    Column a of the result stands for the string that begins a bytes before the gram.
    """
    n = len(group)
    sizes = np.fromiter(map(len, contexts), np.int64, n)
    data = np.frombuffer(b"".join(contexts), np.uint8)
    begin = np.cumsum(sizes) - sizes
    right = Suffixes(data, group, begin + lead, sizes - lead)
    # To the left, the suffixes of the reversed buffer.
    left = Suffixes(data[::-1], group, len(data) - (begin + lead), lead)
    order_r, ext_r = right.sorted_extensions()
    order_l, ext_l = left.sorted_extensions()
    hit = np.zeros((n, int(lead.max(initial=0)) + 1), bool)
    class_r, class_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for a in range(hit.shape[1]):
        some = np.flatnonzero((a <= lead) & (a >= lead - more))
        if not len(some):
            continue
        class_r[order_r] = np.cumsum(ext_r < length - a)
        class_l[order_l] = np.cumsum(ext_l < a)
        key = class_r[some] * (n + 1) + class_l[some]
        _, first = np.unique(key, return_index=True)
        again = np.ones(len(some), bool)
        again[first] = False
        hit[some[again], a] = True
    return hit


def _sort_contexts(length: int):
    """Byte ranges of repeats, from contexts sorted by (gram, doc, tie, place); whole grams are handled, many at a time."""
    names = ["gram", "doc", "tie", "place"]

    def ranges_of(x, raw):
        group = np.cumsum(np.concatenate([[0], (x["gram"][1:] != x["gram"][:-1]).astype(np.int64)]))
        lead, more = x["place"] >> 7 & 127, x["place"] & 127
        hit = repeated_starts(group, raw, lead, more, length)
        gate = np.zeros((hit.shape[0], hit.shape[1] + 2), np.int8)
        gate[:, 1:-1] = hit
        row, low = np.nonzero(np.diff(gate, axis=1) == 1)
        _, high = np.nonzero(np.diff(gate, axis=1) == -1)
        anchor = (x["place"] >> 14) + lead
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (x["doc"][row], x["tie"][row], anchor[row] - (high - 1), anchor[row] - low + length)],
                                          ["doc", "tie", "a", "b"])

    def run(batches):
        held, raw = {c: np.empty(0, np.int64) for c in names}, []
        for batch in batches:
            held = {c: np.concatenate([held[c], batch.column(c).to_numpy()]) for c in names}
            raw += batch.column("bytes").to_pylist()
            if len(raw) >= CHUNK_ROWS:
                cut = int(np.searchsorted(held["gram"], held["gram"][-1]))
                if cut:
                    yield ranges_of({c: v[:cut] for c, v in held.items()}, raw[:cut])
                    held, raw = {c: v[cut:] for c, v in held.items()}, raw[cut:]
        if raw:
            yield ranges_of(held, raw)
    return run


def _strings(length: int):
    """Every string of a context by its 128-bit hash, for grams with too many contexts for one task."""
    def run(batches):
        for batch in batches:
            raw = batch.column("bytes").to_pylist()
            if not raw:
                continue
            place = batch.column("place").to_numpy()
            more = place & 127
            sizes = np.fromiter(map(len, raw), np.int64, len(raw))
            begin = np.cumsum(sizes) - sizes
            data = np.frombuffer(b"".join(raw), np.uint8)
            row = np.repeat(np.arange(len(raw)), more + 1)
            nth = ranges(np.zeros(len(raw), np.int64), more + 1)
            h = [mix64(Prefix(data, b).hashes(begin[row] + nth, length)).view(np.int64) for b in BASES]
            yield pa.RecordBatch.from_arrays([pa.array(h[0]), pa.array(h[1]), batch.column("doc").take(pa.array(row)), batch.column("tie").take(pa.array(row)),
                                              pa.array((place >> 14)[row] + nth)], ["h1", "h2", "doc", "tie", "start"])
    return run


def _fetch(length: int):
    """The bytes of each listed context of a text."""
    def run(batches):
        for batch in batches:
            data, offsets = _bytes_of(filled(batch.column(TEXT)))
            lists = batch.column("wanted")
            n = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            gram, place = flat.field("gram").to_numpy(), flat.field("place").to_numpy()
            row = np.repeat(np.arange(len(n)), n)
            begin = offsets[:-1][row] + (place >> 14)
            end = begin + (place & 127) + length
            view = memoryview(data)
            for k in range(0, len(row), 50_000):
                part = slice(k, k + 50_000)
                raw = [bytes(view[a:b]) for a, b in zip(begin[part].tolist(), end[part].tolist())]
                rows = pa.array(row[part])
                yield pa.RecordBatch.from_arrays([pa.array(gram[part]), batch.column(DOC).take(rows), batch.column(TIE).take(rows),
                                                  pa.array(place[part]), pa.array(raw, pa.binary())], ["gram", "doc", "tie", "place", "bytes"])
    return run


# The whole job -------------------------------------------------------------------------------

DOC, TIE, TEXT = f"{INNER}doc", f"{INNER}tie", f"{INNER}text"


def _keyed(df: DataFrame, others: list[str], id_col: str, text_col: str) -> DataFrame:
    """``others`` and the key of a text: its id, and a tie that tells texts of one id apart and is 0 for all if ids are unique."""
    key = F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(LOWEST))
    most = df.select(key.alias("k")).groupBy("k").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    tie = F.xxhash64(text) if (most or 0) > 1 else F.lit(0).cast("bigint")
    return df.select(*[F.col(f"`{c}`") for c in others if c != text_col], key.alias(DOC), tie.alias(TIE), text.alias(TEXT))


def repeats(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc, tie, a, b): byte ranges that strings cover which also start earlier. Ranges of a text may overlap."""
    row = "doc bigint, tie bigint"
    found = narrow(keyed, doc=DOC, tie=TIE, text=TEXT).mapInArrow(tidy(_find_anchors(length, gram)), f"gram bigint, context bigint, {row}, place bigint")
    settled = stored(found.repartition("gram").sortWithinPartitions("gram", "context", "doc", "tie", "place")
                     .mapInArrow(tidy(_settle(length)), f"gram bigint, {row}, a bigint, b bigint"))
    whole = settled.filter("b >= 0").select("doc", "tie", "a", "b")
    unsettled = settled.filter("b < 0").select("gram", "doc", "tie", F.col("a").alias("place"))

    def contexts(places: DataFrame) -> DataFrame:
        wanted = places.groupBy(F.col("doc").alias(DOC), F.col("tie").alias(TIE)).agg(F.collect_list(F.struct("gram", "place")).alias("wanted"))
        # All columns go into the Python step, so that this exchange of the texts is the one that the last join uses again.
        return keyed.join(wanted, [DOC, TIE]).mapInArrow(tidy(_fetch(length)), f"gram bigint, {row}, place bigint, bytes binary")

    def sorted_out(places: DataFrame) -> DataFrame:
        return (contexts(places).repartition("gram").sortWithinPartitions("gram", "doc", "tie", "place")
                .mapInArrow(tidy(_sort_contexts(length)), f"{row}, a bigint, b bigint"))

    heavy = unsettled.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("gram")
    if heavy.isEmpty():
        return whole.union(sorted_out(unsettled))
    # Grams with more contexts than one task should hold.
    strings = contexts(unsettled.join(heavy, "gram", "left_semi")).mapInArrow(tidy(_strings(length)), f"h1 bigint, h2 bigint, {row}, start bigint")
    firsts = strings.groupBy("h1", "h2").agg(F.min(F.struct("doc", "tie", "start")).alias("first"))
    again = (strings.join(firsts, ["h1", "h2"]).filter(F.struct("doc", "tie", "start") > F.col("first"))
             .select("doc", "tie", F.col("start").alias("a"), (F.col("start") + length).alias("b")))
    return whole.union(sorted_out(unsettled.join(heavy, "gram", "left_anti"))).union(again)


def _cut(passed: list[str], text_col: str):
    def run(batches):
        for batch in batches:
            data, offsets = _bytes_of(filled(batch.column(TEXT)))
            lists = batch.column(f"{INNER}ranges")
            n = [v or 0 for v in lists.value_lengths().to_pylist()]
            flat = lists.flatten()
            a, b = flat.field("a").to_numpy(), flat.field("b").to_numpy()
            at, texts, sizes, gone, spans, digests = 0, [], [], [], [], []
            for d in range(len(n)):
                raw = data[offsets[d]:offsets[d + 1]]
                sizes.append(len(raw))
                if n[d]:
                    edge = np.zeros(len(raw) + 1, np.int32)
                    np.add.at(edge, a[at:at + n[d]], 1)
                    np.add.at(edge, b[at:at + n[d]], -1)
                    cover = np.cumsum(edge[:-1]) > 0
                    gone.append(int(cover.sum()))
                    spans.append(int(cover[0]) + int((cover[1:] & ~cover[:-1]).sum()))
                    kept = raw[~cover].tobytes()
                    at += n[d]
                else:
                    gone.append(0), spans.append(0)
                    kept = raw.tobytes()
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode("utf-8", "ignore"))
            result = pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())],
                                                ["n_bytes", "n_removed", "n_spans", "kept_sha256"])
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in passed] + [result],
                                             passed + [f"{INNER}result"])
    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT,
                   result: str = "repeats") -> DataFrame:
    """All columns of ``df``, the text without the bytes of repeated strings, and a struct column of what was done.

    A byte goes if a string of ``length`` bytes (at most 127 + ``gram``) that covers it also
    starts earlier: in a text with a smaller id, or in the same text at an earlier
    place. Strings are judged on the input and never span two texts. The struct has
    n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 (of the kept
    bytes). A cut may split a character; the text column then leaves its rest out,
    the digest does not.

    Ids are integers. A null id sorts before all others, a null text is empty (and
    comes back empty). Rows with equal id and text do not count as earlier than each
    other; texts of one id are ordered by a hash. Other columns pass through,
    whatever their names; one that is named like ``result`` is replaced. An empty
    table gives an empty result.
    """
    others = [c for c in df.columns if c != result]
    keyed = _keyed(df, others, id_col, text_col)
    found = (repeats(keyed, length, gram, hot).groupBy(F.col("doc").alias(DOC), F.col("tie").alias(TIE))
             .agg(F.collect_list(F.struct("a", "b")).alias(f"{INNER}ranges")))
    types = {f.name: f.dataType for f in df.schema.fields} | {text_col: T.StringType()}
    schema = T.StructType([T.StructField(c, types[c]) for c in others]
                          + [T.StructField(f"{INNER}result", T.StructType.fromDDL("n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"))])
    return keyed.join(found, [DOC, TIE], "left").mapInArrow(tidy(_cut(others, text_col)), schema).withColumnRenamed(f"{INNER}result", result)
