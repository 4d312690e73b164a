"""Packing tokenised documents into as few fixed-length sequences as possible, by bin completion."""

from __future__ import annotations

import itertools
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import narrow, ranges, slices, stored, tidy, worker_cache, words

CAPACITY = 4096
END_ID = 1
#: Search effort per table; the histogram it works on has at most ``CAPACITY`` rows however large the table is.
WIDTH = 4
NODES = 8_000
#: Pieces of one length are ranked inside hash buckets of about this many.
BUCKET_ROWS = 50_000
CACHE_PARTS = 250_000


# Tokens --------------------------------------------------------------------------------------

def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, free = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b], free = chr(free), free + 1
    return [letters[b] for b in range(256)]


#: Texts of these characters only are stable under NFC, lower-case one by one, and have no white space but ASCII's.
_HARD = r"[^\t-\r -~À-ÿ]"
#: The tokenizer's own parts of such a text, in lower case.
_PARTS = r"('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-zß-öø-ÿ0-9]+)"
SLICE = 8 << 20


class PartEncoder:
    """Ids of single parts of a text, remembered from slice to slice.

    The tokenizer lower-cases, cuts a text into parts, drops white space and merges
    inside parts only, so a text's ids are its parts' ids one after the other.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Texts that the parts alone do not settle: other characters, or the literal of an added token in any case.
        self.hard = "|".join([_HARD, *[f"(?i:{re.escape(t)})" for t in added]])
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.seen: dict[str, list[int]] = {}

    def parts(self, parts: list[str]) -> list[list[int]]:
        seen, out = self.seen, []
        if len(seen) >= CACHE_PARTS:
            seen.clear()
        for p in parts:
            ids = seen.get(p)
            if ids is None:
                text = p if p.isascii() else "".join([self.letters[b] for b in p.encode()])
                ids = seen[p] = [t.id for t in self.model.tokenize(text)]
            out.append(ids)
        return out


def token_ids(texts: pa.Array, encoder: PartEncoder, end_id: int = END_ID):
    """(first row, ids of all texts of a slice, offsets of each text's ids); every text ends with ``end_id``.

    Texts with characters beyond Latin-1 letters, or with the literal of a token that
    the file adds (which is one id then), go through the whole tokenizer, one by one.
    """
    for at, part in slices(texts, SLICE):
        hard = pc.match_substring_regex(part, encoder.hard)
        rare = np.flatnonzero(hard.to_numpy(zero_copy_only=False))
        if len(rare):
            part = pc.if_else(hard, "", part)
        flat, offsets = words(pc.replace_substring_regex(pc.utf8_lower(part), _PARTS, r"\1 "))
        coded = flat.dictionary_encode()
        codes, n = coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary)
        each = encoder.parts(coded.dictionary.to_pylist()) + [[end_id]]
        for k, i in enumerate(rare):
            each.append(encoder.tokenizer.encode(texts[at + int(i)].as_py(), add_special_tokens=False).ids)
        # A part of its own ends each text; before it, the ids of a text that took the other way.
        where = np.concatenate([offsets[1:], offsets[1 + rare]]).astype(np.int64)
        extra = np.concatenate([np.full(len(offsets) - 1, n), n + 1 + np.arange(len(rare))])
        order = np.lexsort((extra == n, where))
        order = order[np.lexsort((np.concatenate([np.arange(len(offsets) - 1), rare])[order], where[order]))]
        codes = np.insert(codes.astype(np.int64), where[order], extra[order])
        added = 1 + np.bincount(rare, minlength=len(offsets) - 1) if len(rare) else np.ones(len(offsets) - 1, np.int64)
        offsets = offsets + np.concatenate([[0], np.cumsum(added)])
        length = np.fromiter(map(len, each), np.int64, len(each))
        ids = np.fromiter(itertools.chain.from_iterable(each), np.uint32, int(length.sum()))
        first = np.cumsum(length) - length
        took = length[codes]
        yield at, ids[ranges(first[codes], took)], np.concatenate([[0], np.cumsum(took)])[offsets]


def pieces(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
           with_ids: bool = False) -> DataFrame:
    """Token pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    Only a document that is longer than ``capacity`` is cut. A null text is an empty
    one, which has only its end id.
    """
    fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] if with_ids else []
    source = narrow(df, doc_id=id_col, text=F.col(f"`{text_col}`").cast("string"))
    kind = dict(source.dtypes)["doc_id"]

    def cut(batches):
        encoder = worker_cache(f"part-encoder:{tokenizer}", lambda: PartEncoder(tokenizer))
        for batch in batches:
            ids = batch.column("doc_id")
            for at, out, ends in token_ids(batch.column("text"), encoder, end_id):
                row, piece, start, length, crc, lists = [], [], [], [], [], []
                for d in range(len(ends) - 1):
                    a, b = int(ends[d]), int(ends[d + 1])
                    for k, s in enumerate(range(a, b, capacity)):
                        e = min(b, s + capacity)
                        row.append(at + d), piece.append(k), start.append(s - a), length.append(e - s)
                        crc.append(zlib.crc32(out[s:e].astype("<u4").tobytes()))
                        if with_ids:
                            lists.append(out[s:e].astype(np.int32))
                cols = [piece, start, length, crc] + ([lists] if with_ids else [])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row, pa.int64()))] + [pa.array(c, t) for c, (_, t) in zip(cols, fields)],
                                                 ["doc_id"] + [n for n, _ in fields])

    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    return source.mapInArrow(tidy(cut), schema)


# Bin completion ------------------------------------------------------------------------------

@dataclass
class Plan:
    """Kinds of bins: (lengths with their numbers, how many such bins)."""

    bins: int = 0
    kinds: list[tuple[tuple[tuple[int, int], ...], int]] = field(default_factory=list)


class Counts:
    """How many pieces of each length are left, and the longest one that is not above a bound."""

    def __init__(self, counts: np.ndarray):
        self.n = counts
        self.refresh()

    def refresh(self):
        at = np.arange(len(self.n))
        self.below = np.maximum.accumulate(np.where(self.n > 0, at, 0))

    def take(self, kind, times):
        gone = False
        for length, k in kind:
            self.n[length] -= k * times
            gone |= self.n[length] == 0
        if gone:
            self.refresh()


def _kind(lengths) -> tuple[tuple[int, int], ...]:
    out: dict[int, int] = {}
    for x in lengths:
        out[x] = out.get(x, 0) + 1
    return tuple(sorted(out.items(), reverse=True))


def best_fit(left: Counts, capacity: int, room: int, first: int) -> list[int]:
    """Fill the room behind ``first`` by always taking the longest piece that fits."""
    used = {first: 1}
    filling = []
    while room > 0:
        x = int(left.below[min(room, capacity)])
        while x > 0 and left.n[x] - used.get(x, 0) <= 0:
            x = int(left.below[x - 1])
        if x == 0:
            break
        used[x] = used.get(x, 0) + 1
        filling.append(x)
        room -= x
    return filling


def undominated(left: Counts, capacity: int, first: int, width: int) -> list[tuple[int, ...]]:
    """Fillings of the room behind the largest piece, least waste first, without those that another one dominates.

    A filling dominates another if the other's pieces fit, in groups, into its pieces.
    So one piece that fills the room exactly stands for all fillings; of single
    pieces only the longest matters, and of pairs with the same first piece
    only the one with the longest second piece, if it holds more than the longest
    single piece. The same goes for triples behind each of the longest firsts.
    """
    room = capacity - first
    one = int(left.below[room])
    if one == first and left.n[one] < 2:
        one = int(left.below[one - 1])
    if one == 0:
        return [()]
    if one == room:
        return [(one,)]
    found: dict[tuple[int, ...], int] = {(one,): one}
    own = lambda x: left.n[x] - (x == first)
    a = np.flatnonzero(left.n[:one + 1] > 0)[::-1]
    b = left.below[np.minimum(room - a, a)]
    good = (b > 0) & (a + b > one)
    x2, y2 = a[good], b[good]
    near = np.argpartition(-(x2 + y2), 4 * width)[:4 * width] if len(x2) > 4 * width else np.arange(len(x2))
    for i in near[np.argsort(-(x2 + y2)[near], kind="stable")]:
        x, y = int(x2[i]), int(y2[i])
        if own(x) >= 1 + (x == y) and own(y) >= 1:
            found[(x, y)] = x + y
            if x + y == room:
                break
    if max(found.values()) < room:
        best = max(found.values())
        for j, x in enumerate(a[:32]):
            rest = room - int(x)
            c = a[j:]
            d = left.below[np.minimum(np.maximum(rest - c, 0), c)]
            i = int(np.argmax(np.where((d > 0) & (c < rest), c + d, 0)))
            t = (int(x), int(c[i]), int(d[i]))
            if t[2] and best < sum(t) <= room and all(own(v) >= t.count(v) for v in t):
                found[t] = best = sum(t)
            if best == room:
                break
    if max(found.values()) < room:
        filling = tuple(best_fit(left, capacity, room, first))
        if filling:
            found[filling] = sum(filling)
            if len(filling) > 1:  # a deeper one: the last piece gives way to the best pair
                rest = room - sum(filling[:-1])
                p = a[a < rest]
                if len(p):
                    r = left.below[np.minimum(rest - p, p)]
                    i = int(np.argmax(np.where(r > 0, p + r, 0)))
                    t = filling[:-1] + (int(p[i]), int(r[i]))
                    if r[i] > 0 and all(own(v) >= t.count(v) for v in t) and sum(t) <= room:
                        found[t] = sum(t)
    best = sorted(found, key=lambda t: (-found[t], len(t), tuple(-x for x in t)))
    if found[best[0]] == room:
        best = [t for t in best if found[t] == room or t == (one,)]
    return best[:width]


def complete(counts: np.ndarray, capacity: int = CAPACITY, width: int = WIDTH, nodes: int = NODES) -> Plan:
    """Bins for ``counts[length]`` pieces of each length: branch and bound over fillings of the largest piece.

    A node takes the largest length left and one undominated filling, as often as
    the counts allow. The first dive follows the least waste, which is a best fit,
    and is the first incumbent. The waste that a better plan may have in all
    is known (its bins times the capacity, less the tokens), so a branch whose
    closed bins have wasted more is cut, and the search ends when a plan meets the
    lower bound. After ``nodes`` nodes the best plan so far is used; it places
    every piece, but is not proven to be the smallest.
    """
    counts = counts.astype(np.int64).copy()
    tokens = int((counts * np.arange(len(counts))).sum())
    bound = lower_bound(counts, capacity)
    best: Plan | None = None
    # Depth-first with an explicit stack of (state, bins so far, waste so far, kinds so far as a linked list).
    stack = [(counts, 0, 0, None)]
    visited = 0
    while stack and (best is None or visited < nodes):
        state, bins, waste, path = stack.pop()
        if best is not None and (bins >= best.bins or waste > (best.bins - 1) * capacity - tokens):
            continue
        left = Counts(state.copy())
        while True:
            visited += 1
            first = int(left.below[-1])
            if first == 0:
                if best is None or bins < best.bins:
                    kinds = []
                    while path is not None:
                        path, one = path
                        kinds.append(one)
                    best = Plan(bins, kinds[::-1])
                break
            if best is not None and waste > (best.bins - 1) * capacity - tokens:
                break
            options = undominated(left, capacity, first, width)
            if len(stack) < 4 * width * 64:
                for other in reversed(options[1:]):
                    kind = _kind((first, *other))
                    if all(left.n[x] >= k for x, k in kind):
                        again = left.n.copy()
                        for x, k in kind:
                            again[x] -= k
                        stack.append((again, bins + 1, waste + capacity - first - sum(other), (path, (kind, 1))))
            kind = _kind((first, *options[0]))
            times = int(min(left.n[x] // k for x, k in kind))
            left.take(kind, times)
            bins += times
            waste += times * (capacity - first - sum(options[0]))
            path = (path, (kind, times))
        if best is not None and best.bins <= bound:
            break
    return best or Plan()


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Fewest bins: all tokens over the capacity, or with pieces over half a bin kept apart and what cannot join them left out."""
    at = np.arange(len(counts))
    best = -(-int((counts * at).sum()) // capacity)
    for small in range(0, capacity // 2 + 1, max(1, capacity // 64)):
        alone = int(counts[at > capacity - small].sum())
        large = (at > capacity // 2) & (at <= capacity - small)
        n_large = int(counts[large].sum())
        free = n_large * capacity - int((counts * at)[large].sum())
        rest = int((counts * at)[(at >= max(small, 1)) & (at <= capacity // 2)].sum())
        best = max(best, alone + n_large + max(0, -(-(rest - free) // capacity)))
    return best


def slots(plan: Plan) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, by their rank among equals; sorted by (length, rank_from)."""
    rows, base, taken = [], 0, {}
    for kind, times in plan.kinds:
        offset = 0
        for length, k in kind:
            first = taken.get(length, 0)
            rows.append((length, first, base, k, offset))
            taken[length] = first + k * times
            offset += length * k
        base += times
    t = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {n: t[:, i] for i, n in enumerate(("length", "rank_from", "first_bin", "per_bin", "offset"))}


def pack(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
         width: int = WIDTH, nodes: int = NODES) -> DataFrame:
    """A place for every token piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Texts are tokenised where they lie. What the search sees is the histogram of
    piece lengths, at most ``capacity`` rows for any table; its plan, at most
    some hundred thousand rows, goes back to the pieces, which find their bin by
    their rank among pieces of the same length. Ranks are counted in hash buckets,
    so no length is ever gathered in one task.

    A null or empty text is a document of one end id. Repeated rows are packed as
    often as they occur. An empty table gives an empty result. Columns besides id and
    text are not read.
    """
    cut = stored(pieces(df, tokenizer, capacity, end_id, id_col, text_col))
    n = cut.count()
    buckets = max(64, n // BUCKET_ROWS)
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = sizes.groupBy("length").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(capacity + 1, np.int64)
    counts[histogram["length"].to_numpy(np.int64)] = histogram["n"].to_numpy(np.int64)
    places = slots(complete(counts, capacity, width, nodes))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(
        Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("rank", F.row_number().over(order) - 1).join(before, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    kind = dict(cut.dtypes)["doc_id"]
    span = np.int64(1 << 48)
    keys = places["length"] * span + places["rank_from"]

    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            i = np.searchsorted(keys, length * span + rank, "right") - 1
            nth = rank - places["rank_from"][i]
            per = places["per_bin"][i]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(places["first_bin"][i] + nth // per),
                 pa.array(places["offset"][i] + nth % per * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        tidy(place), f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
