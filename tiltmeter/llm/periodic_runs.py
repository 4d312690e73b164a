"""Periodic runs of words, found once per rule of a Re-Pair grammar and carried to every place that derives it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import INNER, filled, mix64, ranges, release, word_slices

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SHAPE = pa.struct([("runs", pa.list_(RUN)), ("collapsed", pa.string())])
RESULT = "struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"
#: A run repeats its period this often at least, and has this many words.
EXPONENT = 4
LENGTH = 6
#: Candidate periods that are held at a time.
CHUNK = 1 << 21


@dataclass
class Grammar:
    """Rules that are long enough for a run, and all places of the words that derive them.

    ``at``, ``left``, ``length``: where a first occurrence of each rule begins, and
    how many words its left part and the whole have. ``place_rule``, ``place_at``:
    every derivation position, by rule.
    """

    at: np.ndarray
    left: np.ndarray
    length: np.ndarray
    place_rule: np.ndarray
    place_at: np.ndarray


def _most_frequent(seq: np.ndarray, pairs: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair number, occurrences, priority) of each place in ``pairs``; the priority is 0 for a pair that occurs once.

    More frequent pairs go first, equally frequent ones in scrambled order. In a
    streak x x x x the same pair overlaps itself: every second place goes first.
    """
    key = seq[pairs] * symbols + seq[pairs + 1]
    order = np.argsort(key, kind="stable")
    fresh = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(fresh) - 1
    count = np.bincount(number)
    rank = np.empty(len(count), np.int64)
    rank[np.lexsort((mix64(key[order][fresh].astype(np.uint64)), count))] = np.arange(1, len(count) + 1)
    streak = np.concatenate([[False], (np.diff(pairs) == 1) & (key[1:] == key[:-1])])
    k = np.arange(len(key))
    odd = (k - np.maximum.accumulate(np.where(streak, 0, k))) & 1
    occurs = count[number]
    return number, occurs, np.where(occurs > 1, 2 * rank[number] + 1 - odd, 0)


def re_pair(words: np.ndarray, offsets: np.ndarray, least: int) -> Grammar:
    """Grammars of all texts at once; ``words`` holds one number per distinct word of a text, no two texts share one.

    A round replaces every pair that is more frequent than the pairs it overlaps,
    so the most frequent pair of each text is always among them, until no pair of a
    text occurs twice. Then what is left of each text is paired up like a balanced
    tree, so that every place between two words is the middle of one rule. Rules of
    fewer than ``least`` words are not written down.
    """
    seq, start = words.astype(np.int64), np.arange(len(words), dtype=np.int64)
    length = np.ones(len(words), np.int64)
    last = np.zeros(len(words), bool)
    last[offsets[1:][np.diff(offsets) > 0] - 1] = True
    symbols = 2 * len(words) + 1  # a rule shortens the text, so there are fewer rules than words
    used, n_rules = int(words.max()) + 1 if len(words) else 0, 0
    rules, places = [], []

    def replace(at, number):
        """Pairs at ``at`` become the symbols of ``number`` (0, 1, …); which elements stay."""
        nonlocal n_rules, used
        total = length[at] + length[at + 1]
        _, first, number = np.unique(number, return_index=True, return_inverse=True)
        long = total[first] >= least
        if long.any():
            kept = np.cumsum(long) - 1 + n_rules
            f = at[first[long]]
            rules.append((start[f], length[f], total[first[long]]))
            of = long[number]
            places.append((kept[number[of]], start[at[of]]))
            n_rules += int(long.sum())
        seq[at] = used + number
        used += len(first)
        length[at] = total
        last[at] |= last[at + 1]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        return stay

    live = ~last
    while True:
        pairs = np.flatnonzero(live)
        if len(pairs) < 2:
            break
        number, occurs, priority = _most_frequent(seq, pairs, symbols)
        again = occurs > 1
        if not again.any():
            break
        around = np.zeros(len(seq) + 2, np.int64)
        around[pairs + 1] = priority
        take = (priority > around[pairs]) & (priority > around[pairs + 2])
        at = pairs[take]
        live = np.zeros(len(seq), bool)
        live[pairs[again]] = True
        fresh = np.zeros(len(seq), bool)
        fresh[at] = True
        stay = replace(at, number[take])
        seq, start, length, last, live, fresh = (x[stay] for x in (seq, start, length, last, live, fresh))
        live |= fresh
        live[:-1] |= fresh[1:]
        live &= ~last
    while not last.all():
        first = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
        inside = np.arange(len(seq)) - np.repeat(first, np.diff(np.concatenate([first, [len(seq)]])))
        at = np.flatnonzero((inside % 2 == 0) & ~last)
        stay = replace(at, np.arange(len(at)))
        seq, start, length, last = (x[stay] for x in (seq, start, length, last))
    none = [np.empty(0, np.int64)]
    cols = [np.concatenate(none + [r[k] for r in rules]) for k in range(3)]
    rule, place = (np.concatenate(none + [p[k] for p in places]) for k in range(2))
    order = np.argsort(rule, kind="stable")
    return Grammar(*cols, rule[order], place[order])


def _candidates(words: np.ndarray, middle: np.ndarray, most: np.ndarray, side: int):
    """(rule, period) in that order, whose words beside the middle recur one period away; side 1 looks right, -1 left.

    A run of four periods has two of them on one side of the middle. There, and at
    the word across the middle, every word equals the one a period further out.
    """
    edge = middle if side == 1 else middle - 1  # first word on that side
    ends = np.cumsum(most)
    rule = 0
    while rule < len(most):
        to = max(rule + 1, int(np.searchsorted(ends, (ends[rule - 1] if rule else 0) + CHUNK, "right")))
        many = most[rule:to]
        which = np.repeat(np.arange(rule, to), many)
        q = ranges(np.ones(len(many), np.int64), many)
        for step in (-1, 0, 1, 2, 3, None):
            t = q - 1 if step is None else np.minimum(step, q - 1)
            a = edge[which] + side * t
            same = words[a] == words[a + side * q]
            which, q = which[same], q[same]
        yield which, q
        rule = to


def _common(words: np.ndarray, a: int, b: int, room: int) -> int:
    """How many words from ``a`` and from ``b`` on are equal, at most ``room``."""
    n, step = 0, 32
    while n < room:
        m = min(step, room - n)
        differ = words[a + n:a + n + m] != words[b + n:b + n + m]
        k = int(differ.argmax())
        if differ[k]:
            return n + k
        n, step = n + m, 4 * step
    return room


def middle_runs(words: np.ndarray, grammar: Grammar, exponent: int = EXPONENT, length: int = LENGTH) -> np.ndarray:
    """(rule, first word in it, words, period) of every run that crosses the middle of a rule, as far as the rule reaches."""
    at, middle, end = grammar.at, grammar.at + grammar.left, grammar.at + grammar.length
    back, n = words[::-1], len(words)
    found = set()
    for side in (1, -1):
        room = end - middle if side == 1 else grammar.left
        for rules, periods in _candidates(words, middle, np.minimum(grammar.length // exponent, room // 2), side):
            firsts = np.concatenate([[0], np.flatnonzero(np.diff(rules)) + 1, [len(rules)]]).tolist() if len(rules) else []
            for f, t in zip(firsts, firsts[1:]):
                r = int(rules[f])
                lo, b, hi, of = int(at[r]), int(middle[r]), int(end[r]), periods[f:t]
                k = 0
                while k < len(of):
                    q = int(of[k])
                    k += 1
                    if side == 1:
                        e = b + q + _common(words, b, b + q, hi - b - q)
                        if e - b < 2 * q:
                            continue
                        s = b - _common(back, n - b, n - b - q, b - lo)
                        reach = (e - b) // 2
                    else:
                        s = b - q - _common(back, n - b, n - b + q, b - q - lo)
                        if b - s < 2 * q:
                            continue
                        e = b + _common(words, b, b - q, hi - b)
                        reach = (b - s) // 2
                    if e - s >= max(length, exponent * q):
                        found.add((r, s - lo, e - s, q))
                    # Up to there a further period would only be a multiple of this one.
                    k = int(np.searchsorted(of, reach, "right"))
    return np.array(sorted(found), np.int64).reshape(-1, 4)


def text_runs(words: np.ndarray, offsets: np.ndarray, exponent: int = EXPONENT, length: int = LENGTH) -> np.ndarray:
    """(text, start, words, period) of all maximal runs, by text, start and period; ``start`` counts words of the text.

    A run lies inside the lowest rule that derives all of it and crosses the middle
    of that rule. Carried to each place of the rule, an interval that a neighbouring
    word extends is part of one that a higher rule has, so those that none extends
    are the merged maximal ones.
    """
    if exponent < 4:
        raise ValueError("exponent must be 4 or more")
    grammar = re_pair(words, offsets, max(length, exponent))
    inner = middle_runs(words, grammar, exponent, length)
    if not len(inner):
        return np.empty((0, 4), np.int64)
    first = np.searchsorted(grammar.place_rule, inner[:, 0])
    many = np.searchsorted(grammar.place_rule, inner[:, 0], "right") - first
    s = grammar.place_at[ranges(first, many)] + np.repeat(inner[:, 1], many)
    n, q = np.repeat(inner[:, 2], many), np.repeat(inner[:, 3], many)
    e = s + n
    text = np.searchsorted(offsets, s, "right") - 1
    lo, hi = offsets[text], offsets[text + 1]
    before, after = np.maximum(s - 1, 0), np.minimum(e, len(words) - 1)
    whole = ((s == lo) | (words[before] != words[before + q])) & ((e == hi) | (words[after] != words[after - q]))
    return np.unique(np.stack([text, s - lo, n, q], axis=1)[whole][:, [0, 1, 3, 2]], axis=0)[:, [0, 1, 3, 2]]


def _without(flat: pa.Array, offsets: np.ndarray, runs: np.ndarray) -> pa.Array:
    """Texts of the words that no run repeats: of each run only the first period stays; one blank between words."""
    change = np.zeros(len(flat) + 1, np.int64)
    begin = offsets[runs[:, 0]] + runs[:, 1]
    np.add.at(change, begin + runs[:, 3], 1)
    np.add.at(change, begin + runs[:, 2], -1)
    stays = np.cumsum(change[:-1]) == 0
    ends = np.concatenate([[0], np.cumsum(stays)])[offsets]
    kept = flat.filter(pa.array(stays)) if len(runs) else flat
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), kept), " ")


def _runs_of(texts: pa.Array, exponent: int, length: int) -> pa.Array:
    out = []
    for _, part, codes, distinct, offsets in word_slices(texts):
        owner = np.repeat(np.arange(len(part)), np.diff(offsets))
        words = np.unique(owner * (len(distinct) + 1) + codes, return_inverse=True)[1].astype(np.int64)
        runs = text_runs(words, offsets, exponent, length)
        ends = np.concatenate([[0], np.cumsum(np.bincount(runs[:, 0], minlength=len(part)))])
        structs = pa.StructArray.from_arrays([pa.array(runs[:, k], pa.int64()) for k in (1, 2, 3)], fields=list(RUN))
        flat = distinct.take(pa.array(codes))
        out.append(pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs), _without(flat, offsets, runs)],
                                              fields=list(SHAPE)))
    return pa.concat_arrays(out) if out else pa.array([], SHAPE)


def periodic_runs(text: str | Column = "text", exponent: int = EXPONENT, length: int = LENGTH) -> Column:
    """A struct of a whole text's ``runs`` (start, length, period in words; by start, period) and ``collapsed`` text.

    A run is a stretch of words with smallest period q, at least ``exponent`` times
    q and ``length`` words long, that no neighbouring word extends keeping q. The
    collapsed text has the words that lie in no run beyond its first q words, one
    blank between them. Words are what ASCII white space separates.

    A null or empty text has no runs and an empty collapsed text. Each row is worked
    on alone, so repeated rows get equal results and an empty table an empty one;
    other columns are not read. A text is held whole, as one number per word.
    """
    @F.arrow_udf(RESULT)
    def runs(texts: pa.Array) -> pa.Array:
        out = _runs_of(texts, exponent, length)
        release()
        return out
    return runs(F.col(text).cast("string") if isinstance(text, str) else text.cast("string"))


def repeated_tail(text: Column, doc_id: Column) -> Column:
    """The text, in one of ten documents (by id) with all words from a place on replaced by a few of them, said over and over.

    h is the crc32 of the id in decimal and g = h // 10. If 10 divides h and the text
    has n > 0 words, each word i from a = g % n on becomes word a + (i - a) % p with
    p = 1 + (n - a) // (3 + g % 8). A null id changes nothing.
    """
    @F.arrow_udf("string")
    def tail(texts: pa.Array, hashes: pa.Array) -> pa.Array:
        out = filled(texts).to_pylist()
        for k, h in enumerate(hashes.to_pylist()):
            words = out[k].encode().split() if h is not None and h % 10 == 0 else []
            if words:
                g = h // 10
                a = g % len(words)
                p = 1 + (len(words) - a) // (3 + g % 8)
                again = words[a:a + p] * -(-(len(words) - a) // p)
                out[k] = b" ".join(words[:a] + again[:len(words) - a]).decode()
        return pa.array(out, pa.string())
    return tail(text.cast("string"), F.crc32(doc_id.cast("string").cast("binary")))


def run_report(df: DataFrame, id_col: str = "doc_id", text: Column | None = None) -> DataFrame:
    """doc_id and digests of the runs and of the collapsed text; start, length, period, exponent_milli of the run with the greatest
    exact length / period (ties: smallest start, then period), null without a run. A null id stays null."""
    r, found = F.col(f"{INNER}r"), f"{INNER}r"
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), periodic_runs(F.col("text") if text is None else text).alias(found))

    def before(a, b):
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        return (F.when(x != y, F.when(x > y, -1).otherwise(1)).when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1))
                .when(a["period"] != b["period"], F.when(a["period"] < b["period"], -1).otherwise(1)).otherwise(0))

    lines = F.transform(r["runs"], lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n")))
    return (rows.withColumn(f"{INNER}best", F.get(F.array_sort(r["runs"], before), F.lit(0)))
            .select("doc_id", F.size(r["runs"]).cast("bigint").alias("n_runs"), *[F.col(f"{INNER}best")[c].alias(c) for c in ("start", "length", "period")],
                    F.expr(f"{INNER}best.length * 1000 div {INNER}best.period").cast("bigint").alias("exponent_milli"),
                    F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(r["collapsed"].cast("binary"), 256).alias("collapsed_sha256")))
