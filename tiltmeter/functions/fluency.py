"""Checks of a perturbed text: surface fluency and similarity to the original."""

from __future__ import annotations

import bisect
import unicodedata
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from .common import BLANKS, strip

MAX_DISTANCE = 0.3
MIN_FLUENCY = 0.7


def grammaticality(text: Column) -> Column:
    """1 minus penalties for short text, no capital, no end mark, double blanks, unbalanced brackets."""
    t = F.coalesce(text, F.lit(""))
    full = t != ""
    brackets = F.length(F.replace(t, F.lit("("), F.lit(""))) != F.length(F.replace(t, F.lit(")"), F.lit("")))
    score = F.lit(1.0) - F.when(F.length(strip(t)) < 10, 0.3).otherwise(0.0)
    score = score - F.when(full & ~F.rlike(t, F.lit(r"^\p{Lu}")), 0.1).otherwise(0.0)
    score = score - F.when(full & ~F.right(t, F.lit(1)).isin(".", "!", "?"), 0.1).otherwise(0.0)
    score = score - F.when(t.contains("  "), 0.2).otherwise(0.0)
    score = score - F.when(brackets, 0.2).otherwise(0.0)
    return F.greatest(F.lit(0.0), score)


def grammatical(t: str) -> float:
    """:func:`grammaticality` of a text in Python."""
    score = 1.0 - (0.3 if len(t.strip(BLANKS)) < 10 else 0.0)
    score -= 0.1 if t and unicodedata.category(t[0]) != "Lu" else 0.0
    score -= 0.1 if t and t[-1] not in ".!?" else 0.0
    score -= 0.2 if "  " in t else 0.0
    score -= 0.2 if t.count("(") != t.count(")") else 0.0
    return max(0.0, score)


def similarity_bound(a: Column, b: Column) -> Column:
    """An upper limit of the similarity that needs only the lengths."""
    n = F.length(a) + F.length(b)
    return F.when(n > 0, F.least(F.length(a), F.length(b)) * 2.0 / F.greatest(n, F.lit(1))).otherwise(1.0)


#: In a second text of this many letters, a letter that makes up more than one in a hundred starts no block.
LONG_TEXT = 200


def _shared(a: str, i: int, b: str, j: int, most: int, step: int) -> int:
    """Equal letters of ``a`` from i and of ``b`` from j on (step 1) or before i and j (step -1), at most ``most``."""
    if (a[i:i + most] == b[j:j + most]) if step > 0 else (a[i - most:i] == b[j - most:j]):
        return most
    low, size = 0, 16
    if step > 0:
        while a[i + low:i + low + size] == b[j + low:j + low + size]:  # ends before ``most``, as all of it is not equal
            low, size = low + size, size * 2
        high = min(most, low + size) - 1
        while low < high:
            n = (low + high + 1) // 2
            if a[i + low:i + n] == b[j + low:j + n]:
                low = n
            else:
                high = n - 1
        return low
    while (n := min(most, low + size)) and a[i - n:i - low] == b[j - n:j - low]:
        low, size = n, size * 2
    high = min(most, low + size) - 1
    while low < high:
        n = (low + high + 1) // 2
        if a[i - n:i - low] == b[j - n:j - low]:
            low = n
        else:
            high = n - 1
    return low


def _counted(text: str) -> dict[str, int]:
    """How often a text has each of its letters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes) or codes.max() > 1 << 14:
        return dict(Counter(text))
    counts = np.bincount(codes)
    found = np.flatnonzero(counts)
    return dict(zip(map(chr, found.tolist()), counts[found].tolist()))


class _Letters:
    """The first text of many comparisons: how often it has each letter, and its stretches for sets of starting letters."""

    def __init__(self, a: str):
        self.counts, self.known = Counter(_counted(a)), {}
        self.last = a, self.counts

    def count(self, a: str, b: str, before: int, after: int) -> Counter:
        """The letters of ``b``, which begins and ends with so many letters of ``a``: by what sets it off from ``a`` or the text counted last, if that is little."""
        counts = self.counts
        if before + after < len(b) // 2:
            a, counts = self.last
            least = min(len(a), len(b))
            before = _shared(a, 0, b, 0, least, 1)
            after = _shared(a, len(a), b, len(b), least - before, -1)
            if before + after < len(b) // 2:
                self.last = b, Counter(b)
                return self.last[1]
        counts = counts.copy()
        for c in a[before:len(a) - after]:
            counts[c] -= 1
        for c in b[before:len(b) - after]:
            counts[c] += 1
        return counts

    def stretches(self, a: str, letters: set[str]) -> _Stretches:
        """By those of the letters that ``a`` has; others start nothing in it."""
        return self.stretches_of(a, frozenset(letters & self.counts.keys()))

    def stretches_of(self, a: str, own: frozenset[str]) -> _Stretches:
        if own not in self.known:
            if not self.known:
                self.codes = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)
            chosen = np.zeros(int(self.codes.max(initial=0)) + 1, bool)
            chosen[[ord(c) for c in own]] = True
            inside = np.zeros(len(a) + 2, bool)
            inside[1:-1] = chosen[self.codes]
            self.known[own] = _Stretches(np.flatnonzero(inside[1:] != inside[:-1]))
        return self.known[own]


class _Stretches:
    """Stretches of starting letters of a text, and the first longest of any neighbouring ones: levels over 1, 2, 4, … of them."""

    #: Over so few stretches a look at each is quicker than the levels, which are made when they are first needed.
    FEW = 256

    def __init__(self, edges: np.ndarray):
        self.size = edges[1::2] - edges[::2]
        self.starts, self.ends = edges[::2].tolist(), edges[1::2].tolist()
        self.levels = None

    def _levels(self) -> list[np.ndarray]:
        size, levels = self.size, [np.arange(len(self.size))]
        while 2 ** len(levels) <= len(size):
            half, last = 2 ** (len(levels) - 1), levels[-1]
            left, right = last[:-half], last[half:]
            levels.append(np.where(size[left] >= size[right], left, right))
        return levels

    def longest(self, lo: int, hi: int) -> int:
        """The first longest of the stretches lo, …, hi - 1."""
        if hi - lo <= self.FEW:
            return lo + int(self.size[lo:hi].argmax()) if hi - lo > 1 else lo
        self.levels = self.levels or self._levels()
        k = (hi - lo).bit_length() - 1
        x, y = int(self.levels[k][lo]), int(self.levels[k][hi - 2 ** k])
        return x if self.size[x] >= self.size[y] else y

    def within(self, alo: int, ahi: int, size: int):
        """(start, end) of the stretches of a range, cut at its ends, that have ``size`` letters there, in order."""
        lo, hi = bisect.bisect_right(self.ends, alo), bisect.bisect_left(self.starts, ahi)
        if lo >= hi:
            return
        first, last = (max(alo, self.starts[lo]), min(ahi, self.ends[lo])), (max(alo, self.starts[hi - 1]), min(ahi, self.ends[hi - 1]))
        if first[1] - first[0] >= size:
            yield first
        todo = [(lo + 1, hi - 1)]
        while todo:
            x, y = todo.pop()
            if x < 0:
                yield self.starts[y], self.ends[y]
            elif 0 < y - x <= self.FEW:
                for m in range(x, y):
                    if self.ends[m] - self.starts[m] >= size:
                        yield self.starts[m], self.ends[m]
            elif x < y:
                m = self.longest(x, y)
                if self.ends[m] - self.starts[m] >= size:
                    todo += [(m + 1, y), (-1, m), (x, m)]
        if hi - 1 > lo and last[1] - last[0] >= size:
            yield last

    def block(self, a: str, b: str, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        """(place in a, place in b, letters) of the longest string of starting letters in both ranges, first in a, then first in b.

        The first longest stretch of a's range, cut at its ends, is looked for whole
        first: texts that differ by one edit have it in common.
        """
        starts, ends = self.starts, self.ends
        lo, hi = bisect.bisect_right(ends, alo), bisect.bisect_left(starts, ahi)
        if lo >= hi:
            return alo, blo, 0
        i, e = starts[lo], ends[lo]
        if i < alo:
            i = alo
        size = (e if e < ahi else ahi) - i
        if hi - lo > 2:
            m = self.longest(lo + 1, hi - 1)
            if ends[m] - starts[m] > size:
                i, size = starts[m], ends[m] - starts[m]
        if hi - lo > 1:
            s, e = starts[hi - 1], ends[hi - 1]
            if (e if e < ahi else ahi) - s > size:
                i, size = s, (e if e < ahi else ahi) - s
        j = b.find(a[i:i + size], blo, bhi)
        return (i, j, size) if j >= 0 else _shorter_block(a, b, self, alo, ahi, blo, bhi, size) or (alo, blo, 0)


def _shorter_block(a: str, b: str, stretches: _Stretches, alo: int, ahi: int, blo: int, bhi: int, most: int) -> tuple[int, int, int] | None:
    """The longest string of at most ``most`` starting letters; the length is halved, as a string that is shared shares all its parts."""
    def first(size):
        seen = set()
        for s, e in stretches.within(alo, ahi, size):
            for i in range(s, e - size + 1):
                w = a[i:i + size]
                if w not in seen:
                    seen.add(w)
                    j = b.find(w, blo, bhi)
                    if j >= 0:
                        return i, j, size
        return None

    low, high, best = 0, most, None
    while low < high:
        size = (low + high + 1) // 2
        block = first(size)
        if block:
            low, best = size, block
        else:
            high = size - 1
    return best


def _starting(b: str, counts: Counter) -> set[str]:
    """The letters that start blocks in ``b``."""
    if len(b) < LONG_TEXT:
        return set(b)
    most = len(b) // 100 + 1
    return {c for c, n in counts.items() if 0 < n <= most}


def _widest(a: str, b: str, stretches: _Stretches, alo: int, ahi: int, blo: int, bhi: int, differ: Sequence[int] = (), after: int = 0) -> tuple[int, int, int]:
    """(place in a, place in b, letters) of the longest block of two ranges, carried on over equal letters.

    ``differ`` are the first places at which both texts differ, in order, the last of them as a limit to
    what is known; from the end on, they have ``after`` letters in common and no more.
    """
    i, j, n = stretches.block(a, b, alo, ahi, blo, bhi)
    if differ and i == j and i < differ[-1]:
        k = bisect.bisect_left(differ, i)
        first, last = max(alo, blo, differ[k - 1] + 1 if k else 0), min(ahi, bhi, differ[k])
        return first, first, last - first
    if after and len(a) - i == len(b) - j <= after:
        shift = j - i
        first = max(alo, blo - shift, len(a) - after)
        return first, first + shift, min(ahi, bhi - shift) - first
    if i > alo and j > blo and a[i - 1] == b[j - 1]:
        back = _shared(a, i, b, j, min(i - alo, j - blo), -1)
        i, j, n = i - back, j - back, n + back
    if i + n < ahi and j + n < bhi and a[i + n] == b[j + n]:
        n += _shared(a, i + n, b, j + n, min(ahi - i - n, bhi - j - n), 1)
    return i, j, n


def matched_letters(a: str, b: str, known: _Letters | None = None, counts: Counter | None = None, least: float = -1.0) -> int:
    """Letters in the blocks of Ratcliff and Obershelp: the longest block, then the same on both sides of it.

    A block starts from letters that are not frequent in ``b`` (in a short text all
    of them are not) and is then carried on over equal letters both ways. ``known``
    serves calls with the same ``a``; ``counts`` are the letters of ``b``. Once no
    more than ``least`` can come together, -1.
    """
    known = known or _Letters(a)
    return _matched(a, b, known.stretches(a, _starting(b, Counter(b) if counts is None else counts)), least)


def _matched(a: str, b: str, stretches: _Stretches, least: float, place: tuple[int, ...] | None = None, end: _End | None = None, front: int = 0,
             differ: Sequence[int] = (), after: int = 0) -> int:
    """:func:`matched_letters` by given stretches of starting letters, of a range or of all.

    Where ``b`` is ``front`` letters and then the text of ``end``, ranges behind the
    first letters of that text are left to it. ``differ`` and ``after``: see :func:`_widest`.
    """
    if not a or not b:
        return 0
    alo, ahi, blo, bhi = place = place or (0, len(a), 0, len(b))
    total, todo, behind = 0, [place], front + end.head if end else bhi
    open_ = min(ahi - alo, bhi - blo)  # of the ranges to come
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        x, y = ahi - alo, bhi - blo
        open_ -= x if x < y else y
        if blo >= behind:
            total += end.total(alo, ahi, blo - front, bhi - front)
        else:
            i, j, n = _widest(a, b, stretches, alo, ahi, blo, bhi, differ, after)
            if n:
                total += n
                x, y = i - alo, j - blo
                if x == y == 1:
                    total += a[alo] == b[blo]
                elif x and y:
                    todo.append((alo, i, blo, j))
                    open_ += x if x < y else y
                x, y = ahi - i - n, bhi - j - n
                if x == y == 1:
                    total += a[ahi - 1] == b[bhi - 1]
                elif x and y:
                    todo.append((i + n, ahi, j + n, bhi))
                    open_ += x if x < y else y
        if total + open_ <= least:
            return -1
    return total


def ratio(a: str, b: str, above: float = -1.0, known: _Letters | None = None) -> float | None:
    """Ratcliff–Obershelp ratio of two texts, or None if it cannot be more than ``above``.

    The letters that both texts have, counted with repeats, are an upper limit of
    what the matcher can match, and cost one pass over each text.
    """
    total = len(a) + len(b)
    if total == 0:
        return 1.0
    if a == b:
        return 1.0
    least = min(len(a), len(b))
    if above >= 0 and 2.0 * least / total <= above:
        return None
    before = _shared(a, 0, b, 0, least, 1)
    after = _shared(a, len(a), b, len(b), least - before, -1)
    known = known or _Letters(a)
    counts = known.count(a, b, before, after)
    if above >= 0 and 2.0 * (before + after) / total <= above and 2.0 * sum(min(n, counts[c]) for c, n in known.counts.items()) / total <= above:
        return None
    # Half a letter less than the limit: what the division rounds is left to it.
    matched = matched_letters(a, b, known, counts, above * total / 2.0 - 0.5 if above >= 0 else -1.0)
    return 2.0 * matched / total if matched >= 0 else None


@F.arrow_udf(T.DoubleType())
def similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    """Ratcliff–Obershelp ratio of two whole texts."""
    return pa.array([ratio(x or "", y or "") for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


def first_valid_similarities(text: str, lists: list[list[str]], most: int, done: list[list[float | None]] | None = None) -> list[list[float | None]]:
    """For each list of candidates, the similarity of the first ``most`` valid ones, null for the others.

    ``done`` has the results of the first candidates of each list, if they are known already.
    """
    low, out, known = 1.0 - MAX_DISTANCE, [], _Letters(text)
    for texts, before in zip(lists, done or [[]] * len(lists)):
        ratios = list(before)
        kept = len(ratios) - ratios.count(None)
        for t in texts[len(ratios):]:
            v = ratio(text, t, low, known) if kept < most else None
            valid = v is not None and low < v < 1.0
            kept += valid
            ratios.append(v if valid else None)
        out.append(ratios)
    return out


def _differences(a: str, b: str) -> list[int]:
    """The places at which two texts differ, up to the end of the shorter one."""
    n = min(len(a), len(b))
    x, y = (np.frombuffer(t[:n].encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    return [*np.flatnonzero(x != y).tolist(), n]


class _End:
    """A text that other texts end with, held against the first text: what matches in its ranges, whatever stands in front of it."""

    def __init__(self, a: str, b: str, head: int, letters: frozenset[str], stretches: _Stretches, differ: Sequence[int]):
        self.a, self.b, self.head, self.letters, self.stretches, self.differ, self.known = a, b, head, letters, stretches, differ, {}

    def total(self, *place: int) -> int:
        if place not in self.known:
            self.known[place] = _matched(self.a, self.b, self.stretches, -1.0, place, differ=self.differ)
        return self.known[place]


class _Front:
    """The starting letters of a text with something in front of the text of ``end``: some of them only stand in its front.

    A block without such letters is found by ``end``'s stretches, which are there
    already. The strings with such letters are few: they are looked for one by one.
    """

    #: With more strings than that, stretches are found by all of the letters.
    FEW = 20

    def __init__(self, letters: _Letters, a: str, b: str, own: frozenset[str], end: _End, front: int):
        self.letters, self.own, self.end = letters, own, end
        self.many = False
        only, strings, k, last = own - end.letters, set(), 0, front + end.head
        while only and k < last and len(strings) <= self.FEW:
            if b[k] in only:
                first, k = k, k + 1
                while first and b[first - 1] in own:
                    first -= 1
                while k < len(b) and b[k] in own:
                    k += 1
                run = b[first:k]
                strings.update(w for x in range(len(run)) for y in range(x + 1, min(len(run), x + self.FEW) + 1) if not only.isdisjoint(w := run[x:y]))
                if len(run) > self.FEW:
                    self.many = True
                    break
            k += 1
        self.many |= len(strings) > self.FEW
        self.strings = sorted(strings, key=len, reverse=True)

    def block(self, a: str, b: str, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        if self.many:
            return self.letters.stretches_of(a, self.own).block(a, b, alo, ahi, blo, bhi)
        i, j, n = self.end.stretches.block(a, b, alo, ahi, blo, bhi)
        for w in self.strings:
            if len(w) < n:
                break
            x = a.find(w, alo, ahi if len(w) > n else i + n)
            if x >= 0 and (len(w) > n or x < i) and (y := b.find(w, blo, bhi)) >= 0:
                i, j, n = x, y, len(w)
        return i, j, n


def _changed(counts: dict[str, int], known: dict[int, frozenset[str]], own: dict[str, int], most: int, change: dict[str, int]) -> frozenset[str]:
    """Letters of ``own`` that occur 1 to ``most`` times after a change of their ``counts``."""
    if most not in known:
        known[most] = frozenset(c for c in own if 0 < counts.get(c, 0) <= most)
    before = known[most]
    other = [c for c, n in change.items() if c in own and (0 < counts.get(c, 0) + n <= most) != (c in before)]
    return before.symmetric_difference(other) if other else before


class Variants:
    """A text and the similarities of its variants, from what each variant lacks and has instead.

    The letters of a variant are counted by that, not anew, and variants that put
    something in front of the same ``body`` share what matches in it.
    """

    def __init__(self, a: str, body: str):
        self.a, self.letters, self.body, self.ends = a, _Letters(a), body, {}
        self.starting, self.starting_body, self.body_counts = {}, {}, None

    def ratio(self, b: str, removed: str | None, added: str | None, at: int, tail: int, above: float) -> float | None:
        """:func:`ratio` of the text and a variant that has ``added`` for ``removed``, between so many letters that both have.

        ``removed`` is None where ``added`` stands in front of the body, both are None where nothing is told.
        """
        a = self.a
        if added is None or a == b:
            return ratio(a, b, above, self.letters)
        total, least = len(a) + len(b), min(len(a), len(b))
        if 2.0 * least / total <= above:
            return None
        most = len(b) // 100 + 1 if len(b) >= LONG_TEXT else len(b)
        limit = above * total / 2.0 - 0.5
        if removed is not None:
            change = {c: added.count(c) - removed.count(c) for c in {*removed, *added}}
            own = _changed(self.letters.counts, self.starting, self.letters.counts, most, change)
            before = at + _shared(a, at, b, at, least - at, 1)
            after = tail + _shared(a, len(a) - tail, b, len(b) - tail, least - tail, -1)
            matched = _matched(a, b, self.letters.stretches_of(a, own), limit, differ=(before,), after=after)
        else:
            matched = self._fronted(b, added, most, limit)
        return 2.0 * matched / total if matched >= 0 else None

    def _fronted(self, b: str, front: str, most: int, least: float) -> int:
        if self.body_counts is None:
            self.body_counts = _counted(self.body)
            self.head = min(1, len(self.body))
            self.behind = self.letters.counts.keys() & {c for c, n in self.body_counts.items() if n > (c == self.body[0])}
            self.differ = _differences(self.a, self.body)
            self.both = sum(min(n, self.body_counts.get(c, 0)) for c, n in self.letters.counts.items())
        if self.both + len(front) <= least:  # the letters that both have, with those of the front
            return -1
        own = _changed(self.body_counts, self.starting_body, self.letters.counts, most, {c: front.count(c) for c in {*front}})
        behind = own & self.behind
        end = self.ends.get(behind)
        if end is None:
            end = self.ends[behind] = _End(self.a, self.body, self.head, behind, self.letters.stretches_of(self.a, behind), self.differ)
        return _matched(self.a, b, _Front(self.letters, self.a, b, own, end, len(front)), least, end=end, front=len(front))


def validity(ratio: Column, fluency: Column) -> dict[str, Column]:
    low = 1.0 - MAX_DISTANCE
    return {"valid": (ratio > low) & (ratio < 1.0) & (fluency >= MIN_FLUENCY), "too_different": ratio <= low,
            "too_similar": ratio >= 0.99, "low_fluency": fluency < MIN_FLUENCY}
