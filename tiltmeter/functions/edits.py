"""The counterfactual variants of a text in Python, each with what it takes from the text and what it puts in.

The rules stand here as rows; ``operators/perturb.py`` applies the same rows as
Columns. Both make the same variants of every text without a letter of
:data:`RARE`: Java's and Python's letters, cases and blanks agree on all others.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Callable, Iterator

from . import perturbation_rules as R

FIELDS = ["type", "subtype", "original", "replacement", "modifier", "action", "phrase", "source", "target",
          "pattern", "text", "description"]

#: A Java pattern of letters whose case or kind Java and Python may tell differently: matched by ASCII letters without
#: regard to case, lower-cased by their place in a word, cased since the last version of Unicode, or unknown to this Java.
RARE = r"[\u0130\u0131\u017F\u212A\u03A3\u019B\u0264\p{Cn}]"

#: ``\s`` of Java's Unicode classes.
BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANKS = "".join(chr(c) for c in range(0x3001) if re.match(f"[{BLANK}]", chr(c)))


def _replace_all(word: str) -> str:
    return rf"(?iU)\b{word}\b"


def replace_first(inner: str, flags: str = "isU") -> str:
    return rf"(?{flags})^(.*?){inner}"


def _swaps(kind: str, words: dict[str, list[str]]) -> list[dict]:
    return [{"type": kind, "original": w, "replacement": s, "needle": w, "regex": _replace_all(w), "swap": s,
             "description": f'Replace "{w}" with "{s}"'} for w, swaps in words.items() for s in swaps]


def _family(subtype: str, what: str, swaps: dict[str, str]) -> list[dict]:
    return [{"type": "neutral_control", "subtype": subtype, "original": w, "replacement": s, "needle": w.lower(),
             "regex": replace_first(rf"\b{w}\b"), "swap": f"$1{s}",
             "description": f'Neutral {what} swap: "{w}" → "{s}"'} for w, s in swaps.items()]


ACTOR = _swaps("actor_substitution", R.ACTORS)
ACTION = _swaps("action_substitution", R.ACTIONS)
INTENSITY = [
    {"type": f"intensity_{k}", "modifier": m, "action": v, "needle": v, "regex": replace_first(rf"\b{v}"),
     "swap": f"$1{m} {v}", "description": f'Add "{m}" before "{v}"'}
    for k, mods in R.INTENSITY.items() for m in mods for v in R.INTENSITY_VERBS]
NEGATION = [
    {"type": "negation", "target": w, "needle": w, "regex": replace_first(rf"\b{w}"), "swap": f"$1did not {b}",
     "description": f'Negate "{w}" → "did not {b}"'} for w, b in R.NEGATION.items()]
LEGITIMATION = [{"type": "legitimation_add", "phrase": p, "description": f'Add legitimizing phrase: "{p}"'} for p in R.LEGITIMIZING[:1]]
DELEGITIMATION = [
    {"type": "delegitimation_add", "phrase": p, "swap": p.capitalize() + ", ",
     "description": f'Add delegitimizing phrase: "{p}"'} for p in R.DELEGITIMIZING]
PROVENANCE = [{"type": "provenance_add", "source": s, "description": f'Add source attribution: "{s}"'} for s in R.SOURCES]
NO_PROVENANCE = [
    {"type": "provenance_remove", "source": s, "needle": s.lower(), "regex": rf"(?iU)^\Q{s}\E\s*",
     "swap": "", "description": f'Remove source attribution: "{s}"'} for s in R.SOURCES]
DECONTEXTUALIZATION = [{"type": "decontextualization", "replacement": p, "swap": f"$1{p}"} for p in R.PLACES]
CONTROL = [_family("reporting_verb", "verb", R.REPORTING_VERBS), _family("day_of_week", "day", R.WEEKDAYS),
           _family("temporal_connective", "connective", R.CONNECTIVES), _family("cardinal_numeral", "numeral", R.NUMERALS)]

OTHERS = [f for f in FIELDS if f != "text"]


def _fields(row: dict) -> tuple[str | None, ...]:
    """The fields of a variant but its text, in their order."""
    return tuple(row.get(f) for f in OTHERS)


#: The places of words that a rule's edit replaces: all whole words, the first word that begins so, the first whole word.
EVERY, BEGINNING, WHOLE = range(3)


def _worded(rows: list[dict], which: int, word: str) -> list[tuple]:
    """(fields, needle, word, which, what is put in its place) of rules that replace a word."""
    return [(_fields(r), r["needle"], r[word].lower(), which, r["swap"].removeprefix("$1")) for r in rows]


_ACTOR, _ACTION = _worded(ACTOR, EVERY, "original"), _worded(ACTION, EVERY, "original")
_INTENSITY, _NEGATION = _worded(INTENSITY, BEGINNING, "action"), _worded(NEGATION, BEGINNING, "target")
_CONTROL = [_worded(rows, WHOLE, "original") for rows in CONTROL]
_LEGITIMATION = [(_fields(r), f" {r['phrase']}.") for r in LEGITIMATION]
_DELEGITIMATION = [(_fields(r), r["swap"]) for r in DELEGITIMATION]
_PROVENANCE = [(_fields(r), r["source"] + " ") for r in PROVENANCE]
_NO_PROVENANCE = [(_fields(r), r["needle"]) for r in NO_PROVENANCE]
#: Of each pattern the words of its three groups; a word that may have an s stands for two.
_SUFFICIENCY = [[[x for w in group.split("|") for x in ([w[:-2] + "s", w[:-2]] if w.endswith("s?") else [w])]
                 for group in re.findall(r"\\b\((.*?)\)\\b", p)] for p in R.SUFFICIENCY]
_IN_PLACE = re.compile(R.PLACE_PATTERNS[1].removeprefix(r"\b").replace(r"\s", f"[{BLANK}]"))


def _in_words(c: str) -> bool:
    """Whether a letter is part of words as Java's ``\\b`` has it with Unicode classes."""
    if c.isascii():
        return c.isalnum() or c == "_"
    n = ord(c)
    return (c.isalpha() or unicodedata.category(c) in ("Mn", "Mc", "Me", "Nd", "Nl", "Pc") or 0x200C <= n <= 0x200D
            or 0x24B6 <= n <= 0x24E9 or 0x1F130 <= n <= 0x1F149 or 0x1F150 <= n <= 0x1F169 or 0x1F170 <= n <= 0x1F189)


class Text:
    """A text, lower-cased once, and where it has the words of the rules."""

    def __init__(self, text: str):
        self.text, self.low = text, text.lower()
        #: The text with its first letter upper-case and all others lower-case.
        self.body = text[:1].upper() + self.low[1:]
        self.known: dict[str, bool] = {}
        self.spans: dict[tuple[str, int], list[tuple[int, int]]] = {}

    def has(self, needle: str) -> bool:
        if needle not in self.known:
            self.known[needle] = needle in self.low
        return self.known[needle]

    def places(self, word: str, which: int) -> list[tuple[int, int]]:
        """(start, end) of the word, in any case, at the places that ``which`` tells."""
        if (word, which) not in self.spans:
            self.spans[word, which] = out = []
            low, at = self.low, -1
            while (at := low.find(word, at + 1)) >= 0:
                end = at + len(word)
                if (not at or not _in_words(low[at - 1])) and (which == BEGINNING or end == len(low) or not _in_words(low[end])):
                    out.append((at, end))
                    if which != EVERY:
                        break
                    at = end - 1
        return self.spans[word, which]

    def replaced(self, spans: list[tuple[int, int]], put: str) -> str:
        text = self.text
        if len(spans) == 1:
            (s, e), = spans
            return text[:s] + put + text[e:]
        starts = [0, *(e for _, e in spans)]
        return put.join(text[x:y] for x, y in zip(starts, [*(s for s, _ in spans), len(text)]))


#: The fields of a variant but its text, its text, what of the text it lacks, what it has instead, and how many letters before and
#: behind that both have at least. Where it lacks None, the next is put in front of the body; where both are None, nothing is told of it.
Variant = tuple[tuple, str, str | None, str | None, int, int]


def _words(t: Text, rules: list[tuple]) -> Iterator[Variant]:
    known = t.known
    for fields, needle, word, which, put in rules:
        if (known[needle] if needle in known else t.has(needle)) and (spans := t.places(word, which)):
            text = t.replaced(spans, put)
            if text != t.text:
                yield fields, text, "".join(t.text[s:e] for s, e in spans), put * len(spans), spans[0][0], len(t.text) - spans[-1][1]


def _sufficiency(t: Text) -> Iterator[Variant]:
    for k, groups in enumerate(_SUFFICIENCY):
        if not all(any(t.has(w) for w in words) for words in groups):
            continue
        actors, actions, objects = (sorted(x for w in words if t.has(w) for x in t.places(w, EVERY)) for words in groups)
        line = 0  # a match lies in one line; what the first actor of a line lacks, the others lack too
        for start, end in actors:
            if start < line:
                continue
            line = t.low.find("\n", end)
            line = len(t.low) if line < 0 else line
            m = bisect.bisect_left(actions, (end, 0))
            n = bisect.bisect_left(objects, (actions[m][1], 0)) if m < len(actions) else len(objects)
            if n < len(objects) and objects[n][1] <= line:
                span = t.text[start:objects[n][1]]
                yield _fields({"type": "sufficiency", "pattern": f"pattern_{k}", "description": f'Keep only key elements: "{span}"'}), span, None, None, 0, 0
                break


def _legitimation(t: Text) -> Iterator[Variant]:
    ended = t.text.rstrip(".!?")
    for fields, end in _LEGITIMATION:
        if ended + end != t.text:
            yield fields, ended + end, t.text[len(ended):], end, len(ended), 0
    for fields, front in _DELEGITIMATION:
        yield fields, front + t.body, None, front, 0, 0


def _provenance(t: Text) -> Iterator[Variant]:
    for fields, front in _PROVENANCE:
        yield fields, front + t.body, None, front, 0, 0
    for fields, needle in _NO_PROVENANCE:
        if t.low.startswith(needle):
            text = t.text[len(needle):].lstrip(BLANKS)
            yield fields, text, t.text[:len(t.text) - len(text)], "", 0, len(text)


def _place(t: Text) -> tuple[int, int] | None:
    """The first brackets with a comma inside, else the first "in <Place>"."""
    text, at = t.text, -1
    while (at := text.find("(", at + 1)) >= 0:
        end = text.find(")", at)
        if end < 0:
            break
        if text.find(",", at + 2, end - 1) >= 0:
            return at, end + 1
        at = end  # brackets that open inside of these have no comma either
    at = -1
    while found := _IN_PLACE.search(text, at + 1):
        at = found.start()
        if not at or not _in_words(text[at - 1]):
            return found.span()
    return None


def _decontextualization(t: Text) -> Iterator[Variant]:
    if span := _place(t):
        was = t.text[slice(*span)]
        for row in DECONTEXTUALIZATION:
            put = row["replacement"]
            if put != was:
                yield _fields(row | {"original": was, "description": f'Replace location "{was}" with "{put}"'}), t.replaced([span], put), was, put, span[0], len(t.text) - span[1]


def _control(t: Text) -> Iterator[Variant]:
    for rules in _CONTROL:
        if first := next(_words(t, rules), None):
            yield first


#: By generator, in the order of ``perturb.GENERATORS``.
MAKERS: dict[str, Callable[[Text], Iterator[Variant]]] = {
    "actor": lambda t: _words(t, _ACTOR), "intensity": lambda t: _words(t, _INTENSITY), "action": lambda t: _words(t, _ACTION),
    "negation": lambda t: _words(t, _NEGATION), "sufficiency": _sufficiency, "legitimation": _legitimation,
    "provenance": _provenance, "decontextualization": _decontextualization, "control": _control}
