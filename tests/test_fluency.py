"""The block matcher against the standard library's."""

import random
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings, strategies as st

from tiltmeter.functions import fluency as FL

LETTERS = "etaoinshrdlucmfwypvbgk qxjz.,Eé"


def both(a, b):
    if a or b:
        assert FL.ratio(a, b) == SequenceMatcher(None, a, b).ratio(), (a, b)


@settings(max_examples=500, deadline=None)
@given(st.text("abc ", max_size=30), st.text("abc ", max_size=30))
def test_short_texts(a, b):
    both(a, b)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40), st.text(max_size=40))
def test_any_characters(a, b):
    both(a, b)


def edited(rng, text):
    k = rng.randrange(len(text) + 1)
    kind = rng.randrange(5)
    if kind == 0:
        return text[:k] + rng.choice(["very ", "x", "Then it was over. ", "zz"]) + text[k:]
    if kind == 1:
        return text[:k] + text[k + rng.randint(1, 12):]
    if kind == 2:
        return "Reports say, " + text[:1].lower() + text[1:]
    if kind == 3:
        return text.rstrip(".") + " as was just."
    return text.replace(rng.choice(LETTERS), rng.choice(LETTERS), rng.randint(1, 3))


@pytest.mark.parametrize("size", [150, 199, 200, 260, 700, 2500])
def test_edits_of_texts(size):
    rng = random.Random(size)
    for _ in range(120 if size < 1000 else 25):
        a = "".join(rng.choices(LETTERS, weights=[len(LETTERS) - i + (i == 22) * 40 for i in range(len(LETTERS))], k=size + rng.randint(-3, 3)))
        b = edited(rng, a)
        for _ in range(rng.randint(0, 4)):
            b = edited(rng, b)
        both(a, b)
        both(b, a)


def test_repetitive_and_unlike_texts():
    rng = random.Random(1)
    passage = "".join(rng.choices(LETTERS, k=90))
    for a, b in [("ab" * 150, "ba" * 150), (passage * 4, passage * 3 + "x" + passage), ("a" * 400, "a" * 399 + "b"), (passage * 3, "".join(rng.choices(LETTERS, k=300))),
                 ("", "x" * 300), ("q" + "e" * 500, "e" * 500 + "q"), ("]^-\\" * 60, "\\-^]" * 60)]:
        both(a, b)
