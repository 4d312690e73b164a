"""Variants are made one rule after the other, and further ones only for generators whose first ones are not all valid."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tiltmeter.functions import fluency as FL
from tiltmeter.operators import perturb as PB


def texts():
    rng = random.Random(3)
    words = "The army said soldiers killed two men in Mora later while police arrested one (Mora, Far North) military forces beat rebels".split()
    made = [" ".join(rng.choices(words, k=k)) + "." for k in (4, 9, 20, 60, 200, 500) for _ in range(3)]
    # Capitals go when a phrase is put in front, so those variants are too unlike; short ones are unlike by length.
    made += [t.upper() for t in made[::4]] + ["Aa Bb Cc. " * 30, "According to state media, soldiers shot civilians. " + "X. Y. Z. " * 40]
    return [*made, "", "Soldiers killed civilians.", "no", None]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(list(enumerate(texts())), "event_id int, notes string").repartition(4).cache()


@pytest.mark.parametrize("name", PB.GENERATORS)
def test_first_candidates(frame, name):
    t = F.col("notes")
    rows = frame.where("notes IS NOT NULL").select(PB._first_plausible(name, t, 3).alias("few"), PB._all_plausible(name, t).alias("all")).collect()
    assert all(r["few"] == r["all"][:3] for r in rows)


def test_first_valid_of_all(frame):
    def by_row(df):
        return sorted(df.drop("pert_idx").collect(), key=lambda r: (r["event_id"], PB.GENERATORS.index(r["generator"]), r["gen_idx"]))

    taken, want = {}, []
    for r in by_row(PB.valid_variants(frame, max_per_generator=None)):
        k = r["event_id"], r["generator"]
        taken[k] = taken.get(k, 0) + 1
        if taken[k] <= 3:
            want.append(r)
    assert by_row(PB.valid_variants(frame)) == want
    assert max(taken.values()) > 3


def test_texts_are_compared_once(spark, monkeypatch):
    """The second turn goes on after the candidates that have results."""
    asked = []
    ratio = FL.ratio
    monkeypatch.setattr(FL, "ratio", lambda a, b, *x: asked.append(b) or ratio(a, b, *x))
    text = "the soldiers of the north went home " * 8
    lists = [[text + "now", "quite another one" * 20, text + "then", text + "soon", text + "late"], [text + "x"]]
    first = FL.first_valid_similarities(text, [x[:3] for x in lists], 3)
    assert FL.first_valid_similarities(text, lists, 3, first) == FL.first_valid_similarities(text, lists, 3)
    assert asked[:5] == [*lists[0][:3], lists[1][0], lists[0][3]]


def test_a_limit_only_drops_what_is_below():
    rng = random.Random(5)
    for size in (30, 150, 250, 900):
        for _ in range(60):
            a = "".join(rng.choices("etaoin shrdluMNQ.", k=size))
            known = FL._Letters(a)
            for _ in range(6):
                k, n = rng.randrange(size), rng.randrange(size // 2)
                b = rng.choice([a[:k] + "x" * n + a[k:], a[:k] + a[k + n:], "Reports say, " + a.lower(), a[k:] + a[:k], a[n:] + a[:n // 2]])
                want = SequenceMatcher(None, a, b).ratio() if a or b else 1.0
                got = FL.ratio(a, b, 0.7, known)
                assert got == want if want > 0.7 else got is None or got == want


def test_null_text(frame):
    got = PB.explode_variants(frame.where("notes IS NULL")).collect()
    assert [(r["generator"], r["gen_idx"], r["text"]) for r in got] == [("provenance", i, None) for i in range(8)]
