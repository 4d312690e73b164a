"""Variants made in Python against those of the Columns, and their similarities against the standard library's matcher."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tiltmeter.functions import edits as E, fluency as FL
from tiltmeter.operators import perturb as PB

WORDS = ("The army said soldiers killed two men in Mora later while police Arrested one (Mora, Far North) military forces beat rebels; "
         "state forces ATTACKED civilians on Monday, security forces shot protesters in Far North region Members fighter").split(" ")
#: Letters at the borders of words, blanks, marks, letters with two cases, and some that only Java's classes tell.
ODD = ["²", "́", "_", "‍", "‌", "Ⓐ", "ß", "’", "\n", "\u0085", " ", "\x1c", "(", ")", ",", "  ", "-", "\U0001f130", "Ⅰ", "中", "‿", "7"]
RARE = ["İ", "ı", "ſ", "K", "Σ", "ɤ", "\U000e0080"]


def texts():
    rng, made = random.Random(11), []
    for k in (1, 3, 8, 20, 70):
        for odd in ([], ODD, ODD, ODD + RARE):
            for _ in range(8 if k < 70 else 2):
                picked = []
                for w in rng.choices(WORDS, k=k):
                    w = rng.choice([w, w, w, w.lower(), w.title(), w.upper()])
                    if odd and rng.random() < 0.4:
                        w = rng.choice([w + rng.choice(odd), rng.choice(odd) + w, w.replace("i", "ı") if odd[-1] in RARE else w])
                    picked.append(w)
                made.append(" ".join(picked) + rng.choice([".", "", "!?", " "]))
    made += [s + rng.choice([" ", " ", "", "\x1c"]) + "Soldiers shot\nmembers and armed forces beat a civilian." for s in PB.R.SOURCES]
    made += [made[-1].upper() * 3, "", " ", "no", "ßoldiers killed civilians.", "(, a) (a,) (a, b) in Mora", "(a (b, c) in X", "in mora In Far North in Far North village", "x" * 300, "Aa Bb Cc. " * 30]
    return made


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(list(enumerate(texts())), "event_id int, notes string").repartition(8).cache()


@pytest.fixture(scope="module")
def columns(frame):
    """The variants of all rules by the Columns, whether valid or not."""
    made = [PB._tagged(n, F.col("notes"), PB._fluent).alias(n) for n in PB.GENERATORS]
    return frame.select("event_id", "notes", F.rlike("notes", F.lit(E.RARE)).alias("rare"), *made).collect()


def test_same_variants_as_columns(columns):
    """Where Java and Python may differ, ``valid_variants`` takes the Columns."""
    rows = [r for r in columns if not r["rare"]]
    assert 100 < len(rows) < len(columns)
    for r in rows:
        t = E.Text(r["notes"])
        for n in PB.GENERATORS:
            want = [(*(v[f] for f in E.OTHERS), v["text"], v["gen_idx"], v["fluency_score"]) for v in r[n]]
            assert [(*f, text, i, FL.grammatical(text)) for i, (f, text, *_) in enumerate(E.MAKERS[n](t))] == want, (n, r["notes"])


def test_valid_variants(frame, columns):
    """Of all texts, also of those that go by the Columns, against all Columns and the standard library."""
    ratios, low = {}, 1.0 - FL.MAX_DISTANCE
    for most in (None, 1, 3):
        want = []
        for r in columns:
            number = 0
            for n in PB.GENERATORS:
                kept = 0
                for v in r[n]:
                    if v["fluency_score"] >= FL.MIN_FLUENCY and (most is None or kept < most):
                        pair = r["notes"], v["text"]
                        if pair not in ratios:
                            ratios[pair] = SequenceMatcher(None, *pair).ratio()
                        if low < ratios[pair] < 1.0:
                            want.append((r["event_id"], number, n, v["gen_idx"], v["type"], v["text"], v["fluency_score"], ratios[pair]))
                            number, kept = number + 1, kept + 1
        got = PB.valid_variants(frame, max_per_generator=most).select("event_id", "pert_idx", "generator", "gen_idx", "type", "text", "fluency_score", "edit_distance_ratio")
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_letters_of_java(spark):
    """Python tells words, blanks, capitals and cases as Java does, of all letters that are not left to the Columns."""
    df = spark.range(1, 0x110000).where("id < 55296 OR id >= 57344")
    char = F.udf(chr, "string")
    df = df.select(char("id").alias("c")).where(~F.rlike("c", F.lit(E.RARE)))
    z = F.lit("xy")
    rows = df.select("c", F.lower("c"), F.upper("c"), F.rlike("c", F.lit(r"(?U)^\s$")), F.rlike("c", F.lit(r"^\p{Lu}")),
                     ~F.rlike(F.concat("c", z), F.lit(r"(?iU)\bxy\b")), ~F.rlike(F.concat(z, "c"), F.lit(r"(?isU)\bxy\b")),
                     F.rlike("c", F.lit("(?iU)^(?:" + "|".join("abcdefghijklmnopqrstuvwxyz") + ")$"))).toArrow().to_pylist()
    assert len(rows) > 200_000
    import unicodedata
    for r in rows:
        c, low, up, blank, capital, left, right, ascii_ = r.values()
        assert (c.lower(), c.upper(), c in E.BLANKS, unicodedata.category(c) == "Lu", E._in_words(c), E._in_words(c)) == (low, up, blank, capital, left, right), hex(ord(c))
        assert ascii_ == (c.isascii() and c.isalpha()), hex(ord(c))


def test_similarities_of_edits():
    """What is told of an edit, and blocks shared by fronts, change no ratio."""
    rng = random.Random(2)
    for size in (20, 150, 198, 260, 900, 2500):
        for _ in range(8 if size < 300 else 2):
            letters = rng.choice(["etaoin shrdluMNQ.", "etaoin shrdluJjQqZz., (", "ab ", "żetaoin srJjXx.\n"])
            text = "".join(rng.choices(letters, weights=[20] * 8 + [1] * (len(letters) - 8) if len(letters) > 8 else None, k=size))
            for w in ("Soldiers killed", "police"):
                k = rng.randrange(size)
                text = text[:k] + f" {w} " + text[k:]
            t = E.Text(text)
            same, low = FL.Variants(text, t.body), 1.0 - FL.MAX_DISTANCE
            for make in E.MAKERS.values():
                for _, b, *edit in make(t):
                    want, got = SequenceMatcher(None, text, b).ratio(), same.ratio(b, *edit, low)
                    assert got == want if want > low else got is None or got == want
            for front in ("Jjj qZ, ", "x" * 40, "Q"):
                b = front + t.body
                want, got = SequenceMatcher(None, text, b).ratio(), same.ratio(b, None, front, 0, 0, low)
                assert got == want if want > low else got is None or got == want


def test_variants_come_back_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(PB, "LETTERS", 1000)
    df = spark.createDataFrame([(i, "Soldiers killed a civilian in Mora. " * 9) for i in range(40)], "event_id int, notes string").coalesce(1)
    got = PB.valid_variants(df)
    assert got.groupBy("event_id").agg(F.max("pert_idx") + 1 == F.count("*")).distinct().collect()[0][1]
    assert got.where("event_id = 0").select("pert_idx", "text").sort("pert_idx").collect() == got.where("event_id = 39").select("pert_idx", "text").sort("pert_idx").collect()


def test_texts_stay_where_they_are_asked(spark):
    from tiltmeter.operators.scoring import score_variants

    def model():
        return lambda prompts: ['{"label": "%s", "confidence": 0.5}' % "VB"["killed" in p] for p in prompts]

    v = spark.createDataFrame([(1, 0, "They killed."), (1, 1, "They left."), (2, 0, None)], "event_id int, pert_idx int, text string")
    every, kept = (score_variants(v, {"a": model, "b": model}, keep=k) for k in (None, ["event_id", "pert_idx"]))
    assert every.columns == ["event_id", "pert_idx", "text", "model", "label", "confidence", "success"]
    assert sorted(map(str, every.drop("text").collect())) == sorted(map(str, kept.collect()))
    assert kept.count() == 6 and {r["label"] for r in kept.where("event_id = 1").collect()} == {"V", "B"}
