"""Text operators against plain Python, accents included."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tiltmeter.functions import annotate as AN, fluency as FL, perturbation_rules as R, prompts as P, rationale as RA, responses as RS, text_patterns as TP
from tiltmeter.functions import actors as A, labels as L
from tiltmeter.operators import perturb as PB, trace as T

PARTS = ["On Monday, military forces killed 3 civilians in Bamenda.", "Police beat and arrested protesters (Mora, Far North) later.",
         "étwo people éwere shot by unknown gunmen", "The army said that soldiers CLASHED with fighters,", "State forces attacked; state forces fled.",
         "According to state media, five were injured.", "Residents noted that nothing happened after nine.", "no group has claimed the attack",
         "dozens of people killed", "they opened fire\non the crowd", "It was reportedly burnt;", "Überfall in Douala Village town", "kİlled", "()"]


def texts(n=120):
    rnd = random.Random(5)
    return [" ".join(rnd.sample(PARTS, rnd.randint(1, 6))) for _ in range(n)] + ["", "a", "Short."]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(list(enumerate(texts())), "event_id int, notes string").repartition(4).cache()


def find(p, s, flags=re.I):
    return re.search(p, s, flags) is not None


def made(text):
    """Variants per generator, straight from the rules."""
    low = text.lower()
    cap = low.capitalize()
    out = {g: [] for g in PB.GENERATORS}

    def add(g, t):
        if t != text:
            out[g].append(t)

    for g, table in (("actor", R.ACTORS), ("action", R.ACTIONS)):
        for w, swaps in table.items():
            for s in swaps:
                if w in low:
                    add(g, re.sub(rf"\b{w}\b", s, text, flags=re.I))
    for mods in R.INTENSITY.values():
        for m in mods:
            for v in R.INTENSITY_VERBS:
                if v in low:
                    add("intensity", re.sub(rf"\b({v})", f"{m} {v}", text, count=1, flags=re.I))
    for w, b in R.NEGATION.items():
        if w in low:
            add("negation", re.sub(rf"\b({w})", f"did not {b}", text, count=1, flags=re.I))
    for p in R.SUFFICIENCY:
        m = re.search(p, text, re.I)
        if m:
            out["sufficiency"].append(m.group(0))
    add("legitimation", text.rstrip(".!?") + " to restore order.")
    for p in R.DELEGITIMIZING:
        add("legitimation", f"{p.capitalize()}, {cap}")
    out["provenance"] += [f"{s} {cap}" for s in R.SOURCES]
    for s in R.SOURCES:
        if s.lower() in low:
            add("provenance", re.sub(rf"^{re.escape(s)}\s*", "", text, flags=re.I))
    for place in R.PLACES:
        for p in R.PLACE_PATTERNS:
            m = re.search(p, text)
            if m:
                add("decontextualization", text[:m.start()] + place + text[m.end():])
                break
    for family in (R.REPORTING_VERBS, R.WEEKDAYS, R.CONNECTIVES, R.NUMERALS):
        for w, s in family.items():
            if find(rf"\b{w}\b", text):
                add("control", re.sub(rf"\b{w}\b", s, text, count=1, flags=re.I))
                break
    return out


def fluency(t):
    s = 1.0
    s -= 0.3 if not t or len(t.strip()) < 10 else 0
    s -= 0.1 if t and not t[0].isupper() else 0
    s -= 0.1 if t and t[-1] not in ".!?" else 0
    s -= 0.2 if "  " in t else 0
    s -= 0.2 if t.count("(") != t.count(")") else 0
    return max(0.0, s)


def skip(t):
    return "İ" in t  # lower-cases to two characters in Python only


def test_generators(spark, frame):
    got = {}
    for r in PB.explode_variants(frame).collect():
        got.setdefault((r["event_id"], r["generator"]), []).append((r["gen_idx"], r["text"]))
    for i, t in enumerate(texts()):
        if skip(t):
            continue
        for g, want in made(t).items():
            assert [x for _, x in sorted(got.get((i, g), []))] == want, (t, g)


def test_valid_variants(spark, frame):
    got = {}
    for r in PB.valid_variants(frame).collect():
        got.setdefault(r["event_id"], []).append((r["pert_idx"], r["generator"], r["text"], r["edit_distance_ratio"], r["fluency_score"]))
    for i, t in enumerate(texts()):
        if skip(t):
            continue
        want = []
        for g, variants in made(t).items():
            ok = [(g, v, SequenceMatcher(None, t, v).ratio(), fluency(v)) for v in variants]
            want += [x for x in ok if 0.7 < x[2] < 1.0 and x[3] >= 0.7][:3]
        mine = sorted(got.get(i, []))
        assert [x[0] for x in mine] == list(range(len(want)))
        assert [x[1:] for x in mine] == [pytest.approx(w) if isinstance(w, float) else w for w in want]


def test_similarity_of_long_texts(spark):
    a = "".join(random.Random(1).choices("abcdefgh ", k=600))
    b = a[:300] + "xyz" + a[310:]
    df = spark.createDataFrame([(a, b), (b, a), ("", ""), ("a", "")], "a string, b string")
    got = [r[0] for r in df.select(FL.similarity("a", "b")).collect()]
    assert got == [SequenceMatcher(None, x, y).ratio() for x, y in ((a, b), (b, a), ("", ""), ("a", ""))]


def test_grammaticality(spark, frame):
    for r in frame.select("notes", FL.grammaticality(F.col("notes")).alias("f")).collect():
        assert r["f"] == pytest.approx(fluency(r["notes"])), r["notes"]


def test_annotations(spark, frame):
    rows = frame.select("notes", AN.verb_intensity(F.col("notes")).alias("verb"), AN.passive_voice(F.col("notes")).alias("voice"),
                        AN.casualties(F.lit(None).cast("int"), F.col("notes")).alias("cas"), AN.ambiguous_actor(F.col("notes"), F.lit(None).cast("string")).alias("amb"),
                        AN.provenance(F.lit(None).cast("string"), F.lit("Subnational"), F.col("notes")).alias("prov")).collect()
    for r in rows:
        t, low = r["notes"], r["notes"].lower()
        if skip(t):
            continue
        verb = next((k for k, ps in (("High", TP.HIGH_VERBS), ("Medium", TP.MEDIUM_VERBS), ("Low", TP.LOW_VERBS)) if any(find(p, low, 0) for p in ps)), "Unknown")
        assert r["verb"] == verb

        def n(ps):
            return sum(find(p, t) for p in ps)
        pas, act = n(TP.PASSIVE) + 1.5 * n(TP.AGENT_OBSCURING) + n(TP.PASSIVE_HEDGES) + n(TP.NOMINALIZATIONS), 1.5 * n(TP.ACTIVE)
        voice = ("Unknown" if not pas and not act else "Yes" if pas > 0 and not act else "No" if act > 0 and not pas else
                 "Yes" if pas > 1.5 * act else "No" if act > 1.5 * pas else "Mixed")
        assert r["voice"] == voice, t
        hit = next((m for m in (re.search(p, low) for p in TP.CASUALTIES) if m), None)
        num = re.search(r"\d+", hit.group()) if hit else None
        assert r["cas"] == ("No" if not hit else f"Yes ({num.group()})" if num else "Yes (unspecified)")
        k = sum(find(p, low, 0) for p in TP.AMBIGUOUS_ACTOR)
        assert r["amb"] == ("Unknown" if not t else "Yes" if k >= 2 else "Partial" if k else "No")
        state, intl = any(find(p, t) for p in TP.STATE_MEDIA), any(find(p, t) for p in TP.INTERNATIONAL_MEDIA)
        local = any(find(p, t) for p in TP.LOCAL_MEDIA)
        assert r["prov"] == ("State-affiliated" if state and not intl else "Independent-International" if intl else "Local/Community" if local else "Independent-National")


def test_annotate_fills_only_empty_cells(spark):
    df = spark.createDataFrame([(1, "They were killed.", "mine"), (2, "They were killed.", ""), (3, "They were killed.", None)], "event_id int, notes string, annotation_passive_voice string")
    raw = spark.createDataFrame([(1, 4.0), (2, float("nan")), (2, None)], "event_id int, fatalities double")
    got = {r["event_id"]: r for r in AN.annotate(df, raw).collect()}
    assert [got[i]["annotation_passive_voice"] for i in (1, 2, 3)] == ["mine", "Yes", "Yes"]
    assert got[1]["annotation_casualty_counts"] == "Yes (4)" and got[2]["annotation_casualty_counts"] == "No"


def test_label_and_actor_columns(spark):
    df = spark.createDataFrame([("  riots\n",), ("Violence against civilians",), ("v",), (None,), ("x",), ("BATTLES",)], "s string")
    assert [r[0] for r in df.select(L.clean_label("s")).collect()] == ["R", "V", "V", "ERROR", "ERROR", "B"]
    assert [r[0] for r in df.select(L.strict_label("s")).collect()] == ["INVALID", "INVALID", "V", "INVALID", "INVALID", "INVALID"]
    df = spark.createDataFrame([("Military Forces of Cameroon (1982-) Gendarmerie",), ("Kumba Communal Militia (Nigeria)",), ("ISWAP",), ("MNJTF: x",), (None,), ("Rioters (Nigeria)",)], "s string")
    assert [r[0] for r in df.select(A.normalize_actor("s")).collect()] == ["State forces (Cameroon)", "Communal Militia", "Boko Haram / ISWAP", "MNJTF", "Other Actors", "Protesters/Rioters/Civilians"]
    assert L.rename_legacy_columns(spark.createDataFrame([(1, 2)], "pred_x_x int, y int"), "x_x", "x").columns == ["pred_x", "y"]
    with pytest.raises(Exception, match="unsupported country"):
        spark.createDataFrame([("fra",)], "c string").select(L.country_name("c")).collect()


def test_rationale_comparison(spark):
    rows = [(["the police shot a man"], ["police shot man"], "police"), (["a b c"], ["x y z"], "Y "), (["same"], ["same", "more"], "more"), ([], ["x"], "x"), (["one"], ["two"], None)]
    df = spark.createDataFrame(rows, "b array<string>, a array<string>, w string")
    got = df.select(RA.rationale_changed(F.col("b"), F.col("a")), RA.mentions(F.col("a"), F.col("w"))).collect()
    assert [tuple(r) for r in got] == [(False, True), (True, True), (False, True), (False, True), (True, False)]


def words(tokens, scores):
    out = []
    for t, s in zip(tokens, scores):
        if t in RA.SPECIAL_TOKENS:
            continue
        if t.startswith("##") and out:
            out[-1] = (out[-1][0] + t[2:], out[-1][1] + s)
        else:
            out.append((t[2:] if t.startswith("##") else t.lstrip("Ġ▁"), s))
    return [(w, round(s, 6)) for w, s in sorted(out, key=lambda x: -abs(x[1])) if w]


def test_word_attributions_and_deltas(spark):
    rnd = random.Random(2)
    vocab = ["[CLS]", "[SEP]", "##ed", "##s", "kill", "▁army", "Ġthe", "the", "▁", "man", "<pad>"]
    rows = [(i, rnd.choices(vocab, k=rnd.randint(0, 14))) for i in range(60)]
    rows = [(i, t, [round(rnd.uniform(-1, 1), 4) for _ in t]) for i, t in rows]
    df = spark.createDataFrame(rows, "event_id int, tokens array<string>, scores array<double>")
    got = {r["event_id"]: [(w["word"], w["score"]) for w in r["words"]] for r in T.attribution_words(df).collect()}
    for i, t, s in rows:
        assert [w for w, _ in got[i]] == [w for w, _ in words(t, s)]
        assert [x for _, x in got[i]] == pytest.approx([x for _, x in words(t, s)], abs=1.1e-6)
    pairs = [(rows[i], rows[i + 1]) for i in range(0, 58, 2)]
    a = spark.createDataFrame([("m", b[0], p, *x[1:]) for b, c in pairs for p, x in ((-1, b), (0, c))], "model string, event_id int, pert_idx int, tokens array<string>, scores array<double>")
    f = spark.createDataFrame([("m", b[0], 0, "t", True) for b, _ in pairs], "model string, event_id int, pert_idx int, type string, label_flipped boolean")
    got = {r["event_id"]: {d["token"]: d["delta"] for d in r["top_delta"]} for r in T.attribution_deltas(f, a, 99).collect()}
    for b, c in pairs:
        before, after = dict(words(*b[1:])), dict(words(*c[1:]))
        want = {w: after.get(w, 0) - before.get(w, 0) for w in set(before) | set(after)}
        assert got[b[0]] == pytest.approx(want, abs=3e-6)


@pytest.mark.parametrize("raw,label,conf,found", [
    ('{"label": "V", "confidence": 0.9}', "V", 0.9, True), (' \n{"label": "B"}', "B", None, True), ('x {"label": "E", "confidence": 1} y', "E", 1.0, True),
    ('{"label": "P", "confidence": 0.3, "logits": {', "P", 0.3, True), ('"label":"R"', "R", 0.5, True), ("nothing", None, None, False), (None, None, None, False),
    ('see {"label": "riots", "confidence": 0.2} end', "riots", 0.2, True), ('{"label": "S"} and {"label": "V"}', "S", None, True)])
def test_parse_response(spark, raw, label, conf, found):
    r = spark.createDataFrame([(raw,)], "x string").select(RS.parse_response(F.col("x")).alias("r")).first()["r"]
    assert (r["label"], r["confidence"], r["found"]) == (label, conf, found)


@pytest.mark.parametrize("raw,strict,label,conf", [
    ('a {"label": "V", "x": {"y": 1}} b', True, "V", None), ('{"label": "Q", "confidence"', True, "ERROR", 0.0), ('"label": "Q" "confidence": .5', False, "Q", 0.5),
    ('"label": "V" "confidence": 0.7', True, "V", 0.7), ("", True, "ERROR", 0.0), ("[1]", False, None, None), (None, True, "ERROR", 0.0)])
def test_parse_balanced(spark, raw, strict, label, conf):
    r = spark.createDataFrame([(raw,)], "x string").select(RS.parse_balanced(F.col("x"), strict).alias("r")).first()["r"]
    assert (r["label"], r["confidence"]) == (label, conf)


def test_prompts(spark):
    few = P.strategy("few_shot", 2)
    block = P.example_block(2)
    assert block.count("Event: ") == 12 and '{"label": "V", "confidence": 0.89, "logits": {"V": 0.89, "B": 0.05, "E": 0.02, "P": 0.01, "R": 0.02, "S": 0.01}}' in block
    text = spark.range(1).select(few.prompt(F.lit("NOTE HERE")).alias("p")).first()["p"]
    assert text.startswith("Examples:\n\n    Event: Military") and text.endswith("Event: NOTE HERE\n    ")
    assert P.strategy("zero_shot").schema()["required"] == ["label", "confidence"]
    for bad in (("few_shot", 6), ("few_shot", 0), ("other", 1)):
        with pytest.raises(ValueError):
            P.strategy(*bad)


def test_training_records(spark):
    import json
    df = spark.createDataFrame([(1, ' A "quoted"\nnote\t é ', "Riots"), (2, "x", "Other"), (3, "  ", "V"), (4, None, "V"), (5, "ok", "V")], "event_id int, notes string, event_type string")
    rows = {r["event_id"]: r for r in P.training_records(df, "explainable", keep=("event_id",)).collect()}
    assert set(rows) == {1, 5}
    target = {"label": "R", "confidence": 1.0, "logits": {x: 1.0 if x == "R" else 0.0 for x in "VBEPRS"}, "reasoning": [
        "Actors: inferred from event text snippet 'A \"quoted\" note\t é'.", "Actions: identify core conflict behavior and event dynamics.",
        "Rationale: label R best matches violent crowd action."]}
    assert rows[1]["response"] == json.dumps(target, ensure_ascii=False)
    assert rows[1]["prompt"].startswith("### System\n") and rows[1]["prompt"].endswith("\n\n### Assistant\n")
    zero = P.training_records(df.where("event_id = 5"), "zero_shot").first()["response"]
    assert json.loads(zero) == {"label": "V", "confidence": 1.0, "logits": {x: 1.0 if x == "V" else 0.0 for x in "VBEPRS"}}
