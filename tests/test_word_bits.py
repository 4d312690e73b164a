"""The automaton over all words of the annotators against a search for each word, and annotations with and without it."""

import random

from pyspark.sql import functions as F

from tiltmeter.functions import annotate as AN


def texts():
    rnd = random.Random(3)
    words = [*AN._places(), "x", ".", "\n", "É", "Police Spokesman said", "were killed by", "unidentified gunmen", "İ"]
    rows = [" ".join(rnd.choices(words, k=rnd.randrange(12))) for _ in range(300)]
    rows += ["".join(rnd.choices(words, k=rnd.randrange(6))).upper() for _ in range(100)]
    return [(i, t, rnd.choice(["BBC", "", None]), rnd.choice(["National", None]), rnd.choice(["Unknown", "Army", None]), rnd.choice([None, 0, 3]))
            for i, t in enumerate([*rows, "", None, "a" * 100_000 + " police " + "é" * 100_000])]


def frame(spark):
    return spark.createDataFrame(texts(), "event_id int, notes string, source string, source_scale string, actor_norm string, fatalities int").repartition(5)


def test_every_word_has_its_bit(spark):
    places = AN._places()
    got = frame(spark).select(F.lower(F.coalesce("notes", F.lit(""))).alias("low"), AN.word_bits(F.col("notes")).alias("b")).collect()
    assert {len(r["b"]) for r in got} == {-(-len(places) // 63)}
    for r in got:
        assert {w for w, i in places.items() if r["b"][i // 63] >> i % 63 & 1} == {w for w in places if w in r["low"]}


def test_same_annotations_as_each_by_itself(spark):
    df = frame(spark)
    notes = F.col("notes")
    alone = {"annotation_provenance": AN.provenance(F.col("source"), F.col("source_scale"), notes), "annotation_ambiguous_actor": AN.ambiguous_actor(notes, F.col("actor_norm")),
             "annotation_verb_intensity": AN.verb_intensity(notes), "annotation_casualty_counts": AN.casualties(F.col("fatalities"), notes),
             "annotation_passive_voice": AN.passive_voice(notes)}
    want = {r["event_id"]: r.asDict() for r in df.select("event_id", *[v.alias(k) for k, v in alone.items()]).collect()}
    done = AN.annotate(df)
    assert done.columns == [*df.columns, *[c for c in AN.ANNOTATIONS if c in done.columns]]
    got = {r["event_id"]: {k: r[k] for k in ("event_id", *alone)} for r in done.collect()}
    assert got == want
    assert all(len({r[c] for r in want.values()}) > 1 for c in alone)


def test_no_rows(spark):
    assert AN.annotate(frame(spark).where("event_id < 0")).collect() == []


def test_filled_cells_stay(spark):
    df = frame(spark).withColumn("annotation_passive_voice", F.when(F.col("event_id") % 2 == 0, "kept"))
    got = AN.annotate(df)
    assert got.columns[:7] == df.columns
    assert all((r["annotation_passive_voice"] == "kept") == (r["event_id"] % 2 == 0) for r in got.collect())
