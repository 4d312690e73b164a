import random
import zlib

import numpy as np
import pyarrow as pa
from llm_odd import empty, frame, prose
from pyspark.sql import functions as F

from tiltmeter.llm import classifier as C
from tiltmeter.llm.common import word_hashes, word_slices


def corpus(n=240):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(n):
        t, good = prose(rng, rng.randint(20, 150)), rng.random() < 0.75
        if not good:
            t = rng.choice([t.upper().replace(" ", "!! "), " ".join(f"{w}$$$" for w in t.split()), " ".join([t.split()[0]] * 60)])
        rows.append((i, t))
        labels.append((i, int(good)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    df, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int")
    model = C.fit(df, marks)
    got = C.classify(df, model).collect()
    known = dict(labels)
    assert model.trained_on == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, _ in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == known[r.doc_id] for r in held]) >= 0.95


def test_score_is_the_mean_of_vectors_and_a_softmax(spark):
    rows, labels = corpus(60)
    df = frame(spark, rows)
    model = C.fit(df, spark.createDataFrame(labels, "doc_id bigint, quality int"))
    scores = {r.doc_id: r.score for r in df.select("doc_id", C.score(model, "text").alias("score")).collect()}
    for i, t in rows[:10]:
        for _, _, codes, distinct, offsets in word_slices(pa.array([t])):
            hashes = word_hashes(distinct)
            flat, many = C.word_features(distinct, hashes)
            first = np.cumsum(many) - many
            pairs, _ = C.pair_features(codes, hashes, offsets)
            features = np.concatenate([flat[first[c]:first[c] + many[c]] for c in codes] + [pairs])
        z = model.vectors[features].mean(axis=0).astype(float) @ model.out.astype(float) + model.bias
        assert abs(np.exp(z[1]) / np.exp(z).sum() - scores[i]) < 1e-4


def test_character_grams():
    distinct = pa.array(["ab", "é"])
    flat, many = C.word_features(distinct, word_hashes(distinct))
    # <ab>: word, <ab ab> (3), <ab> (4); <é>: word, <é> (3)
    assert many.tolist() == [4, 2] and len(flat) == 6


def test_held_out_labels_are_never_read(spark):
    rows, labels = corpus(80)
    df = frame(spark, rows)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels]
    a, b = (C.fit(df, spark.createDataFrame(x, "doc_id bigint, quality int")) for x in (labels, flipped))
    assert np.array_equal(a.vectors, b.vectors) and np.array_equal(a.out, b.out)


def test_odd_rows(spark):
    rows, labels = corpus(40)
    rows += [(None, "a text"), (900, None), (901, ""), (902, " \n"), (903, "x " * 100_000), (903, "x " * 100_000), (904, "日本語 🙂")]
    marks = spark.createDataFrame(labels + [(None, 1), (900, None), (901, 7), (0, 1), (0, 1)], "doc_id bigint, quality int").withColumns({"key": F.lit(1), "label": F.lit(2)})
    df = frame(spark, rows)
    got = C.classify(df, C.fit(df, marks)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    blank = {r.score for r in got if r.doc_id in (900, 901, 902)}
    assert len(blank) == 1
    assert [r.held_out for r in got if r.doc_id is None] == [False]


def test_without_rows_or_labels(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    model = C.fit(empty(spark), none)
    assert C.classify(empty(spark), model).count() == 0
    assert {r.score for r in C.classify(frame(spark, [(1, "a b"), (2, None)]), model).collect()} == {0.5}
