import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from llm_odd import CLASH

from tiltmeter.llm import language_id as L
from tiltmeter.llm.common import mix64

SYLLABLES = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ein"], "cc": ["ção", "nh", "eira"], "dd": ["да", "не", "ть"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) + rng.choice(["", "", ",", ". 12"]) for _ in range(n))


def rows(seed=0, n=240):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(["aa", "aa", "aa", "bb", "cc", "dd"])
        out.append((i, text(rng, lang, rng.choice([3, 20, 200])), lang))
    return out


def frame(spark, made):
    from pyspark.sql import functions as F
    return spark.createDataFrame(made, "doc_id bigint, text string, lang string").repartition(3).withColumns({c: F.lit(0) for c in CLASH + ["bucket", "docs", "far", "center"]})


def naive(value, buckets):
    """Counts of n-grams, one character after the other."""
    out = np.zeros(buckets)
    for w in value.encode().split():
        w = "".join(c for c in w.decode().lower() if c.isalpha())
        for size in L.GRAMS if w else ():
            marked = w if size == 1 else f" {w} "
            for k in range(len(marked) - size + 1):
                h = np.full(1, size, np.uint64)
                for c in marked[k:k + size]:
                    h = h * np.uint64(0x100000001B3) + np.uint64(ord(c))
                out[int((mix64(h) % np.uint64(buckets))[0])] += 1
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab é Д.1\n", max_size=30), max_size=5))
def test_counts(texts):
    got = {at + k: r for at, n in L.counted(pa.array(texts, pa.string()), 64) for k, r in enumerate(n)}
    for k, t in enumerate(texts):
        assert (got[k] == naive(t, 64)).all()


def test_every_step_by_brute_force(spark):
    """Document frequencies over all that may be learned, and nearest centroids by plain cosine."""
    made = rows()
    model = L.fit(frame(spark, made), buckets=256)
    learn = [t for i, t, _ in made if zlib.crc32(str(i).encode()) % 5]
    docs = sum((naive(t, 256) > 0).astype(int) for t in learn)
    assert np.allclose(model.idf, np.log((1 + len(learn)) / (1 + docs)) + 1, rtol=1e-5)
    assert set(model.language) == set(SYLLABLES) and max(Counter(model.language).values()) > 1
    for r in L.language_of(frame(spark, made), model).collect():
        v = np.sqrt(naive(made[r.doc_id][1], 256)) * model.idf
        cosine = v @ model.centroids / np.linalg.norm(v)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.lang_pred == model.language[cosine.argmax()] and abs(r.score - cosine.max()) < 1e-4
        assert r.rejected == (1 - r.score > model.limit[cosine.argmax()]) and r.lang_sure == ("und" if r.rejected else r.lang_pred)
        assert r.lang_pred == made[r.doc_id][2]


def test_held_out_rows_are_not_learned_from(spark):
    made = rows()
    other = [(i, t, lang) if zlib.crc32(str(i).encode()) % 5 else (i, "qqq www", "zz") for i, t, lang in made]
    a, b = (L.fit(frame(spark, x)) for x in (made, other))
    assert a.language == b.language and np.array_equal(a.idf, b.idf) and np.array_equal(a.centroids, b.centroids) and np.array_equal(a.limit, b.limit)


def test_far_texts_are_rejected(spark):
    model = L.fit(frame(spark, rows()))
    odd = [(1, "xyzzy qwv jjx " * 20, None), (2, "これは日本語です", None), (3, text(random.Random(9), "dd", 100), None)]
    got = {r.doc_id: r for r in L.language_of(frame(spark, odd), model).collect()}
    assert [got[i].rejected for i in (1, 2, 3)] == [True, True, False]
    assert got[1].lang_sure == got[2].lang_sure == "und" and got[1].lang_pred in SYLLABLES and got[3].lang_sure == "dd"


def test_clusters():
    rng = np.random.default_rng(0)
    base = np.eye(8, dtype=np.float32)[[0, 2, 5]]
    x = np.repeat(base, 40, axis=0) + 0.05 * rng.random((120, 8), np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centers, own = L.cluster(x, 3, 1)
    assert len({tuple(own[k:k + 40]) for k in (0, 40, 80)}) == 3 and all(len(set(own[k:k + 40])) == 1 for k in (0, 40, 80))
    assert (own == (x @ centers.T).argmax(axis=1)).all()
    same, own = L.cluster(np.repeat(base[:1], 5, axis=0), 4, 1)
    assert len(same) == 1 and not own.any()


def test_odd_rows(spark):
    made = rows() + [(1, rows()[1][1], "aa")] * 400 + [(None, "sch ung ein", "bb"), (5001, None, "aa"), (5002, "", "aa"), (5003, "12 ?! \n", "bb"), (5004, "ка" * 50_000, None),
                                                       (5005, "x", None), (5006, "alone", "ee")]
    model = L.fit(frame(spark, made))
    got = L.language_of(frame(spark, made), model).collect()
    assert len(got) == len(made)
    by = {r.doc_id: r for r in got}
    assert {by[i].lang_pred for i in (5001, 5002, 5003)} == {"und"} and all(by[i].score == 0 and by[i].rejected for i in (5001, 5002, 5003))
    assert by[5004].lang_pred == "dd" and by[5005].lang_pred in model.language and by[None].lang_pred == "bb" and not by[None].held_out
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 1}) == 1
    assert all(0 <= r.score <= 1 for r in got)


def test_empty_table_and_no_labels(spark):
    model = L.fit(frame(spark, []))
    assert L.language_of(frame(spark, []), model).count() == 0
    unlabelled = frame(spark, [(1, "some words", None), (2, None, None)])
    assert {(r.lang_pred, r.score, r.rejected) for r in L.language_of(unlabelled, L.fit(unlabelled)).collect()} == {("und", 0.0, True)}


def test_too_many_labels(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError):
        L.fit(frame(spark, rows()))


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_query_is_right_on_held_out_rows(spark, sf):
    from tiltmeter.llm.queries import queries
    made = queries()["op12_language_id"](spark, f"/root/testdata/{sf}").join(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), "doc_id").collect()
    held = [r for r in made if r.held_out]
    assert len(held) > 150 and np.mean([r.lang_pred == r.lang for r in held]) >= 0.98
