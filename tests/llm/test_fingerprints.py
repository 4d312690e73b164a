import hashlib
import random
import re

import pytest
from llm_odd import documents, empty, frame, prose

from tiltmeter.llm import fingerprints as G


def paragraphs(text):
    return {p.rstrip(" ") for p in re.findall(r"(?a)[^\n]{30,}?(?:(?<=[.!?])|(?<=\S{14}))\s+|[^\n]+", text)}


def near(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check(spark, rows):
    """Rows with unique ids."""
    docs = sorted(((i, t or "") for i, t in rows), reverse=True)
    got = {r.doc_id: r for r in G.fingerprints(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + following[:half]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(near(paragraphs(t), paragraphs(edited))), i
        assert r.near_next == pytest.approx(near(paragraphs(t), paragraphs(following))), i
    by_text = {}
    for i, t in docs:
        assert by_text.setdefault(t, got[i].fingerprint) == got[i].fingerprint
    return got


def test_documents(spark):
    check(spark, [r for r in dict(documents()).items()])


def test_neighbours_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(G, "ROWS_PER_BUCKET", 3)
    monkeypatch.setattr(G, "COARSE", 4)
    rng = random.Random(6)
    ids = rng.sample(range(-50, 50), 40) + [10 ** 12 + k for k in range(5)] + [-(10 ** 15)]
    check(spark, [(i, prose(rng, rng.randint(1, 30))) for i in ids])


def test_retries_and_the_last_resort(spark, monkeypatch):
    """With sketches that are too small at first, and with hardly a step to peel them, likeness stays exact."""
    rows = [(i, prose(random.Random(i), 150)) for i in range(12)]
    monkeypatch.setattr(G, "ATTEMPTS", ((2, 1), (6, 8), (6, 64)))
    check(spark, rows)
    monkeypatch.setattr(G, "ATTEMPTS", ((1, 1), (1, 8)))
    check(spark, rows)


def test_small_tables(spark):
    assert check(spark, [(1, "One. Two. Three. Four.")])[1].near_next == 1.0
    check(spark, [(1, None), (2, "")])
    check(spark, [(3, "x"), (4, "y. z. " * 30_000)])
    assert G.fingerprints(empty(spark)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a. b. c."), (1, "a. b. c."), (None, "q. r."), (None, "s."), (2, "b. c.")]
    got = G.fingerprints(frame(spark, rows)).collect()
    assert len(got) == 5 and all(0 <= r.near_next <= 1 for r in got)
    assert len({r.fingerprint for r in got if r.doc_id == 1}) == 1


def test_main_path_is_native(spark):
    plan = G.fingerprints(frame(spark, [(1, "a")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Cartesian", plan)
