import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from llm_odd import components, documents, empty, frame, prose, shingles

from tiltmeter.llm import near_duplicates as N
from tiltmeter.llm.components import connected


def unique(rows):
    return list(dict(rows).items())


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("size", [2, 5])
def test_equals_all_pairs(spark, size):
    rows = [r for r in unique(documents()) if len(r[1] or "") < 20_000]
    out = N.near_duplicates(frame(spark, rows), shingle_words=size)
    got = result(out)
    assert got == components(rows, size)
    assert {r.doc_id for r in out.collect() if r.kept} == {i for i, (_, c) in got.items() if i == c}


def test_groups_and_chains(spark):
    """Near copies of near copies, whose ends are not alike, and groups around one text."""
    rng = random.Random(8)
    rows, base = [], prose(rng, 120).split(" ")
    for i in range(40):  # a chain: each has one more word changed than the one before
        words = list(base)
        for k in range(i):
            words[3 * k] = f"new{k}"
        rows.append((1000 - i, " ".join(words)))
    for i in range(60):  # a star: each has a few words changed
        words = list(base[::-1])
        for k in rng.sample(range(len(words)), rng.randint(0, 5)):
            words[k] = f"x{rng.random()}"
        rows.append((2000 + i, " ".join(words)))
    assert result(N.near_duplicates(frame(spark, rows), shingle_words=2)) == components(rows, 2)


def test_small_blocks(spark):
    """Buckets that are compared in several blocks, with many components in each."""
    rng = random.Random(5)
    base = prose(rng, 60).split(" ")
    rows = []
    for i in range(120):
        words = list(base)
        for k in rng.sample(range(len(words)), rng.choice([0, 1, 2, 3, 4, 6, 8, 9])):
            words[k] = rng.choice(["p", "q", "r"]) + str(rng.randrange(4))
        rows.append((rng.randrange(10 ** 6), " ".join(words)))
    rows = unique(rows)
    assert result(N.near_duplicates(frame(spark, rows), shingle_words=2, block=7)) == components(rows, 2)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (None, "one"), (None, "alone here"), (7, "É a"), (8, "é a"), (9, "one one"), (10, "one")]
    rows += [(11, "w " * 200_000), (12, "w w"), (12, "w w")]
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(frame(spark, rows), shingle_words=2).collect()}
    assert got == {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (None, 1, 4, False), (None, 1, None, True),
                   (7, 1, 7, True), (8, 1, 8, True), (9, 1, 9, True), (10, 1, 4, False), (11, 1, 11, True), (12, 1, 11, False)}


def test_empty_table(spark):
    assert N.near_duplicates(empty(spark)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "B", "b", "c"]), max_size=8), min_size=1, max_size=6), st.integers(1, 5))
def test_sets(texts, size):
    joined = [" ".join(t) for t in texts]
    sets, offsets = N.shingle_sets(pa.array(joined), size)
    for k, t in enumerate(joined):
        assert offsets[k + 1] - offsets[k] == len(shingles(t, size))


def test_min_and_max_both_estimate_similarity():
    rng = np.random.default_rng(2)
    both, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (800, 100, 100))
    sets = [np.concatenate([both, a]), np.concatenate([both, b])]
    s = N.signatures(np.concatenate(sets), np.array([0, 900, 1800]), 400)
    same = s[0] == s[1]
    assert abs(same[0::2].mean() - 0.8) < 0.07 and abs(same[1::2].mean() - 0.8) < 0.07


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a bigint, b bigint"), "bigint").collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}
