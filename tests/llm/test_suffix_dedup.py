import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from llm_odd import CLASH, documents, empty, frame, removed

from tiltmeter.llm import suffix_dedup as S


def check(spark, rows, **options):
    want = removed(rows)
    got = S.remove_repeats(frame(spark, rows), **options)
    assert set(CLASH) < set(got.columns)
    got = got.collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r.repeats) == want[r.doc_id][:4], r.doc_id
        assert r.text == want[r.doc_id][4].decode("utf-8", "ignore")


def patchwork(seed, n=70):
    """Texts from random letters, shared passages around the length limit, and periodic runs."""
    rng = random.Random(seed)
    noise = lambda k: "".join(rng.choice("abé \n") for _ in range(k))
    passages = [noise(k) for k in (99, 100, 101, 130, 180, 300)]
    rows = [(i, "".join(rng.choice([noise(rng.randint(0, 200)), rng.choice(passages), "xy" * rng.randint(0, 120)]) for _ in range(rng.randint(0, 5)))) for i in range(n)]
    rows += [(n + i, rows[rng.randrange(n)][1]) for i in range(6)]
    for i in range(6):
        t = rows[rng.randrange(n)][1]
        rows.append((n + 10 + i, t[:len(t) // 2] + "Q" + t[len(t) // 2:]))
    return rows


@pytest.mark.parametrize("hot", [S.HOT, 3])
def test_equals_brute_force(spark, hot):
    check(spark, patchwork(hot), hot=hot)


def test_documents(spark):
    rows = list(dict(documents()).items())
    check(spark, rows)


def test_odd_rows(spark):
    long = "".join(random.Random(1).choices("abcdefgh ", k=300))
    rows = [(5, long), (5, long), (None, long), (6, None), (7, ""), (8, long[:99]), (9, long[50:150] + "!"), (10, "z" * 1000)]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.repeats.n_removed, r.repeats.n_spans, len(r.text)) for r in S.remove_repeats(frame(spark, rows)).collect())
    # the null id sorts first, so both rows of id 5 repeat it; a run of one letter repeats itself from its second place on
    assert got == [(-1, 0, 0, 300), (5, 300, 1, 0), (5, 300, 1, 0), (6, 0, 0, 0), (7, 0, 0, 0), (8, 0, 0, 99), (9, 100, 1, 1), (10, 999, 1, 1)]


def test_equal_rows_do_not_repeat_each_other(spark):
    long = "".join(random.Random(2).choices("abcdefgh ", k=300))
    got = [tuple(r.repeats)[:3] for r in S.remove_repeats(frame(spark, [(5, long), (5, long)])).collect()]
    assert got == [(300, 0, 0)] * 2


def test_empty_table(spark):
    out = S.remove_repeats(empty(spark))
    assert out.count() == 0 and out.columns[:2] == ["doc_id", "text"]


def test_stretches_of_long_texts_find_the_same_anchors():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    offsets = np.array([0, 4000, 5000])
    whole = sorted(zip(*[x.tolist() for x in S.anchors(data, offsets)[1:5:2]]))
    parts = set()
    for first, many, a, b in S._stretches(offsets, 100, limit=500, stretch=700):
        inside = offsets[first:first + many + 1] - a if many > 1 else np.array([0, b - a])
        d, g, _, begin, lead, more = S.anchors(data[a:b], inside)
        base = a - offsets[first] if many == 1 else 0
        parts |= {(int(first + x), int(y + base + k)) for x, y, n in zip(d, begin, more) for k in range(n + 1)}
    assert parts == {(0, k) for k in range(3901)} | {(1, k) for k in range(901)} and whole


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.binary(min_size=0, max_size=9).map(lambda b: bytes(97 + x % 2 for x in b))), min_size=1, max_size=25))
def test_suffix_order_and_extensions(items):
    items.sort(key=lambda x: x[0])
    raw = [b for _, b in items]
    sizes = np.array([len(b) for b in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    s = S.Suffixes(data, np.array([g for g, _ in items]), np.cumsum(sizes) - sizes, sizes)
    order, ext = s.sorted_extensions()
    want_order, want_ext = s.plain()
    assert order.tolist() == want_order.tolist() and ext.tolist() == want_ext.tolist()


def test_a_lying_hash_is_noticed(monkeypatch):
    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    start = np.arange(0, 400, 20)
    s = S.Suffixes(data, np.zeros(20, np.int64), start, np.full(20, 20))
    want = s.plain()
    monkeypatch.setattr(S.Prefix, "hashes", lambda self, start, length: np.zeros(len(start), np.uint64))
    got = s.sorted_extensions()
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()
