import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from llm_odd import documents, empty, frame, prose

from tiltmeter.llm import periodic_runs as P


def brute(words, exponent=4, length=6):
    """(start, length, period) of every maximal run, by comparing each word with the one a period on."""
    out, seen = [], set()
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            k = i
            while k + q < len(words) and words[k] == words[k + q]:
                k += 1
            n = k - i + q
            if n >= max(length, exponent * q) and (i, n) not in seen:  # a stretch found before has a smaller period
                seen.add((i, n))
                out.append((i, n, q))
            i = k + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def numbered(texts):
    codes = {}
    flat = np.array([codes.setdefault((d, w), len(codes)) for d, t in enumerate(texts) for w in t], np.int64)
    return flat, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def check(texts, **limits):
    got = P.text_runs(*numbered(texts), **limits)
    want = [(d, *r) for d, t in enumerate(texts) for r in brute(t, **limits)]
    assert [tuple(r) for r in got.tolist()] == want


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60), max_size=4))
def test_two_letters(texts):
    check(texts)


#: A few words said several times, some of them inside each other.
piece = st.recursive(st.lists(st.sampled_from("abcd"), min_size=1, max_size=5),
                     lambda inner: st.one_of(st.tuples(inner, st.integers(1, 7)).map(lambda x: x[0] * x[1]), st.tuples(inner, inner).map(lambda x: x[0] + x[1])), max_leaves=8)


@settings(max_examples=400, deadline=None)
@given(st.lists(piece, max_size=5), st.integers(4, 6), st.integers(1, 9))
def test_repeated_pieces(texts, exponent, length):
    check([t[:400] for t in texts], exponent=exponent, length=length)


def test_long_texts():
    rng = random.Random(3)
    period = [rng.choice("abc") for _ in range(90)]
    texts = [["a"] * 5000, ["a", "b"] * 3001 + ["a"], period * 41 + period[:17], (["x"] * 7 + ["y"]) * 500, [rng.choice("ab") for _ in range(4000)]]
    fibonacci = ["a"], ["a", "b"]
    while len(fibonacci[1]) < 3000:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    texts += [fibonacci[1], [bin(i).count("1") % 2 for i in range(3000)], [w for i in range(300) for w in [f"w{i}"] + ["same", "line", "again"] * (i % 6)]]
    check(texts)


def test_grammar_derives_every_place():
    """A rule stands for the same words wherever it is derived, and every place between two words is the middle of one rule."""
    rng = random.Random(4)
    texts = [[rng.choice("abcde") for _ in range(300)] * 2, ["z"] * 33, [], ["one"]]
    words, offsets = numbered(texts)
    g = P.re_pair(words, offsets, 2)
    middles = []
    for rule, at in zip(g.place_rule.tolist(), g.place_at.tolist()):
        n = g.length[rule]
        assert words[at:at + n].tolist() == words[g.at[rule]:g.at[rule] + n].tolist()
        middles.append(at + g.left[rule])
    assert sorted(middles) == sorted(set(range(1, len(words))) - set(offsets.tolist()))
    assert len(g.at) < len(middles)


def test_whole_texts(spark):
    rows = [r for r in documents() if len(r[1] or "") < 20_000]
    rows += [(200 + i, prose(random.Random(i), 8) + " " + "so it goes " * i + "end") for i in range(8)]
    df = frame(spark, rows)
    got = df.select("doc_id", "text", P.periodic_runs("text").alias("r")).collect()
    assert len(got) == len(rows)
    for r in got:
        words = (r.text or "").encode().split()
        runs = brute(words)
        assert [tuple(x) for x in r.r.runs] == runs
        assert r.r.collapsed.encode() == b" ".join(w.encode() for w in collapsed([w.decode() for w in words], runs).split(" ") if w)


def rewritten(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text):
    words = rewritten(doc_id, text)
    runs = brute(words)
    best = min(runs, key=lambda r: (-(r[1] / r[2]), r[0], r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed(words, runs)))


def report(df):
    from pyspark.sql import functions as F
    return sorted(map(tuple, P.run_report(df, text=P.repeated_tail(F.col("text"), F.col("doc_id"))).collect()), key=str)


def test_report_equals_brute_force(spark):
    rows = [r for r in documents(7, 200) if len(r[1] or "") < 20_000] + [(None, "a b " * 5), (None, None), (10 ** 12, "x " * 9)]
    got = report(frame(spark, rows))
    assert got == sorted((expected(*r) for r in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 10


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, sf):
    from tiltmeter.llm.queries import queries
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").filter("length(text) < 12000").collect()]
    got = {r[0]: tuple(r) for r in queries()["op13_periodic_runs"](spark, f"/root/testdata/{sf}").collect()}
    for i, t in rows:
        assert got[i] == expected(i, t)


def test_empty_table(spark):
    assert report(empty(spark)) == []
