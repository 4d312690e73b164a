import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from llm_odd import CLASH

from tiltmeter.llm import source_divergence as D

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def found(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(rows, least, top=50):
    """Every group against every kept term, with Python integers."""
    docs, groups, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        w = found(text)
        docs[lang or ""].update(set(w))
        groups[lang or "", source or ""].update(w)
        langs[lang or ""].update(w)
    out = []
    for (lang, source), counts in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def p(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10 ** 9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}
        own, whole = p(counts), p(langs[lang])
        pairs = [(s, sum(abs(own[t] - q) for t, q in p(c).items())) for (other, s), c in groups.items() if other == lang and s != source]
        terms = [(t, own[t] - whole[t]) for t in kept if counts[t] and own[t] > whole[t]]
        for part, items in (("pair", pairs), ("term", terms)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(ranked) if part == "pair" or k < top]
    return sorted(out)


def frame(spark, rows, extra=False):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    return df.withColumns({c: F.lit(0) for c in CLASH + ["term", "total", "block", "number", "rank", "value", "item"]}) if extra else df


def result(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, df.collect()))


def rows(seed, n, n_sources):
    rng = random.Random(seed)
    words = ["the", "The", "of", "café", "É", "é", "naïve", "x1y", "日本", "a", "b_c", "d-e", "ß"] + [f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(60)]
    out = []
    for i in range(n):
        lang = rng.choice(["en", "en", "en", "fr", None, ""])
        source = "hot" if i % 3 == 0 else rng.choice([f"s{k}" for k in range(n_sources)] + [None, "ü", "Z"])
        favourites = words[hash_of(source) % 40:][:12]
        out.append((lang, source, rng.choice([" ", "\n", ", ", "|", "\0"]).join(rng.choices(words + 3 * favourites, k=rng.randint(0, 40)))))
    return out + [("de", "only", "ein Wort"), ("nl", "none", None), ("nl", "other", "12 34"), ("en", "empty", ""), ("fr", None, None), ("en", "hot", "the " * 30_000)] + out[:5]


def hash_of(source):
    return sum((source or "").encode()) * 7


@pytest.mark.parametrize("block, tile, least", [(1 << 15, 8, 3), (7, 2, 2), (1, 1, 5), (20, 3, 10 ** 6)])
def test_equals_dense_shares(spark, block, tile, least):
    made = rows(block, 300, 9)
    got = result(D.divergence(frame(spark, made, extra=True), least_docs=least, block=block, tile=tile, top_terms=6))
    assert got == brute(made, least, 6)
    assert {r[2] for r in got} == ({"pair"} if least > 10 ** 5 else {"pair", "term"})


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(0, 200), max_size=80), st.sets(st.integers(0, 200), max_size=80))
def test_galloping(a, b):
    a, b = np.array(sorted(a), np.int64), np.array(sorted(b), np.int64)
    where = {x: k for k, x in enumerate(b.tolist())}
    assert D.gallop(a, b).tolist() == [where.get(x, -1) for x in a.tolist()]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 30), st.integers(1, 10 ** 6), max_size=20), st.dictionaries(st.integers(0, 30), st.integers(1, 10 ** 6), max_size=20),
       st.integers(1, 9), st.integers(1, 9))
def test_merge_prices_each_term_once(a, b, a_none, b_none):
    arrays = [(np.array(sorted(x), np.int64), np.array([x[k] for k in sorted(x)], np.int64)) for x in (a, b)]
    want = sum(abs(a.get(t, a_none) - b.get(t, b_none)) for t in a.keys() | b.keys())
    assert D.merge_price(*arrays[0], a_none, *arrays[1], b_none) == (want, len(a.keys() | b.keys()))


def test_shares_of_large_counts(spark):
    from pyspark.sql import functions as F
    cases = [(0, 0, 1), (5, 5, 1), (10 ** 14, 3 * 10 ** 14 + 1, 10 ** 9), (7, 10 ** 16, 3), (10 ** 15 - 1, 10 ** 15, 10 ** 6 + 3)]
    want = [1 + 10 ** 9 * (c + 5) // (n + 5 * v) for c, n, v in cases]
    assert [int(D.shares(np.array([c]), n + 5 * v)[0]) for c, n, v in cases] == want
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, c bigint, n bigint, v bigint")
    assert [r.p for r in df.withColumn("p", D.share(F.col("c"), F.col("n"), F.col("v"))).orderBy("k").collect()] == want


def test_terms():
    texts = ["Ab-cD É\0x", None, "", "ÀB c1d", "日本 a"]
    flat, offsets = D.terms(pa.array(texts))
    assert [flat[int(a):int(b)].to_pylist() for a, b in zip(offsets, offsets[1:])] == [found(t) for t in texts]


def test_counts_are_let_go_in_between(spark, monkeypatch):
    made = rows(5, 120, 4)
    want = brute(made, 2)
    monkeypatch.setattr(D, "MERGED", 20)
    monkeypatch.setattr(D, "SLICE", 100)
    batch = pa.RecordBatch.from_pylist([{"lang": a or "", "source": b or "", "text": c or ""} for a, b, c in made])
    total = Counter()
    for b in D._task_counts([batch]):
        for r in b.to_pylist():
            total[r["lang"], r["source"], r["term"]] += r["n"]
    assert {k: n for k, n in total.items() if k[2]} == dict(Counter((a or "", b or "", t) for a, b, c in made for t in found(c)))
    assert want


def test_empty_table(spark):
    assert result(D.divergence(frame(spark, []))) == []
