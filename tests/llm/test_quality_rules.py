from collections import Counter

from llm_odd import documents, empty, frame, split_words

from tiltmeter.llm.quality_rules import BANDS, quality_rules


def brute(text):
    w = split_words(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = set()
    for i in range(len(w) - 2):
        if windows[tuple(w[i:i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (text or "").encode().split(b"\n"):
        if line.split():
            dup += line in seen
            seen.add(line)
    return (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))


def compressed_well(text):
    import math

    import zstandard
    raw, c = (text or "").encode(), zstandard.ZstdCompressor(level=3)
    if not raw:
        return True
    points = BANDS.whole
    x = min(max(math.log2(len(raw)), points[0][0]), points[-1][0])
    k = max(i for i in range(len(points) - 1) if points[i][0] <= x)
    (x0, l0, h0), (x1, l1, h1) = points[k], points[k + 1]
    share = (x - x0) / (x1 - x0)
    whole = len(raw) / len(c.compress(raw))
    if not l0 + share * (l1 - l0) - 1e-9 <= whole <= h0 + share * (h1 - h0) + 1e-9:
        return False
    size = max((s for s, _, _ in BANDS.chunks if s <= len(raw)), default=0)
    if not size:
        return True
    each = [size / len(c.compress(raw[i:i + size])) for i in range(0, len(raw) - size + 1, size)]
    low, high = next((a, b) for s, a, b in BANDS.chunks if s == size)
    return low <= sum(each) / len(each) <= high


def test_counts_and_verdicts(spark):
    rows = documents() + [(900, "x y z\nx y z\n\n \nx y z #*$%&|<>"), (901, "loud loud loud " * 100), (902, "\x1c\x1f a b")]
    got = frame(spark, rows).select("doc_id", "text", quality_rules("text").alias("q")).collect()
    assert len(got) == len(rows)
    for r in got:
        q = r.q
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == brute(r.text), r.doc_id
        assert q.kept == (not q.base_failed and compressed_well(r.text)), r.doc_id


def test_repetitive_and_random_texts_go(spark):
    import base64
    import random
    rng = random.Random(3)
    noise = " ".join(base64.b64encode(rng.randbytes(15)).decode() for _ in range(200))
    menu = " ".join(f"{w} |" for w in "home news about contact terms privacy".split() for _ in range(60))
    got = {r.doc_id: r.kept for r in spark.createDataFrame([(1, noise), (2, menu), (3, None), (4, "")], "doc_id bigint, text string")
           .select("doc_id", quality_rules("text")["kept"].alias("kept")).collect()}
    assert got == {1: False, 2: False, 3: False, 4: False}


def test_long_text_is_judged_whole(spark):
    head = "alpha beta gamma delta " * 20
    text = " ".join(f"word{i}" for i in range(200_000))
    r = spark.createDataFrame([(1, text + " " + head)], "doc_id bigint, text string").select(quality_rules("text").alias("q")).first().q
    assert r.n_words == 200_080 and r.n_repeat_words == 80


def test_empty_table(spark):
    assert empty(spark).select(quality_rules("text").alias("q")).count() == 0


LICENCE = """Mozilla Public License Version 2.0
==================================

1. Definitions
--------------

1.1. "Contributor"
    means each individual or legal entity that creates, contributes to
    the creation of, or owns Covered Software.

1.2. "Contributor Version"
    means the combination of the Contributions of others (if any) used
    by a Contributor and that particular Contributor's Contribution.

1.3. "Contribution"
    means Covered Software of a particular Contributor.

1.4. "Covered Software"
    means Source Code Form to which the initial Contributor has attached
    the notice in Exhibit A, the Executable Form of such Source Code
    Form, and Modifications of such Source Code Form, in each case
    including portions thereof.

1.5. "Incompatible With Secondary Licenses"
    means

    (a) that the initial Contributor has attached the notice described
        in Exhibit B to the Covered Software; or

    (b) that the Covered Software was made available under the terms of"""


def test_real_prose_has_bands_of_its_own(spark):
    import base64
    import random

    import zstandard

    from tiltmeter.llm.quality_rules import REAL_PROSE, compression
    menu = " ".join(f"{w} |" for w in "home news about contact terms privacy".split() for _ in range(60))
    noise = base64.b64encode(random.Random(3).randbytes(900)).decode()
    noise = " ".join(noise[i:i + 20] for i in range(0, len(noise), 20))
    df = spark.createDataFrame([(1, LICENCE), (2, menu), (3, noise)], "doc_id bigint, text string")
    got = {r.doc_id: r.q for r in df.select("doc_id", quality_rules("text", REAL_PROSE)["kept"].alias("q")).collect()}
    assert got == {1: True, 2: False, 3: False}
    compress = zstandard.ZstdCompressor(level=3).compress
    assert [compression(compress, x.encode(), REAL_PROSE)[2] for x in (LICENCE, menu, noise)] == [True, False, False]
    assert not df.where("doc_id = 1").select(quality_rules("text")["kept"]).first()[0]


def test_every_part_of_a_text_is_judged(spark):
    import base64
    import random

    import zstandard
    from llm_odd import WORDS

    from tiltmeter.llm.quality_rules import compression
    rng = random.Random(11)
    compress = zstandard.ZstdCompressor(level=3).compress
    judged = lambda x: compression(compress, x, BANDS)[2]

    def noise(n):
        return b" ".join(base64.b64encode(rng.randbytes(45)) for _ in range(n // 61 + 1))[:n]
    def word():
        return rng.choice(WORDS) if rng.random() < 0.65 else "".join(rng.choices("etaoinshrdlcumwfgypbvk", range(22, 0, -1), k=rng.randint(2, 9)))
    clean = " ".join(word() for _ in range(8_000)).encode()[:30_000]
    assert judged(clean) and judged(clean[:3_950])
    menu = b"home | news | about | contact | terms | privacy | " * 80
    texts = {"clean": clean, "clean and short": clean[:3_950], "noise first": noise(790) + clean[:3_160], "noise last": clean[:3_160] + noise(790),
             "noise inside": clean[:15_000] + noise(6_000) + clean[15_000:], "menu inside": clean[:16_384] + menu[:2_048] + clean[16_384:],
             "menu last": clean[:26_000] + menu[:2_500]}
    df = spark.createDataFrame([(k, v.decode()) for k, v in texts.items()], "name string, text string")
    got = {r.name: r.kept for r in df.select("name", quality_rules("text")["kept"].alias("kept")).collect()}
    assert got == {k: k.startswith("clean") for k in texts}


def test_text_with_more_distinct_words_than_a_window_key_holds(spark):
    from pyspark.sql import functions as F
    n = (1 << 21) + 5_000
    text = F.concat(F.expr(f"array_join(transform(sequence(1, {n}), i -> hex(i)), ' ')"), F.lit(" 1 2 3 4 5 1 9 3"))
    r = spark.range(1).select(quality_rules(text).alias("q")).first().q
    assert (r.n_words, r.n_repeat_words, r.base_failed) == (n + 8, 10, False)


def test_keys_of_numbered_pairs_are_exact(monkeypatch):
    import pyarrow as pa

    from tiltmeter.llm import quality_rules as Q
    texts = [t for _, t in documents()]
    monkeypatch.setattr(Q, "MAX_KEY_CODES", 0)
    got = Q.judge(pa.array(texts)).to_pylist()
    assert [r["n_repeat_words"] for r in got] == [brute(t)[4] for t in texts]
