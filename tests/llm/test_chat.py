import random

from tiltmeter.llm import chat


def brute(rows):
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, set()).add((turn, role, text))
    order = lambda x: tuple((v is not None, v if v is not None else 0) for v in x)
    whole = {c: sorted(v, key=order) for c, v in by.items()}
    kept = {}
    for c, v in whole.items():
        longer = any(len(w) > len(v) and w[:len(v)] == v for w in whole.values())
        equal = any(w == v and order((d,)) < order((c,)) and d is not None for d, w in whole.items() if d != c)
        if not longer and not equal:
            kept[c] = v
    return kept


def render(turns):
    return "".join(f"<|im_start|>{'unknown' if r is None else r}\n{t or ''}<|im_end|>\n" for _, r, t in turns)


def frame(spark, rows):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    return df.withColumns({c: F.lit(1) for c in ("conv", "block", "n", "a", "b", "k", "ha")})


def check(spark, rows):
    got = {}
    for r in chat.format_conversations(frame(spark, rows)).collect():
        got.setdefault(r.conv_id, []).append((r.part, r.n_turns, r.text))
    want = brute(rows)
    assert set(got) == set(want)
    for c, parts in got.items():
        assert "".join(t for _, _, t in sorted(parts)) == render(want[c])
        assert {n for _, n, _ in parts} == {len(want[c])}


def test_snapshots(spark):
    rng = random.Random(4)
    rows, conv = [], 0
    for _ in range(25):
        turns = [(k, "user" if k % 2 == 0 else "assistant", rng.choice(["hi", "yes", "no", f"t{rng.random()}"])) for k in range(rng.randint(1, 9))]
        for n in rng.sample(range(1, len(turns) + 1), min(3, len(turns))):
            rows += [(conv, *t) for t in turns[:n]]
            conv += 1
    check(spark, rows)


def test_odd_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, None, "b"), (2, 0, "user", "a"), (3, 0, "user", None), (4, 0, "user", ""), (5, None, "user", "x"),
            (5, 0, "user", "y"), (6, 0, "user", "a"), (6, 1, None, "b"), (None, 0, "user", "q"), (7, 0, "user", "z"), (7, 0, "assistant", "z"), (8, 0, "user", "t" * 300_000)]
    check(spark, rows)


def test_long_conversations_are_rendered_in_parts(spark):
    long = [(1, k, "user", f"m{k}") for k in range(1000)]
    rows = long + [(2, *t[1:]) for t in long[:600]] + [(3, *t[1:]) for t in long[:256]] + [(4, 0, "user", "m0"), (4, 1, "user", "other")]
    check(spark, rows)
    assert chat.format_conversations(frame(spark, long)).count() == 4


def test_empty_table(spark):
    assert chat.format_conversations(frame(spark, [])).count() == 0


def test_main_path_is_native(spark):
    plan = chat.format_conversations(frame(spark, [(1, 0, "user", "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
