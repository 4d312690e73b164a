"""Changes of word attributions are found within rows of whole texts."""

from tiltmeter.operators import trace as T

A = "model string, event_id int, pert_idx int, tokens array<string>, scores array<double>"
FLIPS = "model string, event_id int, pert_idx int, type string, label_flipped boolean"


def test_no_row_per_word(spark):
    """The longest step has a row per flipped text and one per original, not one per word."""
    a = spark.createDataFrame([("m", 1, p, [f"w{i}" for i in range(50)], [float(i + p) for i in range(50)]) for p in (-1, 0, 1)], A)
    f = spark.createDataFrame([("m", 1, p, "t", True) for p in (0, 1)], FLIPS)
    got = T.attribution_deltas(f, a, None)
    assert "posexplode" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {len(r["top_delta"]) for r in got.collect()} == {50}


def test_words_that_stand_twice_and_repeated_rows(spark):
    a = spark.createDataFrame([
        ("m", 1, -1, ["a", "b", "a"], [0.5, -0.75, 1.5]), ("m", 1, 0, ["b", "c", "b"], [0.25, 1.0, 2.0]), ("m", 1, 0, ["b", "c", "b"], [0.25, 1.0, 2.0]),
        ("m", 2, -1, [], []), ("m", 2, 0, ["[CLS]"], [1.0]), ("m", 3, -1, None, None), ("m", 3, 0, ["x"], [1.0]),
        ("m", 4, 0, ["x"], [1.0]), ("m", 5, -1, ["x"], [1.0]), ("m", None, 0, ["x"], [1.0])], A)
    f = spark.createDataFrame([("m", 1, 0, None, True), ("m", 1, 0, None, True)] + [("m", e, 0, "t", True) for e in (2, 3, 4, 5, None)]
                              + [("m", 1, 1, "t", False), ("m", 1, 2, "t", None)], FLIPS)
    got = {r["event_id"]: [(x["token"], x["delta"]) for x in r["top_delta"]] for r in T.attribution_deltas(f, a, None).collect()}
    # The weakest place of a word counts: 0.5 of "a", 0.25 of "b".
    assert got == {1: [("b", 1.0), ("c", 1.0), ("a", -0.5)], 2: [], 3: [("x", 1.0)]}
