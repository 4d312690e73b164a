"""Variants and pairs are made from whole documents, not from a few sentences."""

from pyspark.sql import functions as F

from tiltmeter.registry import queries
from tiltmeter.registry.inputs import rich_events

SF = "/root/testdata/sf0.001"


def test_variants_hold_whole_documents(spark):
    got = queries()["valid_variants"](spark, SF).where("generator = 'legitimation' and type = 'legitimation_add'")
    end = F.expr("rtrim('.!?', body)")
    r = (got.join(rich_events(spark, SF).select("event_id", "body"), "event_id")
         .agg(F.count("*").alias("n"), F.countDistinct("text").alias("texts"), F.count(F.when(F.col("text").startswith(end), 1)).alias("whole")).first())
    assert r.n > 50 and r.whole == r.n and r.texts > 8


def test_pairs_are_compared_whole(spark):
    from difflib import SequenceMatcher
    bodies = {r.event_id: r.body for r in rich_events(spark, SF).select("event_id", "body").collect()}
    got = {r.event_id: r.edit_distance_ratio for r in queries()["validated_pairs"](spark, SF).collect()}
    assert set(got) == set(bodies)
    for i in sorted(x for x in bodies if x % 4 == 1)[:15]:
        assert abs(got[i] - SequenceMatcher(None, bodies[i], bodies[i] + " Then it was over.").ratio()) < 1e-5
