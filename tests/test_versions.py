"""Upserts by versions."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tiltmeter.sources import versions as V


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def files(root):
    return {p: os.path.getmtime(p) for p in glob.glob(f"{root}/rows/**/*.parquet", recursive=True)}


def table(spark, *data, schema="model string, n int"):
    return spark.createDataFrame(list(data), schema)


def test_only_its_own_files_are_written(spark, tmp_path):
    root = str(tmp_path)
    many = spark.range(1000).select(F.concat(F.lit("m:"), F.col("id") % 20).alias("model"), F.col("id").cast("int").alias("n"))
    assert V.upsert_version(many, root) == 1
    before = files(root)
    assert V.upsert_version(table(spark, ("m:3", -1), ("new/one", -2)), root) == 2
    after = files(root)
    assert before.items() <= after.items() and len(after) == len(before) + 2
    want = [(r["model"], r["n"]) for r in many.collect()]
    assert rows(V.read_version(spark, root, 1)) == sorted(want)
    assert rows(V.read_version(spark, root)) == sorted([w for w in want if w[0] != "m:3"] + [("m:3", -1), ("new/one", -2)])
    used = {r["p"] for r in V.read_version(spark, root).select(F.col("_metadata.file_path").alias("p")).distinct().collect()}
    assert len(used) == 21


def test_keys_that_look_alike(spark, tmp_path):
    first = table(spark, ("007", 1), ("7", 2), (None, 3), ("none", 4), ("", 5), ("7.0", 6), ("null", 7))
    V.upsert_version(first, str(tmp_path))
    V.upsert_version(table(spark, ("7", 20), (None, 30), (None, 31)), str(tmp_path))
    got = {r["n"]: r["model"] for r in V.read_version(spark, str(tmp_path)).collect()}
    assert got == {1: "007", 20: "7", 30: None, 31: None, 4: "none", 5: "", 6: "7.0", 7: "null"}


def test_new_columns_and_equal_names(spark, tmp_path):
    V.upsert_version(table(spark, ("a", 1), ("b", 2), schema="model string, version int"), str(tmp_path))
    V.upsert_version(table(spark, ("b", 5, "x", "y"), schema="model string, version int, batch string, file string"), str(tmp_path))
    assert rows(V.read_version(spark, str(tmp_path)).select("model", "version", "batch", "file")) == [("a", 1, None, None), ("b", 5, "x", "y")]


def test_empty_upserts(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(LookupError):
        V.read_version(spark, root)
    assert V.upsert_version(table(spark), root) == 1
    assert V.read_version(spark, root).count() == 0
    V.upsert_version(table(spark, ("a", 1)), root)
    assert V.upsert_version(table(spark), root) == 3
    assert rows(V.read_version(spark, root)) == [("a", 1)] and V.versions(spark, root) == [1, 2, 3]


def test_a_failed_upsert_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path)
    V.upsert_version(table(spark, ("a", 1), ("b", 2)), root)
    bad = table(spark, ("a", 9), ("c", 0)).withColumn("n", F.when(F.col("n") == 0, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("n")))
    with pytest.raises(Exception, match="lost"):
        V.upsert_version(bad, root)
    assert rows(V.read_version(spark, root)) == [("a", 1), ("b", 2)]
    assert V.upsert_version(table(spark, ("a", 3)), root) == 2
    assert rows(V.read_version(spark, root)) == [("a", 3), ("b", 2)]


def test_two_upserts_from_one_version(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    V.upsert_version(table(spark, ("a", 1)), root)
    seen, known = V._marks(spark, root), V._marks
    V.upsert_version(table(spark, ("b", 2)), root)
    calls = iter([seen])
    monkeypatch.setattr(V, "_marks", lambda s, r: next(calls, None) or known(s, r))
    with pytest.raises(V.Conflict):
        V.upsert_version(table(spark, ("c", 3)), root)
    assert rows(V.read_version(spark, root)) == [("a", 1), ("b", 2)]
    assert V.upsert_version(table(spark, ("c", 3)), root) == 3
    assert rows(V.read_version(spark, root)) == [("a", 1), ("b", 2), ("c", 3)]
