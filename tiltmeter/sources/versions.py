"""A table kept by versions: an upsert writes the files of its own keys and leaves those of all others alone.

Every upsert puts its rows into a batch folder of its own, a folder per key
below it; nothing is changed or deleted afterwards. The manifest of a version
tells for each key which batch holds its rows. It is a single file and appears in
one rename, after all rows: a reader sees the old version or the new one, never a
mixture, and an upsert that fails leaves the old one (and rows that nothing
points to). The manifest has a row per key, so keys are models or the like.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .sinks import sized

_MANIFEST = "version long, attempt string, file string, batch string"


class Conflict(RuntimeError):
    """Another upsert has made the same version first."""


def _file(key: str) -> Column:
    """Name of a key's folder, the same for any type; a null key has one of its own."""
    return F.coalesce(F.concat(F.lit("k"), F.md5(F.col(key).cast("string").cast("binary"))), F.lit("none"))


def _marks(spark: SparkSession, root: str) -> dict[int, str]:
    """The attempt that made each version: of several, the first one that was there."""
    try:
        rows = spark.read.schema(_MANIFEST).parquet(f"{root}/manifest").select("version", F.col("_metadata.file_modification_time").alias("t"), "attempt")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    first = rows.groupBy("version").agg(F.min(F.struct("t", "attempt"))["attempt"].alias("attempt"))
    return {r["version"]: r["attempt"] for r in first.collect()}


def versions(spark: SparkSession, root: str) -> list[int]:
    return sorted(_marks(spark, root))


def manifest(spark: SparkSession, root: str, version: int, attempt: str) -> DataFrame:
    """(file, batch) of a version."""
    rows = spark.read.schema(_MANIFEST).parquet(f"{root}/manifest")
    return rows.where((F.col("version") == version) & (F.col("attempt") == attempt) & F.col("file").isNotNull()).select("file", "batch")


def upsert_version(new: DataFrame, root: str, key: str = "model") -> int:
    """Put the rows of the keys in ``new`` in place of theirs; the new version's number.

    An upsert without rows makes a version equal to the last. Of two upserts that
    start from the same version the later one ends with :class:`Conflict` and
    changes nothing; it can be run again.
    """
    spark, marks, attempt = new.sparkSession, _marks(new.sparkSession, root), uuid.uuid4().hex
    before = max(marks, default=0)
    batch = f"{root}/rows/batch=b{attempt}"
    sized(new.withColumn("_file", _file(key)), ["_file"]).write.mode("errorifexists").partitionBy("_file").parquet(batch)
    told = spark.read.schema("_file string").parquet(batch).select(F.col("_file").alias("file")).distinct().withColumn("batch", F.lit(f"b{attempt}"))
    if before:
        told = told.unionByName(manifest(spark, root, before, marks[before]).join(told, "file", "left_anti"))
    # A row without a file, so that a version without any key exists as well.
    told = told.unionByName(spark.createDataFrame([(None, None)], "file string, batch string"))
    row = told.select(F.lit(before + 1).cast("long").alias("version"), F.lit(attempt).alias("attempt"), "file", "batch")
    row.coalesce(1).write.mode("append").partitionBy("version").parquet(f"{root}/manifest")
    if _marks(spark, root)[before + 1] != attempt:
        raise Conflict(f"version {before + 1} of {root} was made by another upsert")
    return before + 1


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The table as of a version, the newest if none is given; only files that count in it are read.

    Columns of all its batches, null where a batch lacks them. A version without any row has no columns.
    """
    marks = _marks(spark, root)
    at = max(marks, default=None) if version is None else version
    if at not in marks:
        raise LookupError(f"no version {at} of {root}")
    held = manifest(spark, root, at, marks[at]).collect()
    if not held:
        return spark.createDataFrame([], T.StructType([]))
    return spark.read.option("mergeSchema", True).parquet(*[f"{root}/rows/batch={r['batch']}/_file={r['file']}" for r in held])
