"""Reading event tables, per-model result files and nested counterfactual reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.cleaning import union_training_tables
from ..operators.ranking import keep_one
from . import schemas
from .records import parse_records, read_records
from .reports import read_objects


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType, line_breaks: bool = True, split: bool = True) -> DataFrame:
    """CSV with header and a declared schema; the header must name its columns in their order.

    ``line_breaks`` allows them inside quotes. Large files are split between
    tasks in any case; ``split=False`` reads each file in one task, for quotes
    that do not follow RFC 4180.
    """
    if line_breaks and split:
        return parse_records(read_records(spark, path), schema).select(*schema.names)
    return (spark.read.schema(schema).option("header", True).option("multiLine", line_breaks).option("escape", '"')
            .option("enforceSchema", False).csv(path))


def read_raw_events(spark: SparkSession, path: str, line_breaks: bool = True, split: bool = True) -> DataFrame:
    return read_csv(spark, path, schemas.RAW_EVENTS, line_breaks, split)


def file_slug(path: Column, name_pattern: str) -> Column:
    """Model slug in a file name; ``name_pattern`` has one group, e.g. ``results_(.+)_cmr\\.csv``."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.nullif(F.regexp_extract(name, "^" + name_pattern + "$", 1), F.lit(""))


def path_country(path: Column) -> Column:
    """Country code told by a file name, else unknown."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return (F.when(name.contains("cmr") | name.contains("cameroon"), "cmr")
            .when(name.contains("nga") | name.contains("nigeria"), "nga").otherwise("unknown"))


def path_sample_size(path: Column) -> Column:
    """First path part made of digits only."""
    return F.nullif(F.regexp_extract(path, r"(?:^|/)(\d+)(?=/|$)", 1), F.lit("")).try_cast("int")


def read_model_results(spark: SparkSession, root: str, name_pattern: str, models: Sequence[str] | None = None,
                       schema: T.StructType = schemas.PREDICTIONS, glob: str = "*.csv", line_breaks: bool = True, split: bool = True) -> DataFrame:
    """All per-model files under ``root`` in one read, with slug, source_file and file_time.

    Files are left out if neither their name nor that of their folder (as Spark
    writes a file in parts) fits; ``models`` keeps the listed model names
    (compared as slugs). ``row_in_run`` grows along each file.
    """
    where = {"recursiveFileLookup": True, "pathGlobFilter": glob}
    if line_breaks and split:
        df = parse_records(read_records(spark, root, **where), schema).withColumnRenamed("place", "row_in_run")
    else:
        df = (spark.read.schema(schema).option("header", True).option("multiLine", line_breaks).option("escape", '"')
              .option("enforceSchema", False).options(**where).csv(root))
        df = df.select("*", F.col("_metadata.file_path").alias("source_file"),
                       F.col("_metadata.file_modification_time").alias("file_time"),
                       F.monotonically_increasing_id().alias("row_in_run"))
    folder = F.regexp_replace("source_file", "/[^/]*$", "")
    slug = F.coalesce(file_slug(F.col("source_file"), name_pattern), file_slug(folder, name_pattern))
    df = df.withColumn("slug", slug).where(F.col("slug").isNotNull())
    if models:
        df = df.where(F.col("slug").isin([m.strip().replace(":", "-").replace("/", "_") for m in models if m.strip()]))
    return df


def combine_model_results(files: DataFrame) -> DataFrame:
    """One row per (model, event_id), the newest file winning and, in a file, the last row."""
    out = keep_one(files, ["model", "event_id"], ["file_time", "source_file", "row_in_run"], last=True)
    return out.drop("source_file", "file_time", "row_in_run", "slug")


def tag_from_path(df: DataFrame, path: str = "source_file") -> DataFrame:
    return df.withColumns({"country": path_country(F.col(path)), "sample_size": path_sample_size(F.col(path))})


def read_event_results(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Nested results, one event on each line: files of any size are split, and no document has to fit in one task."""
    return spark.read.schema(schemas.EVENT_RESULT).json(path)


def read_counterfactuals(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Nested reports, one JSON document per file, each in one task and one row; the first file of each folder counts."""
    df = spark.read.schema(schemas.COUNTERFACTUAL_FILE).option("multiLine", True).json(path)
    df = df.select("*", F.col("_metadata.file_path").alias("source_file"))
    df = df.withColumn("folder", F.regexp_replace("source_file", "/[^/]*$", ""))
    first = df.groupBy("folder").agg(F.min("source_file").alias("source_file")).select("source_file")
    return df.join(first, "source_file", "left_semi")


def _read_from_reports(spark: SparkSession, path: str | list[str], key: str, in_array: bool, schema: T.StructType) -> DataFrame:
    objects = read_objects(spark, path, key, in_array, first_of_folder=True)
    folder = F.regexp_replace("source_file", "/[^/]*$", "")
    return objects.select("source_file", folder.alias("folder"), "place", F.from_json("record", schema).alias("_e")).select("source_file", "folder", "place", "_e.*")


def read_report_events(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Event results of nested reports, one row each, with source_file, folder and place; the first file of each folder counts.

    A report of any size is shared by several tasks, and no task holds more of it
    than one event. Documents that are not whole are an error; :func:`read_counterfactuals` takes them as nulls.
    """
    return _read_from_reports(spark, path, "detailed_results", True, schemas.EVENT_RESULT)


def read_report_metadata(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Metadata of nested reports, one row per folder, for a join on source_file with :func:`read_report_events`."""
    return _read_from_reports(spark, path, "metadata", False, schemas.COUNTERFACTUAL_FILE["metadata"].dataType)


def flatten_counterfactuals(events: DataFrame, *kept: str) -> DataFrame:
    """One row per (event, variant, model) from rows of event results, with the ``kept`` columns."""
    p = events.select(*kept, "event_id", "original_text", "true_label", "ambiguity_tier",
                      F.posexplode("perturbations").alias("pert_idx", "_p"))
    m = p.select(*kept, "event_id", "original_text", "true_label", "ambiguity_tier", "pert_idx", "_p.perturbation.*",
                 F.explode("_p.model_results").alias("model", "_r"))
    return m.select("*", "_r.*").drop("_r")


def flips_from_reports(reports: DataFrame) -> DataFrame:
    return flatten_counterfactuals(reports.select(F.explode("detailed_results").alias("_e")).select("_e.*"))


def read_training_tables(spark: SparkSession, paths: list[str], schemas_: list[T.StructType]) -> DataFrame:
    return union_training_tables(*[read_csv(spark, p, s) for p, s in zip(paths, schemas_)])
