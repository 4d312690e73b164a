"""CSV records with line breaks inside quotes, read from files that are split between tasks.

The text source splits a file at line ends and tells the block of each line.
Whether a line starts a record depends only on the parity of the quotes before
it, and parity adds up: blocks are summed up, the sums are added over the blocks
of a file, and each task carries its block's parity on from line to line. Lines
are joined to records where they lie; only the records that cross the end of a
block, at most one a block, are shuffled. The files are scanned three times (sums,
records, records that cross a border) and parsed once.

Quotes must follow RFC 4180: around whole fields, doubled inside. A file with an
odd number of quotes is an error, as are a line whose open quote begins no field
and a header that does not fit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.tables import sized_table

BLOCK = ["source_file", "block_start", "block_length"]
_FRAGMENTS = "source_file string, file_time timestamp, block_start long, place long, record string, begun boolean, ended boolean"


def read_lines(spark: SparkSession, path: str | list[str], end: str = "\n", **options) -> DataFrame:
    """Lines (up to each ``end``) with the block of the file they begin in, in the order of the file within each block."""
    m = "_metadata."
    text = spark.read.options(lineSep=end, **options).text(path)
    return text.select(F.col("value").alias("line"), F.col(m + "file_path").alias("source_file"), F.col(m + "file_modification_time").alias("file_time"),
                       F.col(m + "file_block_start").alias("block_start"), F.col(m + "file_block_length").alias("block_length"))


def block_parity(lines: DataFrame) -> DataFrame:
    """Per block whether it begins inside quotes (``inside``, 0 or 1). An odd number of quotes in a file is an error."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    totals = lines.groupBy(*BLOCK).agg((F.sum(quotes) % 2).alias("odd"))
    file = Window.partitionBy("source_file")
    before = F.sum("odd").over(file.orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1))
    text = F.concat(F.lit("quotes are not closed in "), "source_file", F.lit("; read it with split=False"))
    checked = F.when(F.sum("odd").over(file) % 2 == 1, F.raise_error(text).cast("long")).otherwise(F.coalesce(before, F.lit(0)) % 2)
    return totals.select(*BLOCK, checked.alias("inside"))


def _join_lines(batches: Iterator[pa.RecordBatch], torn: bool) -> Iterator[pa.RecordBatch]:
    """Whole records of the blocks of a task or, if ``torn``, only what their blocks do not begin or do not end."""
    block, held, odd, place, begun = None, [], 0, 0, True

    def rows(records: pa.Array, begins: list[bool], ends: list[bool]) -> pa.RecordBatch:
        nonlocal place
        if begins[0] and ends[0]:
            records = records.filter(pc.not_equal(records, ""))
            begins, ends = [True] * len(records), [True] * len(records)
        n = len(records)
        out = pa.RecordBatch.from_arrays(
            [pa.repeat(block[0], n), pa.repeat(block[1], n).cast(pa.timestamp("us", tz="UTC")), pa.repeat(block[2], n).cast(pa.int64()),
             pa.array(np.arange(place, place + n)), records, pa.array(begins, pa.bool_()), pa.array(ends, pa.bool_())],
            names=["source_file", "file_time", "block_start", "place", "record", "begun", "ended"])
        place += n
        return out.slice(0, 0) if n and torn == (begins[0] and ends[0]) else out

    for batch in batches:
        file, start = batch.column("source_file"), batch.column("block_start").to_numpy(zero_copy_only=False)
        coded = file.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        turns = np.flatnonzero((np.diff(start) != 0) | (np.diff(coded) != 0)) + 1
        bounds = [0, *turns.tolist(), len(start)]
        for a, b in zip(bounds, bounds[1:]):
            if a == b:
                continue
            here = (file[a].as_py(), batch.column("file_time")[a], int(start[a]))
            if block is None or (here[0], here[2]) != (block[0], block[2]):
                if held:
                    yield rows(pa.array(["\n".join(held)]), [begun], [odd == 0])
                block, held, place = here, [], 0
                odd = batch.column("inside")[a].as_py()
                begun = odd == 0
            lines = batch.column("line").slice(a, b - a)
            after = (odd + np.cumsum(pc.count_substring(lines, '"').to_numpy(zero_copy_only=False))) % 2
            inside = np.concatenate([[odd], after[:-1]])
            heads = np.flatnonzero(inside == 0)
            opening = pa.array(np.flatnonzero((inside == 0) & (after == 1)))
            if not pc.all(pc.match_substring_regex(lines.take(opening), '(^|,)"'), min_count=0).as_py():
                raise ValueError(f"a quote inside a field without quotes in {here[0]}; read it with split=False")
            odd = int(after[-1])
            if len(heads) == 0:
                held += lines.to_pylist()
                continue
            if heads[0] > 0 or held:
                held += lines.slice(0, heads[0]).to_pylist()
                yield rows(pa.array(["\n".join(held)]), [begun], [True])
            begun = True
            whole = pa.ListArray.from_arrays(pa.array(heads, pa.int32()), lines.slice(0, heads[-1]).cast(pa.string()))
            if len(whole):
                yield rows(pc.binary_join(whole, "\n"), [True] * len(whole), [True] * len(whole))
            held = lines.slice(heads[-1]).to_pylist()
    if held:
        yield rows(pa.array(["\n".join(held)]), [begun], [odd == 0])


def join_fragments(lines: DataFrame, blocks: DataFrame, join: Callable, glue: str) -> DataFrame:
    """What ``join`` makes of the lines of each block, given the block's row of ``blocks``: record, source_file, file_time, place.

    ``join(batches, torn)`` gives the whole records of its blocks or, if ``torn``,
    the parts of those that cross a border, which are put together here.
    """
    blocks, small = sized_table(blocks)
    told = [c for c in blocks.columns if c not in BLOCK]
    if small:
        marked = lines.join(blocks, BLOCK, "left")
    else:
        # Blocks as partitions: a join that shuffles loses the order of lines.
        marked = (lines.withColumn("at", F.monotonically_increasing_id()).join(blocks, BLOCK, "left")
                  .repartition(*BLOCK).sortWithinPartitions(*BLOCK, "at").drop("at"))
    lost = F.raise_error(F.concat(F.lit("blocks have changed in "), "source_file")).cast("long")
    marked = marked.withColumn(told[0], F.coalesce(told[0], lost))
    whole = marked.mapInArrow(partial(join, torn=False), _FRAGMENTS).select("source_file", "file_time", "block_start", "place", "record")
    order = Window.partitionBy("source_file").orderBy("block_start", "place")
    torn = marked.mapInArrow(partial(join, torn=True), _FRAGMENTS).withColumn("head", F.last(F.when(F.col("begun"), F.col("block_start")), True).over(order))
    lines_of = F.array_sort(F.collect_list(F.struct("block_start", "place", "record")))
    joined = torn.groupBy("source_file", "head").agg(F.min("file_time").alias("file_time"), lines_of.alias("p")).select(
        "source_file", "file_time", F.col("head").alias("block_start"), F.col("p")[0]["place"].alias("place"), F.array_join("p.record", glue).alias("record"))
    # A block has no more records than bytes, so its start plus their number grows along the file.
    return whole.unionByName(joined).select("source_file", "file_time", (F.col("block_start") + F.col("place")).alias("place"), "record")


def read_records(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """One row per CSV record: record (with its line breaks as LF), source_file, file_time, place.

    ``place`` grows with the order in the file; only its first record has 0. Of
    CRLF, the CR goes. Empty lines between records are left out. Both passes
    over the files must see the same blocks; if the cluster splits them otherwise
    in between, that is an error, not another result.
    """
    lines = read_lines(spark, path, **options).withColumn("line", F.regexp_replace("line", r"\r$", ""))
    return join_fragments(lines, block_parity(lines), _join_lines, "\n")


def header_fits(record: Column, schema: T.StructType) -> Column:
    """Whether a header record names the schema's columns in their order."""
    names = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(schema))] + [T.StructField("_rest", T.StringType())])
    told = F.from_csv(record, names.simpleString()[len("struct<"):-1].replace(":", " "), {"escape": '"', "columnNameOfCorruptRecord": "_rest"})
    same = F.isnull(told["_rest"])
    for i, f in enumerate(schema):
        same &= F.lower(F.regexp_replace(told[f"c{i}"], "^﻿", "")).eqNullSafe(f.name.lower())
    return same


def parse_records(records: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` from records with a header in each file, beside source_file, file_time and place."""
    wrong = F.raise_error(F.concat(F.lit("the header does not fit in "), "source_file")).cast("boolean")
    keep = F.when(F.col("place") > 0, True).otherwise(F.when(header_fits(F.col("record"), schema), False).otherwise(wrong))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    parsed = records.where(keep).withColumn("_r", F.from_csv("record", ddl, {"escape": '"'}))
    return parsed.select(*[F.col("_r")[f.name].alias(f.name) for f in schema], "source_file", "file_time", "place")
