"""Sharding by sampled splitters: near-equal bytes, whatever the keys look like."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import INNER, narrow, stored

#: Ranges and samples of a run: constants, so what reaches the driver does not grow with the table.
RANGES_PER_SHARD = 32
SAMPLES_PER_RANGE = 24
OVERFULL = 3.0
ROUNDS = 6
SEED = 20_011
TIE_BITS = 24


def record_key(text, record_id):
    """Order of the records: equal texts are neighbours, and a large group of them can still be split.

    The upper bits hash the text, the lower 24 the id.
    """
    high = F.xxhash64(text).bitwiseAND(F.lit(~((1 << TIE_BITS) - 1)))
    return high.bitwiseOR(F.xxhash64(F.lit(SEED), record_id).bitwiseAND(F.lit((1 << TIE_BITS) - 1)))


def _sample(rows: DataFrame, total: float, most: int, among: tuple[np.ndarray, list[int]] | None = None) -> np.ndarray:
    """Keys drawn with a chance in proportion to the record's size; ``most`` are expected."""
    if among is not None:
        rows = rows.withColumn("r", range_of(among[0])("key")).filter(F.col("r").isin(among[1]))
    chance = F.least(F.lit(1.0), F.col("size") * F.lit(most / max(total, 1.0)))
    drawn = rows.filter(F.rand(SEED) < chance).select("key").toArrow()
    return np.sort(drawn.column("key").to_numpy())


def _quantiles(keys: np.ndarray, parts: int) -> np.ndarray:
    if not len(keys):
        return keys
    return np.unique(keys[(np.arange(1, parts) * len(keys)) // parts])


def range_of(splitters: np.ndarray):
    """Number of splitters at or below a key."""
    @F.pandas_udf(T.IntegerType())
    def find(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splitters, keys.to_numpy(), side="right").astype(np.int32))
    return find


def _range_sizes(rows: DataFrame, splitters: np.ndarray) -> pd.DataFrame:
    found = rows.groupBy(range_of(splitters)("key").alias("r")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).toPandas()
    return found.set_index("r").reindex(range(len(splitters) + 1), fill_value=0)


def splitters_for(rows: DataFrame, total: float, n_ranges: int) -> tuple[np.ndarray, pd.DataFrame]:
    """Range boundaries for (key, size) rows, and the exact rows and bytes of each range.

    A first sample gives quantile boundaries; ranges that hold more than three
    times their share get a sample of their own and are divided again.
    """
    share = total / n_ranges
    splitters = _quantiles(_sample(rows, total, n_ranges * SAMPLES_PER_RANGE), n_ranges)
    for _ in range(ROUNDS):
        sizes = _range_sizes(rows, splitters)
        over = [int(r) for r in sizes.index[(sizes["bytes"] > OVERFULL * share) & (sizes["n"] > 1)]]
        if not over:
            return splitters, sizes
        heavy = float(sizes.loc[over, "bytes"].sum())
        parts = int(np.ceil(heavy / share)) * 2
        more = _quantiles(_sample(rows, heavy, parts * SAMPLES_PER_RANGE, (splitters, over)), parts)
        grown = np.union1d(splitters, more)
        if len(grown) == len(splitters):
            return splitters, sizes
        splitters = grown
    return splitters, _range_sizes(rows, splitters)


def shard_by_bytes(df: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every record in one of ``n_shards`` shards whose byte sizes differ by about one record.

    Records are ordered by :func:`record_key`. Sampled splitters cut that order
    into many ranges; ranges are numbered in place, and a record's shard follows
    from the bytes before it, so shards are cut between records, not between
    ranges. Only (id, size, checksum, key) is ever moved; no text is.

    Returns doc_id, size (UTF-8 bytes plus 8), text_crc32, law ("bytes"), shard,
    slot (gapless from 0), grown_shard (always null: shards move when their number
    changes). A null text counts as an empty one. An empty table gives an empty
    result. Equal rows are told apart by no column, so which of them comes first
    does not matter; more rows of one key and id than a range may hold stay
    in one range. Columns besides id and text are not read.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = stored(narrow(df, doc_id=id_col, size=(F.octet_length(text) + 8).cast("bigint"), text_crc32=F.crc32(text.cast("binary")),
                         key=record_key(text, F.col(f"`{id_col}`"))))
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    spark = df.sparkSession
    if not n:
        splitters, sizes = np.empty(0, np.int64), pd.DataFrame({"n": [0], "bytes": [0]})
        total = 1
    else:
        splitters, sizes = splitters_for(rows, float(total), n_shards * RANGES_PER_SHARD)
    before = pd.DataFrame({"r": np.arange(len(sizes), dtype=np.int32),
                           "rows_before": (sizes["n"].cumsum() - sizes["n"]).to_numpy(np.int64),
                           "bytes_before": (sizes["bytes"].cumsum() - sizes["bytes"]).to_numpy(np.int64)})
    starts = F.broadcast(spark.createDataFrame(before, "r int, rows_before bigint, bytes_before bigint"))
    order = Window.partitionBy("r").orderBy("key", "doc_id", "text_crc32", "size")
    placed = (rows.withColumn("r", range_of(splitters)("key")).join(starts, "r")
              .withColumn("place", F.col("rows_before") + F.row_number().over(order) - 1)
              .withColumn("first_byte", F.col("bytes_before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")))
    middle = F.col("first_byte").cast("decimal(38,0)") * 2 + F.col("size")
    shard = F.least(F.lit(n_shards - 1), F.expr(f"CAST({INNER}m * {n_shards} div {2 * int(total)} AS INT)"))
    placed = stored(placed.withColumn(f"{INNER}m", middle.cast("decimal(30,0)")).select("doc_id", "size", "text_crc32", "place", shard.alias("shard")))
    firsts = F.broadcast(placed.groupBy("shard").agg(F.min("place").alias("first")))  # one row a shard
    return placed.join(firsts, "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
