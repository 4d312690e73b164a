"""Intermediate tables: small ones to broadcast after a size check, large ones to store."""

from __future__ import annotations

import json
import re
import tempfile

from pyspark.sql import DataFrame, functions as F, types as T

CONTROL_ROWS = 100_000
CONTROL_BYTES = 32 << 20


def _nullable(schema: T.StructType) -> T.StructType:
    text = json.dumps(schema.jsonValue())
    for flag in ("nullable", "containsNull", "valueContainsNull"):
        text = text.replace(f'"{flag}": false', f'"{flag}": true')
    return T.StructType.fromJson(json.loads(text))


def sized_table(df: DataFrame, most: int = CONTROL_ROWS, most_bytes: int = CONTROL_BYTES) -> tuple[DataFrame, bool]:
    """:func:`control_table`, and whether it is small."""
    schema = _nullable(df.schema)
    loose = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])
    got = loose.limit(most + 1).toArrow()
    if got.num_rows > most or got.nbytes > most_bytes:
        return stored(df), False
    return F.broadcast(df.sparkSession.createDataFrame(got, schema)), True


def control_table(df: DataFrame, most: int = CONTROL_ROWS, most_bytes: int = CONTROL_BYTES) -> DataFrame:
    """A table of one row per group (quotas, cuts, model parameters), ready to be broadcast.

    Joining rows with such a table on the group key must not shuffle the rows:
    a third of them may share one key. So the table is fetched once, but only
    after its size is checked, in rows and in bytes. A larger one is stored, so
    that no later pass computes it anew, and stays distributed; the join is then
    left to Spark's adaptive skew handling.
    """
    return sized_table(df, most, most_bytes)[0]


def shared_folder(spark) -> str:
    """The folder that all executors share; only a local session may do without one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tiltmeter-checkpoint-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, for a table that several passes read.

    The folder is the cluster's ``spark.checkpoint.dir``, which all executors
    share. Only a local session may do without: it gets a temporary folder. A
    cluster without one is an error, because every pass would silently compute
    the table anew, and could even see other rows if a model is asked again.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
