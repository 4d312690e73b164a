"""A ledger of model answers: every distinct prompt is asked once, and a run that broke off is taken up where it stopped.

The ledger is a folder of Parquet files that all executors share, with a row
per (model, key of the prompt). Prompts that it does not answer yet are asked in
rounds, each a Spark write of its own that appends its answers; when a round
fails, those before it stay. A prompt whose answer failed is not written, so
the next run asks it again. Only tasks of the unfinished round are ever asked
twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.tables import stored

Predictor = Callable[[], Callable[[Sequence[str]], Sequence[str]]]

ROW = "model string, prompt_key string, raw_response string, latency_sec double, asked_at timestamp"
ROUNDS = 8

#: A predictor gets so many prompts at once at most, and no second one beyond so many bytes.
MOST_PROMPTS = 1000
MOST_BYTES = 2 << 20


def answers_of(predict, prompts: list[str]) -> list[str | None]:
    """Answers of a batch; if it fails as a whole each prompt by itself, with None for those that fail."""
    try:
        return list(predict(prompts))
    except Exception:
        out = []
        for p in prompts:
            try:
                out.append(predict([p])[0])
            except Exception:
                out.append(None)
        return out


def portions(batches: Iterator[pa.RecordBatch], prompt: str) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow's batches, which hold up to 64 MB, so that only few prompts are Python strings at a time."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(prompt)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(b):
            limit = (ends[at - 1] if at else 0) + MOST_BYTES
            n = max(1, min(MOST_PROMPTS, int(np.searchsorted(ends, limit, "right")) - at))
            yield b.slice(at, n)
            at += n


def with_answers(b: pa.RecordBatch, drop: Sequence[str], predict, prompt: str, **more: pa.Array) -> pa.RecordBatch:
    """A portion without the columns ``drop``, with any more columns, raw_response and latency_sec."""
    t0 = time.time()
    raw = answers_of(predict, b.column(prompt).to_pylist())
    each = round((time.time() - t0) / max(len(b), 1), 4)
    kept = {n: b.column(i) for i, n in enumerate(b.schema.names) if n not in drop} | more
    kept |= {"raw_response": pa.array(raw, pa.string(), from_pandas=True), "latency_sec": pa.array([each] * len(b), pa.float64())}
    return pa.RecordBatch.from_arrays(list(kept.values()), list(kept))


def prompt_key(prompt: Column) -> Column:
    """128 bits more than any number of prompts needs; a null prompt has a key of its own."""
    return F.coalesce(F.sha2(prompt.cast("binary"), 256), F.lit("none"))


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """One answer per model and prompt, the first one given; no rows where there is no ledger yet."""
    try:
        rows = spark.read.schema(ROW).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ROW)
    first = F.min(F.struct("asked_at", "raw_response", "latency_sec")).alias("_f")
    return rows.groupBy("model", "prompt_key").agg(first).select("model", "prompt_key", "_f.raw_response", "_f.latency_sec", "_f.asked_at")


def _asker(models: dict[str, Predictor]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {}
        for b in portions(batches, "prompt"):
            for model in sorted(set(b.column("model").to_pylist())):
                part = b.filter(pc.equal(b.column("model"), model))
                if model not in made:
                    made[model] = models[model]()
                out = with_answers(part, ["prompt"], made[model], "prompt")
                out = out.append_column("asked_at", pa.array([datetime.now(timezone.utc)] * len(out), pa.timestamp("us", "UTC")))
                yield out.filter(pc.is_valid(out.column("raw_response")))
    return run


def fill_ledger(df: DataFrame, prompt: Column, models: dict[str, Predictor], folder: str, rounds: int = ROUNDS) -> None:
    """Ask every model the distinct prompts of ``df`` that the ledger does not answer yet, in ``rounds`` appended writes."""
    spark = df.sparkSession
    distinct = df.select(prompt_key(prompt).alias("prompt_key"), prompt.alias("prompt")).groupBy("prompt_key").agg(F.first("prompt").alias("prompt"))
    names = F.explode(F.array(*[F.lit(m) for m in models])).alias("model")
    known = read_ledger(spark, folder).select("model", "prompt_key")
    # Stored, because the ledger that it is held against grows with every round.
    rest = stored(distinct.select("prompt_key", "prompt", names).join(known, ["model", "prompt_key"], "left_anti")
                  .withColumn("round", F.pmod(F.xxhash64("prompt_key"), F.lit(rounds))))
    for i in range(rounds):
        here = rest.where(F.col("round") == i).select("model", "prompt_key", "prompt")
        here.mapInArrow(_asker(models), ROW).write.mode("append").parquet(folder)


def answered(df: DataFrame, prompt: Column, models: dict[str, Predictor], folder: str, rounds: int = ROUNDS) -> DataFrame:
    """Every row with every model's answer from the ledger, which is filled first: model, raw_response, latency_sec.

    Rows whose prompt has no answer get null ones. The ledger has one row per
    key, so a prompt that many rows share is only a skewed join.
    """
    fill_ledger(df, prompt, models, folder, rounds)
    names = F.explode(F.array(*[F.lit(m) for m in models]))
    keyed = df.drop("model", "raw_response", "latency_sec").withColumn("_key", prompt_key(prompt)).withColumn("model", names)
    told = read_ledger(df.sparkSession, folder).select("model", F.col("prompt_key").alias("_key"), "raw_response", "latency_sec")
    return keyed.join(told, ["model", "_key"], "left").drop("_key")
