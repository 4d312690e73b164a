"""Batch scoring of texts with a caller's model, and re-scoring of variants.

The engine ships no model. A predictor is ``factory() -> (list of prompts ->
list of raw answers)``; the factory runs once per task, the function once per
portion of an Arrow batch. A failing row becomes label ERROR with confidence 0.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.prompts import generation_prompt, strategy as prompt_strategy
from ..functions.responses import prediction
from .ledger import Predictor, answered, portions, with_answers


def ask(df: DataFrame, prompt: Column, predictor: Predictor) -> DataFrame:
    """Add raw_response and latency_sec. The prompt travels to Python with the other columns, once."""
    d = df.withColumn("_prompt", prompt)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = predictor()
        for b in portions(batches, "_prompt"):
            yield with_answers(b, ["_prompt"], predict, "_prompt")

    return d.mapInArrow(run, f"{schema}, raw_response string, latency_sec double")


def score_events(df: DataFrame, model: str, predictor: Predictor, strategy: str = "zero_shot", num_examples: int = 1,
                 text: str = "notes", parser: str = "structured", ledger: str | None = None) -> DataFrame:
    """Prediction columns for every event: model, pred_label, pred_conf, logits, reasoning, latency_sec.

    With a ``ledger`` folder, each distinct prompt is asked once and its answer kept
    there (see ``operators/ledger.py``); so for the other two.

    ``parser`` names how answers are read: "structured" (a schema-bound server),
    "generated" or "generated_loose" (free text with an object in it).
    """
    s = prompt_strategy(strategy, num_examples)
    prompt = generation_prompt(s.prompt(F.col(text)), s.system)
    asked = ask(df, prompt, predictor) if ledger is None else answered(df, prompt, {model: predictor}, ledger).drop("model")
    read = asked.withColumn("_read", prediction(F.col("raw_response"), parser=parser))
    return read.select(*[F.col(f"`{c}`") for c in df.columns if c != "model"], "latency_sec", F.lit(model).alias("model"),
                       *[F.col(f"_read.{c}").alias(c) for c in ("pred_label", "pred_conf", "logits", "reasoning")])


def ask_all(df: DataFrame, prompt: Column, models: dict[str, Predictor], keep: Sequence[str] | None = None) -> DataFrame:
    """Every row's prompt put to every model in one pass over ``df``: model, raw_response and latency_sec per row and model.

    With ``keep``, only these columns go to Python beside the prompt, and come back.
    """
    kept = [F.col(f"`{c}`") for c in (df.columns if keep is None else keep)]
    d = df.select(*kept, prompt.alias("_prompt"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = {name: factory() for name, factory in models.items()}
        for b in portions(batches, "_prompt"):
            for name, fn in predict.items():
                yield with_answers(b, ["_prompt"], fn, "_prompt", model=pa.array([name] * len(b), pa.string()))

    return d.mapInArrow(run, f"{schema}, model string, raw_response string, latency_sec double")


def score_variants(variants: DataFrame, models: dict[str, Predictor], strategy: str = "zero_shot", parser: str = "structured",
                   ledger: str | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """Every variant scored by every model: label, confidence, success. The variants are computed once for all models.

    ``keep`` names the columns of the variants that are wanted back (None: all); their texts are long.
    """
    s = prompt_strategy(strategy, 1)
    prompt = generation_prompt(s.prompt(F.col("text")), s.system)
    asked = ask_all(variants, prompt, models, keep) if ledger is None else answered(variants, prompt, models, ledger)
    read = asked.withColumn("_read", prediction(F.col("raw_response"), parser=parser))
    return read.select(*[F.col(f"`{c}`") for c in (variants.columns if keep is None else keep)], "model", F.col("_read.pred_label").alias("label"),
                       F.col("_read.pred_conf").alias("confidence"), (F.col("_read.pred_label") != "ERROR").alias("success"))


def collect_rationales(texts: DataFrame, model: str, predictor: Predictor, parser: str = "structured",
                       ledger: str | None = None) -> DataFrame:
    """(model, event_id, pert_idx, reasoning) by the explainable prompt; null where the answer has no list of reasons."""
    s = prompt_strategy("explainable")
    texts, prompt = texts.select("event_id", "pert_idx", "text"), generation_prompt(s.prompt(F.col("text")), s.system)
    asked = ask(texts, prompt, predictor) if ledger is None else answered(texts, prompt, {model: predictor}, ledger)
    return asked.select(F.lit(model).alias("model"), "event_id", "pert_idx", prediction(F.col("raw_response"), parser=parser)["items"].alias("reasoning"))
