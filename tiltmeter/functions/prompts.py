"""Prompt strategies as Columns, generation wrapper, and supervised training targets."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from . import fixed_prompts as T
from .common import lookup, strip
from .labels import LABELS, class_code


@dataclass(frozen=True)
class Strategy:
    """A prompt template with its answer fields; ``required`` fields must be in an answer."""

    name: str
    template: str
    system: str | None
    fields: tuple[str, ...]
    required: tuple[str, ...]

    def prompt(self, note: Column) -> Column:
        before, after = self.template.split(T.NOTE)
        return F.concat(F.lit(before), note, F.lit(after))

    def schema(self) -> dict:
        num = {"type": "number"}
        kinds = {"label": {"type": "string", "enum": LABELS}, "confidence": num,
                 "logits": {"type": "object", "properties": {x: num for x in LABELS}},
                 "reasoning": {"type": "array", "items": {"type": "string"}}}
        return {"type": "object", "properties": {f: kinds[f] for f in self.fields}, "required": list(self.required)}


def example_block(per_label: int) -> str:
    """The first ``per_label`` examples of every label, as event and answer lines."""
    lines = []
    for lab, pool in T.POOL.items():
        for text, scores in pool[:per_label]:
            by_label = dict(zip(LABELS, scores))
            lines += [f"Event: {text}", json.dumps({"label": lab, "confidence": by_label[lab], "logits": by_label}), ""]
    return "\n".join(lines)


def _zero_shot(_: int) -> Strategy:
    return Strategy("zero_shot", T.ZERO_SHOT, None, ("label", "confidence", "logits"), ("label", "confidence"))


def _few_shot(n: int) -> Strategy:
    if not 1 <= n <= 5:
        raise ValueError("few-shot prompts take 1 to 5 examples per label")
    fields = ("label", "confidence", "logits")
    return Strategy("few_shot", T.FEW_SHOT.replace(T.EXAMPLES, example_block(n)), T.FEW_SHOT_SYSTEM, fields, fields)


def _explainable(_: int) -> Strategy:
    fields = ("reasoning", "label", "confidence", "logits")
    return Strategy("explainable", T.EXPLAINABLE, T.EXPLAINABLE_SYSTEM, fields, fields)


STRATEGIES: dict[str, Callable[[int], Strategy]] = {
    "zero_shot": _zero_shot, "few_shot": _few_shot, "explainable": _explainable}


def strategy(name: str, num_examples: int | None = None) -> Strategy:
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}; known: {sorted(STRATEGIES)}")
    return STRATEGIES[name](1 if num_examples is None else num_examples)


def generation_prompt(user: Column, system: str | Column | None) -> Column:
    """One string for a causal model: optional system part, user part, open assistant part."""
    body = F.concat(F.lit("### User\n"), user, F.lit("\n\n### Assistant\n"))
    if system is None:
        return body
    s = F.lit(system) if isinstance(system, str) else system
    return F.when(F.coalesce(s, F.lit("")) != "", F.concat(F.lit("### System\n"), s, F.lit("\n\n"), body)).otherwise(body)


def _json_string(c: Column) -> Column:
    """A text as a quoted JSON string."""
    listed = F.to_json(F.array(c))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def reasoning(note: Column, label: Column) -> list[Column]:
    """Three rationale lines for a note and its label."""
    snippet = F.replace(F.substring(note, 1, T.SNIPPET), F.lit("\n"), F.lit(" "))
    a, b = T.REASON_ACTORS.split("{}")
    c, d, e = T.REASON_LABEL.split("{}")
    meaning = F.coalesce(lookup(T.LABEL_MEANING, label), F.lit("the observed pattern"))
    return [F.concat(F.lit(a), snippet, F.lit(b)), F.lit(T.REASON_ACTIONS),
            F.concat(F.lit(c), label, F.lit(d), meaning, F.lit(e))]


def training_target(note: Column, label: Column, s: Strategy, include_confidence: bool = False) -> Column:
    """The answer a model should give, as JSON text with the fields of the strategy."""
    parts = [F.concat(F.lit('{"label": "'), label, F.lit('"'))]
    if "confidence" in s.required or ("confidence" in s.fields and include_confidence):
        parts.append(F.lit(', "confidence": 1.0'))
    if "logits" in s.fields:
        one_hot = [F.concat(F.lit(f'"{x}": '), F.when(label == x, "1.0").otherwise("0.0")) for x in LABELS]
        parts += [F.lit(', "logits": {'), F.concat_ws(", ", *one_hot), F.lit("}")]
    if "reasoning" in s.fields:
        parts += [F.lit(', "reasoning": ['), F.concat_ws(", ", *[_json_string(x) for x in reasoning(note, label)]), F.lit("]")]
    return F.concat(*parts, F.lit("}"))


def training_records(df: DataFrame, strategy_name: str = "zero_shot", num_examples: int = 3, include_confidence: bool = False,
                     label_col: str = "event_type", keep: tuple[str, ...] = ()) -> DataFrame:
    """(prompt, response) rows; rows without a note or a known label are left out."""
    s = strategy(strategy_name, num_examples if strategy_name == "few_shot" else None)
    raw = strip(F.col(label_col))
    d = df.withColumns({"_note": strip(F.col("notes")), "_label": F.coalesce(F.when(raw.isin(LABELS), raw), class_code(raw))})
    d = d.where((F.coalesce("_note", F.lit("")) != "") & F.col("_label").isNotNull())
    return d.select(*keep, generation_prompt(s.prompt(F.col("_note")), s.system).alias("prompt"),
                    training_target(F.col("_note"), F.col("_label"), s, include_confidence).alias("response"))
