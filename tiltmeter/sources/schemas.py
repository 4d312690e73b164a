"""Declared schemas; nothing is inferred from file headers."""

from pyspark.sql import types as T

_S, _D, _I, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


RAW_EVENTS = _struct(event_id_cnty=_S, notes=_S, event_type=_S, country=_S, actor1=_S, inter1=_I, source=_S,
                     source_scale=_S, fatalities=_I)
STANDARD_EVENTS = _struct(event_id=_S, notes=_S, event_type=_S, country=_S, actor_norm=_S)
SAMPLE = _struct(event_id_cnty=_S, notes=_S, gold_label=_S, gold_label_full=_S, actor_type=_S, actor_norm=_S)
PREDICTIONS = _struct(model=_S, event_id=_S, true_label=_S, pred_label=_S, pred_conf=_D, logits=_S, reasoning=_S,
                      latency_sec=_D, actor_norm=_S, notes=_S)
FAIRNESS = _struct(model=_S, target_label=_S, n_state=_I, n_nonstate=_I, SPD=_D, SPD_CI_lower=_D, SPD_CI_upper=_D,
                   TPR_state=_D, TPR_nonstate=_D, TPR_diff=_D, TPR_pvalue=_D, FPR_state=_D, FPR_nonstate=_D,
                   FPR_diff=_D, FPR_pvalue=_D)

MODEL_RESULT = _struct(label=_S, confidence=_D, success=_B, label_flipped=_B, confidence_delta=_D, flip_direction=_S)
PERTURBATION = _struct(type=_S, subtype=_S, original=_S, replacement=_S, modifier=_S, action=_S, phrase=_S, source=_S,
                       target=_S, pattern=_S, text=_S, description=_S)
EVENT_RESULT = _struct(
    event_id=_S, original_text=_S, true_label=_S, ambiguity_score=_D, ambiguity_tier=_S,
    perturbations=T.ArrayType(_struct(perturbation=PERTURBATION, model_results=T.MapType(_S, MODEL_RESULT))))
COUNTERFACTUAL_FILE = _struct(metadata=_struct(country=_S, models=T.ArrayType(_S)),
                              detailed_results=T.ArrayType(EVENT_RESULT))
