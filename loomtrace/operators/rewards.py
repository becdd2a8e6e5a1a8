"""Rewards of completions as columns, and their weighted sum by stage."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compat import let
from ..functions.text import answer, coherence, confidence, steps, tagged
from ..sources.scratch import written

CORRECT, RIGHT = 0.1, 0.15

# Weights of outcome, coherence, tool use, reasoning quality and calibration at each stage.
STAGES = {
    1: {"outcome": 0.6, "coherence": 0.4},
    2: {"outcome": 0.5, "coherence": 0.25, "tool_use": 0.25},
    3: {"outcome": 0.4, "coherence": 0.15, "tool_use": 0.15, "reasoning_quality": 0.3},
    4: {"outcome": 0.35, "coherence": 0.1, "tool_use": 0.15, "reasoning_quality": 0.25, "calibration": 0.15},
}


def mean_abs_error(pred: Column, truth: Column) -> Column:
    """Over the truth's properties; null if the prediction lacks one, or if there is none."""
    covered = F.size(F.array_except(F.map_keys(truth), F.map_keys(pred))) == 0

    def of(errors: Column) -> Column:
        return F.try_divide(F.aggregate(errors, F.lit(0.0), lambda a, x: a + x), F.size(errors))

    errors = F.transform(F.map_entries(truth), lambda e: F.abs(F.try_element_at(pred, e["key"]) - e["value"]))
    return F.when(pred.isNotNull() & covered, let(errors, of))


def outcome(pred: Column, truth: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), 1.0 - mean_abs_error(pred, truth)), F.lit(0.0))


def is_correct(pred: Column, truth: Column, tolerance: float = CORRECT) -> Column:
    return F.coalesce(mean_abs_error(pred, truth) <= tolerance, F.lit(False))


def calibration(text: Column, pred: Column, truth: Column, prop: str) -> Column:
    """1 less the squared gap between the expressed confidence and being right; 0.5 where either is missing. A truth that lacks the property raises where both are there."""
    said = confidence(text)
    lacks = F.raise_error(F.concat(F.lit(f"the truth has no {prop}: "), F.coalesce(F.to_json(truth), F.lit("null")))).cast("double")
    true = F.coalesce(F.try_element_at(truth, F.lit(prop)), lacks)
    right = F.when(F.abs(F.try_element_at(pred, F.lit(prop)) - true) <= RIGHT, 1.0).otherwise(0.0)
    known = said.isNotNull() & F.try_element_at(pred, F.lit(prop)).isNotNull()
    return F.when(known, F.greatest(F.lit(0.0), 1.0 - (said - right) * (said - right))).otherwise(0.5)


def no_judge(step: str, context: str | None) -> float:
    raise NotImplementedError("pass a judge: a function of a step and its context that gives a score")


def reasoning_quality(completions: DataFrame, key: str, text: str, judge: Callable[[str, str | None], float] = no_judge, context: str | None = None) -> DataFrame:
    """key, reasoning_quality: the judge's mean score of the steps; 0 without any.

    The judge runs in Arrow batches, once for each distinct step and context; its scores are written before they meet the steps again.
    """

    @F.pandas_udf("double")
    def rate(step: pd.Series, given: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else float(judge(s, c)) for s, c in zip(step, given, strict=True)], dtype="float64")

    given = F.col(context) if context else F.lit(None).cast("string")
    each = completions.select(key, given.alias("__context"), F.explode_outer(steps(tagged(F.col(text), "reasoning"))).alias("__step")).where("__step is not null")
    uses = each.groupBy(key, "__context", "__step").agg(F.count("*").alias("n"))
    rated = written(uses.select("__context", "__step").distinct().withColumn("s", rate("__step", "__context")))
    judged = rated.select(F.col("__context").alias("__c"), F.col("__step").alias("__s"), "s")
    scored = uses.join(judged, uses["__step"].eqNullSafe(judged["__s"]) & uses["__context"].eqNullSafe(judged["__c"])).groupBy(key).agg((F.sum(F.col("s") * F.col("n")) / F.sum(F.when(F.col("s").isNotNull(), F.col("n")))).alias("s"))
    return completions.select(key).distinct().join(scored, key, "left").select(key, F.coalesce("s", F.lit(0.0)).alias("reasoning_quality"))


def reward_columns(completions: DataFrame, text: str, truth: str, prop: str = "strength") -> DataFrame:
    """Adds pred, outcome, coherence, mae, is_correct and calibration."""
    ready = completions.withColumn("pred", answer(F.col(text)))
    pred, true = F.col("pred"), F.col(truth)
    return ready.select(
        "*", outcome(pred, true).alias("outcome"), coherence(F.col(text)).alias("coherence"), mean_abs_error(pred, true).alias("mae"),
        is_correct(pred, true).alias("is_correct"), calibration(F.col(text), pred, true, prop).alias("calibration"),
    )


def staged_reward(stage: int, calibrated: bool = False) -> Column:
    """Weighted sum of the stage's reward columns. Calibration is a separate term: it counts only where asked for."""
    if stage not in STAGES:
        raise ValueError(f"stage must be one of {sorted(STAGES)}, got {stage}")
    parts = [F.col(name) * w for name, w in STAGES[stage].items() if calibrated or name != "calibration"]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def grouped_calibration(completions: DataFrame, prompt: str, order: str) -> DataFrame:
    """prompt, rewards: each prompt's calibration rewards in order. A prompt has few samples."""
    return completions.groupBy(prompt).agg(F.array_sort(F.collect_list(F.struct(order, "calibration"))).alias("s")).select(prompt, F.col("s.calibration").alias("rewards"))
