"""Completions from an injected function, with retries, and their resumption."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RETRIES, BASE_DELAY = 3, 2.0


class NotConfigured(RuntimeError):
    """The connector lacks its key or address: never retried, and it ends the run."""


def no_llm(prompt: str) -> str:
    raise NotConfigured("pass a function from prompt to completion")


def mock_llm(prompt: str) -> str:
    """One claim that tools bear out for most sequences, and one that none does."""
    return (
        "<reasoning>The sequence shows a glycine-rich spacer. Because of that, the value 98765.4 at residue 9876 stands out."
        '</reasoning>\n<answer>{"strength": 0.5, "toughness": 0.5}</answer> confidence: 60%'
    )


def with_retry(call: Callable[[str], str], retries: int = RETRIES, base_delay: float = BASE_DELAY, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """The call, tried again after growing pauses; the last error is chained."""

    def tried(prompt: str) -> str:
        last: Exception | None = None
        for attempt in range(retries):
            try:
                return call(prompt)
            except NotConfigured:
                raise
            except Exception as e:  # noqa: BLE001
                last = e
                sleep(base_delay * 2**attempt)
        raise RuntimeError(f"no completion after {retries} tries") from last

    return tried


def complete(slots: DataFrame, prompt: str, call: Callable[[str], str] = no_llm, pause: float = 0.0) -> DataFrame:
    """Adds completion and error; a failing row gets its error and the others go on.

    Write the result before anything else reads it: a task that runs again asks again.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts: list[str | None] = []
            errors: list[str | None] = []
            for p in part[prompt]:
                try:
                    texts.append(call(p))
                    errors.append(None)
                except NotConfigured:
                    raise
                except Exception as e:  # noqa: BLE001
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
                if pause:
                    time.sleep(pause)
            yield part.assign(completion=texts, error=errors)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slots.schema.fields)
    return slots.mapInPandas(run, f"{fields}, completion string, error string")


def fan_out(prompts: DataFrame, k_grounded: int, k_shortcut: int) -> DataFrame:
    """A row for each prompt, kind of trace and k; a kind of no samples gives none."""
    kinds = [F.struct(F.lit(kind).alias("trace_kind"), F.lit(k).alias("k")) for kind, n in (("grounded", k_grounded), ("shortcut", k_shortcut)) for k in range(n)]
    if not kinds:
        return prompts.select("*", F.lit("").alias("trace_kind"), F.lit(0).alias("k")).limit(0)
    return prompts.select("*", F.explode(F.array(*kinds)).alias("slot")).select(*prompts.columns, "slot.trace_kind", "slot.k")


SLOT = ["prompt_id", "trace_kind", "k"]


def resume(slots: DataFrame, prior: DataFrame, errors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Slots to run again (those in errors), and the prior rows to keep. Raises if a prior row's sequence is not its prompt's."""
    digest = F.sha2(F.col("sequence").cast("string").cast("binary"), 256)  # sequences may be long: only these are shuffled
    given, had = (df.select("prompt_id", digest.alias(name)).distinct() for df, name in ((slots, "s"), (prior, "p")))
    odd = had.join(given, "prompt_id").where("p <> s")
    if odd.take(1):
        raise ValueError("the prior run was made from other sequences")
    return slots.join(errors.select(*SLOT).distinct(), SLOT, "left_semi"), prior.join(errors.select(*SLOT), SLOT, "left_anti")
