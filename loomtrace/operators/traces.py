"""From samples to prompts, completions, structured traces and scored pools."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence
from ..functions.text import answer, tagged
from ..sources.completions import complete, fan_out, mock_llm
from ..sources.parts import part
from ..sources.scratch import written
from . import grounding
from .pairs import PairConfig, bucket, build_pairs, diversity, same_answer, summarize
from .rewards import is_correct, mean_abs_error

SYSTEM = (
    "You are asked about a silk protein. Think step by step inside <reasoning> tags, and cite the numbers, positions and "
    'motifs that you use. Then give <answer>{"strength": x, "toughness": y}</answer> with values from 0 to 1, and your confidence.'
)


def _header() -> Column:
    about = F.to_json(F.struct("family", "genus", "species", "protein_category"))
    return F.concat(F.lit(SYSTEM + "\n\nSequence: "), "sequence", F.lit("\nMetadata: "), about)


def tools_json() -> Column:
    """The six tools' outputs as one JSON object, by name in order of calls."""
    return F.concat(*[x for i, n in enumerate(sequence.TOOLS) for x in (F.lit(f'{", " if i else "{"}"{n}": '), grounding.output_json(n))], F.lit("}"))


def tool_table(samples: DataFrame, path: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """seq_key, outputs (JSON) and tools (as ``grounding`` takes them) of each distinct sequence, as a table: the tools run once for each, whatever reads them.

    known: an earlier such table, whose sequences the tools don't run for again.
    """
    keyed = samples.select(sequence_key().alias("seq_key"), "sequence")
    if known is not None:
        # Keys alone are shuffled, and sequences only where some are lacking.
        new = written(keyed.select("seq_key").distinct().join(known.select("seq_key"), "seq_key", "left_anti"))
        return known if new.isEmpty() else known.unionByName(tool_table(keyed.join(new, "seq_key", "left_semi").select("sequence"), path))
    keyed = keyed.dropDuplicates(["seq_key"])
    return written(sequence.with_tools(keyed, "sequence").select("seq_key", tools_json().alias("outputs"), grounding.tool_outputs().alias("tools")), path)


def sequence_key() -> Column:
    return F.sha2(F.col("sequence").cast("binary"), 256)


def with_outputs(rows: DataFrame, tools: DataFrame, *columns: str) -> DataFrame:
    """Rows with columns of the ``tool_table`` of their sequence."""
    return rows.withColumn("seq_key", sequence_key()).join(tools.select("seq_key", *columns), "seq_key").drop("seq_key")


def prompt(outputs: Column | None) -> Column:
    """The prompt of a sample, with the tools' outputs as JSON or without any."""
    return _header() if outputs is None else F.concat(_header(), F.lit("\nTool outputs: "), outputs)


def tool_steps() -> Column:
    """The six calls as steps; the input tells the raw length."""
    return F.array(*[F.struct(F.lit("tool_call").alias("step_type"), F.lit(n).alias("tool_name"), F.length("sequence").alias("sequence_length"), grounding.output_json(n).alias("tool_output"), F.lit(None).cast("string").alias("text")) for n in sequence.TOOLS])


def reasoning(completion: Column) -> Column:
    """What the first reasoning tags hold, trimmed; without tags the whole completion."""
    return F.coalesce(F.trim(tagged(completion, "reasoning")), completion)


def assemble(samples: DataFrame, completion: str = "completion") -> DataFrame:
    """Adds ``trace``: the tool calls, then the reasoning."""
    last = F.struct(F.lit("reasoning").alias("step_type"), F.lit(None).cast("string").alias("tool_name"), F.lit(None).cast("int").alias("sequence_length"), F.lit(None).cast("string").alias("tool_output"), reasoning(F.col(completion)).alias("text"))
    return samples.withColumn("trace", F.concat(tool_steps(), F.array(last)))


def grounded_claims(completed: DataFrame, *keys: str) -> DataFrame:
    """A row for each claim of each completion. completed: with ``tools``."""
    ready = completed.select(*keys, reasoning(F.col("completion")).alias("reasoning"), "tools")
    return grounding.ground(grounding.explode_claims(ready, "reasoning")).drop("tools", "reasoning")


def pilot_batch(samples: DataFrame, key: str, llm: Callable[[str], str] = mock_llm, pause: float = 0.0) -> dict[str, DataFrame]:
    """claims, reports, errors and audit of one trace a sample. Tools' outputs and completions are written before anything reads them: each is made once."""
    tools = tool_table(samples)
    asked = with_outputs(samples, tools, "outputs").select(*samples.columns, prompt(F.col("outputs")).alias("prompt"))
    done = written(complete(asked, "prompt", llm, pause).drop("prompt"))
    claims = written(grounded_claims(with_outputs(done.where("error is null").select(key, "sequence", "completion"), tools, "tools"), key))  # read by the reports and by the sink
    reports = grounding.report(claims, key)
    return {"claims": claims, "reports": reports, "errors": done.where("error is not null").select(key, "error"), "audit": grounding.audit(reports)}


def slots(samples: DataFrame, k_grounded: int, k_shortcut: int) -> DataFrame:
    """A row for each slot of each sample that has a truth. samples: prompt_id, sequence, its metadata and truth."""
    found = fan_out(samples.where(F.size("ground_truth") > 0), k_grounded, k_shortcut)
    return found.withColumn("trace_id", F.concat_ws("/", "prompt_id", "trace_kind", "k"))


def answered(wanted: DataFrame, tools: DataFrame, llm: Callable[[str], str] = mock_llm, pause: float = 0.0) -> DataFrame:
    """The slots with their completion or error. Only grounded slots get the tools' outputs. tools: a ``tool_table``."""
    grounded = with_outputs(wanted.where("trace_kind = 'grounded'"), tools, "outputs").select(*wanted.columns, prompt(F.col("outputs")).alias("prompt"))
    asked = grounded.unionByName(wanted.where("trace_kind <> 'grounded'").select("*", prompt(None).alias("prompt")))
    return complete(asked, "prompt", llm, pause).drop("prompt")


LOTS = 4  # of a pool's part, each in one task


def score(done: DataFrame, tools: DataFrame, tolerance: float = 0.1, dealt: bool = False) -> DataFrame:
    """Answer, grounding and correctness of each completion. tools: the ``tool_table`` of their sequences. dealt: rows come by a pool's parts, so that ``parts.put`` need not move them once more."""
    scores = grounding.report(grounded_claims(with_outputs(done.where("error is null"), tools, "tools"), "trace_id"), "trace_id").select("trace_id", "grounding_score")
    rows = done.select("trace_id", "prompt_id", "trace_kind", "k", "sequence", "protein_category", "ground_truth", "error", F.col("completion").alias("trace_text"), answer(F.col("completion")).alias("final_answer"))
    pred, truth = F.col("final_answer"), F.col("ground_truth")
    judged = rows.withColumn("mae", mean_abs_error(pred, truth)).withColumn("is_correct", is_correct(pred, truth, tolerance))
    if not dealt:
        return judged.join(scores, "trace_id", "left")
    # A trace_id is the prompt's, kind and k, so both sides know the part; what they share is all that is dealt by.
    lot = F.regexp_replace("trace_id", "/[^/]*/[^/]*$", "")
    by_lot = lambda df: df.withColumn("__part", part(lot)).withColumn("__lot", F.pmod(F.hash(lot), F.lit(LOTS))).repartition("__part", "__lot")
    return by_lot(judged).join(by_lot(scores), ["__part", "__lot", "trace_id"], "left").drop("__part", "__lot")


def scored_pool(samples: DataFrame, k_grounded: int, k_shortcut: int, llm: Callable[[str], str] = mock_llm, tolerance: float = 0.1) -> DataFrame:
    tools = tool_table(samples.where(F.size("ground_truth") > 0))
    return score(written(answered(slots(samples, k_grounded, k_shortcut), tools, llm)), tools, tolerance)


def preference_run(pool: DataFrame, config: PairConfig | None = None) -> dict[str, DataFrame]:
    """Buckets, diversity, pairs and their summary of a scored pool."""
    config = config or PairConfig(agree=same_answer(0.05))
    traces = pool.where("error is null").withColumn("bucket", bucket(F.col("grounding_score"), F.col("is_correct"), config.threshold))
    pairs = written(build_pairs(traces, "prompt_id", "trace_id", config))  # read by both summaries and where texts join in
    by_type, total = summarize(pairs)
    return {"traces": traces, "diversity": diversity(traces, "prompt_id"), "pairs": pairs, "pairs_by_type": by_type, "pairs_total": total}


SHORT = 32  # steps of a trace that is checked within its row


def structured_claims(traces: DataFrame, key: str, trace: str = "trace", short: int = SHORT) -> DataFrame:
    """A row for each claim of every reasoning step, with ``step_index``, checked against the tool calls before that step only.

    trace: an array of steps in order, structs of step_type ("tool_call" or "reasoning"), text, and tool (name, numbers, ranges, text and keys, as in
    ``grounding``). The latest tool that has evidence counts. A trace without reasoning steps keeps one row of nulls. Keys are unique.

    In a trace of few steps each step takes along the tools before it; steps and calls of longer ones become rows that meet by trace and value.
    """
    few = F.coalesce(F.size(trace), F.lit(0)) <= short
    within = _claims_within(traces.where(few), key, trace)
    long = traces.where(~few).select(key, F.posexplode(trace).alias("step_index", "step"))
    # Written, since claims and calls meet several times over.
    calls = written(long.where("step.step_type = 'tool_call'").select(key, "step_index", "step.tool"))
    said = long.where("step.step_type = 'reasoning'").select(key, "step_index", F.col("step.text").alias("reasoning"))
    silent = traces.where(~few & ~F.exists(trace, lambda s: s["step_type"] == "reasoning")).select(key, F.lit(None).cast("int").alias("step_index"), F.lit(None).cast("string").alias("reasoning"))
    claimed = written(grounding.explode_claims(said.unionByName(silent), "reasoning").drop("reasoning"))
    return within.unionByName(grounding.ground_asof(claimed, calls, key))


def _claims_within(traces: DataFrame, key: str, trace: str) -> DataFrame:
    steps = F.transform(trace, lambda s, i: F.struct(i.alias("step_index"), s.alias("step")))
    reasoned = F.filter(steps, lambda x: x["step"]["step_type"] == "reasoning")
    before = lambda i: F.transform(F.filter(F.slice(trace, F.lit(1), i), lambda s: s["step_type"] == "tool_call"), lambda s: s["tool"])
    each = F.transform(reasoned, lambda x: F.struct(x["step_index"].alias("step_index"), x["step"]["text"].alias("reasoning"), before(x["step_index"]).alias("tools")))
    rows = traces.select(key, F.explode_outer(each).alias("x")).select(key, "x.*")
    return grounding.ground(grounding.explode_claims(rows, "reasoning")).drop("tools", "reasoning")
