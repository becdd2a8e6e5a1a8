"""The three runs as functions: pilot batch, preference pairs, and comparison of predictors."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.compat import seeded
from ..functions.sequence import with_tools
from ..sources import completions, datasets, parts, sinks
from ..sources.scratch import written
from . import grounding, pairs, stats, traces

TARGETS = ("strength", "toughness")
KINDS = ("grounded", "shortcut")


def _numbered(samples: DataFrame, seed: int) -> DataFrame:
    """prompt_id by place in the seeded order."""
    order = ["__rnd", "sequence", "family", "genus", "species", "protein_category"]
    placed = stats.numbered(samples.withColumn("__rnd", seeded(seed, F.col("sequence"))), "__place", *order)
    return placed.select(*samples.columns, F.concat(F.lit("sample_"), F.col("__place").cast("string")).alias("prompt_id"))


def _batch(spark: SparkSession, data_path: str | None, n: int, seed: int, need_truth: bool) -> DataFrame:
    samples = datasets.load_dataset(spark, data_path)[0] if data_path else datasets.demo(spark)
    samples = datasets.with_truth(samples) if need_truth else samples
    return _numbered(datasets.sample_seeded(samples, n, seed, "sequence"), seed)


def run_pilot(spark: SparkSession, data_path: str | None = None, n_samples: int = 200, output: str | None = None, llm: Callable[[str], str] = completions.no_llm, seed: int = 0, pause: float = 0.0, max_retries: int = 3) -> dict[str, DataFrame]:
    """Traces of a seeded sample, grounded and audited; written as JSON where an output is given."""
    batch = _batch(spark, data_path, n_samples, seed, need_truth=False).withColumnRenamed("prompt_id", "trace_id")
    call = llm if llm is completions.mock_llm else completions.with_retry(llm, max_retries)
    run = traces.pilot_batch(batch, "trace_id", call, pause)
    run["by_kind"] = grounding.audit_by_kind(run["claims"])
    run["worst"] = grounding.worst_traces(run["reports"], "trace_id")
    if output:
        sinks.write_pilot(output, run["reports"], run["claims"], run["errors"], run["audit"])
    return run


def run_pairs(
    spark: SparkSession,
    output: str,
    data_path: str | None = None,
    n_prompts: int = 20,
    k_samples: int = 4,
    k_shortcut_samples: int = 4,
    llm: Callable[[str], str] = completions.no_llm,
    seed: int = 0,
    pause: float = 0.0,
    max_retries: int = 3,
    correctness_tolerance: float = 0.1,
    config: pairs.PairConfig | None = None,
    resume_from: str | None = None,
) -> dict[str, DataFrame]:
    """A scored pool and its preference pairs, written to the output. resume_from: an earlier output of the same
    settings, whose rows are kept and of which only failed slots run again."""
    if resume_from and resume_from.rstrip("/") == output.rstrip("/"):
        raise ValueError("resume_from must not be the output: it is read while the output is written")
    batch = _batch(spark, data_path, n_prompts, seed, need_truth=True)
    call = llm if llm is completions.mock_llm else completions.with_retry(llm, max_retries)
    settings = {"n_prompts": n_prompts, "k_samples": k_samples, "k_shortcut_samples": k_shortcut_samples}
    slots = traces.slots(batch, k_samples, k_shortcut_samples)
    kept = None
    if resume_from:
        sinks.check_same_run(spark, resume_from, **settings)
        prior = sinks.read_pool(spark, resume_from, "pool")[0]
        slots, kept = completions.resume(slots, prior, prior.where("error is not null"))
    # What the model said is written before it is scored, so that no later failure asks again.
    tools = traces.tool_table(slots)
    done = written(traces.answered(slots, tools, call, pause), f"{output}/completions")
    pool = traces.score(done, tools, correctness_tolerance)
    pool = pool.unionByName(kept) if kept is not None else pool
    pool.write.mode("overwrite").parquet(f"{output}/pool")
    pool = spark.read.parquet(f"{output}/pool")
    run = traces.preference_run(pool, config)
    sinks.write_pool(output, settings, pool_tables(pool, run))
    return run | {"pool": pool}


def pool_tables(pool: DataFrame, run: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables that are kept of a scored pool and its ``traces.preference_run``."""
    full = pairs.with_texts(run["pairs"], run["traces"], "trace_id")
    return {"pairs": full, "diversity": run["diversity"], "pairs_by_type": run["pairs_by_type"], "pairs_total": run["pairs_total"], "errors": pool.where("error is not null").select(*completions.SLOT, "error")}


def _tools(path: str) -> str:
    """Where a pool keeps its sequences' tool outputs."""
    return f"{path}/tools"


def start_pool(spark: SparkSession, path: str, slots: DataFrame, llm: Callable[[str], str] = completions.no_llm, settings: dict | None = None, tolerance: float = 0.1, config: pairs.PairConfig | None = None) -> None:
    """Answers and scores slots into a folder that ``backfill`` can complete in place (see ``sources.parts``). The tools' outputs stay beside it."""
    tools = traces.tool_table(slots, _tools(path))
    pool = traces.score(written(traces.answered(slots, tools, llm)), tools, tolerance, dealt=True)
    parts.put(spark, path, {"pool": pool}, "prompt_id", settings or {}, dealt=True, more=lambda held: pool_tables(held["pool"], traces.preference_run(held["pool"], config)))


def backfill(spark: SparkSession, path: str, slots: DataFrame, llm: Callable[[str], str] = completions.no_llm, settings: dict | None = None, tolerance: float = 0.1, config: pairs.PairConfig | None = None) -> int:
    """Asks for the slots that failed once more, and tells how many these were. slots: those of the whole run, which must be as they were.

    Only parts of the pool with a failed slot are written anew; what is kept is not scored again, and the tools run only for sequences that the pool's table of outputs lacks. The tables made from the pool follow, and all of them change at once.
    """
    had = parts.manifest(spark, path)["settings"]
    for name, value in (settings or {}).items():
        if had.get(name) != value:
            raise ValueError(f"the prior run had {name}={had.get(name)}, not {value}")
    prior = parts.read(spark, path, "pool")
    failed = written(prior.where("error is not null").select(*completions.SLOT))
    todo, kept = completions.resume(slots, prior, failed)
    well = prior.where("error is null")
    if not well.select(*completions.SLOT).join(failed, completions.SLOT, "left_semi").take(1):
        # No slot has both kinds of rows: what is kept is then told row by row, without a shuffle. A slot that lacks a key is never asked again.
        kept = prior.where(" or ".join(f"{c} is null" for c in ("error", *completions.SLOT)))
    touched = [r[0] for r in failed.select(parts.part(F.col("prompt_id"))).distinct().collect()]  # PARTS at most
    if not touched:
        return 0
    todo = written(todo)
    tools = traces.tool_table(todo, known=spark.read.parquet(_tools(path)) if parts.exists(spark, _tools(path)) else None)
    new = traces.score(written(traces.answered(todo, tools, llm)), tools, tolerance, dealt=True)
    filled = kept.where(parts.part(F.col("prompt_id")).isin(touched)).unionByName(new)
    parts.put(spark, path, {"pool": filled}, "prompt_id", only={"pool": touched}, dealt=True, more=lambda held: pool_tables(held["pool"], traces.preference_run(held["pool"], config)))
    return failed.count()


def compare(answers: DataFrame, fitted: dict[str, DataFrame], dataset: DataFrame, reps: int = stats.REPS, tolerance: float = 0.1, seed: int = 0) -> DataFrame:
    """section, label, target, metric, value: rank correlations with intervals, length diagnostics, absolute errors, and shares within tolerance.

    answers: seq, kind and both targets of each trace. fitted: by name, seq, truths (strength, log10_toughness) and out-of-fold
    predictions; the first gives the truth. dataset: seq, strength_norm and toughness_norm. Sequences count that all of them
    have; fitted inputs must not repeat one.
    """
    # Written: the checks of keys, the ranges' bounds and both kinds read it, and the traces are read once.
    means = written(answers.groupBy("seq", "kind").agg(*[F.avg(t).alias(t) for t in TARGETS]))
    wide = None
    for kind in KINDS:
        side = means.where(F.col("kind") == kind).select("seq", *[F.col(t).alias(f"{kind}_{t}") for t in TARGETS])
        wide = side if wide is None else wide.join(side, "seq")
    for i, (name, f) in enumerate(fitted.items()):
        truth = [F.col("strength").alias("truth_strength"), F.col("log10_toughness").alias("truth_toughness")] if i == 0 else []
        wide = stats.align(wide, f.select("seq", *truth, F.col("pred_strength").alias(f"{name}_strength"), F.col("pred_log10_toughness").alias(f"{name}_toughness")), "seq")
    wide = stats.numbered(wide.withColumn("length", F.length("seq").cast("double")), "item", "seq")
    labels = [*KINDS, *fitted, "length"]
    pred = lambda label, t: F.col("length") if label == "length" else F.col(f"{label}_{t}")
    cells = [F.struct(F.lit(label).alias("label"), F.lit(t).alias("target"), pred(label, t).alias("pred"), F.col(f"truth_{t}").alias("truth")) for label in labels for t in TARGETS]
    long = wide.select("item", "length", F.explode(F.array(*cells)).alias("c")).select("item", "length", "c.*")
    by = ("label", "target")
    llm = long.where(F.col("label").isin(*KINDS))
    # All correlations rank together: a group is one of them.
    sides = [("spearman", "rho", "pred", "truth"), ("length", "pred_vs_length", "pred", "length"), ("length", "truth_vs_length", "truth", "length")]
    each = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(m).alias("metric"), F.col(a).alias("a"), F.col(b).alias("b")) for s, m, a, b in sides])
    both = long.select(*by, F.explode(each).alias("x")).select(*by, "x.*").where((F.col("section") == "spearman") | F.col("label").isin(*KINDS))
    rho = written(stats.spearman(both, "a", "b", *by, "section", "metric"))
    out = [(rho.where(F.col("metric") == m).withColumnRenamed("rho", m), s, [m, "n"] if s == "spearman" else [m]) for s, m, _, _ in sides]
    out += [
        (stats.bootstrap_spearman(long, "pred", "truth", "item", *by, reps=reps, seed=seed), "spearman", ["ci_low", "ci_high"]),
        (stats.partial_spearman(llm, "pred", "truth", "length", *by), "length", ["partial_rho"]),
        (stats.bootstrap_partial(llm, "pred", "truth", "length", "item", *by, reps=reps, seed=seed), "length", ["ci_low", "ci_high"]),
    ]
    data = dataset.select(F.upper("seq").alias("seq"), *[F.col(f"{t}_norm").alias(f"norm_{t}") for t in TARGETS])
    inside, rest = stats.holdout(data, wide, "seq")
    judged = wide.join(inside.groupBy("seq").agg(*[F.avg(f"norm_{t}").alias(f"norm_{t}") for t in TARGETS]), "seq")
    judged = judged.crossJoin(F.broadcast(rest.agg(*[F.avg(f"norm_{t}").alias(f"mean_{t}") for t in TARGETS])))  # one row
    guess = {"constant_mean": lambda t: F.col(f"mean_{t}")} | {k: (lambda t, k=k: F.col(f"{k}_{t}")) for k in KINDS}
    errors = {(label, t): F.abs(F.col(f"norm_{t}") - g(t)) for label, g in guess.items() for t in TARGETS}
    maes = [F.struct(F.lit(label).alias("label"), F.lit(t).alias("target"), F.avg(e).alias("mae")) for (label, t), e in errors.items()]
    out.append((judged.agg(F.array(*maes).alias("m")).select(F.explode("m").alias("m")).select("m.*"), "absolute_error", ["mae"]))
    shares = [F.struct(F.lit(label).alias("label"), F.lit("both").alias("target"), F.avg((((errors[label, "strength"] + errors[label, "toughness"]) / 2) <= tolerance).cast("double")).alias("share")) for label in guess]
    out.append((judged.agg(F.array(*shares).alias("m")).select(F.explode("m").alias("m")).select("m.*"), "within_tolerance", ["share"]))
    rows = [df.select(F.lit(section).alias("section"), *by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select("section", *by, "x.*") for df, section, metrics in out]
    return reduce(DataFrame.unionByName, rows)


def read_comparison_inputs(spark: SparkSession, pool_json: str, fitted_csv: dict[str, str], dataset_csv: str) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """The inputs of ``compare`` from their files."""
    csv = lambda path: spark.read.option("header", True).csv(path)
    number = lambda df, names: df.select("seq", *[F.col(c).try_cast("double").alias(c) for c in names])
    fitted = {name: number(csv(path), ["strength", "log10_toughness", "pred_strength", "pred_log10_toughness"]) for name, path in fitted_csv.items()}
    return sinks.read_scored_traces(spark, pool_json), fitted, number(csv(dataset_csv), ["strength_norm", "toughness_norm"])


def show_tools(spark: SparkSession, sequence: str) -> None:
    """Prints the tools' outputs for one sequence."""
    with_tools(spark.createDataFrame([(sequence,)], "s string"), "s").drop("s").show(vertical=True, truncate=False)

