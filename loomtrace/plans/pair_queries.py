"""Buckets, preference pairs, samples and resumption over the bridge traces, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.compat import py_round
from ..operators import pairs
from ..sources import completions, datasets
from ..sources.ledger import complete_once
from ..sources.scratch import scratch, written
from . import bridge

CONFIG = pairs.PairConfig(agree=pairs.same_answer(0.05))


def _bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.traces(spark, sf_dir).withColumn("bucket", pairs.bucket(F.col("grounding_score"), F.col("is_correct"), CONFIG.threshold))


def _pairs(spark: SparkSession, sf_dir: str, config: pairs.PairConfig = CONFIG) -> DataFrame:
    return pairs.build_pairs(_bucketed(spark, sf_dir), "prompt_id", "trace_key", config)


def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bucketed(spark, sf_dir).groupBy("bucket").agg(F.count("*").alias("n"))


def bucket_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.diversity(_bucketed(spark, sf_dir), "prompt_id").withColumn("diverse_fraction", py_round(F.col("diverse_fraction"), 4))


def pairs_budgeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


def pairs_unbounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget of 0 cuts nothing: all pairs of equal answers, and no others."""
    return _pairs(spark, sf_dir, pairs.PairConfig(max_pairs=0, agree=pairs.same_answer(0.05)))


def pairs_with_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grounding and correctness of both sides of each pair."""
    traces = _bucketed(spark, sf_dir)
    full = pairs.with_texts(_pairs(spark, sf_dir), traces, "trace_key")
    return full.select("prompt_id", "pair_type", "chosen_text", "rejected_text", F.col("chosen_meta.correct").alias("chosen_correct"), F.col("chosen_meta.grounding").alias("chosen_grounding"), F.col("rejected_meta.correct").alias("rejected_correct"), F.col("rejected_meta.grounding").alias("rejected_grounding"))


def pair_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.summarize(_pairs(spark, sf_dir))[0]


def pair_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.summarize(_pairs(spark, sf_dir))[1].withColumn("chosen_incorrect_fraction", py_round(F.col("chosen_incorrect_fraction"), 4))


def sample_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample of 100 documents: the sampling operator's own limit."""
    return datasets.sample_seeded(bridge.table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), 100, 0, "doc_id")


def slots_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = bridge.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("prompt_id"))
    return completions.fan_out(prompts, 2, 1)


def _prior(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    prompts = bridge.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("prompt_id"), F.col("o_orderpriority").alias("sequence"))
    slots = completions.fan_out(prompts, 2, 1)
    failed = F.pmod(F.col("prompt_id") * 3 + F.col("k") + F.when(F.col("trace_kind") == "grounded", 0).otherwise(2), F.lit(7)) == 0
    return slots, slots.where(~failed), slots.where(failed).select(*completions.SLOT)


def resume_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completions.resume(*_prior(spark, sf_dir))[0]


def resume_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = completions.resume(*_prior(spark, sf_dir))[1]
    return kept.groupBy("trace_kind", "k").agg(F.count("*").alias("n"))


def _flaky() -> Callable[[str], str]:
    """Fails as often as the prompt's number modulo 4 tells, and then answers. Calls for a prompt follow one another, so the last prompt is all it remembers."""
    asked, times = "", 0

    def call(prompt: str) -> str:
        nonlocal asked, times
        times = times + 1 if prompt == asked else 1
        asked = prompt
        if times <= int(prompt.split()[1]) % 4:
            raise ConnectionError(f"no answer to {prompt}")
        return f"answer to {prompt}"

    return call


def ask_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of a sampled order's prompts, asked through a connector that fails at times; asked again from the ledger, with a connector that is gone."""
    slots = slots_fan_out(spark, sf_dir).withColumn("prompt", F.concat_ws(" ", F.lit("order"), "prompt_id", "trace_kind", "k"))
    ledger = scratch(spark)
    written(complete_once(slots, "prompt", completions.SLOT, ledger, _flaky(), retries=3, base_delay=0.0, buckets=16, every=500))
    return complete_once(slots, "prompt", completions.SLOT, ledger, completions.no_llm, buckets=16).drop("prompt")


_T = f"WITH {bridge.TRACES}"


def _rnd(kind: str) -> str:
    return f"md5('0:{kind}:' || a.trace_key || ':' || b.trace_key)"


_AGREE = "abs(a.strength - b.strength) <= 0.05::DOUBLE AND abs(a.toughness - b.toughness) <= 0.05::DOUBLE"


def _cand(kind: str, chosen: str, rejected: str, where: str = "true") -> str:
    return f"SELECT a.prompt_id, '{kind}' AS pair_type, a.trace_key AS chosen, b.trace_key AS rejected, {_rnd(kind)} AS rnd FROM bucketed a JOIN bucketed b ON a.prompt_id = b.prompt_id AND a.bucket = '{chosen}' AND b.bucket = '{rejected}' WHERE {where}"


def _moved(n: str, turn: int, side: str, other: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', '0', pair_type, prompt_id, '{turn}', '{side}', {other})), 1, 8))::BIGINT % {n}"


def _rounds() -> str:
    """The permutation of ``pairs.permuted``, a table for each half of a round."""
    out, last = [], "r0"
    for turn in range(pairs.ROUNDS):
        for side, n, other in (("i", "p", "j"), ("j", "d", "i")):
            name = f"r{turn}{side}"
            out.append(f"{name} AS (SELECT * REPLACE (({side} + {_moved(n, turn, side, other)}) % {n} AS {side}) FROM {last})")
            last = name
    return ", ".join([*out, f"moved AS (SELECT * FROM {last})"])


_LIMITED = " UNION ALL ".join(f"SELECT prompt_id, n_same, '{name}' AS pair_type, {place} AS place, '{a}' AS a_bucket, '{b}' AS b_bucket, n_{a} AS p, n_{b} AS d FROM sizes" for place, (name, a, b) in enumerate(pairs.LIMITED))
_PAIRS = f"""{_T}, same AS ({_cand("same_answer", "grounded_correct", "shortcut_correct", _AGREE)}),
same_n AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY rnd, chosen, rejected) AS n FROM same),
spot AS (SELECT prompt_id, bucket, trace_key, row_number() OVER (PARTITION BY prompt_id, bucket ORDER BY substr(md5(trace_key), 1, 2), trace_key) - 1 AS place FROM bucketed),
sizes AS (SELECT prompt_id, coalesce(any_value(s.n_same), 0) AS n_same, {", ".join(f"count(*) FILTER (bucket = '{b}') AS n_{b}" for b in ("grounded_correct", "shortcut_correct", "grounded_incorrect", "shortcut_incorrect"))}
  FROM bucketed LEFT JOIN (SELECT prompt_id, count(*) AS n_same FROM same GROUP BY 1) s USING (prompt_id) GROUP BY prompt_id),
kinds AS (SELECT *, p * d AS every, greatest(0, 3 - n_same) AS remaining FROM ({_LIMITED})),
standard AS (SELECT prompt_id, least(remaining, every) AS n FROM kinds WHERE place = 1),
limits AS (SELECT kinds.*, CASE place WHEN 0 THEN least(1, every) WHEN 1 THEN standard.n ELSE least(remaining - standard.n, every) END AS k FROM kinds JOIN standard USING (prompt_id)),
r0 AS (SELECT *, r // d AS i, r % d AS j FROM (SELECT *, unnest(range(k)) AS r FROM limits WHERE k > 0)), {_rounds()},
cand AS (SELECT prompt_id, 'same_answer' AS pair_type, chosen, rejected, -1 AS place, n FROM same_n UNION ALL SELECT m.prompt_id, pair_type, a.trace_key, b.trace_key, m.place, r FROM moved m
  JOIN spot a ON a.prompt_id = m.prompt_id AND a.bucket = a_bucket AND a.place = i JOIN spot b ON b.prompt_id = m.prompt_id AND b.bucket = b_bucket AND b.place = j),
pairs AS (SELECT prompt_id, pair_type, chosen, rejected, pair_rank FROM (SELECT *, (row_number() OVER (PARTITION BY prompt_id ORDER BY place, n))::INT AS pair_rank FROM cand) WHERE pair_rank <= 4)"""
_SLOTS = """WITH slots AS (SELECT o_orderkey AS prompt_id, o_orderpriority AS sequence, s.trace_kind, s.k FROM orders, (VALUES ('grounded', 0, 0), ('grounded', 1, 0), ('shortcut', 0, 2)) s(trace_kind, k, plus)),
f AS (SELECT *, (prompt_id * 3 + k + CASE trace_kind WHEN 'grounded' THEN 0 ELSE 2 END) % 7 = 0 AS failed FROM slots)"""

ORACLES = {
    "bucket_counts": f"{_T} SELECT bucket, count(*) AS n FROM bucketed GROUP BY bucket",
    "bucket_diversity": f"""{_T}, d AS (SELECT prompt_id, count(DISTINCT bucket) AS n FROM bucketed GROUP BY 1) SELECT count(*) AS n_prompts, count(*) FILTER (n > 1) AS n_diverse,
printf('%.4f', count(*) FILTER (n > 1) / count(*))::DOUBLE AS diverse_fraction FROM d""",
    "pairs_budgeted": f"{_PAIRS} SELECT * FROM pairs",
    "pairs_unbounded": f"{_T}, s AS ({_cand('same_answer', 'grounded_correct', 'shortcut_correct', _AGREE)}) SELECT prompt_id, pair_type, chosen, rejected, (row_number() OVER (PARTITION BY prompt_id ORDER BY rnd, chosen, rejected))::INT AS pair_rank FROM s",
    "pairs_with_meta": f"""{_PAIRS} SELECT p.prompt_id, pair_type, 'trace ' || chosen AS chosen_text, 'trace ' || rejected AS rejected_text, a.is_correct AS chosen_correct, a.grounding_score AS chosen_grounding,
b.is_correct AS rejected_correct, b.grounding_score AS rejected_grounding FROM pairs p JOIN traces a ON a.trace_key = chosen JOIN traces b ON b.trace_key = rejected""",
    "pair_summary": f"{_PAIRS} SELECT pair_type, count(*) AS n_pairs FROM pairs GROUP BY 1",
    "pair_totals": f"{_PAIRS} SELECT count(*) AS n_pairs, printf('%.4f', count(*) FILTER (pair_type = 'anti_shortcut') / count(*))::DOUBLE AS chosen_incorrect_fraction FROM pairs",
    "sample_seeded": "SELECT doc_id, lang, source FROM documents ORDER BY md5('0:' || doc_id::VARCHAR), doc_id LIMIT 100",
    "slots_fan_out": f"{_SLOTS} SELECT prompt_id, trace_kind, k FROM slots",
    "ask_ledger": f"""{_SLOTS}, a AS (SELECT prompt_id, trace_kind, k, concat_ws(' ', 'order', prompt_id, trace_kind, k) AS prompt FROM slots)
SELECT prompt_id, trace_kind, k, CASE WHEN prompt_id % 4 < 3 THEN 'answer to ' || prompt END AS completion, CASE WHEN prompt_id % 4 = 3 THEN 'ConnectionError: no answer to ' || prompt END AS error, least(3, prompt_id % 4 + 1)::INT AS attempts FROM a""",
    "resume_slots": f"{_SLOTS} SELECT prompt_id, sequence, trace_kind, k FROM f WHERE failed",
    "resume_kept": f"{_SLOTS} SELECT trace_kind, k, count(*) AS n FROM f WHERE NOT failed GROUP BY 1, 2",
}
QUERIES = [bucket_counts, bucket_diversity, pairs_budgeted, pairs_unbounded, pairs_with_meta, pair_summary, pair_totals, sample_seeded, slots_fan_out, ask_ledger, resume_slots, resume_kept]
