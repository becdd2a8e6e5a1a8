"""Claims, grounding, rewards and calibration over the bridge completions, with SQL that knows the parts they are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence
from ..functions.compat import py_round
from ..functions.text import answer, coherence, confidence, steps, tagged
from ..operators import grounding, rewards, traces
from ..sources.scratch import written
from . import bridge, sequence_queries


#: What ``ground_tools`` claims: values of tools, times a factor by id.
CLAIMED = [("hydropathy_profile", "mean_hydropathy"), ("beta_sheet_propensity", "mean_beta_propensity"), ("disorder_prediction_chplot", "boundary_value"), ("repeat_pattern_analyzer", "repeat_score"), ("motif_detector", "sequence_length"), ("charge_profile", "positive_residues")]
OFF = [1.0, 1.029, 1.031, 0.5]


def _claims(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    rows = grounding.explode_claims(bridge.completions(spark, sf_dir).select("id", "body"), "body")
    return rows.where(F.col("kind") == kind)


def claims_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claims(spark, sf_dir, "numeric").select("id", "raw", "num", "role")


def claims_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claims(spark, sf_dir, "position").select("id", "raw", "lo", "hi", "role")


def claims_motif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claims(spark, sf_dir, "motif").select("id", "raw", "term", "role")


def claim_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grounding.explode_claims(bridge.completions(spark, sf_dir).select("id", "body"), "body")
    return rows.where("kind is not null").groupBy("kind", "role").agg(F.count("*").alias("n"))


def _grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.ground(grounding.explode_claims(bridge.facts(spark, sf_dir).select("id", "body", "tools"), "body")).drop("tools", "body")


def ground_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _grounded(spark, sf_dir).where("kind = 'numeric'")
    return rows.select("id", "num", "grounded", "evidence_tool", py_round(F.col("matched"), 4).alias("matched"), py_round(F.col("diff"), 4).alias("diff"))


def ground_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grounded(spark, sf_dir).where("kind = 'position'").select("id", "lo", "hi", "grounded", "evidence_tool")


def ground_motif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grounded(spark, sf_dir).where("kind = 'motif'").select("id", "term", "grounded", "evidence_tool")


def trace_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = grounding.report(_grounded(spark, sf_dir), "id")
    return r.withColumn("grounding_score", py_round(F.col("grounding_score"), 4)).withColumn("contrastive_score", py_round(F.col("contrastive_score"), 4))


def batch_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = grounding.audit(grounding.report(_grounded(spark, sf_dir), "id"))
    return a.select("n_traces", *[py_round(F.col(c), 4).alias(c) for c in ("mean_grounding_score", "fully_grounded_fraction")], "n_contrastive_mentions", py_round(F.col("contrastive_ungrounded_fraction"), 4).alias("contrastive_ungrounded_fraction"))


def audit_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.audit_by_kind(_grounded(spark, sf_dir))


def worst_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = grounding.worst_traces(grounding.report(_grounded(spark, sf_dir), "id"), "id")
    return w.select("id", py_round(F.col("grounding_score"), 4).alias("grounding_score"))


def trace_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bridge.completions(spark, sf_dir)
    return rows.select("id", traces.reasoning(F.col("completion")).alias("reasoning"))


def reasoning_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.completions(spark, sf_dir).select("id", F.greatest(F.size(steps(tagged(F.col("completion"), "reasoning"))), F.lit(0)).alias("n_steps"), py_round(coherence(F.col("completion")), 4).alias("coherence"))


def answer_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bridge.completions(spark, sf_dir).select("id", answer(F.col("completion")).alias("m"))
    return got.select("id", F.col("m").isNotNull().alias("parsed"), F.try_element_at("m", F.lit("strength")).alias("strength"), F.try_element_at("m", F.lit("toughness")).alias("toughness"))


def outcome_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rewards.reward_columns(bridge.completions(spark, sf_dir), "completion", "truth")
    return rows.select("id", py_round(F.col("outcome"), 4).alias("outcome"), py_round(F.col("mae"), 4).alias("mae"), F.col("is_correct"))


def expressed_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.completions(spark, sf_dir).select("id", confidence(F.col("completion")).alias("confidence"))


def calibration_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rewards.reward_columns(bridge.completions(spark, sf_dir), "completion", "truth")
    return rows.select("id", py_round(F.col("calibration"), 4).alias("calibration"))


def calibration_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration rewards of each prompt's samples, in order; four documents count as one prompt."""
    rows = rewards.reward_columns(bridge.completions(spark, sf_dir), "completion", "truth").withColumn("prompt", F.expr("id div 4"))
    said = F.transform("rewards", lambda x: F.call_function("format_number", x, F.lit("0.0000")))
    return rewards.grouped_calibration(rows, "prompt", "id").select("prompt", F.array_join(said, ",").alias("rewards"))


def _rewarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rewards.reward_columns(bridge.completions(spark, sf_dir), "completion", "truth")
    score = grounding.report(_grounded(spark, sf_dir), "id").select("id", F.col("grounding_score").alias("tool_use"))
    return rows.join(score, "id")


def staged_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rewarded(spark, sf_dir).select("id", *[py_round(rewards.staged_reward(s), 3).alias(f"stage_{s}") for s in (1, 2)])


def staged_reward_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages 3 and 4 with a judge that rates a step by its length."""
    rows = _rewarded(spark, sf_dir)
    judged = rewards.reasoning_quality(bridge.completions(spark, sf_dir), "id", "completion", judge=lambda step, _: min(1.0, len(step) / 100))
    return rows.join(judged, "id").select("id", *[py_round(rewards.staged_reward(s, calibrated=True), 3).alias(f"stage_{s}") for s in (3, 4)])


def seq_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.validate(spark).drop("detail")


def validation_passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.passed_fraction(sequence.validate(spark))


#: The motifs of ``bridge.BLOCKS``, which sequences have at both ends; and letters without which a motif can't be.
PLANTED = [["poly_alanine"], ["GGX_repeat", "glycine_rich_spacer"], ["GPGXX_repeat"], ["proline_rich_turn"], []]
NEEDED = {"poly_alanine": "AAA", "GGX_repeat": "GG", "GPGXX_repeat": "GPG"}


def planted_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the motifs at a sequence's ends are detected, and those whose letters it lacks are not."""
    rows = bridge.silk(spark, sf_dir).where("id >= 0")
    lists = F.array(*[F.array(*[F.lit(m) for m in block]).cast("array<string>") for block in PLANTED])
    lacking = F.array_compact(F.array(*[F.when(~F.col("seq").contains(letters), F.lit(m)) for m, letters in NEEDED.items()]))
    return sequence.expectations(rows.withColumns({"wanted": F.get(lists, (F.col("id") % 5).cast("int")), "unwanted": lacking}), "id", "seq", "wanted", "unwanted")


def planted_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.passed_fraction(planted_checks(spark, sf_dir))


def ground_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims made from the tools' own values, some off by 2.9 or 3.1 % or by half, and spans moved by up to four residues, against the tools' outputs as nested JSON."""
    rows = sequence.with_tools(bridge.silk(spark, sf_dir), "seq")
    off = F.element_at(F.array(*[F.lit(x) for x in OFF]), (F.pmod("id", F.lit(4)) + 1).cast("int"))
    said = lambda tool, field: F.call_function("format_number", F.col(tool)[field].cast("double") * off, F.lit("0.0000"))
    numbers = F.concat(*[x for tool, field in CLAIMED for x in (F.lit(f"The {field.replace('_', ' ')} is "), said(tool, field), F.lit(". "))])
    span, by = F.col("hydropathy_profile")["most_hydrophobic_span"], (F.pmod("id", F.lit(3)) * 2).cast("int")
    where = F.when(span["hi"] + by < 10000, F.concat(F.lit("So residues "), (span["lo"] + by).cast("string"), F.lit("-"), (span["hi"] + by).cast("string"), F.lit(" fold."))).otherwise("")
    body = F.concat(numbers, F.coalesce(where, F.lit("")), F.lit(" It has a poly-alanine run and an amorphous region."))
    called = written(rows.select("id", body.alias("body"), F.array(*[F.struct(F.lit(n).alias("name"), grounding.output_json(n).alias("output")) for n in sequence.TOOLS]).alias("outputs")))
    opened = called.select("id", "body", F.transform("outputs", lambda o: grounding.facts(o["name"], o["output"])).alias("tools"))
    claims = grounding.ground(grounding.explode_claims(opened, "body")).where("kind <> 'numeric' or raw like '%.%'")
    return claims.select("id", "kind", "claim_ord", "grounded", "evidence_tool", py_round(F.col("diff"), 4).alias("diff"))


def interleaved_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces of a reasoning step before, between and after two tool calls: each step knows only the tools before it."""
    return _interleaved(spark, sf_dir, short=traces.SHORT)


def _interleaved(spark: SparkSession, sf_dir: str, short: int) -> DataFrame:
    rows = bridge.facts(spark, sf_dir)
    tool = lambda i: F.struct(F.lit("tool_call").alias("step_type"), F.lit(None).cast("string").alias("text"), F.get("tools", F.lit(i)).alias("tool"))
    none = F.get("tools", F.lit(9))
    said = F.struct(F.lit("reasoning").alias("step_type"), F.col("body").alias("text"), none.alias("tool"))
    claims = traces.structured_claims(rows.select("id", F.array(said, tool(0), said, tool(1), said).alias("trace")), "id", short=short)
    return claims.where("kind is not null").select("id", "step_index", "kind", "claim_ord", "grounded", "evidence_tool")


def interleaved_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same traces, with their steps as rows that meet by trace and value."""
    return _interleaved(spark, sf_dir, short=0)


def mock_pilot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain over the bridge sequences: tools, prompt, injected completion, claims, grounding, report."""
    samples = bridge.silk(spark, sf_dir).select("id", F.col("seq").alias("sequence"), *[F.lit("").alias(c) for c in ("family", "genus", "species", "protein_category")])
    return traces.pilot_batch(samples, "id")["reports"]


def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = bridge.silk(spark, sf_dir).select("id", F.col("seq").alias("sequence"), *[F.lit("").alias(c) for c in ("family", "genus", "species", "protein_category")])
    return sequence.with_tools(samples, "sequence").select("id", traces.prompt(traces.tools_json()).alias("prompt"), traces.prompt(None).alias("shortcut_prompt"))


#: What ``prompt_fields`` reads of the tools' outputs.
OUTPUTS = """motif_detector struct<spans:map<string,array<array<int>>>,sequence_length:int>, hydropathy_profile struct<mean_hydropathy:double,window_size:int,most_hydrophobic_span:array<int>,min_window_value:double>,
charge_profile struct<positive_residues:int,net_charge:int>, beta_sheet_propensity struct<mean_beta_propensity:double,mean_turn_propensity:double,beta_rich_spans:array<array<int>>>,
repeat_pattern_analyzer struct<dominant_period:int,repeat_score:double,example_repeat_unit:string>, disorder_prediction_chplot struct<boundary_value:double,predicted_disordered:boolean>"""


def prompt_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both prompts, read back: the sequence's line, the metadata's and the tools' JSON, and whether the shortcut is the prompt without tools."""
    family = F.concat(F.lit('a "family"\n'), F.pmod("id", F.lit(4)).cast("string"))
    samples = bridge.silk(spark, sf_dir).select("id", F.col("seq").alias("sequence"), family.alias("family"), *[F.lit("").alias(c) for c in ("genus", "species", "protein_category")])
    built = written(traces.with_outputs(samples, traces.tool_table(samples), "outputs").select("id", traces.prompt(F.col("outputs")).alias("prompt"), traces.prompt(None).alias("shortcut")))
    lines = F.regexp_extract_all("prompt", F.lit("(?m)^(Sequence|Metadata|Tool outputs): (.*)$"), F.lit(2))
    read = built.select("id", lines.alias("lines"), (F.col("prompt").startswith(F.col("shortcut")) & ~F.col("shortcut").contains("Tool outputs") & (F.regexp_count(F.col("shortcut"), F.lit("\n")) == 3)).alias("shortcut_without_tools"))
    said = read.select("id", "shortcut_without_tools", F.size("lines").alias("n_lines"), F.get("lines", F.lit(0)).alias("sequence"), F.from_json(F.get("lines", F.lit(1)), "family string")["family"].alias("family"), F.from_json(F.get("lines", F.lit(2)), OUTPUTS).alias("o"))
    flat = said.select("id", "shortcut_without_tools", "n_lines", "sequence", "family", "o.*")
    spans = F.aggregate(F.map_values("motif_detector.spans"), F.lit(0), lambda n, x: n + F.size(x))
    return flat.select(
        "id", "sequence", "family", "n_lines", "shortcut_without_tools", "motif_detector.sequence_length", spans.alias("n_motif_spans"), "hydropathy_profile.mean_hydropathy", "hydropathy_profile.window_size",
        F.array_join("hydropathy_profile.most_hydrophobic_span", "-").alias("most_hydrophobic_span"), "hydropathy_profile.min_window_value", "charge_profile.positive_residues", "charge_profile.net_charge", "beta_sheet_propensity.mean_beta_propensity",
        "beta_sheet_propensity.mean_turn_propensity", F.size("beta_sheet_propensity.beta_rich_spans").alias("n_beta_spans"), "repeat_pattern_analyzer.*", "disorder_prediction_chplot.*",
    )


_C = f"WITH {bridge.COMPLETIONS_SQL}"
_NUMERIC = """num AS (SELECT id, a, b, c, concat('0.', a + 100) AS raw, concat('0.', a + 100)::DOUBLE AS num FROM completions WHERE t = 0
  UNION ALL SELECT id, a, b, c, concat(a + b, '.'), (a + b)::DOUBLE FROM completions WHERE t = 1 UNION ALL SELECT id, a, b, c, concat(c, '%'), c::DOUBLE FROM completions WHERE t = 1
  UNION ALL SELECT id, a, b, c, concat('-', b + 100), -(b + 100)::DOUBLE FROM completions WHERE t = 2 UNION ALL SELECT id, a, b, c, concat(a, '.5 kcal/mol'), a + 0.5::DOUBLE FROM completions WHERE t = 3
  UNION ALL SELECT id, a, b, c, concat('0.', b + 1000), concat('0.', b + 1000)::DOUBLE FROM completions WHERE t = 5 UNION ALL SELECT id, a, b, c, concat(c + 1000), (c + 1000)::DOUBLE FROM completions WHERE t = 6)"""
_POSITION = """pos AS (SELECT id, a, concat('residues ', a, '-', a + b + 1) AS raw, a AS lo, a + b + 1 AS hi FROM completions WHERE t = 0
  UNION ALL SELECT id, a, concat('positions ', a, ' to ', a + b), a, a + b FROM completions WHERE t = 1 UNION ALL SELECT id, a, concat('residue ', c), c, c FROM completions WHERE t = 3
  UNION ALL SELECT id, a, concat('region at ', a, '-', a + 3), a, a + 3 FROM completions WHERE t = 4)"""
_MOTIF = """mot AS (SELECT id, b, u.term, CASE WHEN t = 2 THEN 'contrastive' ELSE 'direct' END AS role FROM completions JOIN (VALUES (0, 'beta-sheet'), (1, 'poly-alanine'), (2, 'alpha-helix'), (4, 'amorphous region'), (4, 'random coil'),
  (6, 'glycine rich'), (6, 'proline-rich turn')) u(k, term) ON u.k = t)"""
_GN = f"""{_NUMERIC}, leaves AS (SELECT num.*, x.tool, x.i, x.v FROM num, LATERAL (VALUES (1, 1, c::DOUBLE), (1, 2, 0.1::DOUBLE + a / 1000.0::DOUBLE), (1, 3, a + 0.5::DOUBLE), (2, 1, (-b - 101)::DOUBLE), (2, 2, (c + 1020)::DOUBLE)) x(tool, i, v)),
hits AS (SELECT *, abs(v - num) AS d FROM leaves WHERE abs(v - num) <= greatest(0.02::DOUBLE, abs(v) * 0.03::DOUBLE)),
best AS (SELECT *, row_number() OVER (PARTITION BY id, num ORDER BY tool DESC, d, i) AS rn FROM hits),
gn AS (SELECT num.id, num.num, best.id IS NOT NULL AS grounded, CASE best.tool WHEN 1 THEN 'first' WHEN 2 THEN 'second' END AS evidence_tool, best.v AS matched, best.d AS diff
  FROM num LEFT JOIN best ON best.id = num.id AND best.num = num.num AND best.rn = 1)"""
_GP = f"""{_POSITION}, gp AS (SELECT id, lo, hi, CASE WHEN lo >= a AND hi <= a + 20 THEN 'second' WHEN hi <= 50 THEN 'first' END AS evidence_tool FROM pos)"""
_GM = f"""{_MOTIF}, gm AS (SELECT id, term, role, CASE WHEN term = 'random coil' THEN 'second' WHEN term IN ('beta-sheet', 'alpha-helix') AND b % 3 = 0 THEN 'second'
  WHEN term IN ('poly-alanine', 'glycine rich') AND b % 2 = 0 THEN 'first' END AS evidence_tool FROM mot)"""
_ALL = f"""{_C}, {_GN}, {_GP}, {_GM}, every AS (SELECT id, 'numeric' AS kind, 'direct' AS role, grounded FROM gn UNION ALL SELECT id, 'position', 'direct', evidence_tool IS NOT NULL FROM gp
  UNION ALL SELECT id, 'motif', role, evidence_tool IS NOT NULL FROM gm),
rep AS (SELECT c.id, count(*) FILTER (e.role = 'direct') AS n_direct, count(*) FILTER (e.role = 'direct' AND e.grounded) AS n_direct_grounded,
  count(*) FILTER (e.role = 'contrastive') AS n_contrastive, count(*) FILTER (e.role = 'contrastive' AND e.grounded) AS n_contrastive_grounded FROM completions c LEFT JOIN every e USING (id) GROUP BY c.id),
report AS (SELECT *, CASE WHEN n_direct > 0 THEN n_direct_grounded / n_direct ELSE 1.0::DOUBLE END AS grounding_score, CASE WHEN n_contrastive > 0 THEN n_contrastive_grounded / n_contrastive END AS contrastive_score FROM rep)"""


def _r(x: str, d: int = 4) -> str:
    return f"(printf('%.{d}f', {x})::DOUBLE + 0.0::DOUBLE)"


_ANSWER = """ans AS (SELECT *, c % 6 IN (0, 1, 4) AS parsed, CASE WHEN c % 6 IN (0, 1) THEN concat('0.', a + 10)::DOUBLE END AS strength,
  CASE WHEN c % 6 IN (0, 4) THEN concat('0.', b + 10)::DOUBLE WHEN c % 6 = 1 THEN 1.0::DOUBLE END AS toughness,
  CASE c % 5 WHEN 0 THEN c / 100.0::DOUBLE WHEN 1 THEN 0.9::DOUBLE WHEN 2 THEN 0.3::DOUBLE WHEN 3 THEN 1.0::DOUBLE END AS confidence,
  CASE t WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE / 3 WHEN 3 THEN 0.5::DOUBLE WHEN 6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS coherence FROM completions),
err AS (SELECT *, CASE WHEN strength IS NOT NULL AND toughness IS NOT NULL THEN (abs(strength - truth_strength) + abs(toughness - truth_toughness)) / 2 END AS mae,
  CASE WHEN confidence IS NULL OR strength IS NULL THEN 0.5::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - (confidence - r) * (confidence - r)) END AS calibration
  FROM (SELECT *, CASE WHEN abs(strength - truth_strength) <= 0.15::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS r FROM ans)),
rew AS (SELECT *, coalesce(greatest(0.0::DOUBLE, 1.0::DOUBLE - mae), 0.0::DOUBLE) AS outcome FROM err)"""

_O = sequence_queries.ORACLES
_TOOL_FACTS = f"""WITH m AS ({_O["seq_motif_spans"]}), h AS ({_O["seq_hydropathy"]}), q AS ({_O["seq_charge"]}), b AS ({_O["seq_propensity"]}), bs AS ({_O["seq_beta_spans"]}), p AS ({_O["seq_period"]}), d AS ({_O["seq_disorder"]}),
{bridge.SILK.strip()}, ranges AS (SELECT id, 1 AS tool, lo, hi FROM m UNION ALL SELECT id, 4, lo, hi FROM bs
  UNION ALL SELECT id, 2, split_part(s, '-', 1)::INT, split_part(s, '-', 2)::INT FROM (SELECT id, unnest([most_hydrophobic_span, most_hydrophilic_span]) AS s FROM h) WHERE s IS NOT NULL),
leaves AS (SELECT id, tool, unnest([lo, hi])::DOUBLE AS v FROM ranges UNION ALL SELECT id, 1, length(seq) FROM silk UNION ALL SELECT id, 2, unnest([mean_hydropathy, window_size, max_window_value, min_window_value]) FROM h
  UNION ALL SELECT id, 3, unnest([positive_residues, negative_residues, net_charge, mean_net_charge_per_residue]) FROM q UNION ALL SELECT id, 4, unnest([mean_alpha_propensity, mean_beta_propensity, mean_turn_propensity, 1.05::DOUBLE]) FROM b
  UNION ALL SELECT id, 5, unnest([dominant_period, repeat_score]) FROM p UNION ALL SELECT id, 6, unnest([mean_charge, mean_hydropathy_normalized, boundary_value]) FROM d),
value AS (SELECT silk.id, length(seq) AS n, [1.0::DOUBLE, 1.029::DOUBLE, 1.031::DOUBLE, 0.5::DOUBLE][((silk.id % 4 + 4) % 4 + 1)::INT] AS off, [mean_hydropathy, mean_beta_propensity, boundary_value, repeat_score, length(seq)::DOUBLE, positive_residues::DOUBLE] AS v
  FROM silk JOIN h USING (id) JOIN b USING (id) JOIN d USING (id) JOIN p USING (id) JOIN q USING (id)),
num AS (SELECT id, unnest(range(6)) AS i, printf('%.4f', unnest(v) * off)::DOUBLE AS num FROM value),
hit AS (SELECT num.id, i, tool, min(abs(v - num)) AS diff FROM num JOIN leaves USING (id) WHERE abs(v - num) <= greatest(0.02::DOUBLE, abs(v) * 0.03::DOUBLE) GROUP BY ALL),
best AS (SELECT id, i, arg_max(tool, tool) AS tool, arg_max(diff, tool) AS diff FROM hit GROUP BY ALL),
pos AS (SELECT id, lo + (id % 3 + 3) % 3 * 2 AS lo, hi + (id % 3 + 3) % 3 * 2 AS hi FROM (SELECT id, split_part(most_hydrophobic_span, '-', 1)::INT AS lo, split_part(most_hydrophobic_span, '-', 2)::INT AS hi FROM h WHERE most_hydrophobic_span IS NOT NULL)),
inside AS (SELECT pos.id, max(tool) AS tool FROM pos LEFT JOIN ranges r ON r.id = pos.id AND pos.lo BETWEEN r.lo AND r.hi AND pos.hi BETWEEN r.lo AND r.hi WHERE pos.hi < 10000 GROUP BY pos.id),
named AS (SELECT silk.id, count(*) FILTER (motif = 'poly_alanine') > 0 AS ala, count(*) FILTER (motif IN ('glycine_rich_spacer', 'GGX_repeat', 'GPGXX_repeat')) > 0 AS loose FROM silk LEFT JOIN m USING (id) GROUP BY silk.id),
tool(tool, name) AS (VALUES (1, 'motif_detector'), (2, 'hydropathy_profile'), (3, 'charge_profile'), (4, 'beta_sheet_propensity'), (5, 'repeat_pattern_analyzer'), (6, 'disorder_prediction_chplot'))"""
_PLANTED = f"""WITH m AS ({_O["seq_motif_spans"]}), {bridge.SILK.strip()}, f AS (SELECT DISTINCT id, motif FROM m), w AS (SELECT id, unnest({PLANTED}[(id % 5 + 1)::INT]) AS motif FROM silk WHERE id >= 0),
u AS (SELECT id, n.motif FROM silk JOIN (VALUES {', '.join(f"('{m}', '{x}')" for m, x in NEEDED.items())}) n(motif, x) ON NOT contains(seq, n.x) WHERE id >= 0),
c AS (SELECT w.id, w.motif || ' detected' AS "check", f.id IS NOT NULL AS passed FROM w LEFT JOIN f USING (id, motif) UNION ALL SELECT u.id, u.motif || ' absent', f.id IS NULL FROM u LEFT JOIN f USING (id, motif))"""
_SEVEN = _TOOL_FACTS[: _TOOL_FACTS.index(", ranges AS")]
ORACLES = {
    "planted_checks": f"{_PLANTED} SELECT * FROM c",
    "planted_fraction": f"{_PLANTED} SELECT count(*) AS n_checks, coalesce(avg(passed::INT), 1.0::DOUBLE) AS passed_fraction FROM c",
    "prompt_fields": f"""{_SEVEN}, ms AS (SELECT id, count(*) AS n FROM m GROUP BY id), bn AS (SELECT id, count(*) AS n FROM bs GROUP BY id)
SELECT silk.id, seq AS sequence, concat('a "family"', chr(10), (silk.id % 4 + 4) % 4) AS family, 3 AS n_lines, true AS shortcut_without_tools, length(seq)::INT AS sequence_length, coalesce(ms.n, 0)::INT AS n_motif_spans, mean_hydropathy, window_size,
most_hydrophobic_span, min_window_value, positive_residues, net_charge, mean_beta_propensity, mean_turn_propensity, coalesce(bn.n, 0)::INT AS n_beta_spans, dominant_period, repeat_score, example_repeat_unit, boundary_value, predicted_disordered
FROM silk JOIN h USING (id) JOIN q USING (id) JOIN b USING (id) JOIN p USING (id) JOIN d USING (id) LEFT JOIN ms ON ms.id = silk.id LEFT JOIN bn ON bn.id = silk.id""",
    "ground_tools": f"""{_TOOL_FACTS}, g AS (SELECT num.id, 'numeric' AS kind, num.i AS o, best.tool, best.diff FROM num LEFT JOIN best USING (id, i) UNION ALL SELECT id, 'position', 6, tool, NULL FROM inside
  UNION ALL SELECT id, 'motif', 7, CASE WHEN ala THEN 1 END, NULL FROM named UNION ALL SELECT id, 'motif', 8, CASE WHEN loose THEN 1 END, NULL FROM named),
-- Ends of three digits and more are numbers too: the first of the position's two, behind the six.
o AS (SELECT g.id, kind, tool, diff, CASE WHEN kind = 'numeric' THEN o ELSE 6 + CASE WHEN coalesce(pos.lo >= 100 AND pos.hi < 10000, false) THEN 1 ELSE 0 END + row_number() OVER (PARTITION BY g.id, kind = 'numeric' ORDER BY o) - 1 END AS claim_ord FROM g LEFT JOIN pos USING (id))
SELECT id, kind, claim_ord::INT AS claim_ord, tool.tool IS NOT NULL AS grounded, name AS evidence_tool, {_r('diff')} AS diff FROM o LEFT JOIN tool USING (tool)""",
    "seq_validation": """SELECT * FROM (VALUES ('masp_like', 'poly_alanine detected', true), ('masp_like', 'GGX_repeat detected', true), ('masp_like', 'repeat period detected', true),
('masp_like', 'report: motif and propensity differ on poly_alanine', true), ('pysp', 'proline_rich_turn detected', true), ('pysp', 'poly_alanine absent', true), ('pysp', 'more proline than masp_like', true),
('pysp', 'report: turn propensity and proline content may differ', true)) v(sequence_name, "check", passed)""",
    "validation_passed": "SELECT 8::BIGINT AS n_checks, 1.0::DOUBLE AS passed_fraction",
    "interleaved_trace": f"""{_C}, {_NUMERIC}, {_POSITION}, {_MOTIF},
every AS (SELECT id, 'numeric' AS kind, 0 AS k, num, NULL::INT AS lo, NULL::INT AS hi, NULL AS term FROM num UNION ALL SELECT id, 'position', 1, NULL, lo, hi, NULL FROM pos UNION ALL SELECT id, 'motif', 2, NULL, NULL, NULL, term FROM mot),
-- Claims of a kind stand in the order of the text: of the two numbers of template 1 the sum comes first, of the motifs of template 4 the region.
ord AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k, CASE WHEN kind = 'numeric' AND t = 1 AND num = c AND NOT first THEN 1 ELSE 0 END, term) - 1 AS claim_ord
  FROM (SELECT e.*, c.a, c.b, c.c, c.t, row_number() OVER (PARTITION BY e.id, e.kind ORDER BY CASE WHEN e.num = c.a + c.b THEN 0 ELSE 1 END) = 1 AND e.num = c.a + c.b AS first FROM every e JOIN completions c USING (id))),
s AS (SELECT * FROM ord, (VALUES (0, 0), (2, 1), (4, 2)) v(step_index, n_tools)),
leaves AS (SELECT s.id, s.step_index, s.claim_ord, x.tool FROM s, LATERAL (VALUES (1, c::DOUBLE), (1, 0.1::DOUBLE + a / 1000.0::DOUBLE), (1, a + 0.5::DOUBLE), (2, (-b - 101)::DOUBLE), (2, (c + 1020)::DOUBLE)) x(tool, v)
  WHERE kind = 'numeric' AND tool <= n_tools AND abs(v - num) <= greatest(0.02::DOUBLE, abs(v) * 0.03::DOUBLE)),
hit AS (SELECT id, step_index, claim_ord, max(tool) AS tool FROM leaves GROUP BY ALL),
g AS (SELECT s.*, CASE kind WHEN 'numeric' THEN hit.tool WHEN 'position' THEN CASE WHEN n_tools >= 2 AND lo >= a AND hi <= a + 20 THEN 2 WHEN n_tools >= 1 AND hi <= 50 THEN 1 END
  ELSE CASE WHEN n_tools >= 2 AND (term = 'random coil' OR term IN ('beta-sheet', 'alpha-helix') AND b % 3 = 0) THEN 2 WHEN n_tools >= 1 AND term IN ('poly-alanine', 'glycine rich') AND b % 2 = 0 THEN 1 END END AS tool
  FROM s LEFT JOIN hit USING (id, step_index, claim_ord))
SELECT id, step_index::INT AS step_index, kind, claim_ord::INT AS claim_ord, tool IS NOT NULL AS grounded, CASE tool WHEN 1 THEN 'first' WHEN 2 THEN 'second' END AS evidence_tool FROM g""",
    "claims_numeric": f"{_C}, {_NUMERIC} SELECT id, raw, num, 'direct' AS role FROM num",
    "claims_position": f"{_C}, {_POSITION} SELECT id, raw, lo, hi, 'direct' AS role FROM pos",
    "claims_motif": f"{_C}, {_MOTIF} SELECT id, term AS raw, term, role FROM mot",
    "claim_roles": f"{_ALL} SELECT kind, role, count(*) AS n FROM every GROUP BY kind, role",
    "ground_numeric": f"{_C}, {_GN} SELECT id, num, grounded, evidence_tool, {_r('matched')} AS matched, {_r('diff')} AS diff FROM gn",
    "ground_position": f"{_C}, {_GP} SELECT id, lo, hi, evidence_tool IS NOT NULL AS grounded, evidence_tool FROM gp",
    "ground_motif": f"{_C}, {_GM} SELECT id, term, evidence_tool IS NOT NULL AS grounded, evidence_tool FROM gm",
    "trace_report": f"{_ALL} SELECT id, n_direct, n_direct_grounded, n_contrastive, n_contrastive_grounded, {_r('grounding_score')} AS grounding_score, {_r('contrastive_score')} AS contrastive_score FROM report",
    "batch_audit": f"""{_ALL} SELECT count(*) AS n_traces, {_r('avg(grounding_score)')} AS mean_grounding_score, {_r('avg((grounding_score = 1.0)::INT)')} AS fully_grounded_fraction,
sum(n_contrastive)::BIGINT AS n_contrastive_mentions, {_r('sum(n_contrastive - n_contrastive_grounded) / sum(n_contrastive)')} AS contrastive_ungrounded_fraction FROM report""",
    "audit_kinds": f"{_ALL} SELECT kind, count(*) AS n_claims, count(*) FILTER (NOT grounded) AS n_ungrounded FROM every WHERE role = 'direct' GROUP BY kind",
    "worst_traces": f"{_ALL} SELECT id, {_r('grounding_score')} AS grounding_score FROM report ORDER BY report.grounding_score, id LIMIT {grounding.WORST}",
    "trace_assemble": f"{_C} SELECT id, CASE WHEN t IN (4, 7) THEN completion ELSE body END AS reasoning FROM completions",
    "reasoning_steps": f"{_C}, {_ANSWER} SELECT id, CASE t WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 5 THEN 4 WHEN 6 THEN 2 ELSE 0 END AS n_steps, {_r('coherence')} AS coherence FROM ans",
    "answer_parse": f"{_C}, {_ANSWER} SELECT id, parsed, strength, toughness FROM ans",
    "outcome_reward": f"{_C}, {_ANSWER} SELECT id, {_r('outcome')} AS outcome, {_r('mae')} AS mae, coalesce(mae <= 0.1::DOUBLE, false) AS is_correct FROM rew",
    "expressed_confidence": f"{_C}, {_ANSWER} SELECT id, confidence FROM ans",
    "calibration_reward": f"{_C}, {_ANSWER} SELECT id, {_r('calibration')} AS calibration FROM rew",
    "calibration_grouped": f"{_C}, {_ANSWER} SELECT id // 4 AS prompt, string_agg(printf('%.4f', calibration), ',' ORDER BY id) AS rewards FROM rew GROUP BY 1",
    "staged_reward_judged": f"""{_ALL}, {_ANSWER}, steps AS (SELECT id, unnest(CASE t WHEN 0 THEN [concat('The mean value is 0.', a + 100, ' overall.'), concat('Because of that, residues ', a, '-', a + b + 1, ' fold into a beta-sheet.')]
  WHEN 1 THEN ['1.', concat('A poly-alanine run spans positions ', a, ' to ', a + b, '.'), '12.', concat('Therefore the share is ', c, '% of it.')]
  WHEN 2 THEN ['The chain lacks an alpha-helix here and shows nothing else that one could name at all in the whole of this rather long sentence.', concat('Charge is -', b + 100, ' in total.')]
  WHEN 3 THEN [concat('Only one step with energy ', a, '.5 kcal/mol at residue ', c)] WHEN 5 THEN ['Nothing follows.', 'Zebra quartz.', 'Jumping vixens.', concat('residue 0.', b + 1000)]
  WHEN 6 THEN ['The spacer is glycine rich.', concat('The spacer is proline-rich turn like, since ', c + 1000, ' of them show.')] ELSE [] END) AS step FROM completions),
judged AS (SELECT id, avg(least(1.0::DOUBLE, length(step) / 100)) AS quality FROM steps GROUP BY id),
j AS (SELECT rew.*, grounding_score, coalesce(quality, 0.0::DOUBLE) AS quality FROM rew JOIN report USING (id) LEFT JOIN judged USING (id))
SELECT id, {_r('outcome * 0.4::DOUBLE + coherence * 0.15::DOUBLE + grounding_score * 0.15::DOUBLE + quality * 0.3::DOUBLE', 3)} AS stage_3,
{_r('outcome * 0.35::DOUBLE + coherence * 0.1::DOUBLE + grounding_score * 0.15::DOUBLE + quality * 0.25::DOUBLE + calibration * 0.15::DOUBLE', 3)} AS stage_4 FROM j""",
    "staged_reward": f"""{_ALL}, {_ANSWER} SELECT id, {_r('outcome * 0.6::DOUBLE + coherence * 0.4::DOUBLE', 3)} AS stage_1,
{_r('outcome * 0.5::DOUBLE + coherence * 0.25::DOUBLE + grounding_score * 0.25::DOUBLE', 3)} AS stage_2 FROM rew JOIN report USING (id)""",
}
ORACLES["interleaved_long"] = ORACLES["interleaved_trace"]
QUERIES = [
    claims_numeric, claims_position, claims_motif, claim_roles, ground_numeric, ground_position, ground_motif, trace_report, batch_audit, audit_kinds, worst_traces, trace_assemble,
    reasoning_steps, answer_parse, outcome_reward, expressed_confidence, calibration_reward, calibration_grouped, staged_reward, staged_reward_judged, seq_validation, validation_passed, ground_tools, interleaved_trace, interleaved_long, mock_pilot, prompt_build, prompt_fields,
    planted_checks, planted_fraction,
]
