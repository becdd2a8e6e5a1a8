"""Sequence features over the bridge views, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence
from ..functions.compat import py_round
from . import bridge


def _flat(spark: SparkSession, sf_dir: str, tool: str) -> DataFrame:
    """The tool's struct as columns, spans as text."""
    out = bridge.silk(spark, sf_dir).select("id", sequence.TOOLS[tool](F.col("seq")).alias("x"))
    return out.select("id", "x.*")


def _said(span: str) -> Column:
    return F.when(F.col(span).isNotNull(), F.concat_ws("-", F.col(span)["lo"], F.col(span)["hi"])).alias(span)


def _each(explode: Callable[[Column], Column], listed: Column) -> Column:
    """A row for each entry, and one of nulls where there is none. Without that Spark infers a filter on the size, which works the list out once more, in the
    tasks that scan the files."""
    return explode(listed)


def seq_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean net charge and proline share of sequences by source."""
    seq = sequence.clean(F.col("seq"))
    rows = bridge.sequences(spark, sf_dir).select("source", sequence.charge_profile(seq)["mean_net_charge_per_residue"].alias("charge"), sequence.proline_fraction(seq).alias("p"))
    return rows.groupBy("source").agg(F.count("*").alias("n"), py_round(F.avg("charge"), 4).alias("mean_charge"), py_round(F.avg("p"), 4).alias("mean_proline"))


def seq_charge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(spark, sf_dir, "charge_profile")


def seq_motif_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bridge.silk(spark, sf_dir).select("id", _each(F.explode_outer, sequence.motif_spans(F.col("seq"))).alias("motif", "spans"))
    return rows.select("id", "motif", _each(F.posexplode_outer, F.col("spans")).alias("pos", "s")).where("pos is not null").select("id", "motif", "pos", "s.lo", "s.hi")


def seq_motif_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bridge.silk(spark, sf_dir).select(_each(F.explode_outer, sequence.motif_spans(F.col("seq"))).alias("motif", "spans"))
    return rows.where("motif is not null").groupBy("motif").agg(F.count("*").alias("n_sequences"), F.sum(F.size("spans")).cast("long").alias("n_spans"))


def seq_hydropathy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(spark, sf_dir, "hydropathy_profile").select("id", "mean_hydropathy", "window_size", _said("most_hydrophobic_span"), _said("most_hydrophilic_span"), "max_window_value", "min_window_value")


def seq_propensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(spark, sf_dir, "beta_sheet_propensity").select("id", "mean_alpha_propensity", "mean_beta_propensity", "mean_turn_propensity")


def seq_beta_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _flat(spark, sf_dir, "beta_sheet_propensity").select("id", _each(F.posexplode_outer, F.col("beta_rich_spans")).alias("pos", "s"))
    return rows.where("pos is not null").select("id", "pos", "s.lo", "s.hi")


def seq_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(spark, sf_dir, "repeat_pattern_analyzer")


def seq_disorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(spark, sf_dir, "disorder_prediction_chplot")


def _round(x: str, d: int) -> str:
    return f"(printf('%.{d}f', {x})::DOUBLE + 0.0::DOUBLE)"


_CHARS = """chars AS (SELECT id, length(seq) AS n, unnest(string_split(seq, '')) AS ch, generate_subscripts(string_split(seq, ''), 1) AS pos FROM silk WHERE seq <> '')"""


def _values(name: str, values: dict[str, float], other: float) -> str:
    """Each residue's value in whole hundredths; and each sequence's mean."""
    whole = {k: round(v * 100) for k, v in values.items()}
    return f"""{name} AS (SELECT id, n, pos, coalesce(t.v, {other * 100:.0f})::BIGINT AS v FROM chars LEFT JOIN (VALUES {", ".join(f"('{k}', {v})" for k, v in whole.items())}) t(ch, v) USING (ch)),
{name}_mean AS (SELECT id, sum(v)::DOUBLE / 100.0::DOUBLE / any_value(n) AS m FROM {name} GROUP BY id)"""


def _slide(name: str, width: int) -> str:
    """Means of all windows, the window shrunk to the sequence where that is shorter."""
    return f"{name}_w AS (SELECT id, n, w, pos, s, s::DOUBLE / 100.0::DOUBLE / w AS m FROM (SELECT id, n, least({width}, n) AS w, pos, sum(v) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {width - 1} FOLLOWING)::BIGINT AS s FROM {name}) WHERE pos <= n - w + 1)"


_PARTS = [{k: v[i] for k, v in sequence.PROPENSITY.items()} for i in range(3)]
_CHARGE = """(length(seq) - length(regexp_replace(seq, '[KR]', '', 'g')))::INT AS plus, (length(seq) - length(regexp_replace(seq, '[DE]', '', 'g')))::INT AS minus"""
_MOTIFS = " UNION ALL ".join(f"SELECT id, '{n}' AS motif, regexp_extract_all(seq, '{p}') AS m, string_split(regexp_replace(seq, '{p}', chr(1), 'g'), chr(1)) AS g FROM silk" for n, p in sequence.MOTIFS.items())
_SPANS = f"""WITH {bridge.SILK}, found AS ({_MOTIFS}), each AS (SELECT id, motif, unnest(m) AS m, unnest(g[1:len(m)]) AS g, generate_subscripts(m, 1) - 1 AS pos FROM found),
spans AS (SELECT id, motif, pos::INT AS pos, (sum(length(g) + length(m)) OVER (PARTITION BY id, motif ORDER BY pos) - length(m))::INT AS lo, length(m)::INT AS n FROM each)"""
_HYD = f"""WITH {bridge.SILK}, {_CHARS}, {_values("h", sequence.HYDROPATHY, 0.0)}, {_slide("h", 9)},
x AS (SELECT id, any_value(w) AS w, max(m) AS hi, min(m) AS lo FROM h_w GROUP BY id), y AS (SELECT id, x.w, hi, lo, min(pos) FILTER (m = hi) - 1 AS i, min(pos) FILTER (m = lo) - 1 AS j FROM x JOIN h_w USING (id) GROUP BY ALL)"""
_BETA = f"""WITH {bridge.SILK}, {_CHARS}, {_values("b", _PARTS[1], 1.0)}, {_slide("b", 6)},
h AS (SELECT id, pos - 1 AS i, pos - row_number() OVER (PARTITION BY id ORDER BY pos) AS island FROM b_w WHERE s >= 630 AND n >= 6), r AS (SELECT id, min(i)::INT AS lo, (max(i) + 5)::INT AS hi FROM h GROUP BY id, island)"""

ORACLES = {
    "seq_composition": f"""WITH {bridge.SEQUENCES}, c AS (SELECT source, seq, {_CHARGE} FROM sequences),
x AS (SELECT source, CASE WHEN seq = '' THEN 0.0::DOUBLE ELSE {_round("(plus - minus)::DOUBLE / length(seq)", 4)} END AS charge, CASE WHEN seq = '' THEN 0.0::DOUBLE ELSE (length(seq) - length(replace(seq, 'P', '')))::DOUBLE / length(seq) END AS p FROM c)
SELECT source, count(*) AS n, {_round("avg(charge)", 4)} AS mean_charge, {_round("avg(p)", 4)} AS mean_proline FROM x GROUP BY source""",
    "seq_charge": f"""WITH {bridge.SILK}, c AS (SELECT id, seq, {_CHARGE} FROM silk) SELECT id, plus AS positive_residues, minus AS negative_residues, plus - minus AS net_charge,
CASE WHEN seq = '' THEN 0.0::DOUBLE ELSE {_round("(plus - minus)::DOUBLE / length(seq)", 4)} END AS mean_net_charge_per_residue FROM c""",
    "seq_motif_spans": f"{_SPANS} SELECT id, motif, pos, lo, lo + n - 1 AS hi FROM spans",
    "seq_motif_counts": f"WITH {bridge.SILK}, found AS ({_MOTIFS}) SELECT motif, count(*) AS n_sequences, sum(len(m))::BIGINT AS n_spans FROM found WHERE len(m) > 0 GROUP BY motif",
    "seq_hydropathy": f"""{_HYD} SELECT silk.id, coalesce({_round("h_mean.m", 3)}, 0.0::DOUBLE) AS mean_hydropathy, coalesce(w, 1)::INT AS window_size, CASE WHEN w > 0 THEN concat(i, '-', i + w - 1) END AS most_hydrophobic_span,
CASE WHEN w > 0 THEN concat(j, '-', j + w - 1) END AS most_hydrophilic_span, {_round("hi", 3)} AS max_window_value, {_round("lo", 3)} AS min_window_value FROM silk LEFT JOIN y USING (id) LEFT JOIN h_mean USING (id)""",
    "seq_propensity": f"""WITH {bridge.SILK}, {_CHARS}, {_values("a", _PARTS[0], 1.0)}, {_values("b", _PARTS[1], 1.0)}, {_values("t", _PARTS[2], 1.0)}
SELECT silk.id, coalesce({_round("a_mean.m", 3)}, 0.0::DOUBLE) AS mean_alpha_propensity, coalesce({_round("b_mean.m", 3)}, 0.0::DOUBLE) AS mean_beta_propensity, coalesce({_round("t_mean.m", 3)}, 0.0::DOUBLE) AS mean_turn_propensity
FROM silk LEFT JOIN a_mean USING (id) LEFT JOIN b_mean USING (id) LEFT JOIN t_mean USING (id)""",
    "seq_beta_spans": f"{_BETA} SELECT id, (row_number() OVER (PARTITION BY id ORDER BY lo) - 1)::INT AS pos, lo, hi FROM r",
    "seq_period": f"""WITH {bridge.SILK}, c AS (SELECT id, string_split(seq, '') AS ch FROM silk WHERE seq <> ''), p AS (SELECT id, ch, unnest(range(2, least(50, len(ch) // 2) + 1)) AS p FROM c),
s AS (SELECT id, p, len(list_filter(list_zip(ch[1:len(ch) - p], ch[p + 1:len(ch)]), lambda z: z[1] = z[2]))::DOUBLE / (len(ch) - p) AS s FROM p),
b AS (SELECT id, p, s, row_number() OVER (PARTITION BY id ORDER BY s DESC, p) AS rn FROM s)
SELECT silk.id, b.p::INT AS dominant_period, coalesce({_round("b.s", 3)}, 0.0::DOUBLE) AS repeat_score, substr(seq, 1, b.p) AS example_repeat_unit FROM silk LEFT JOIN b ON b.id = silk.id AND b.rn = 1 AND b.s > 0""",
    "seq_disorder": f"""WITH {bridge.SILK}, {_CHARS}, {_values("h", sequence.HYDROPATHY, 0.0)}, c AS (SELECT id, seq, {_CHARGE} FROM silk),
x AS (SELECT id, seq, abs({_round("(plus - minus)::DOUBLE / length(seq)", 4)}) AS q, (m + 4.5::DOUBLE) / 9.0::DOUBLE AS h FROM c LEFT JOIN h_mean USING (id)),
y AS (SELECT *, (q + 1.151::DOUBLE) / 2.785::DOUBLE AS b FROM x)
SELECT id, CASE WHEN seq = '' THEN 0.0::DOUBLE ELSE {_round("q", 4)} END AS mean_charge, CASE WHEN seq = '' THEN 0.0::DOUBLE ELSE {_round("h", 4)} END AS mean_hydropathy_normalized,
CASE WHEN seq = '' THEN 0.0::DOUBLE ELSE {_round("b", 4)} END AS boundary_value, seq <> '' AND h < b AS predicted_disordered FROM y""",
}
QUERIES = [seq_composition, seq_charge, seq_motif_spans, seq_motif_counts, seq_hydropathy, seq_propensity, seq_beta_spans, seq_period, seq_disorder]
