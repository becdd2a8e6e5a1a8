"""Protein sequence features as columns. Spans are 0-based and inclusive. Motifs are native; residues are counted in NumPy, a sequence at a time in Arrow
batches, in whole numbers: rounding and division are Spark's.

Every builder takes a cleaned sequence (see ``clean``); ``TOOLS`` lists them in the order in which traces call them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructField, StructType

from .compat import let, matches, py_round

# Kyte and Doolittle (1982) hydropathy; Chou and Fasman (1978) propensities for helix, sheet and turn.
HYDROPATHY = {
    "A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5,
    "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2,
}
PROPENSITY = {
    "A": (1.42, 0.83, 0.66), "R": (0.98, 0.93, 0.95), "N": (0.67, 0.89, 1.56), "D": (1.01, 0.54, 1.46),
    "C": (0.70, 1.19, 1.19), "Q": (1.11, 1.10, 0.98), "E": (1.51, 0.37, 0.74), "G": (0.57, 0.75, 1.56),
    "H": (1.00, 0.87, 0.95), "I": (1.08, 1.60, 0.47), "L": (1.21, 1.30, 0.59), "K": (1.16, 0.74, 1.01),
    "M": (1.45, 1.05, 0.60), "F": (1.13, 1.38, 0.60), "P": (0.57, 0.55, 1.52), "S": (0.77, 0.75, 1.43),
    "T": (0.83, 1.19, 0.96), "W": (1.08, 1.37, 0.96), "Y": (0.69, 1.47, 1.14), "V": (1.06, 1.70, 0.50),
}
MOTIFS = {
    "poly_alanine": "A{5,}",
    "GGX_repeat": "(?:GG[A-Z]){2,}",
    "GPGXX_repeat": "(?:GPG[A-Z]{2}){2,}",
    "proline_rich_turn": "(?:[AP]{2}){3,}",
    "glycine_rich_spacer": "G[A-Z]{0,2}G[A-Z]{0,2}G",
}
HYDROPATHY_WINDOW, BETA_WINDOW, BETA_THRESHOLD, PERIODS = 9, 6, 1.05, (2, 50)
SPANS = "array<struct<lo:int,hi:int>>"


def clean(sequence: Column) -> Column:
    """Upper case, letters only."""
    return F.regexp_replace(F.upper(sequence), r"[^\p{L}]", "")


def _span(lo: Column, hi: Column) -> Column:
    return F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def _scale(table: dict[str, float]) -> int:
    """10 or 100: what makes all values whole numbers, so that sums are exact in any order."""
    return 10 if all(abs(v * 10 - round(v * 10)) < 1e-9 for v in table.values()) else 100


def _table(values: dict[str, float], other: float) -> np.ndarray:
    """By a letter's code, its value as a whole number of tenths or hundredths."""
    scale = _scale(values)
    table = np.full(128, round(other * scale), np.int64)
    for letter, v in values.items():
        table[ord(letter)] = round(v * scale)
    return table


def _per_sequence(seq: Column, of: Callable[[np.ndarray], dict | None], **fields: pa.DataType) -> Column:
    """A struct for each sequence, from the codes of its letters. A null sequence counts as empty."""

    def run(texts: pa.Array) -> pa.Array:
        found = []
        for text in texts:
            raw = text.as_py() or ""
            codes = np.frombuffer(raw.encode(), np.uint8) if raw.isascii() else np.frombuffer(raw.encode("utf-32-le"), np.uint32)
            found.append(of(codes))
        return pa.array(found, pa.struct(fields))

    return F.arrow_udf(run, StructType([StructField(name, from_arrow_type(t)) for name, t in fields.items()]))(seq)


def _known(codes: np.ndarray) -> np.ndarray:
    """Codes within a table: those beyond are no residue's."""
    return np.minimum(codes, 127)


def _mean(total: Column, seq: Column, scale: int) -> Column:
    """0 for none."""
    return F.when(F.length(seq) > 0, total / F.lit(float(scale)) / F.length(seq)).otherwise(0.0)


def _sliding(values: np.ndarray, width: int) -> np.ndarray:
    """The sums of all runs of ``width`` values."""
    upto = np.concatenate([[0], np.cumsum(values)])
    return upto[width:] - upto[:-width]


def motif_spans(seq: Column) -> Column:
    """Motif name to its spans; motifs that do not occur are left out."""
    spans = [F.transform(matches(seq, p), lambda m: _span(m["start"], m["end"] - 1)) for p in MOTIFS.values()]
    every = F.map_from_arrays(F.array(*[F.lit(n) for n in MOTIFS]), F.array(*spans))
    return F.map_filter(every, lambda _, v: F.size(v) > 0)


def motif_detector(seq: Column) -> Column:
    return let(motif_spans(seq), lambda s: F.struct(F.map_keys(s).alias("motifs"), s.alias("spans"), F.length(seq).alias("sequence_length")))


def hydropathy_profile(seq: Column, window: int = HYDROPATHY_WINDOW) -> Column:
    table, scale = _table(HYDROPATHY, 0.0), _scale(HYDROPATHY)

    def of(codes: np.ndarray) -> dict | None:
        """A sequence shorter than the window is one window."""
        if not len(codes):
            return None
        values = table[_known(codes)]
        sums = _sliding(values, min(window, len(values)))
        i, j = int(sums.argmax()), int(sums.argmin())  # the first of equals
        return {"total": int(values.sum()), "i": i, "high": int(sums[i]), "j": j, "low": int(sums[j])}

    x = _per_sequence(seq, of, total=pa.int64(), i=pa.int32(), high=pa.int64(), j=pa.int32(), low=pa.int64())
    width = F.greatest(F.lit(1), F.least(F.lit(window), F.coalesce(F.length(seq), F.lit(0))))
    some = F.length(seq) > 0
    mean = lambda v: py_round(v / F.lit(float(scale)) / width, 3)
    return F.struct(
        py_round(_mean(x["total"], seq, scale), 3).alias("mean_hydropathy"), width.alias("window_size"),
        F.when(some, _span(x["i"], x["i"] + width - 1)).alias("most_hydrophobic_span"),
        F.when(some, _span(x["j"], x["j"] + width - 1)).alias("most_hydrophilic_span"),
        mean(x["high"]).alias("max_window_value"), mean(x["low"]).alias("min_window_value"),
    )


def charge_profile(seq: Column) -> Column:
    counted = _per_sequence(seq, lambda codes: _charges(np.bincount(_known(codes), minlength=128)), plus=pa.int32(), minus=pa.int32())
    return _charge(seq, *[F.when(seq.isNotNull(), counted[x]) for x in ("plus", "minus")])


def _charges(counts: np.ndarray) -> dict:
    """Charged residues, from the counts of letters by their code."""
    return {name: int(sum(counts[ord(c)] for c in letters)) for name, letters in (("plus", "KR"), ("minus", "DE"))}


def _charge(seq: Column, plus: Column, minus: Column) -> Column:
    net = F.when(F.length(seq) > 0, (plus - minus) / F.length(seq)).otherwise(0.0)
    return F.struct(plus.alias("positive_residues"), minus.alias("negative_residues"), (plus - minus).alias("net_charge"), py_round(net, 4).alias("mean_net_charge_per_residue"))


def beta_sheet_propensity(seq: Column, window: int = BETA_WINDOW, threshold: float = BETA_THRESHOLD) -> Column:
    parts = [{k: v[i] for k, v in PROPENSITY.items()} for i in range(3)]
    scale = _scale(parts[1])
    tables = np.stack([_table(t, 1.0) for t in parts], 1)
    least = round(threshold * scale * window)  # whole hundredths: a window reaches the threshold exactly or not at all

    def of(codes: np.ndarray) -> dict:
        codes = _known(codes)
        helix, sheet, turn = (np.bincount(codes, minlength=128) @ tables).tolist()
        hot = _sliding(tables[codes, 1], window) >= least
        edges = np.flatnonzero(np.diff(np.concatenate([[False], hot, [False]]))).tolist()
        return {"helix": helix, "sheet": sheet, "turn": turn, "spans": [{"lo": a, "hi": b + window - 2} for a, b in zip(edges[::2], edges[1::2], strict=True)]}

    span = pa.struct({"lo": pa.int32(), "hi": pa.int32()})
    x = _per_sequence(seq, of, helix=pa.int64(), sheet=pa.int64(), turn=pa.int64(), spans=pa.list_(span))
    mean = lambda t, name: py_round(_mean(x[t], seq, scale), 3).alias(name)
    return F.struct(
        mean("helix", "mean_alpha_propensity"), mean("sheet", "mean_beta_propensity"), mean("turn", "mean_turn_propensity"),
        F.when(seq.isNotNull(), x["spans"]).alias("beta_rich_spans"), F.lit(threshold).alias("beta_threshold"),
    )


def repeat_pattern_analyzer(seq: Column, shortest: int = PERIODS[0], longest: int = PERIODS[1]) -> Column:
    def of(codes: np.ndarray) -> dict | None:
        """Letters that come again after the period of the highest share of such, the shortest of equals."""
        periods = np.arange(shortest, min(longest, len(codes) // 2) + 1)
        if not len(periods):
            return None
        same = np.array([np.count_nonzero(codes[p:] == codes[:-p]) for p in periods])
        score = same / (len(codes) - periods)
        i = score.argmax()
        return {"p": int(periods[i]), "score": float(score[i])} if same[i] else None

    x = _per_sequence(seq, of, p=pa.int32(), score=pa.float64())
    found = x["p"].isNotNull()
    return F.struct(
        x["p"].alias("dominant_period"),
        F.when(found, py_round(x["score"], 3)).otherwise(0.0).alias("repeat_score"),
        F.when(found, F.substring(seq, F.lit(1), x["p"])).alias("example_repeat_unit"),
    )


def disorder_prediction_chplot(seq: Column) -> Column:
    table = _table(HYDROPATHY, 0.0)

    def of(codes: np.ndarray) -> dict:
        counts = np.bincount(_known(codes), minlength=128)
        return {"total": int(counts @ table), **_charges(counts)}

    x = _per_sequence(seq, of, total=pa.int64(), plus=pa.int32(), minus=pa.int32())
    charge = F.abs(_charge(seq, x["plus"], x["minus"])["mean_net_charge_per_residue"])
    hydropathy = (_mean(x["total"], seq, _scale(HYDROPATHY)) + 4.5) / 9.0
    boundary = (charge + 1.151) / 2.785
    some = F.length(seq) > 0
    number = lambda x, name: F.when(some, py_round(x, 4)).otherwise(0.0).alias(name)
    return F.struct(number(charge, "mean_charge"), number(hydropathy, "mean_hydropathy_normalized"), number(boundary, "boundary_value"), F.when(some, hydropathy < boundary).otherwise(False).alias("predicted_disordered"))


#: In the order of calls; the number is the tool's place.
TOOLS = {
    "motif_detector": motif_detector,
    "hydropathy_profile": hydropathy_profile,
    "charge_profile": charge_profile,
    "beta_sheet_propensity": beta_sheet_propensity,
    "repeat_pattern_analyzer": repeat_pattern_analyzer,
    "disorder_prediction_chplot": disorder_prediction_chplot,
}


def with_tools(df: DataFrame, sequence: str) -> DataFrame:
    """Adds ``seq`` (cleaned) and a struct for each tool."""
    ready = df.withColumn("seq", clean(F.col(sequence)))
    return ready.select("*", *[f(F.col("seq")).alias(name) for name, f in TOOLS.items()])


def proline_fraction(seq: Column) -> Column:
    return F.when(F.length(seq) > 0, F.regexp_count(seq, F.lit("P")) / F.length(seq)).otherwise(0.0)


#: A unit put together for this check from the motifs of a dragline repeat: GGX runs, then alanines.
MASP_UNIT, MASP_COPIES = "GGQ" * 4 + "GGS" * 3 + "SVR" + "A" * 11, 3  # 35 letters
# A real proline-rich sequence.
PYSP = (
    "SSSAYSGTSTGGSSVSQSQPIISSAPVYFNAQTLTSSLASSLQSDRALNFISSGQLSASDVSTSVSSAVAQTLGISQSSVQNIISQQMSSVRTGASSSSVSQAIANAVSSAVQASGAATPGQEQ"
    "SIAQRVYSSISTYLSQLISQRTAPAPAPAPRPAPMPAPAPRPAPMPAPAPRPRPAPAPRPAPVYAPAPVVSQIQAAASSQSSAQQSSFAQAQQSAYAQSQQSSSAYSGASTGGSSVSQSQPIIS"
    "SAPVYFNAQTLTSSLASSLQSDRALNFISSGQLSASDVSTSVSSAVAQTLGISQSSVQNIISQQMSSVRTGASSSSVSQAIANAVSSAVQASGAATPGQEQSIAQRVYSSISTYLSQLISQRTA"
)


def _motif_names(seq: Column) -> Column:
    return F.array_join(F.map_keys(motif_spans(seq)), " ")


def passed_fraction(checks: DataFrame) -> DataFrame:
    """One row: the number of checks, and the share that passed (1 without any)."""
    return checks.agg(F.count("*").alias("n_checks"), F.coalesce(F.avg(F.col("passed").cast("int")), F.lit(1.0)).alias("passed_fraction"))


def expectations(df: DataFrame, name: str, seq: str, wanted: str, unwanted: str) -> DataFrame:
    """name, check, passed: whether each sequence shows the motifs that it should (an array of names), and none that it shouldn't. A null array asks for nothing; a null sequence shows nothing."""
    names = F.map_keys(motif_spans(clean(F.coalesce(seq, F.lit("")))))
    held = df.select(name, wanted, unwanted, names.alias("__found"))
    one = lambda word, passed: lambda m: F.struct(F.concat(m, F.lit(word)).alias("check"), passed(m).alias("passed"))
    there = lambda m: F.array_contains("__found", m)
    checks = F.concat(F.transform(F.coalesce(wanted, F.array().cast("array<string>")), one(" detected", there)), F.transform(F.coalesce(unwanted, F.array().cast("array<string>")), one(" absent", lambda m: ~there(m))))
    return held.select(name, F.explode_outer(checks).alias("x")).where("x is not null").select(name, "x.*")


def validate(spark: SparkSession) -> DataFrame:
    """sequence_name, check, passed, detail: what the tools must say of the two control sequences; two checks only report."""
    both = spark.createDataFrame([(MASP_UNIT * MASP_COPIES, PYSP)], "masp string, pysp string")
    masp, pysp = F.col("masp"), F.col("pysp")
    has = lambda seq, name: F.map_contains_key(motif_spans(seq), name)
    period, beta = repeat_pattern_analyzer(masp), beta_sheet_propensity(masp)
    rows = [
        ("masp_like", "poly_alanine detected", has(masp, "poly_alanine"), _motif_names(masp)),
        ("masp_like", "GGX_repeat detected", has(masp, "GGX_repeat"), _motif_names(masp)),
        ("masp_like", "repeat period detected", period["dominant_period"].isNotNull() & (period["repeat_score"] > 0.5), F.concat_ws(" ", period["dominant_period"], period["repeat_score"])),
        (
            "masp_like", "report: motif and propensity differ on poly_alanine", F.lit(True),
            F.when(has(masp, "poly_alanine") & (beta["mean_beta_propensity"] < BETA_THRESHOLD), "they differ").otherwise("they agree"),
        ),
        ("pysp", "proline_rich_turn detected", has(pysp, "proline_rich_turn"), _motif_names(pysp)),
        ("pysp", "poly_alanine absent", ~has(pysp, "poly_alanine"), _motif_names(pysp)),
        ("pysp", "more proline than masp_like", proline_fraction(pysp) > proline_fraction(masp), F.concat_ws(" ", py_round(proline_fraction(pysp), 3), py_round(proline_fraction(masp), 3))),
        ("pysp", "report: turn propensity and proline content may differ", F.lit(True), beta_sheet_propensity(pysp)["mean_turn_propensity"].cast("string")),
    ]
    checks = F.array(*[F.struct(F.lit(s).alias("sequence_name"), F.lit(c).alias("check"), p.alias("passed"), d.alias("detail")) for s, c, p, d in rows])
    return both.select(F.explode(checks).alias("x")).select("x.*")
