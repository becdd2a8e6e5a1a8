"""Labelled sequence datasets: CSV, JSON and JSON lines, with column names resolved by alias.

Rows carry sequence, family, genus, species, protein_category and ground_truth (a map of strength and toughness, null
unless both are numbers). Rows without a sequence are dropped and counted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.compat import number, seeded
from .scratch import written

# Accepted names of each column; the first that exists counts.
ALIASES = {
    "sequence": ["sequence", "protein_sequence", "fasta", "seq"],
    "family": ["family"],
    "genus": ["genus"],
    "species": ["species"],
    "protein_category": ["protein_category", "category", "spidroin_type"],
    "strength": ["strength_norm", "strength"],
    "toughness": ["toughness_norm", "toughness"],
}
TEXTS = ["family", "genus", "species", "protein_category"]
DEMO = [
    ("GGQGGSGGQGGS" + "A" * 9 + "GPGQSGPGQS", "Araneidae", "Demo", "example", "MaSp"),
    ("SVQAPAPAPKPAPAPAPQVS", "Araneidae", "Demo", "example", "PySp"),
]


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """CSV: all columns as text. JSON: a variant column ``row`` for each record. Unknown suffixes and missing files
    raise; so does a malformed JSON line."""
    suffix = path.rpartition(".")[2].lower()
    if suffix == "csv":
        return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if suffix not in ("json", "jsonl"):
        raise ValueError(f"unsupported dataset suffix: {path}")
    found = spark.read.option("singleVariantColumn", "row").option("multiLine", suffix == "json").option("mode", "FAILFAST").json(path)
    if suffix == "jsonl":
        return found
    listed = F.coalesce(F.try_variant_get("row", "$", "array<variant>"), F.try_variant_get("row", "$.data", "array<variant>"), F.array().cast("array<variant>"))
    return found.select(F.explode(listed).alias("row"))


def resolve(columns: list[str], target: str) -> str | None:
    """The column for a target, whatever its case; of equal names the last."""
    by = {c.lower(): c for c in columns}
    return next((by[a] for a in ALIASES[target] if a in by), None)


def _samples(rows: DataFrame, pick: Callable[[str], Column], text: Callable[[str], Column]) -> DataFrame:
    strength, toughness = number(pick("strength")), number(pick("toughness"))
    truth = F.when(strength.isNotNull() & toughness.isNotNull(), F.create_map(F.lit("strength"), strength, F.lit("toughness"), toughness))
    kept = rows.where(pick("sequence").isNotNull() & (pick("sequence") != ""))
    return kept.select(F.trim(pick("sequence")).alias("sequence"), *[text(t).alias(t) for t in TEXTS], truth.alias("ground_truth"))


def from_columns(raw: DataFrame) -> DataFrame:
    """Aliases are resolved once, by the columns that exist. A CSV field that is empty and one that its row lacks read alike: as an empty text."""

    def pick(target: str) -> Column:
        name = resolve(raw.columns, target)
        return F.col(f"`{name}`").cast("string") if name else F.lit(None).cast("string")

    return _samples(raw, pick, lambda t: F.coalesce(pick(t), F.lit("")))


def from_records(raw: DataFrame) -> DataFrame:
    """Aliases are resolved for each record, by the keys it has. A key that is null reads "None", one that is missing ""."""
    fields = F.map_entries(F.try_variant_get("row", "$", "map<string,variant>"))
    lowered = F.transform(fields, lambda e: F.struct(F.lower(e["key"]).alias("key"), F.try_variant_get(e["value"], "$", "string").alias("value")))
    rows = raw.select(lowered.alias("fields"))

    def found(target: str) -> Column:
        """The last field of the first alias that the record has."""
        last = lambda alias: F.try_element_at(F.filter("fields", lambda e: e["key"] == alias), F.lit(-1))
        return F.coalesce(*[last(a) for a in ALIASES[target]])

    pick = lambda t: found(t)["value"]
    return _samples(rows, pick, lambda t: F.when(found(t).isNull(), "").otherwise(F.coalesce(pick(t), F.lit("None"))))


def load_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The samples, as a table, and how many rows were dropped; raises if none is left.

    The file is read once: rows are counted on their way into the table, before and behind the filter that drops those without a sequence.
    """
    read, kept = Observation(), Observation()
    raw = read_raw(spark, path).observe(read, F.count(F.lit(1)).alias("n"))
    samples = from_columns(raw) if path.lower().endswith(".csv") else from_records(raw)
    table = written(samples.observe(kept, F.count(F.lit(1)).alias("n")))
    if not kept.get["n"]:
        raise ValueError(f"no usable rows in {path}")
    return table, read.get["n"] - kept.get["n"]


def demo(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(DEMO, "sequence string, family string, genus string, species string, protein_category string")
    return rows.withColumn("ground_truth", F.lit(None).cast("map<string,double>"))


def with_truth(samples: DataFrame) -> DataFrame:
    return samples.where(F.size("ground_truth") > 0)


def sample_seeded(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """Exactly n rows (all, if there are no more), the same for the same seed and keys."""
    return df.orderBy(seeded(seed, *[F.col(k) for k in keys]), *keys).limit(n)
