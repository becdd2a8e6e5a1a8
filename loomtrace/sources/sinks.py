"""Writers of pilot runs, pools and comparisons, and readers of the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_pilot(path: str, reports: DataFrame, claims: DataFrame, errors: DataFrame, audit: DataFrame) -> None:
    """Traces with their claims nested, errors and the audit, as JSON; the steps are not saved."""
    fields = [c for c in ("kind", "raw", "num", "lo", "hi", "term", "role", "grounded", "evidence_tool") if c in claims.columns]
    nested = claims.where("kind is not null").groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("claim_ord", *fields))).alias("claims"))
    reports.join(nested, "trace_id", "left").write.mode("overwrite").json(f"{path}/traces")
    errors.write.mode("overwrite").json(f"{path}/errors")
    audit.write.mode("overwrite").json(f"{path}/audit")


def write_pool(path: str, config: dict[str, float], tables: dict[str, DataFrame]) -> None:
    """A Parquet table for each part (scored traces, pairs, errors, summaries) and the settings as JSON."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    first = next(iter(tables.values()))
    first.sparkSession.createDataFrame([config]).write.mode("overwrite").json(f"{path}/config")


def read_pool(spark: SparkSession, path: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{path}/{n}") for n in names]


def read_config(spark: SparkSession, path: str) -> dict:
    return spark.read.json(f"{path}/config").first().asDict()


def check_same_run(spark: SparkSession, path: str, **wanted: int) -> None:
    """Raises if the prior run had other numbers of prompts or samples."""
    had = read_config(spark, path)
    for name, value in wanted.items():
        if had.get(name) != value:
            raise ValueError(f"the prior run had {name}={had.get(name)}, not {value}")


def write_comparison(path: str, metrics: DataFrame) -> None:
    metrics.coalesce(1).write.mode("overwrite").json(path)


def read_scored_traces(spark: SparkSession, path: str) -> DataFrame:
    """seq, kind and the answer's two properties of each scored trace in a pool's JSON. Rows without an answer, or with an empty one, go; an answer that lacks one of the two raises."""
    pool = spark.read.option("multiLine", True).json(path).select(F.explode("scored_traces").alias("t"))
    rows = pool.select(F.col("t.metadata.sequence").alias("seq"), F.col("t.metadata.trace_kind").alias("kind"), "t.final_answer.strength", "t.final_answer.toughness")
    must = lambda name: F.coalesce(F.col(name), F.raise_error(F.concat(F.lit(f"an answer without {name}: "), F.coalesce("seq", F.lit("null")))).cast("double")).alias(name)
    return rows.where("strength is not null or toughness is not null").select("seq", "kind", must("strength"), must("toughness"))
