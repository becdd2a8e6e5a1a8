"""Tables that a run writes for itself, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir; a local session without that setting gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="loomtrace-")
    return f"{base}/loomtrace-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def no_leftovers(spark: SparkSession) -> Iterator[None]:
    """What is written in here leaves no shuffle files: else they stay until the driver happens to collect garbage, those of all steps at once."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows as a Parquet table: what made them runs once, whatever reads them. By Zstandard, to which a text that neighbouring rows repeat is next to nothing."""
    path = path or scratch(df.sparkSession)
    with no_leftovers(df.sparkSession):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
