"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses spark.checkpoint.dir; sets a local folder only for a local session that has none."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomtrace-"))


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder, so that later plans start there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared checkpoint folder."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    path = f"{base}/loomtrace-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def thrifty(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: gives memory back at a task's end, since workers stay for the stages after it; rows: batches are cut to so many."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches if rows is None else (b.slice(i, rows) for b in batches for i in range(0, max(1, b.num_rows), rows)))
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library keeps freed memory until asked
        if trim:
            trim(0)

    return own


def crc_mod(column: str, modulus: int) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def packed(rows: DataFrame, n_bytes: int = 1 << 22) -> DataFrame:
    """``bucket``, ``ids`` and ``texts``: rows (an id and a text) put together to about ``n_bytes`` of text each, as a table.

    ids is an array; texts is one, too, compressed (see ``texts_in``). Rows stay in the task that reads them, so no group of rows meets anywhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, made = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                held.append(part)
                size += part.nbytes
                if size >= n_bytes:
                    yield _row(made, held)
                    held, size, made = [], 0, made + 1
        if held:
            yield _row(made, held)

    kind = rows.schema[0].dataType.simpleString()
    return stored(rows.mapInArrow(run, f"bucket long, ids array<{kind}>, texts binary"))


def _row(bucket: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    whole = pa.Table.from_batches(parts).combine_chunks()
    ids = pa.ListArray.from_arrays(pa.array([0, whole.num_rows], pa.int32()), whole.column(0).chunk(0))
    sink = pa.BufferOutputStream()
    texts = whole.select([1])
    with pa.ipc.new_stream(sink, texts.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(texts)
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), ids, pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["bucket", "ids", "texts"])


def texts_in(packed_texts: pa.Scalar) -> pa.Array:
    """The texts of a row of ``packed``."""
    return pa.ipc.open_stream(packed_texts.as_buffer()).read_all().column(0).combine_chunks()


def text_bytes(texts: DataFrame, text: str) -> int:
    return texts.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def let_go(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables of ``stored`` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for table_ in tables:
        for file in {f.rpartition("/")[0] for f in table_.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
