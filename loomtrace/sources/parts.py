"""Tables of a run that are filled in place: parts by hash of a key, and a manifest that tells which files count.

Rows of new or replaced parts are written to a folder of their own. Then one manifest for all tables of the run, with the next number, is renamed into place: readers see all tables as
they were or as they are, and parts that nothing has changed keep their files. Two writers at once get in each other's way: the second one's manifest exists
already, and it raises. Folders that no manifest needs any more stay until ``forget`` deletes them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scratch import no_leftovers

PARTS = 64


def part(key: Column) -> Column:
    """0 to PARTS - 1, by the key's MD5; null keys are in part 0."""
    return F.coalesce(F.pmod(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 4), 16, 10).cast("int"), F.lit(PARTS)), F.lit(0))


def _store(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _names(spark: SparkSession, path: str) -> list[str]:
    store, place = _store(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(place)) if store.exists(place) else []


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    return "_SUCCESS" in _names(spark, path)


def manifest(spark: SparkSession, path: str) -> dict:
    """The latest; an empty one where there is none."""
    found = [n for n in _names(spark, path) if n.startswith("manifest-") and n.endswith(".json")]
    if not found:
        return {"number": 0, "tables": {}, "settings": {}}
    return json.loads(spark.read.text(f"{path}/{found[-1]}", wholetext=True).first()[0])


def _commit(spark: SparkSession, path: str, new: dict) -> None:
    store, draft = _store(spark, f"{path}/draft-{uuid.uuid4().hex}")
    out = store.create(draft)
    out.write(bytearray(json.dumps(new).encode()))
    out.close()
    _, place = _store(spark, f"{path}/manifest-{new['number']:08d}.json")
    if store.exists(place) or not store.rename(draft, place):
        store.delete(draft, False)
        raise RuntimeError(f"{path} was changed by another run")


def put(
    spark: SparkSession, path: str, tables: dict[str, DataFrame], key: str, settings: dict | None = None, only: dict[str, list[int]] | None = None,
    more: Callable[[dict[str, DataFrame]], dict[str, DataFrame]] | None = None, dealt: bool = False,
) -> None:
    """Writes tables and makes them count, all at once. only: of these tables the given parts are replaced, and the others stay. Tables without the key are one part.

    more: makes further tables of those that have been written, as they then are, so that what they have in common is stored nowhere else. dealt: the rows of ``tables`` come by parts and are written where they are.
    """
    before, version = manifest(spark, path), uuid.uuid4().hex
    now = {"number": before["number"] + 1, "tables": dict(before["tables"]), "settings": settings if settings is not None else before["settings"]}

    def write(name: str, df: DataFrame, dealt: bool) -> None:
        rows = df.withColumn("__part", part(F.col(key)) if key in df.columns else F.lit(0))
        with no_leftovers(spark):
            (rows if dealt else rows.hint("rebalance", "__part")).write.option("compression", "zstd").partitionBy("__part").parquet(f"{path}/{name}/{version}")
        files = {n.partition("=")[2]: version for n in _names(spark, f"{path}/{name}/{version}") if n.startswith("__part=")}
        if only and name in only:
            files |= {p: v for p, v in before["tables"][name]["files"].items() if int(p) not in only[name]}
        now["tables"][name] = {"schema": df.schema.jsonValue(), "files": files}

    for name, df in tables.items():
        write(name, df, dealt)
    for name, df in more({name: _rows(spark, path, name, now) for name in tables}).items() if more else ():
        write(name, df, False)
    _commit(spark, path, now)


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The table as the latest manifest has it."""
    return _rows(spark, path, name, manifest(spark, path))


def _rows(spark: SparkSession, path: str, name: str, manifest_: dict) -> DataFrame:
    held = manifest_["tables"][name]
    schema = StructType.fromJson(held["schema"])
    files = [f"{path}/{name}/{v}/__part={p}" for p, v in sorted(held["files"].items())]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def forget(spark: SparkSession, path: str) -> None:
    """Deletes what the latest manifest doesn't need. Readers of older ones must be done."""
    held = manifest(spark, path)
    for name, own in held["tables"].items():
        for version in _names(spark, f"{path}/{name}"):
            for folder in _names(spark, f"{path}/{name}/{version}"):
                if folder.startswith("__part=") and own["files"].get(folder.partition("=")[2]) != version:
                    store, place = _store(spark, f"{path}/{name}/{version}/{folder}")
                    store.delete(place, True)
