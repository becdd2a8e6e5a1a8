"""Pools that are completed in place."""

import os
import random

import pytest
from pyspark.sql import functions as F

from loomtrace.operators import drivers, traces
from loomtrace.sources import completions, parts


def files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_only_parts_with_failed_slots_change(spark, tmp_path):
    path = tmp_path / "run"
    samples = spark.createDataFrame([(f"p{i}", "GGAGGQAAAA" if i % 9 else "PPPPPP", "f", "g", "s", "c", {"strength": 0.5, "toughness": 0.5}) for i in range(40)], "prompt_id string, sequence string, family string, genus string, species string, protein_category string, ground_truth map<string,double>")
    slots = traces.slots(samples, 1, 1)

    def at_times(prompt):
        if "PPPPPP" in prompt:
            raise ConnectionError("no")
        return completions.mock_llm(prompt)

    drivers.start_pool(spark, str(path), slots, at_times, {"k": 1})
    before, first = files(path / "pool"), parts.manifest(spark, str(path))
    old = parts.read(spark, str(path), "pool")  # a reader that has begun
    assert old.where("error is not null").count() == 10 and parts.read(spark, str(path), "errors").count() == 10
    with pytest.raises(ValueError, match="k=1"):
        drivers.backfill(spark, str(path), slots, completions.mock_llm, {"k": 2})
    with pytest.raises(ValueError, match="other sequences"):
        drivers.backfill(spark, str(path), slots.withColumn("sequence", F.lit("AC")), completions.mock_llm)
    asked = []
    assert drivers.backfill(spark, str(path), slots, lambda p: completions.mock_llm(p) if "PPPPPP" in p else asked[0], {"k": 1}) == 10
    after, last = files(path / "pool"), parts.manifest(spark, str(path))
    assert all(after[f] == t for f, t in before.items())  # nothing is written over
    touched = {str(r[0]) for r in slots.where("sequence = 'PPPPPP'").select(parts.part(F.col("prompt_id"))).distinct().collect()}
    same = {p for p, v in last["tables"]["pool"]["files"].items() if first["tables"]["pool"]["files"][p] == v}
    assert same == set(first["tables"]["pool"]["files"]) - touched and same
    assert old.count() == 80
    now = parts.read(spark, str(path), "pool")
    assert now.count() == 80 and now.where("error is null and is_correct").count() == 80 and parts.read(spark, str(path), "errors").count() == 0
    assert now.select("trace_id").distinct().count() == 80
    assert parts.read(spark, str(path), "diversity").first()["n_prompts"] == 40
    assert drivers.backfill(spark, str(path), slots, completions.no_llm, {"k": 1}) == 0  # nothing is left to ask
    parts.forget(spark, str(path))
    assert parts.read(spark, str(path), "pool").count() == 80 and len(files(path / "pool")) < len(after)


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path, monkeypatch):
    path, df = str(tmp_path / "t"), spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    parts.put(spark, path, {"t": df}, "k")
    held = parts.manifest(spark, path)
    parts.put(spark, path, {"t": df.limit(0)}, "k")
    assert parts.read(spark, path, "t").count() == 0 and parts.read(spark, path, "t").columns == ["k", "v"]
    monkeypatch.setattr(parts, "manifest", lambda *_: held)
    with pytest.raises(RuntimeError, match="another run"):
        parts.put(spark, path, {"t": df}, "k")


def test_backfill_runs_no_tool_again(spark, tmp_path):
    """The outputs that lie beside the pool go into the prompts: here marked ones. A sequence that they lack gets its own."""
    path = str(tmp_path / "run")
    samples = spark.createDataFrame([("p0", "GGAGGQAAAA", {"strength": 0.5}), ("p1", "PPPPPP", {"strength": 0.5})], "prompt_id string, sequence string, ground_truth map<string,double>")
    samples = samples.select("*", *[F.lit("").alias(c) for c in ("family", "genus", "species", "protein_category")])
    slots = traces.slots(samples, 1, 0)

    def never(prompt):
        raise ConnectionError("no")

    def echo(prompt):
        return prompt.partition("Tool outputs: ")[2]

    drivers.start_pool(spark, path, slots, never)
    held = spark.read.parquet(f"{path}/tools").where(F.col("outputs").contains("GGX_repeat")).collect()
    assert len(held) == 1
    spark.createDataFrame(held, spark.read.parquet(f"{path}/tools").schema).withColumn("outputs", F.lit("marked")).write.parquet(f"{path}/marked")
    spark.read.parquet(f"{path}/marked").write.mode("overwrite").parquet(f"{path}/tools")
    assert drivers.backfill(spark, path, slots, echo) == 2
    said = {r["prompt_id"]: r["trace_text"] for r in parts.read(spark, path, "pool").collect()}
    assert said["p0"] == "marked" and "motif_detector" in said["p1"]


def test_a_pool_moves_its_sequences_few_times(spark, tmp_path):
    """MB of long sequences, in a pool and its backfill with sorted joins: what is shuffled and written is bounded, and no shuffle file outlives its step."""
    rng, path = random.Random(4), tmp_path / "run"
    rows = [(f"p{i}", "".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=20000)), "f", "g", "s", "c", {"strength": 0.5}) for i in range(100)]
    samples = spark.createDataFrame(rows, "prompt_id string, sequence string, family string, genus string, species string, protein_category string, ground_truth map<string,double>").repartition(4)
    samples.write.parquet(f"{tmp_path}/samples")
    slots = traces.slots(spark.read.parquet(f"{tmp_path}/samples"), 2, 1)

    def half(prompt):
        if prompt.partition("Sequence: ")[2][:1] < "L":
            raise ConnectionError("no")
        return completions.mock_llm(prompt)

    sc = spark.sparkContext
    blocks = sc._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: sc._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    left = lambda: {f for f in blocks.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    before, files_before = shuffled(), left()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        drivers.start_pool(spark, str(path), slots, half)
        assert drivers.backfill(spark, str(path), slots, completions.mock_llm) > 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    pool = parts.read(spark, str(path), "pool")
    assert pool.count() == 300 and pool.where("error is null AND length(sequence) = 20000 AND grounding_score is not null").count() == 300
    assert shuffled() - before < 45_000_000 and sum(map(os.path.getsize, left() - files_before)) < 100_000
