"""Shards and mixes against plain Python, and their odd inputs."""

import hashlib
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomtrace.llm import mixing, sharding

SCHEMA = "doc_id long, text string, source string, cell long, cdf string, copies int, n_bytes string"


def rows(n, **more):
    return [(i, "x" * (i % 37), f"s{i % 3}", None, "c", 9, "odd") for i in range(n)]


def key_hash(i):
    return int(hashlib.md5(("null" if i is None else str(i)).encode()).hexdigest()[:15], 16)


def expected(items, limit):
    """The shortest prefix whose bytes fit, or that has one key."""
    out = []
    for i, n in items:
        for depth in range(61):
            same = [(j, m) for j, m in items if key_hash(j) >> (60 - depth) == key_hash(i) >> (60 - depth)]
            if sum(m for _, m in same) <= limit or len({j for j, _ in same}) == 1:
                out.append((i, n, bin(1 << depth | key_hash(i) >> (60 - depth))[3:], sum(m for _, m in same), len(same)))
                break
    return out


@pytest.mark.parametrize("limit", [1, 40, 300, 10**6])
def test_shards_match_plain_python(spark, limit):
    df = spark.createDataFrame(rows(120), SCHEMA)
    got = sharding.extendible_shards(df, "doc_id", "text", limit).collect()
    want = expected([(r[0], len(r[1])) for r in rows(120)], limit)
    assert sorted((r["doc_id"], r["n_bytes"], r["shard"], r["shard_bytes"], r["shard_docs"]) for r in got) == sorted(want)
    assert all(len(r["shard"]) == r["depth"] for r in got)


def test_shards_of_odd_rows(spark):
    big = "y" * 500_000
    data = [(1, big, "a"), (1, big, "a"), (None, None, None), (2, "", "a"), (3, "é", "b")]
    got = sharding.extendible_shards(spark.createDataFrame(data, "doc_id long, text string, h string"), "doc_id", "text", 1000).collect()
    assert len(got) == 5
    assert sorted((r["doc_id"] or -1, r["n_bytes"]) for r in got) == [(-1, 0), (1, 500_000), (1, 500_000), (2, 0), (3, 2)]
    by = defaultdict(set)
    for r in got:
        by[r["shard"]].add(r["doc_id"])
    assert {1} in by.values()  # the heavy key is alone
    names = list(by)
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    assert sharding.extendible_shards(spark.createDataFrame([], SCHEMA), "doc_id", "text").count() == 0


def test_write_shards_keeps_every_row(spark, tmp_path):
    df = spark.createDataFrame(rows(50), SCHEMA).select("doc_id", "text", "source")
    sharding.write_shards(df, "doc_id", "text", str(tmp_path / "out"), 100)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["doc_id"] for r in back.collect()) == list(range(50))
    assert back.select("shard").distinct().count() > 3


def poisson_count(rate, u):
    total, k = 0.0, 0
    while True:
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        if u < total or k > rate + 12 * math.sqrt(rate) + 30:
            return k
        k += 1


def test_mix_draws_the_inverse_poisson(spark):
    data = rows(300)
    df = spark.createDataFrame(data, SCHEMA)
    got = mixing.mix(df, {"s0": 3.0, "s1": 1.0}, total=500).collect()
    sizes = Counter(r[2] for r in data)
    want = Counter()
    for i, _, source, *_ in data:
        if source == "s2":
            continue
        u = int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) / 2**52
        want[i] = poisson_count(500 * {"s0": 0.75, "s1": 0.25}[source] / sizes[source], u)
    assert Counter(r["doc_id"] for r in got) == +want
    assert got[0]["cdf"] == "c" and got[0]["copies"] == 9  # extra columns stay
    assert {r["copy"] for r in got if r["doc_id"] == got[0]["doc_id"]} == set(range(1, want[got[0]["doc_id"]] + 1))
    assert abs(len(got) - 500) < 120


def test_mix_large_rates_nulls_and_empty(spark):
    data = [(1, None, None), (None, "", None), (2, "t" * 200_000, "b"), (2, "t" * 200_000, "b")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.mix(df, total=4000).collect()
    counts = Counter((r["doc_id"], r["source"]) for r in got)
    assert all(800 < n < 2600 for n in counts.values()) and len(counts) == 3
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(df, {"nowhere": 1.0}).count() == 0
    again = mixing.mix(df.repartition(3), total=4000).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mix_is_native(spark):
    plan = mixing.mix(spark.createDataFrame(rows(9), SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_shuffle_key_orders_each_partition(spark):
    df = mixing.mix(spark.createDataFrame(rows(200), SCHEMA), total=400)
    parts = df.withColumn("p", F.spark_partition_id()).collect()
    by = defaultdict(list)
    for r in parts:
        by[r["p"]].append(r["shuffle_key"])
    assert all(v == sorted(v) for v in by.values())
