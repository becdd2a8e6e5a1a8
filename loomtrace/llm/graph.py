"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (its smallest node) for every node that has a link to another.

    A round connects each node's larger neighbours, then its smaller ones, to the least node it knows. Rounds grow with the logarithm
    of the longest path. Only the number of links and a checksum of them reach the driver; each round's links are
    checkpointed. The least nodes are written before they are joined: a join of two tables as read is one whose large keys Spark can split,
    which it does not do where one side comes out of an aggregate with the same partitioning.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    pairs = cut(pairs)
    state = _state(pairs)
    while state[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(pairs)
        if state == before:
            break
    out = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionByName(out.select(F.col("component").alias("node"), "component").distinct())
