"""Exact nearest binary codes by incremental multi-index hashing.

Codes of 64 bits are cut into segments of 16 bits or more, wider ones for more codes, so that few codes share a key. For radius 0, 1, 2, ... a query looks up every key at exactly that
distance from its own in each segment; each code found has its complete distance verified. After radius r in the first j
of m segments (and r - 1 in the others) every code within m r + j - 1 bits has been found, so a query ends once its k-th
distance is covered. Equal codes are one entry that keeps its k + 1 smallest ids, and equal queries are asked once.

Cases. Null or empty vectors, and null entries only, have no code: they are neither found nor asked. Null entries count
as 0. Ties go to the smaller id. A query is not its own neighbour. Repeated ids with one code count once. Fewer than k
others: all of them. Empty table: no rows. Vectors of other lengths than 64 are folded (entry i adds to bit i mod 64).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

K, EVERY = 10, 20


def binarize(vectors: DataFrame, ident: str, vector: str) -> DataFrame:
    """ident, code: bit i is set where the entries i, i + 64, ... add up to over 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            n = lists.value_lengths().fill_null(0).to_numpy()
            values = np.nan_to_num(lists.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64))
            first = np.cumsum(n) - n
            place = np.arange(len(values)) - np.repeat(first, n)
            sums = np.bincount(np.repeat(np.arange(len(n)), n) * 64 + place % 64, values, 64 * len(n)).reshape(-1, 64)
            codes = np.packbits(sums > 0, axis=1, bitorder="little").view(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, mask=n == 0)], names=["id", "code"])

    kind = vectors.schema[ident].dataType.simpleString()
    return vectors.select(vectors[ident], vectors[vector]).mapInArrow(run, f"id {kind}, code long").where("id is not null and code is not null").distinct()


def cuts(n: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment for n codes: any cut gives the same results."""
    m = 4 if n <= 1 << 18 else 3 if n <= 1 << 24 else 2
    widths = [64 // m + (i < 64 % m) for i in range(m)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def masks(radius: int, width: int) -> np.ndarray:
    """All segment values with so many bits set."""
    return np.array([sum(1 << b for b in bits) for bits in combinations(range(width), radius)], np.int64)


def steps(plan: list[tuple[int, int]]) -> Iterator[tuple[list[tuple[int, int]], int]]:
    """What to look up next as (radius, segment), and the distance that is covered then."""
    every, m = range(len(plan)), len(plan)
    yield [(r, j) for r in (0, 1) for j in every], m * 2 - 1
    for r in (2, 3, 4):
        yield [(r, j) for j in every], m * (r + 1) - 1
    for r in range(5, max(w for _, w in plan) + 1):
        for j in every:
            yield [(r, j)], m * r + j


def probes(queries: DataFrame, step: list[tuple[int, int]], plan: list[tuple[int, int]]) -> DataFrame:
    """A row for each key that a query looks up. Queries are dealt anew for each radius and segment, so all cores make keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, worst, of = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            for number, (r, j) in enumerate(step):
                shift, width = plan[j]
                own_q, own_worst, flips = q[of == number], worst[of == number], masks(r, width)
                part = (own_q >> np.int64(shift)) & np.int64((1 << width) - 1)
                size = max(1, 200_000 // max(1, len(flips)))
                for i in range(0, len(own_q), size):
                    own = slice(i, i + size)
                    keys = ((part[own, None] ^ flips[None, :]) | np.int64(j << 58)).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(own_q[own], len(flips))), pa.array(np.repeat(own_worst[own], len(flips)))], names=["key", "q", "worst"])

    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = queries.select("q", "worst", F.explode(F.sequence(F.lit(0), F.lit(len(step) - 1))).alias("step")).repartition(tasks, "q", "step")
    return dealt.mapInArrow(run, "key long, q long, worst int")


def nearest(codes: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, rank, id, distance. codes, asked: id and code, ids distinct."""
    first = Window.partitionBy("code").orderBy("id")
    entries = codes.withColumn("n", F.row_number().over(first)).where(f"n <= {k + 1}")
    entries = cut(entries.groupBy("code").agg(F.collect_list("id").alias("ids")))  # k + 1 at most
    plan = cuts(entries.count())
    key = lambda j, shift, width: F.shiftright("code", shift).bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit(j << 58))
    keyed = entries.select("code", "ids", F.explode(F.array(*[key(j, *x) for j, x in enumerate(plan)])).alias("key"))
    best = None
    open_ = cut(asked.select(F.col("code").alias("q")).distinct().withColumn("worst", F.lit(64)))
    per = Window.partitionBy("q").orderBy("distance", "id")
    closed: list[DataFrame] = []
    for step, covered in steps(plan):
        found = probes(open_, step, plan).join(keyed.hint("shuffle_hash"), "key").where("bit_count(q ^ code) <= worst")
        rows = found.select("q", F.expr("bit_count(q ^ code)").alias("distance"), F.explode("ids").alias("id"))
        if best is not None:
            rows = rows.unionByName(best.join(open_.select("q"), "q", "left_semi"))
        rows = rows.distinct().withColumn("n", F.row_number().over(per)).where(f"n <= {k + 1}").drop("n")
        best = cut(rows)
        worst = best.groupBy("q").agg(F.when(F.count("*") > k, F.max("distance")).otherwise(64).alias("worst"))
        state = cut(open_.select("q").join(worst, "q", "left").withColumn("worst", F.coalesce("worst", F.lit(64))))
        closed.append(best.join(state.where(f"worst <= {covered}"), "q", "left_semi"))
        open_ = state.where(f"worst > {covered}")
        if not open_.take(1):
            break
    else:
        closed.append(best.join(open_, "q", "left_semi"))  # every key has been looked up
    found = closed[0]
    for more in closed[1:]:
        found = found.unionByName(more)
    mine = Window.partitionBy("query_id").orderBy("distance", "id")
    out = asked.select(F.col("id").alias("query_id"), F.col("code").alias("q")).join(found, "q").where("id <> query_id")
    return out.withColumn("rank", F.row_number().over(mine)).where(f"rank <= {k}").select("query_id", "rank", "id", "distance")


def op10_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = cut(binarize(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    found = nearest(codes, codes.where(F.col("id") % EVERY == 0), K)
    return found.withColumnRenamed("id", "vec_id")


ORACLE = f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings),
p AS (SELECT q.vec_id AS query_id, e.vec_id, list_sum(list_transform(range(1, 65), lambda i: (q.b[i] <> e.b[i])::INT))::INT AS distance
      FROM e q JOIN e ON q.vec_id % {EVERY} = 0 AND q.vec_id <> e.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p) WHERE rank <= {K}
"""
