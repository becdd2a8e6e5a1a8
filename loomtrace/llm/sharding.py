"""Extendible hashing: shards are hash prefixes, and only prefixes whose bytes exceed the limit get another bit.

Rows are told apart by 60 bits of an MD5 of their key. A round looks at ``BITS`` bits below the prefixes that are still
too large: it sums the bytes of each cell, adds them up for every prefix length, and takes as shards the shortest prefixes
that fit. Its directory has a slot for each cell that a new shard covers; rows find their shard by it. Cells that are
still too large go to the next round, so a few heavy rows do not make the whole directory double.

Cases. Null text counts as 0 bytes. A null key hashes as its own value. Rows of equal key stay together: a shard of one
key may pass the limit, as may a shard whose single row does. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, stored, table

HASH_BITS, BITS = 60, 12
LIMIT = 1 << 20


def key_hash(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def _nodes(cells: DataFrame, depth: int) -> DataFrame:
    """Bytes, rows and keys of every prefix from ``depth`` to ``depth + BITS`` bits."""
    level = cells.select("cell", "bytes", "docs", "low", "high", F.explode(F.sequence(F.lit(0), F.lit(BITS))).alias("level"))
    level = level.withColumn("node", F.expr(f"shiftright(cell, {BITS} - level)"))
    return level.groupBy("level", "node").agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"), F.min("low").alias("low"), F.max("high").alias("high"))


def _directory(rows: DataFrame, depth: int, limit: int) -> DataFrame:
    """cell -> level, node, bytes and docs of its shard; level null where the cell is still too large."""
    cell = F.expr(f"shiftright(h, {HASH_BITS - depth - BITS})")
    cells = rows.groupBy(cell.alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("docs"), F.min("h").alias("low"), F.max("h").alias("high"))
    nodes = cut(_nodes(cells, depth).withColumn("fits", (F.col("bytes") <= limit) | (F.col("low") == F.col("high"))))
    if depth:  # the round's roots are known to be too large
        nodes = nodes.withColumn("fits", F.col("fits") & (F.col("level") > 0))
    above = nodes.where(~F.col("fits")).select((F.col("level") + 1).alias("level"), F.explode(F.array(F.expr("node * 2"), F.expr("node * 2 + 1"))).alias("node"))
    shards = nodes.where("fits and level = 0").unionByName(nodes.where("fits").join(above, ["level", "node"], "left_semi"))
    slots = shards.select("level", "node", F.col("bytes").alias("shard_bytes"), F.col("docs").alias("shard_docs"), F.explode(F.expr(f"sequence(shiftleft(node, {BITS} - level), shiftleft(node + 1, {BITS} - level) - 1)")).alias("cell"))
    return cut(slots.unionByName(nodes.where(f"level = {BITS} and not fits").select(F.lit(None).cast("int").alias("level"), "node", F.lit(0).cast("long").alias("shard_bytes"), F.lit(0).cast("long").alias("shard_docs"), F.col("node").alias("cell"))))


def extendible_shards(docs: DataFrame, key: str, text: str, limit: int = LIMIT) -> DataFrame:
    """key, n_bytes, shard (its prefix as 0s and 1s), depth, shard_bytes and shard_docs of every row."""
    rows = docs.select(docs[key].alias("k"), key_hash(docs[key]).alias("h"), F.coalesce(F.octet_length(docs[text]), F.lit(0)).cast("long").alias("n_bytes"))
    rows = stored(rows)  # every round reads these few bytes a row, and the texts are read once
    done: list[DataFrame] = []
    for depth in range(0, HASH_BITS, BITS):
        directory = _directory(rows, depth, limit)
        if not depth:
            directory = F.broadcast(directory)  # 2**BITS slots at most
        found = rows.withColumn("cell", F.expr(f"shiftright(h, {HASH_BITS - depth - BITS})")).join(directory, "cell")
        name = F.lpad(F.conv(F.col("node").cast("string"), 10, 2), F.lit(depth) + F.col("level"), F.lit("0"))
        shard = F.when(F.lit(depth) + F.col("level") == 0, F.lit("")).otherwise(name)
        done.append(found.where("level is not null").select(F.col("k").alias(key), "n_bytes", shard.alias("shard"), (F.lit(depth) + F.col("level")).alias("depth"), "shard_bytes", "shard_docs"))
        if not directory.where("level is null").take(1):
            break
        rows = stored(found.where("level is null").select("k", "h", "n_bytes"))
    return reduce(DataFrame.unionByName, done)


def write_shards(docs: DataFrame, key: str, text: str, path: str, limit: int = LIMIT) -> None:
    """The rows as Parquet, one folder a shard. Rows of equal key share theirs."""
    shards = extendible_shards(docs, key, text, limit).select(F.col(key).alias("__key"), "shard").distinct()
    joined = docs.join(shards, docs[key].eqNullSafe(shards["__key"])).drop("__key")
    joined.withColumn("shard", F.concat(F.lit("b"), "shard")).repartition("shard").write.partitionBy("shard").parquet(path)


def op1_extendible_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible_shards(table(spark, sf_dir, "documents"), "doc_id", "text")


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h FROM documents),
n AS (SELECT g.depth, d.h >> (60 - g.depth)::INT AS p, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs, min(h) AS lo, max(h) AS hi
      FROM d, range(0, 61) AS g(depth) GROUP BY 1, 2),
f AS (SELECT d.doc_id, d.n_bytes, d.h, n.depth, n.p, n.shard_bytes, n.shard_docs,
             row_number() OVER (PARTITION BY d.doc_id, d.h ORDER BY n.depth) AS rn
      FROM d JOIN n ON n.p = d.h >> (60 - n.depth)::INT WHERE n.shard_bytes <= {LIMIT} OR n.lo = n.hi)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(p), 60, '0'), depth::INT) END AS shard,
       depth::INT AS depth, shard_bytes, shard_docs
FROM f WHERE rn = 1
"""
