"""Poisson replication: sources mixed to target weights by drawing a number of copies for each document.

A source of weight w (weights add up to 1) and n documents has the rate ``total * w / n``. A document's count is drawn by inversion: the
smallest k whose cumulative probability exceeds a number in [0, 1) taken from an MD5 of seed and doc_id, so it depends on
nothing else. A rate over ``MOST`` is the sum of several equal ones of at most ``MOST``, each drawn with an MD5 of its own: the
sum of Poisson numbers is a Poisson number, and no table of probabilities has over some 200 entries whatever the rate. Work grows with the
rows that come out. Each document is exploded by its count, and the copies are dealt and sorted by an MD5 of seed, doc_id and
copy: a global shuffle in which every partition holds a uniform share, whatever the sources' sizes.

Cases. A null source is a source like the others. A source without a weight counts as 0 and goes. A null doc_id is drawn
as its own value; rows of equal doc_id get equal counts. Null, empty and very long texts are kept whole. Ties: copies of equal ids have equal
keys, in no order among themselves. Empty table: no rows. Extra columns are kept; columns named ``copy`` or ``shuffle_key`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

SEED, MOST = 20, 64
#: Rates are broadcast where all sources' names and tables together have so many bytes at most; others join by a shuffle, each source dealt to ``SALTS`` keys.
BROADCAST_BYTES, ROW_BYTES, SALTS = 16 << 20, 2048, 64
STRIDE = 1024  # numbers of copies that each part of a rate may use; none reaches it


def _key(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]).cast("binary"))


def uniform(seed: int, ident: Column, part: Column) -> Column:
    """A number in [0, 1) of 52 bits, another for each part."""
    drawn = F.when(part == 1, _key(F.lit(seed), ident)).otherwise(_key(F.lit(seed), ident, F.lit("part"), part))
    return F.conv(F.substring(drawn, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None, total: int | None, source: str = "source") -> DataFrame:
    """A row for each source: its rate, the number of its parts, and the cumulative Poisson probabilities of one up to where less than 2**-52 is left."""
    sizes = cut(docs.select(docs[source].alias("__source")).groupBy("__source").agg(F.count("*").alias("n")))
    everything = sizes.agg(F.sum("n").alias("all_n"), F.count("*").alias("all_sources"))
    sizes = sizes.crossJoin(F.broadcast(everything))  # one row
    if weights is None:
        weight = 1.0 / F.col("all_sources")
    else:
        given = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v) / sum(weights.values()))]) if weights else F.lit(None)
        weight = F.coalesce(given[F.col("__source")], F.lit(0.0)) if weights else F.lit(0.0)
    wanted = F.col("all_n").cast("double") if total is None else F.lit(float(total))
    sizes = sizes.select("__source", (wanted * weight / F.col("n")).alias("__rate"))
    sizes = sizes.withColumn("__parts", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("__rate") / MOST))).withColumn("rate", F.col("__rate") / F.col("__parts"))
    steps = F.sequence(F.lit(1), F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int"))
    first = F.struct(F.lit(0.0).alias("log_fact"), F.array(F.exp(-F.col("rate"))).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        log_fact = acc["log_fact"] + F.ln(k)
        more = F.element_at(acc["cdf"], -1) + F.exp(k * F.ln("rate") - F.col("rate") - log_fact)
        return F.struct(log_fact.alias("log_fact"), F.concat(acc["cdf"], F.array(more)).alias("cdf"))

    cdf = F.when(F.col("rate") > 0, F.aggregate(steps, first, step)["cdf"]).otherwise(F.array(F.lit(1.0)))
    return sizes.select("__source", "__rate", "__parts", cdf.alias("__cdf"))


def _with_rates(docs: DataFrame, found: DataFrame, source: str) -> DataFrame:
    size = found.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("__source"), F.lit(0)) + ROW_BYTES), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        return docs.join(F.broadcast(found), docs[source].eqNullSafe(found["__source"]))
    hashable = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    dealt = docs.withColumn("__salt", F.pmod(F.xxhash64(*hashable), F.lit(SALTS)).cast("int"))
    salted = found.withColumn("__own", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(salted, dealt[source].eqNullSafe(salted["__source"]) & (dealt["__salt"] == salted["__own"]))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, seed: int = SEED, ident: str = "doc_id", source: str = "source") -> DataFrame:
    """The copies, with ``copy`` and ``shuffle_key``. weights: by source, any scale; None: all alike. total: rows wanted; None: as many as there are.

    Copies are numbered from 1; those of the second part of a large rate from ``STRIDE`` + 1, and so on.
    """
    docs = docs.drop("copy", "shuffle_key")
    names = docs.columns
    parts = _with_rates(docs, cut(rates(docs, weights, total, source)), source).where("__rate > 0")
    parts = parts.select(*[docs[c] for c in names], "__cdf", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__parts"))).alias("__part"))
    # The number is drawn once for each row. Rows that get no copy are left out before their texts move.
    drawn = F.transform(F.array(uniform(seed, F.col(f"`{ident}`"), F.col("__part"))), lambda u: F.size(F.filter("__cdf", lambda p: p <= u)))[0]
    counted = parts.withColumn("__copies", drawn).where("__copies > 0")
    number = (F.col("__part") - 1) * STRIDE
    copies = counted.select(*[F.col(f"`{c}`") for c in names], F.explode(F.sequence(number + 1, number + F.col("__copies"))).alias("copy"))
    copies = copies.withColumn("shuffle_key", _key(F.lit(seed), F.col(f"`{ident}`"), F.col("copy")))
    return copies.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op6_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH s AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
a AS (SELECT count(*)::DOUBLE AS s, sum(n) AS n FROM s),
r AS (SELECT source, whole / parts AS rate, parts FROM (SELECT *, greatest(1, ceil(whole / {MOST}))::BIGINT AS parts
      FROM (SELECT s.source, a.n * (1.0::DOUBLE / a.s) / s.n AS whole FROM s, a))),
k AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS k FROM r),
f AS (SELECT *, sum(CASE WHEN k = 0 THEN 0.0::DOUBLE ELSE ln(k::DOUBLE) END) OVER (PARTITION BY source ORDER BY k) AS lf FROM k),
c AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lf)) OVER (PARTITION BY source ORDER BY k) AS cdf FROM f),
p AS (SELECT d.doc_id, d.source, unnest(range(1, parts + 1)) AS part FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
u AS (SELECT *, ('0x' || substr(md5('{SEED}:' || doc_id::VARCHAR || CASE WHEN part = 1 THEN '' ELSE ':part:' || part::VARCHAR END), 1, 13))::BIGINT / {float(1 << 52)!r}::DOUBLE AS u FROM p),
n AS (SELECT u.doc_id, u.part, count(*) AS copies FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source AND c.cdf <= u.u GROUP BY u.doc_id, u.part)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, g.copy::BIGINT AS copy, md5('{SEED}:' || d.doc_id::VARCHAR || ':' || g.copy::VARCHAR) AS shuffle_key
FROM documents d JOIN n USING (doc_id), LATERAL (SELECT (n.part - 1) * {STRIDE} + unnest(range(1, n.copies + 1)) AS copy) g
"""
