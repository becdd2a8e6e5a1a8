"""Hard negatives: for an anchor and each of its positives, the best rows of other labels whose score lies in a window below the positive's.

Anchors are dealt in groups, rows in blocks, which are written once. A task scores a group against its share of the blocks, one
block at a time: it works out the whole block's integer scores, sorts them by score and id, and reads from the sorted list. The first pass
reads each anchor's best rows of its own label; the second finds, by binary search, where each positive's upper limit lies, and
reads on from there through rows of other labels while they stay above its lower limit. Between blocks a task keeps only
what may still be among the first, so its memory doesn't grow with the table; tasks' lists are then ranked together.

All rows meet all anchors, as the full sort asks: work grows with rows times anchors, and each group of ``GROUP`` anchors has all
blocks shuffled to it once in each pass.

Cases. Rows with a null id, a null label, a null or empty vector, or an entry that is null or not finite take no part; nor do those of another length
than most have (of equals the longer). Ties go to the smaller id. Repeated rows are rows of their own: each is an anchor, and any may be another's positive or negative; an
anchor is never its own positive. Scores are exact; those beyond 63 bits count as the largest. Empty tables, and tables of one label, give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let_go, stored, table
from .whitening import usable, whole

POSITIVES, NEGATIVES, EVERY = 5, 10, 100
LOW, HIGH = 3, 9  # tenths of the positive's score that a negative's lies between
BLOCK, GROUP = 2048, 8192  # rows of a block, anchors of a group
PENDING = 1 << 17  # found entries that a task holds before it drops those that are not among the first


def blocks(vectors: DataFrame, ident: str, vector: str, label: Column) -> DataFrame:
    """block, rows, ids, labels and xs: usable rows in blocks, in which they stand by id; as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

        def packed(d: int) -> pa.RecordBatch:
            nonlocal at
            ids, labels, xs = (np.concatenate(c) for c in zip(*held.pop(d), strict=True))
            order = np.argsort(ids, kind="stable")
            at += 1
            narrow = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= xs.min() and xs.max() <= np.iinfo(t).max)
            cols = [[at], [d], [len(ids)], [ids[order].tobytes()], [labels[order].tobytes()], [xs[order].astype(narrow).tobytes()]]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["block", "d", "n", "ids", "labels", "xs"])

        for batch in batches:
            good = usable(batch.column(1))[0] & batch.column(0).is_valid().to_numpy(zero_copy_only=False) & batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            kept = batch.filter(pa.array(good))
            sizes = kept.column(1).value_lengths().to_numpy()
            for d in np.unique(sizes).tolist():
                own = kept.filter(pa.array(sizes == d))
                xs = whole(own.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(-1, d)
                ids, labels = own.column(0).to_numpy(), own.column(2).to_numpy()
                for i in range(0, len(ids), BLOCK):
                    held.setdefault(d, []).append((ids[i : i + BLOCK], labels[i : i + BLOCK], xs[i : i + BLOCK]))
                    if sum(len(p[0]) for p in held[d]) >= BLOCK:
                        yield packed(d)
        for d in [*held]:
            yield packed(d)

    rows = vectors.select(vectors[ident].cast("long").alias("id"), vectors[vector].alias("v"), label.cast("long").alias("label"))
    return stored(rows.mapInArrow(run, "block long, d int, n int, ids binary, labels binary, xs binary"))


class Rows:
    """The rows of a block."""

    def __init__(self, block: int, d: int, n: int, ids: bytes, labels: bytes, xs: bytes) -> None:
        self.block, self.ids, self.labels = block, np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.xs = np.frombuffer(xs, f"i{len(xs) // (n * d)}").reshape(n, d)


def scores(anchors: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """Integer inner products: as doubles while those are exact, then as longs, then as Python's integers."""
    most = anchors.shape[1] * int(np.abs(anchors.astype(np.float64)).max(initial=0) + 1) * int(np.abs(xs.astype(np.float64)).max(initial=0) + 1)
    if most < 1 << 53:
        return (anchors.astype(np.float64) @ xs.T.astype(np.float64)).astype(np.int64)
    if most < 1 << 62:
        return anchors @ xs.T.astype(np.int64)
    top = np.iinfo(np.int64).max
    return np.clip((anchors.astype(object) @ xs.T.astype(object)), -top, top).astype(np.int64)


def sorted_scores(anchors: np.ndarray, rows: Rows) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each anchor its scores of the whole block, highest first and ties by id, and the rows in that order."""
    for i in range(0, len(anchors), 64):
        some = scores(anchors[i : i + 64], rows.xs)
        for j, own in enumerate(some):
            order = np.lexsort((rows.ids, -own))
            yield i + j, own[order], order


def first_of(found: list[np.ndarray], keys: int, k: int) -> list[np.ndarray]:
    """The first k entries, by score (falling) and id, of each key: the columns are the keys, then id and score."""
    rows = np.concatenate(found) if found else np.empty((0, keys + 2), np.int64)
    rows = rows[np.lexsort((rows[:, keys], -rows[:, keys + 1], *(rows[:, c] for c in range(keys - 1, -1, -1))))]
    new = np.r_[True, (rows[1:, :keys] != rows[:-1, :keys]).any(1)][: len(rows)]
    start = np.flatnonzero(new)
    place = np.arange(len(rows)) - np.repeat(start, np.diff(np.r_[start, len(rows)]))
    return [rows[place < k]]


def _met(anchors: DataFrame, rows: DataFrame, groups: int, parts: int, read: Callable, keys: int, k: int, names: list[str]) -> DataFrame:
    """What ``read`` finds for each group of anchors in each block, cut to the first k of each key and part.

    anchors: ``group`` and ``row`` (a struct). A group's anchors go to each of its parts, blocks to a part of every group."""
    of = lambda df, kind: df.select("group", "part", F.lit(kind).alias("kind"), *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in fields.items()])
    fields = {"block": "long", "d": "int", "n": "int", "ids": "binary", "labels": "binary", "xs": "binary", "anchor": "binary"}
    asked = anchors.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    every = rows.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int"))
    dealt = of(asked, 0).unionByName(of(every, 1)).repartition(groups * parts, "group", "part").sortWithinPartitions("group", "part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, found, size = None, [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            rows = first_of(found, keys, k)[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                group, part, kind, block, d, n, ids, labels, xs, anchor = (c[i].as_py() for c in batch.columns)
                if (group, part) != now:
                    if found:
                        yield from out()
                    now, held, found, size = (group, part), [], [], 0
                if kind == 0:
                    held.append(anchor)
                    continue
                if held and isinstance(held[0], bytes):
                    held = [np.array([np.frombuffer(a, np.int64) for a in held])]
                if held:
                    more = read(held[0], Rows(block, d, n, ids, labels, xs))
                    found.append(more)
                    size += len(more)
                    if size > PENDING:
                        found, size = first_of(found, keys, k), 0
        if found:
            yield from out()

    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """keys, best: the first k of each key as an array of (minus score, id); a key has k entries at most from each part."""
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("below"), "id")))
    return found.groupBy(*keys).agg(F.slice(best, 1, k).alias("best"))


#: An anchor as longs: number of its row, id, label, then positives (lower and upper limit, score and id of each, and whether it is one), then its vector.
HEAD = 3


def mine(vectors: DataFrame, ident: str, vector: str, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, every: int = EVERY) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; anchors are the rows whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    found = blocks(vectors, ident, vector, label)
    shape = found.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if shape is None:
        return spark.createDataFrame([], result)
    d, rows = shape["d"], found.where(F.col("d") == shape["d"])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, n, ids, labels, xs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = Rows(block, d, n, ids, labels, xs)
                at = np.flatnonzero(own.ids % every == 0)
                number = own.block * BLOCK * 2 + at  # blocks hold fewer rows than that
                whole_rows = np.c_[number, own.ids[at], own.labels[at], own.xs[at].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(number), pa.array([r.tobytes() for r in whole_rows], pa.binary())], names=["number", "anchor"])

    anchors = stored(rows.select("block", "n", "ids", "labels", "xs").mapInArrow(pick, "number long, anchor binary"))
    n_anchors = anchors.count()
    if not n_anchors:
        return spark.createDataFrame([], result)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = -(-n_anchors // GROUP)
    parts = max(1, min(rows.count(), -(-2 * tasks // groups)))
    grouped = lambda df: df.withColumn("group", F.pmod(F.xxhash64("number"), F.lit(groups)).cast("int"))

    def best_own(held: np.ndarray, rows: Rows) -> np.ndarray:
        """The first rows of each anchor's own label; a row isn't its own positive."""
        out = []
        for a, s, order in sorted_scores(held[:, HEAD:], rows):
            number, own_label = held[a, 0], held[a, 2]
            same = np.flatnonzero(rows.labels[order] == own_label)[: positives + 1]
            same = same[rows.block * BLOCK * 2 + order[same] != number][:positives]
            out.append(np.c_[np.full(len(same), number), rows.ids[order[same]], s[same]])
        return np.concatenate(out)

    own = _met(grouped(anchors), rows, groups, parts, best_own, 1, positives, ["number", "id", "score"])
    best = _ranked(own, ["number"], positives)

    def with_limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for anchor, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                head = []
                for place in range(positives):
                    score, positive = (-own[place]["below"], own[place]["id"]) if place < len(own) else (0, 0)
                    low, high = -(-LOW * score // 10), HIGH * score // 10  # 30 s <= 100 t <= 90 s, in whole numbers
                    head += [low, high, score, positive, int(place < len(own))]
                a = np.frombuffer(anchor, np.int64)
                out.append(np.r_[a[:HEAD], np.array(head, np.int64), a[HEAD:]].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["number", "anchor"])

    ready = stored(anchors.join(best, "number").mapInArrow(with_limits, "number long, anchor binary"))

    def window(held: np.ndarray, rows: Rows) -> np.ndarray:
        """The first rows of other labels between the limits of each positive."""
        out = []
        for a, s, order in sorted_scores(held[:, HEAD + 5 * positives :], rows):
            other = np.flatnonzero(rows.labels[order] != held[a, 2])
            for place in range(positives):
                low, high, _, _, there = held[a, HEAD + 5 * place : HEAD + 5 * place + 5].tolist()
                if not there or low > high:
                    continue
                first, last = np.searchsorted(-s, -high, "left"), np.searchsorted(-s, -low, "right")
                i, j = np.searchsorted(other, first), np.searchsorted(other, last)
                at = other[i : min(j, i + negatives)]
                out.append(np.c_[np.full(len(at), held[a, 0]), np.full(len(at), place), rows.ids[order[at]], s[at]])
        return np.concatenate(out) if out else np.empty((0, 4), np.int64)

    met = _met(grouped(ready), rows, groups, parts, window, 2, negatives, ["number", "place", "id", "score"])
    ranked = _ranked(met, ["number", "place"], negatives)

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, place, best in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a = np.frombuffer(anchor, np.int64)
                score, positive = a[HEAD + 5 * place + 2 : HEAD + 5 * place + 4].tolist()
                n = len(best)
                cols = [np.full(n, a[1]), np.full(n, positive), np.arange(1, n + 1, dtype=np.int32), np.array([b["id"] for b in best]), np.full(n, score), np.array([-b["below"] for b in best])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    out = stored(ready.join(ranked, "number").select("anchor", "place", "best").mapInArrow(spelled, result))
    let_go(spark, found, anchors, ready)
    return out


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label)


ORACLE = f"""
WITH e AS (SELECT row_number() OVER () AS number, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor({256} * c::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.number, a.vec_id AS anchor_id, a.label = e.label AS same, e.vec_id, list_sum(list_transform(list_zip(a.x, e.x), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM e a JOIN e ON a.vec_id % {EVERY} = 0 AND a.number <> e.number),
p AS (SELECT number, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY number ORDER BY score DESC, vec_id) AS place FROM s WHERE same QUALIFY place <= {POSITIVES}),
n AS (SELECT p.number, p.place, p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.number, p.place ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.number = p.number AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score QUALIFY rank <= {NEGATIVES})
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n
"""
