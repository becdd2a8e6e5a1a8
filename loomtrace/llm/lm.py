"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Tokens are lower-cased words and one end a text, known by 64-bit hashes; there is no vocabulary, and every n-gram of every
learning row is kept. The keys' highest bits deal n-grams to segments. A segment's task adds up the counts that the other tasks
send it (each text chunk's n-grams are counted before), and puts each n-gram into the segment's part of the filter under
its levels 1 to j, where the j-th of ``STEPS`` is the largest that its count reaches; the part has ``BITS`` bits for each entry. A
count is read back by probing levels until one is missing. The filter grows with the corpus. Up to ``BROADCAST_BYTES``,
measured before, it is broadcast; a larger one stays dealt, and buckets of texts send their n-grams to the segments and get
levels back. Both ways give the same scores. What tasks send each other is a row for each chunk or bucket and *group* of segments, and a group's
task looks up many buckets' n-grams at once: rows of fewer and fewer n-grams, as segments grow in number, would take their time one by one.

With v the token before w and u the one before v: p(w|v) = (q(v w) + m p(w)) / (Q(v) + m) and, from order 3 on,
p(w|u v) = (q(u v w) + m p(w|v)) / (Q(u v) + m), down to add-one p(w). q is the least count of the level that was read, Q the greatest, so
the probabilities of all tokens add up to 1 at most (but for false hits). m is the mean number of different n-grams that go on
from a context. ``ORDER`` is 2 in the query; see the README on 3.

Cases. Null or empty text: the end token alone. Null ids are learned from. Repeated rows and ties are scored one by one. A very
long text is a chunk of its own. No learning rows: counts are 0. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import crc_mod, let_go, packed, stored, table, text_bytes, texts_in, thrifty
from .words import batch_of, cut_by, found_at, from_bytes, narrow, remix, rows_of, to_bytes  # noqa: F401

ORDER, BITS, PROBES = 2, 8, 4
SEGMENT_TEXT = 1 << 22  # bytes of text for each segment
CHUNK = 1 << 21  # bytes of text whose n-grams are counted at once
BROADCAST_BYTES = 160 << 20  # of filter and token counts together
#: Counts from which levels begin: 1, 2, 3, 4, 6, 8, 12, ...
STEPS = np.array([1, 2, *(x for i in range(1, 61) for x in (3 << (i - 1), 2 << i))], np.uint64)
#: Most segments in a group are 2 ** these; no segments share a group while there are at most 2 ** WIDE.
COUNT_GROUP, ASK_GROUP, WIDE = 2, 4, 8
ASKED = 1 << 18  # n-grams that a group looks up at once
START, END = np.uint64(0x51AFD7ED558CCD01), np.uint64(0xC4CEB9FE1A85EC55)
FOLDS, HELD_OUT = 7, 2


@dataclass
class Tokens:
    """The tokens of some texts in a row, two starts before each text; ``event``: where a token stands that is predicted."""

    hashes: np.ndarray
    event: np.ndarray
    first: np.ndarray  # of each text's events


def tokens_of(texts: pa.Array) -> Tokens:
    w = words.split(texts, lower=True)
    n = np.diff(w.starts)
    starts = w.starts[:-1] + 3 * np.arange(len(n))
    hashes = np.full(len(w.hashes) + 3 * len(n), START, np.uint64)
    hashes[np.arange(len(w.hashes)) + 3 * np.repeat(np.arange(len(n)), n) + 2] = w.hashes
    hashes[starts + n + 2] = END
    events = np.ones(len(hashes), bool)
    events[starts] = events[starts + 1] = False
    return Tokens(hashes, np.flatnonzero(events), np.cumsum(np.r_[0, n[:-1] + 1]) if len(n) else n)


def keys_of(t: Tokens, order: int) -> np.ndarray:
    """Keys of the n-grams that end at each place; those that begin before a text's two starts are none of the text's."""
    out = t.hashes
    with np.errstate(over="ignore"):
        for back in range(1, order):
            out = remix(out * np.uint64(0x9E3779B97F4A7C15) + np.r_[np.full(back, START), t.hashes[:-back]])
        return remix(out + np.uint64(order))


def learned_keys(t: Tokens, order: int, last: bool) -> np.ndarray:
    """What a chunk adds to the counts: its events and, but for the last order, each text's starts as contexts."""
    keys = keys_of(t, order)
    return keys[t.event] if last else np.r_[keys[t.event], keys[t.event[t.first] - 1]]


def places(keys: np.ndarray, level: int, probe: int, size: np.ndarray | int) -> np.ndarray:
    """Which of ``size`` bits (under 2 ** 32) a key of a level sets or probes."""
    with np.errstate(over="ignore"):
        x = remix(keys + np.uint64(level * 0x9E3779B97F4A7C15 + probe * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
        return (x >> np.uint64(32)) * np.uint64(size) >> np.uint64(32) if np.isscalar(size) else (x >> np.uint64(32)) * size >> np.uint64(32)


def build_part(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A segment's part of the filter: whole 64-bit words, a bit for each place."""
    level = np.searchsorted(STEPS, counts, "right")
    size = 64 * max(1, math.ceil(int(level.sum()) * BITS / 64))
    bits = np.zeros(size, bool)
    for j in range(1, int(level.max(initial=0)) + 1):
        own = keys[level >= j]
        for p in range(PROBES):
            bits[places(own, j, p, size)] = True
    return np.packbits(bits, bitorder="little")


@dataclass
class Filter:
    """Parts of some segments, one after the other; ``at`` and ``size`` (in bits) by segment."""

    bits: int
    data: np.ndarray
    at: np.ndarray
    size: np.ndarray
    first: int = 0  # the segment that ``at`` and ``size`` begin with

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The highest level all of whose probes, and those of the levels below, are set; 0: none."""
        keys = narrow(keys, self.bits)
        segment = (keys >> np.uint64(64 - self.bits)).astype(np.int64) - self.first
        at, size = self.at[segment], self.size[segment].astype(np.uint64)
        out, left, j = np.zeros(len(keys), np.uint8), np.flatnonzero(size), 1
        while len(left):
            for p in range(PROBES):
                place = at[left] + places(keys[left], j, p, size[left]).astype(np.int64)
                left = left[self.data[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1]
            out[left] = j
            j += 1
        return out


@dataclass
class Model:
    """``segments``: segment, part, tokens, counts as a table; and the totals."""

    segments: DataFrame
    bits: int
    order: int
    total: int
    types: int
    more: list[float]  # m of order 2, 3, ...
    n_bytes: int


SEGMENT = "segment int, part binary, tokens binary, counts binary, total long, distinct array<long>"


def group_bits(bits: int, most: int) -> int:
    return min(bits, max(WIDE, bits - most))


def edges(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each of the segments, or groups, of sorted keys begins, and their end."""
    return np.r_[np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(keys)]


def distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)  # np.unique by hashing takes many times as long
    return keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys


def learn(texts: DataFrame, order: int = ORDER, segment_text: int = SEGMENT_TEXT) -> Model:
    """texts: a column of texts."""
    if not 1 <= order <= 3:
        raise ValueError("order: 1 to 3")
    column = texts.columns[0]
    bits = words.segment_bits(text_bytes(texts, column), segment_text)

    shared = group_bits(bits, COUNT_GROUP)
    each = 1 << (bits - shared)  # segments of a group

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in words.chunks(batch, 0, CHUNK):
                t = tokens_of(chunk.column(0))
                found = [np.unique(x, return_counts=True) for x in (t.hashes[t.event], *(narrow(learned_keys(t, k, k == order), bits) for k in range(1, order + 1)))]
                at = [edges(keys, bits) for keys, _ in found]
                n = [x.astype(np.uint32) for _, x in found]
                rows: list[tuple] = []
                for s in range(0, 1 << bits, each):
                    own = [slice(x[s], x[s + each]) for x in at]
                    if any(x.start < x.stop for x in own):
                        sizes = np.concatenate([np.diff(x[s : s + each + 1]) for x in at]).astype(np.int32)
                        keys = b"".join(to_bytes(keys[x], bits) for (keys, _), x in zip(found[1:], own[1:], strict=True))
                        rows.append((s // each, sizes.tobytes(), found[0][0][own[0]].tobytes(), keys, np.concatenate([x[y] for x, y in zip(n, own, strict=True)]).tobytes()))
                yield batch_of(rows, ["group", "sizes", "tokens", "keys", "n"], (pa.int32(), *4 * (pa.binary(),)))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, rows in groupby(rows_of(batches), lambda r: r[0]):
            segment = np.arange(group * each, (group + 1) * each, dtype=np.uint64)
            parts: list[list[tuple]] = [[] for _ in range(order + 1)]
            for _, sizes, tokens, keys, n in rows:
                size = np.frombuffer(sizes, np.int32).reshape(order + 1, each)
                every = from_bytes(keys, 0, bits) | np.repeat(np.tile(segment, order), size[1:].ravel()) << np.uint64(64 - bits)
                split = np.split(every, np.cumsum(size[1:].sum(1))[:-1])
                for own, *x in zip(parts, [np.frombuffer(tokens, np.uint64), *split], np.split(np.frombuffer(n, np.uint32), np.cumsum(size.sum(1))[:-1]), strict=True):
                    own.append(x)
            found = [_sums(x) for x in parts]
            del parts
            at = [np.searchsorted(keys, segment << np.uint64(64 - bits)).tolist() + [len(keys)] for keys, _ in found]
            for i, s in enumerate(segment.tolist()):
                tokens, *grams = [(keys[x[i] : x[i + 1]], n[x[i] : x[i + 1]]) for (keys, n), x in zip(found, at, strict=True)]
                part = build_part(np.concatenate([g[0] for g in grams]), np.concatenate([g[1] for g in grams]))
                row = (s, part.tobytes(), tokens[0].tobytes(), tokens[1].tobytes(), int(tokens[1].sum()), [len(tokens[0]), *(len(g[0]) for g in grams[1:])])
                kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64()))
                yield batch_of([row], ["segment", "part", "tokens", "counts", "total", "distinct"], kinds)

    counted = texts.mapInArrow(thrifty(count), "group int, sizes binary, tokens binary, keys binary, n binary")
    segments = stored(counted.repartition("group").sortWithinPartitions("group").mapInArrow(thrifty(merge), SEGMENT))
    sums = segments.agg(F.sum("total"), *[F.sum(F.get("distinct", F.lit(k))) for k in range(order)], F.sum(F.octet_length("part") + F.octet_length("tokens") + F.octet_length("counts"))).first()
    total, *distinct, n_bytes = [x or 0 for x in sums]
    return Model(segments, bits, order, total, distinct[0], [max(1.0, b / max(1, a)) for a, b in zip(distinct, distinct[1:], strict=False)], n_bytes)


def _sums(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.uint64)
    if not len(keys):
        return keys, n
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(n, first)


@dataclass
class Totals:
    order: int
    total: int
    types: int
    more: list[float]


def text_scores(t: Tokens, totals: Totals, counts: Callable[[np.ndarray], np.ndarray], levels: Callable[[np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """n_tokens, n_known, base and score of each text. counts: of tokens; levels: of keys."""
    if not len(t.first):
        return [np.empty(0)] * 4
    low = np.r_[np.uint64(0), STEPS].astype(np.float64)
    high = np.r_[0.0, STEPS[1:].astype(np.float64) - 1, np.inf]

    def once(x: np.ndarray, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        distinct, where = np.unique(x, return_inverse=True)
        return f(distinct)[where]

    c = once(t.hashes[t.event], counts).astype(np.float64)
    base = np.log10((c + 1) / (totals.total + totals.types + 1))
    p = before = None
    for k in range(1, totals.order + 1):
        level = once(keys_of(t, k), levels)
        q = low[level[t.event]]
        if k == 1:
            p = (q + 1) / (totals.total + totals.types + 1)
        else:
            m = totals.more[k - 2]
            p = np.minimum(1.0, (q + m * p) / (before + m))
        before = high[level[t.event - 1]]
    per = lambda x: np.add.reduceat(x, t.first)
    return [np.diff(np.r_[t.first, len(t.event)]), per((c > 0).astype(np.int64)), per(base), per(np.log10(p))]


def _found(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Values of sorted keys; 0 for those that are missing."""
    at, there = found_at(keys, asked)
    return np.where(there, values[at], 0) if len(keys) else np.zeros(len(asked), np.int64)


NAMES = ["n_tokens", "n_known", "base_score", "score"]


def _batch(ids: pa.Array, ident: str, scores: list[np.ndarray]) -> pa.RecordBatch:
    kinds = (np.int64, np.int64, np.float64, np.float64)
    return pa.RecordBatch.from_arrays([ids, *(pa.array(np.asarray(x).astype(k)) for x, k in zip(scores, kinds, strict=True))], names=[ident, *NAMES])


def score(docs: DataFrame, model: Model, ident: str, text: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """ident, n_tokens, n_known, base_score, score."""
    rows = docs.select(docs[ident], docs[text])
    totals = Totals(model.order, model.total, model.types, model.more)
    schema = f"`{ident}` {rows.schema[0].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double"
    return _by_broadcast(rows, model, totals, ident, schema) if model.n_bytes <= broadcast_bytes else _by_exchange(rows, model, totals, ident, schema)


def _by_broadcast(rows: DataFrame, model: Model, totals: Totals, ident: str, schema: str) -> DataFrame:
    """The filter and the token counts, of ``BROADCAST_BYTES`` at most, go to every worker."""
    n, at = 1 << model.bits, 0
    where, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
    data, tokens, counts = [], [], []
    for r in model.segments.orderBy("segment").select("segment", "part", "tokens", "counts").toLocalIterator():
        where[r["segment"]], size[r["segment"]] = at, 8 * len(r["part"])
        at += 8 * len(r["part"])
        data.append(np.frombuffer(r["part"], np.uint8))
        tokens.append(np.frombuffer(r["tokens"], np.uint64))
        counts.append(np.frombuffer(r["counts"], np.uint64).astype(np.uint32 if model.total < 1 << 32 else np.uint64))
    none = np.empty(0, np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast((np.concatenate([none, *data]), where, size, np.concatenate([np.empty(0, np.uint64), *tokens]), np.concatenate([np.empty(0, np.uint32), *counts])))
    bits = model.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, where, size, tokens, counts = shared.value
        held = Filter(bits, data, where, size)
        for batch in batches:
            for chunk in words.chunks(batch, 1):
                yield _batch(chunk.column(0), ident, text_scores(tokens_of(chunk.column(1)), totals, lambda x: _found(tokens, counts, x), held.levels))

    return rows.mapInArrow(thrifty(run), schema)


def _by_exchange(rows: DataFrame, model: Model, totals: Totals, ident: str, schema: str) -> DataFrame:
    """Buckets of texts ask the groups of segments: for the counts of their tokens, and for the levels of their keys."""
    buckets = packed(rows)
    bits, order = model.bits, model.order
    shared = group_bits(bits, ASK_GROUP)
    each = 1 << (bits - shared)  # segments of a group
    kind = np.uint32 if model.total < 1 << 32 else np.uint64  # of counts
    names = ["group", "bucket", "what", "a", "b", "c"]
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    fields = "group int, bucket long, what int, a binary, b binary, c binary"

    def keys_in(t: Tokens) -> np.ndarray:
        return distinct(np.concatenate([narrow(keys_of(t, k), bits) for k in range(1, order + 1)]))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                t, bucket = tokens_of(texts_in(batch.column(2)[i])), batch.column(0)[i].as_py()
                tokens, keys = distinct(t.hashes[t.event]), keys_in(t)
                at = np.column_stack([edges(x, shared)[j:][: 1 << shared] for x in (tokens, keys) for j in (0, 1)])
                yield batch_of([(g, bucket, 1, tokens[i:j].tobytes(), keys[k:n].tobytes(), None) for g, (i, j, k, n) in enumerate(at.tolist()) if i < j or k < n], names, kinds)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, own in groupby(rows_of(batches), lambda r: r[0]):
            at, size = np.zeros(each, np.int64), np.zeros(each, np.int64)
            data, tokens, counts = [np.empty(0, np.uint8)], [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
            held, waiting, n = None, [], 0
            for _, bucket, what, a, b, c in own:
                if what == 0:  # the group's segments come first, in order
                    i = bucket - group * each
                    at[i], size[i] = 8 * sum(map(len, data)), 8 * len(a)
                    for x, raw, k in zip((data, tokens, counts), (a, b, c), (np.uint8, np.uint64, np.uint64), strict=True):
                        x.append(np.frombuffer(raw, k))
                    continue
                if held is None:
                    held, tokens, counts = Filter(bits, np.concatenate(data), at, size, group * each), np.concatenate(tokens), np.concatenate(counts).astype(kind)
                waiting.append((bucket, np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)))
                n += len(waiting[-1][1]) + len(waiting[-1][2])
                if n >= ASKED:
                    yield told(group, waiting, held, tokens, counts)
                    waiting, n = [], 0
            if waiting:
                yield told(group, waiting, held, tokens, counts)

    def told(group: int, waiting: list[tuple], held: Filter, tokens: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        """What some buckets asked for, looked up together."""
        found = _found(tokens, counts, np.concatenate([w[1] for w in waiting])).astype(kind)
        levels = held.levels(np.concatenate([w[2] for w in waiting]))
        cuts = [np.split(x, np.cumsum([len(w[i]) for w in waiting])[:-1]) for i, x in ((1, found), (2, levels))]
        return batch_of([(group, w[0], 1, x.tobytes(), y.tobytes(), None) for w, x, y in zip(waiting, *cuts, strict=True)], names, kinds)

    def use(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said: list[tuple[bytes, bytes]] = []
        for batch in batches:
            what = batch.column(2).to_pylist()
            for i in range(batch.num_rows):
                if what[i] == 1:
                    said.append((batch.column(3)[i].as_py(), batch.column(4)[i].as_py()))
                    continue
                t = tokens_of(texts_in(batch.column(6)[i]))
                counts, levels = np.frombuffer(b"".join(x[0] for x in said), kind), np.frombuffer(b"".join(x[1] for x in said), np.uint8)
                keys, said = keys_in(t), []
                yield _batch(batch.column(5)[i].values, ident, text_scores(t, totals, lambda _: counts, lambda x: _found(keys, levels, narrow(x, bits))))  # noqa: B023

    whole = model.segments.select(F.expr(f"CAST(segment DIV {each} AS int)").alias("group"), F.col("segment").cast("long").alias("bucket"), F.lit(0).alias("what"), F.col("part").alias("a"), F.col("tokens").alias("b"), F.col("counts").alias("c"))
    asks = buckets.mapInArrow(thrifty(ask), fields).unionByName(whole)
    answers = asks.repartition("group").sortWithinPartitions("group", "what", "bucket").mapInArrow(thrifty(answer), fields)
    texts = buckets.select("bucket", F.lit(None).cast("int").alias("group"), F.lit(3).alias("what"), F.lit(None).cast("binary").alias("a"), F.lit(None).cast("binary").alias("b"), "ids", "texts")
    nothing = buckets.schema
    both = answers.select("bucket", "group", "what", "a", "b", F.lit(None).cast(nothing["ids"].dataType).alias("ids"), F.lit(None).cast(nothing["texts"].dataType).alias("texts"))
    ready = both.unionByName(texts).repartition("bucket").sortWithinPartitions("bucket", "what", "group")
    return ready.mapInArrow(thrifty(use), schema)


def op2_log_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    model = learn(docs.where(~held_out).select("text"))
    found = score(docs, model, "doc_id", "text")
    if model.n_bytes <= BROADCAST_BYTES:
        let_go(spark, model.segments)  # the workers have it all
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
