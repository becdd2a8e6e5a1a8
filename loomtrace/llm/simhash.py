"""SimHash near-duplicates, linked by multi-index hashing.

A text's fingerprint is the bitwise majority over the hashes of its word shingles. Equal fingerprints are one node. The
first 64 bits are cut into segments; a link within the distance must come within a small radius in one of them
(pigeonhole), so each node goes to the tables under the keys of a small Hamming ball around every segment, and nodes that
meet under a key have their complete distance verified. Under a key only links of a spanning forest are emitted: they
keep what is connected, and number fewer than the nodes.

Cases. Null or empty text: fingerprint zero, linked like any other. Fewer words than a shingle: the whole sequence is the
one shingle. Repeated rows and equal texts: one node. A null id: the row keeps its fingerprint, and its component
is that of its fingerprint, null if no other row has it. Rows that share an id count as one document with several fingerprints: what links to one of them is reached
(``keep_one`` tells them apart). Very long texts are hashed whole, one at a time. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.stats import numbered
from . import words as hashed
from .common import let_go, stored, table, thrifty
from .graph import components
from .words import remix

SEED = 42
_SALT = 0xA0761D6478BD642F
WHOLE = 512  # rows under a key that are compared all at once
BLOCK = 1 << 15  # rows of a key in one part: a task holds two parts at most
FEW = 16  # sets of no more shingles are looked at whatever their fingerprints
NEAR = 4  # bits of the first word within which multi-index hashing finds all pairs
ODD = 4  # longs of a set's odd sketch
NEAREST = 4  # of each text that the first round looks at; each round looks at 16 times as many
SAMPLE, OFTEN, COMMON = 32, 16, 100_000  # one text in so many is counted; the counts and number of common shingles


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of every shingle of the words, lower-cased in A-Z."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    body = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(body, SEED)], np.uint64)
    ends = list(accumulate(map(len, words), lambda x, n: x + 1 + n))
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(body[a:b], SEED) for a, b in zip(starts, ends[width - 1 :])], np.uint64)


def majorities(hashes: np.ndarray, n_words: int) -> list[int]:
    """Bits set in over half the hashes; further words from hashes mixed again."""
    mixed = [hashes]
    for _ in range(n_words - 1):
        mixed.append(remix(mixed[-1]))
    bits = np.unpackbits(np.stack(mixed, 1).view(np.uint8), axis=1, bitorder="little")
    total = np.zeros(64 * n_words, np.int64)
    for i in range(0, len(bits), 255):  # sums of bytes
        total += np.add.reduce(bits[i : i + 255], axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > len(hashes), bitorder="little").view(np.uint64).tolist()


def majority(hashes: np.ndarray) -> int:
    return majorities(hashes, 1)[0]


def _names(n_words: int) -> list[str]:
    return [f"f{i}" for i in range(n_words)]


def fingerprints(docs: DataFrame, ident: str, text: str, shingle: int, words: int = 1, repeats: bool = True) -> DataFrame:
    """ident and the fingerprint as ``words`` longs, the first the plain 64 bits. repeats: whether a shingle counts as often as it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for body in batch.column(1).to_pylist():
                hashes = shingle_hashes(body, shingle)
                found.append(majorities(hashes if repeats else np.unique(hashes), words))
            longs = np.array(found, np.uint64).reshape(-1, words).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in longs)], names=[ident, *_names(words)])

    kind = docs.schema[ident].dataType.simpleString()
    return docs.select(docs[ident], docs[text]).mapInArrow(run, ", ".join([f"`{ident}` {kind}", *(f"{x} long" for x in _names(words))]))


def layout(segments: int, radius: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment: the radii add up to what the pigeonhole principle asks for ``radius``."""
    base, more = divmod(max(0, radius - segments + 1), segments)
    if base + (more > 0) > 2:
        raise ValueError("more segments are needed for this radius")
    widths = [64 // segments + (i < 64 % segments) for i in range(segments)]
    return [(sum(widths[i + 1 :]), w, base + (i < more)) for i, w in enumerate(widths)]


def ball_keys(f: np.ndarray, plan: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and table keys. Two values within a segment's radius meet under a key: at radius 1 under the one that
    has the differing bit set; at radius 2 each gives the ball of radius 1, and the balls meet."""
    rows, keys = [], []
    every = np.arange(len(f))
    for number, (shift, width, radius) in enumerate(plan):
        part = (f >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        tag = np.uint64(number << 56)
        rows.append(every)
        keys.append(part | tag)
        for bit in range(width) if radius else ():
            flip = np.uint64(1 << bit)
            own = every if radius == 2 else np.nonzero(part & flip == 0)[0]
            rows.append(own)
            keys.append((part[own] ^ flip) | tag)
    return np.concatenate(rows), np.concatenate(keys)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Complete distances between rows of a and rows of b."""
    d = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]).astype(np.uint16)
    for i in range(1, a.shape[1]):
        d += np.bitwise_count(a[:, None, i] ^ b[None, :, i])
    return d


def _closest_forest(d: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """The forest of least distances: every row keeps the link to its nearest."""
    i, j = np.nonzero(np.triu(d <= limit, 1))
    parent, links = list(range(len(d))), []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for k in np.argsort(d[i, j], kind="stable").tolist():
        a, b = find(int(i[k])), find(int(j[k]))
        if a != b:
            parent[b] = a
            links.append((int(i[k]), int(j[k])))
            if len(links) == len(d) - 1:
                break
    return links


def forest(f: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Links (row numbers) that connect what links within the limit connect, fewer than the rows.

    Rows outside the largest component so far are compared with all rows, a block at a time. Links inside it need no
    further look, so a dense group costs little more than its size.
    """
    n = len(f)
    if n <= WHOLE:
        return _closest_forest(distances(f, f), limit)
    label, size, done = np.arange(n), np.ones(n, np.int64), np.zeros(n, bool)
    links: list[tuple[int, int]] = []
    while len(rest := np.nonzero(~done & (label != size.argmax()))[0]):
        block = rest[:64]
        near = distances(f[block], f) <= limit
        done[block] = True
        for k in np.nonzero(near.sum(1) > 1)[0]:
            i = block[k]
            others = np.nonzero(near[k] & (label != label[i]))[0]
            while len(others):
                mine, other = label[i], label[others[0]]
                links.append((int(i), int(others[0])))
                label[label == other] = mine
                size[mine] += size[other]
                size[other] = 0
                others = others[label[others] != mine]
    return links


def bucket_links(key: np.ndarray, ids: np.ndarray, f: np.ndarray, limit: int, small: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Links between ids under equal keys; key is sorted. Every pair is looked at under keys of few rows, a forest under the others."""
    starts = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0]
    sizes = np.diff(np.r_[starts, len(key)])
    of = np.repeat(sizes, sizes)
    left, right = [], []
    for step in range(1, min(small, int(sizes.max(initial=1)))):
        i = np.nonzero((key[step:] == key[:-step]) & (of[:-step] <= small))[0]
        d = sum(np.bitwise_count(f[i, w] ^ f[i + step, w]).astype(np.uint16) for w in range(f.shape[1]))
        i = i[d <= limit]
        left.append(ids[i])
        right.append(ids[i + step])
    for s, n in zip(starts[sizes > small], sizes[sizes > small], strict=True):
        found = np.array(forest(f[s : s + n], limit), np.int64).reshape(-1, 2)
        left.append(ids[s + found[:, 0]])
        right.append(ids[s + found[:, 1]])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def grouped(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[list[np.ndarray]]:
    """Columns of whole groups; rows are sorted by their first ``by`` columns, and a group may go on over batches."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(cols[0]):
            continue
        other = np.zeros(len(cols[0]), bool)
        for c in cols[:by]:
            other |= c != c[-1]
        at = int(np.nonzero(other)[0][-1]) + 1 if other.any() else 0
        if held and (at or any(h[-1] != c[0] for h, c in zip(held[-1][:by], cols[:by], strict=True))):
            ends = [np.concatenate(x) for x in zip(*held, [c[:at] for c in cols], strict=True)]
            yield ends
            held = []
        elif at:
            yield [c[:at] for c in cols]
        held.append([c[at:] for c in cols])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def in_parts(rows: DataFrame, n: Column) -> DataFrame:
    """Rows with ``part`` and ``side``: a key of n rows over ``BLOCK`` is dealt into blocks by id, and each pair of blocks is a part."""
    blocks = rows.withColumn("__m", F.ceil(n / F.lit(BLOCK))).withColumn("__own", F.pmod(F.xxhash64("id"), F.col("__m")))
    pairs = blocks.withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__m") - 1)))
    low, high = F.least("__own", "__other"), F.greatest("__own", "__other")
    return pairs.withColumn("part", low * F.col("__m") + high).withColumn("side", (F.col("__own") > low).cast("int")).drop("__m", "__own", "__other")


def near_links(nodes: DataFrame, radius: int, segments: int, limit: int, words: int) -> DataFrame:
    """a, b: ids whose fingerprints lie within ``limit`` bits in all their words, as far as connection needs them.

    nodes: id and fingerprint, fingerprints distinct. Complete for pairs within ``radius`` bits of the first word.
    """
    plan, names = layout(segments, radius), _names(words)
    fields = ", ".join(["key long, id long", *(f"{x} long" for x in names)])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                cols = [c.to_numpy(zero_copy_only=False) for c in part.columns]
                rows, keys = ball_keys(cols[1].view(np.uint64), plan)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(pa.array(c[rows]) for c in cols)], names=["key", "id", *names])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in grouped(batches, 2):
            part = np.cumsum(np.r_[False, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])])
            a, b = bucket_links(part, cols[2], np.stack(cols[3:], 1).view(np.uint64), limit)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    dealt = nodes.select("id", *names).mapInArrow(deal, fields)
    heavy = dealt.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > BLOCK)
    split = in_parts(dealt.join(F.broadcast(heavy), "key", "left"), F.coalesce("rows", F.lit(1))).select("key", "part", "id", *names)
    return split.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(link, "a long, b long").distinct()


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes; fewer words than ``width``: one shingle of all."""
    w = hashed.split(texts, lower=True)
    n = np.diff(w.starts)
    h, (at, of) = hashed.runs(w.hashes, width, _SALT), hashed.windows(w, width)
    edge = np.searchsorted(of, np.arange(len(n) + 1))
    short = {int(k): hashed.runs(w.hashes, int(k), _SALT) for k in np.unique(n[(n > 0) & (n < width)])}
    for i in range(len(n)):
        if n[i] >= width:
            yield np.unique(h[at[edge[i] : edge[i + 1]]])
        else:
            yield short[int(n[i])][w.starts[i] : w.starts[i] + 1] if n[i] else np.empty(0, np.uint64)


def common_shingles(docs: DataFrame, ident: str, text: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the shingles that many texts of a sample share, at most ``COMMON``; they come last in the order of
    prefixes. Any order gives the same links, so neither the sample nor the bound decides what is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in hashed.chunks(batch, 0):
                h, n = np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_sets(chunk.column(0), shingle)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    some = docs.where(F.pmod(F.xxhash64(docs[ident]), F.lit(SAMPLE)) == 0).select(docs[text])
    counted = some.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(f"n >= {OFTEN}")
    rows = counted.orderBy(F.desc("n"), "h").limit(COMMON).collect()
    h, c = np.array([r["h"] for r in rows], np.int64).view(np.uint64), np.array([r["n"] for r in rows], np.int64)
    order = np.argsort(h)
    return h[order], c[order]


def prefix(s: np.ndarray, least: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles of a set, in an order that all sets share: two sets of this similarity have one of them in common."""
    h, c = common
    if len(h) and len(s):
        at, there = hashed.found_at(h, s)
        s = s[np.lexsort((s, np.where(there, c[at], 0)))]
    return s[: len(s) - math.ceil(least * len(s) - 1e-9) + 1]


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """Whether each of 64 * ``ODD`` cells gets an odd number of the set's hashes, as longs. Two sets' sketches differ in no more bits than there are hashes that only one of
    them has, since each of these changes one cell and those in common change none."""
    cell = (remix(s) % np.uint64(64 * ODD)).astype(np.int64)
    return np.packbits(np.bincount(cell, minlength=64 * ODD).astype(np.uint8) & 1, bitorder="little").view(np.uint64)


def most_odd(least: float) -> float:
    """Times the sum of both sizes: so many hashes at most does only one of two sets of this similarity have."""
    return (1 - least) / (1 + least)


def _odd_names() -> list[str]:
    return [f"odd{i}" for i in range(ODD)]


def sketches(docs: DataFrame, ident: str, text: str, shingle: int, n_words: int, least: float) -> DataFrame:
    """ident, the fingerprint of the set of shingles as ``n_words`` longs, its odd sketch, their number, and the prefix of their set."""
    names = [*_names(n_words), *_odd_names()]
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, ident, text, shingle))  # 16 bytes each, ``COMMON`` at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in hashed.chunks(batch, 1):
                found, odd, sizes, firsts = [], [], [], []
                for s in shingle_sets(chunk.column(1), shingle):
                    sizes.append(len(s))
                    firsts.append(prefix(s, least, shared.value).view(np.int64))
                    found.append(majorities(s, n_words))
                    odd.append(odd_sketch(s))
                both = np.hstack([np.array(found, np.uint64).reshape(-1, n_words), np.array(odd, np.uint64).reshape(-1, ODD)])
                longs = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in both.T]
                yield pa.RecordBatch.from_arrays([chunk.column(0), *longs, pa.array(sizes, pa.int32()), pa.array(firsts, pa.list_(pa.int64()))], names=[ident, *names, "n", "keys"])

    kind = docs.schema[ident].dataType.simpleString()
    return docs.select(docs[ident], docs[text]).mapInArrow(thrifty(run), ", ".join([f"`{ident}` {kind}", *(f"{x} long" for x in names), "n int", "keys array<long>"]))


SET = 5  # bytes of a shingle's hash that the exact look compares


def similar(links: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those links a, b whose sets have at least this Jaccard similarity; empty sets are alike. sets: id, s."""

    def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        column = column.cast(pa.large_binary())
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        out = np.zeros(((at[-1] - at[0]) // SET, 8), np.uint8)
        if len(out):
            out[:, :SET] = np.frombuffer(data, np.uint8)[at[0] : at[-1]].reshape(-1, SET)
        return out.view(np.uint64)[:, 0], (at - at[0]) // SET

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            (x, at), (y, to) = unpacked(batch.column(2)), unpacked(batch.column(3))
            keep = []
            for i in range(batch.num_rows):
                s, t = x[at[i] : at[i + 1]], y[to[i] : to[i + 1]]
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(both >= least * (len(s) + len(t) - both) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = links.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(thrifty(run), "a long, b long")


def _sets(docs: DataFrame, ids: DataFrame, ident: str, text: str, shingle: int) -> DataFrame:
    """id and s: the hashes of the texts of these ids, ``SET`` bytes each, as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in hashed.chunks(batch, 1):
                found = [np.unique(s >> np.uint64(64 - 8 * SET)).view(np.uint8).reshape(-1, 8)[:, :SET].tobytes() for s in shingle_sets(chunk.column(1), shingle)]
                yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array(found, pa.binary())], names=["id", "s"])

    texts = docs.select(docs[ident].cast("long").alias("id"), docs[text].alias("text")).join(ids, "id", "left_semi")
    sets = stored(texts.mapInArrow(thrifty(run), "id long, s binary"))
    return sets if sets.count() == ids.count() else stored(sets.dropDuplicates(["id"]))


def outside(ids: np.ndarray, label: np.ndarray, n: np.ndarray, side: np.ndarray, f: np.ndarray, odd: np.ndarray, limit: int, least: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Each row's ``most`` nearest of another label as its id, theirs and the distance; and whether any row has more than that.

    Sets whose sizes or odd sketches alone rule out the similarity do not link, nor do fingerprints over the limit unless a set has ``FEW`` shingles or
    fewer. Rows of two sides link across only.
    """
    left, right, apart, more = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint16)], False
    across = side.any() and not side.all()
    for s in range(0, len(ids), 64):
        own = slice(s, s + 64)
        d = distances(f[own], f)
        ok = (label[own, None] != label) & ((d <= limit) | (n[own, None] <= FEW) | (n <= FEW)) & (least * np.maximum(n[own, None], n) <= np.minimum(n[own, None], n) + 1e-9)
        ok &= distances(odd[own], odd) <= most_odd(least) * (n[own, None] + n) + 1e-9
        if across:
            ok &= side[own, None] != side
        for i in np.nonzero(ok.sum(1) > most)[0]:
            more = True
            at = np.nonzero(ok[i])[0]
            ok[i, at[np.lexsort((ids[at], d[i, at]))[most:]]] = False
        i, j = np.nonzero(ok)
        left.append(ids[s + i])
        right.append(ids[j])
        apart.append(d[i, j])
    return np.concatenate(left), np.concatenate(right), np.concatenate(apart), more


def _searcher(n_words: int, limit: int, least: float, most: int):
    """For ``mapInArrow``: what ``outside`` finds under each key and part, and the keys where more are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in grouped(batches, 2):
            starts = np.r_[np.nonzero(np.r_[True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])])[0], len(cols[0])]
            f = np.stack(cols[6:], 1).view(np.uint64)
            found, again = [], []
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                *links, more = outside(*(c[s:e] for c in cols[2:6]), f[s:e, :n_words], f[s:e, n_words:], limit, least, most)
                found.append(links)
                if more:
                    again.append(int(cols[0][s]))
            own, other, apart = (np.concatenate(x) for x in zip(*found, strict=True))
            none = pa.nulls(len(again), pa.int64())
            names = ["own", "other", "apart", "again"]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(other), pa.array(apart.astype(np.int32)), pa.nulls(len(own), pa.int64())], names=names)
            yield pa.RecordBatch.from_arrays([none, none, none.cast(pa.int32()), pa.array(again, pa.int64())], names=names)

    return run


def similar_links(docs: DataFrame, prints: DataFrame, nodes: DataFrame, ident: str, text: str, shingle: int, least: float, limit: int, n_words: int) -> DataFrame:
    """a, b: links of at least this similarity that connect all that such links connect.

    Multi-index hashing comes first: fingerprints within ``NEAR`` bits of the first word link as in ``near_links``. What it can't find is searched for among nodes that share
    a shingle of their prefixes; of keys that hold the same nodes one is looked at. Each node is tried with its key's node of least id. After each
    round's exact look every node searches again, among the nodes outside its confirmed component, for its nearest under all of its keys, more of them than in the round before,
    until no key and no node has any left: the links of a round are at most so many for each node.
    """
    names, odd, spark = _names(n_words), _odd_names(), docs.sparkSession
    ends = lambda links: links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    own = prints.select(F.col(ident).cast("long").alias("id"), "n", *names, *odd, "keys").join(nodes.select("id"), "id", "left_semi")
    dealt = own.select("id", F.explode("keys").alias("key"))
    met = dealt.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").select("key", "hub")
    met = stored(dealt.join(stored(met), "key").distinct())
    same = met.groupBy("key", "hub").agg(F.count("*").alias("rows"), F.expr("bit_xor(xxhash64(id))").alias("of"), F.max("id").alias("last"))
    keys = stored(same.groupBy("rows", "of", "hub", "last").agg(F.min("key").alias("key")).select("key", "rows"))
    slim = stored(own.drop("keys").dropDuplicates(["id"]))
    held = stored(met.join(keys, "key").join(slim, "id"))
    let_go(spark, met)
    hubs = slim.select(F.col("id").alias("hub"), F.struct("n", *names, *odd).alias("p"))
    pairs = held.where("id <> hub").join(hubs, "hub")
    differing = lambda of: sum((F.bit_count(F.col(x).bitwiseXOR(F.col(f"p.{x}"))) for x in of), F.lit(0))
    apart, few, many = differing(names), F.least("n", "p.n"), F.greatest("n", "p.n")
    near = pairs.where(((apart <= limit) | (few <= FEW)) & (F.lit(least) * many <= few + F.lit(1e-9)) & (differing(odd) <= F.lit(most_odd(least)) * (few + many) + F.lit(1e-9)))
    # Two hubs are enough to begin with, the nearest and the least: whatever these leave apart, the rounds look at.
    first = near.select("id", "hub", apart.alias("apart")).groupBy("id").agg(F.min(F.struct("apart", "hub")).alias("nearest"), F.min("hub").alias("least"))
    hub_links = first.select(F.explode(F.array_distinct(F.array("nearest.hub", "least"))).alias("a"), F.col("id").alias("b"))
    hashed_links = near_links(slim, NEAR, segments_for(slim.count(), NEAR), limit, n_words).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    tried = stored(hub_links.unionByName(hashed_links).distinct())
    sets = _sets(docs, stored(ends(tried)), ident, text, shingle)
    confirmed = stored(similar(tried, sets, least))
    again, most, done = None, NEAREST, [keys, held, slim, tried, sets]
    while True:
        of = components(confirmed, "a", "b")
        rows = held.join(of.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("component", "id"))
        mixed = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
        mixed = mixed if again is None else mixed.join(again, "key", "left_semi")
        split = in_parts(rows.join(mixed, "key"), F.col("rows")).select("key", "part", "id", "label", "n", "side", *names, *odd)
        searched = split.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(thrifty(_searcher(n_words, limit, least, most)), "own long, other long, apart int, again long")
        found = stored(searched.distinct())
        # Of what a node finds under all of its keys the nearest are looked at now; whatever it leaves, it searches for again.
        near_first = Window.partitionBy("own").orderBy("apart", "other")
        placed = found.where("own is not null").select("own", "other", F.row_number().over(near_first).alias("place"))
        chosen = stored(placed.where(f"place <= {most + 1}"))
        new = stored(chosen.where(f"place <= {most}").select(F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"))
        if not new.isEmpty():
            own_sets, before = _sets(docs, stored(ends(new).join(sets, "id", "left_anti")), ident, text, shingle), confirmed
            sets, done = sets.unionByName(own_sets), [*done, own_sets, before]
            confirmed = stored(confirmed.unionByName(similar(new, sets, least)))
        left = chosen.where(f"place > {most}").select(F.col("own").alias("id")).distinct()
        again = found.where("again is not null").select(F.col("again").alias("key")).unionByName(held.join(left, "id", "left_semi").select("key")).distinct()
        done += [found, chosen, new]
        if again.isEmpty():
            let_go(spark, *done)
            return confirmed
        tried, most = tried.unionByName(new), most * 16


def near_components(
    docs: DataFrame, ident: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4, segments: int | None = None, limit: int | None = None, words: int = 1, repeats: bool = True, least: float | None = None
) -> DataFrame:
    """ident, the fingerprint's longs, and component_id: the smallest id that links reach.

    ``radius`` bounds the first 64 bits, ``limit`` (by default the same) the distance over all ``words`` times 64.
    ``segments``: by default as few as keep the keys' mean number of rows small, given the number of nodes.
    ``least``: links are the pairs whose sets of shingles have this Jaccard similarity. Candidates come from prefixes of these sets and not
    from segments, so ``radius`` and ``repeats`` play no part; ``limit`` spares the exact look at candidates of more than ``FEW`` shingles.
    """
    names = _names(words)
    limit = radius if limit is None else limit
    prints = stored(fingerprints(docs, ident, text, shingle, words, repeats) if least is None else sketches(docs, ident, text, shingle, words, least))
    nodes = prints.groupBy(*names).agg(F.min(ident).cast("long").alias("id"))
    if least is None:
        nodes = stored(nodes)
        links = near_links(nodes.where("id is not null"), radius, segments or segments_for(nodes.count(), radius), limit, words)
    else:
        links = similar_links(docs, prints, nodes.where("id is not null"), ident, text, shingle, least, limit, words)
    joined = nodes.join(components(links, "a", "b"), F.col("id") == F.col("node"), "left")
    of = joined.select(*names, F.coalesce("component", "id").alias("component_id"))
    return prints.join(of, names).select(ident, *names, "component_id")


def segments_for(n: int, radius: int) -> int:
    """The number of segments of the widest keys that ``layout`` allows for few keys a node, so that rows a key stay near 1.

    Wider keys need balls of a larger radius: up to 2**20 nodes segments are near 21 bits at radius 4, beyond that 32 bits.
    """
    narrow, wide = max(1, math.ceil((radius + 1) / 2)), max(1, math.ceil((radius + 1) / 3))
    return narrow if n <= 1 << 20 else wide


def keep_one(docs: DataFrame, ident: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row of each group: that of least id; the columns stay as they are. Rows without an id stay.

    Where an id has several rows, each of its texts is a document of its own, in the order of a 64-bit hash of the text behind the id; of rows that have
    id and text in common the least by all columns stays.
    """
    if docs.where(docs[ident].isNotNull()).groupBy(ident).agg(F.count("*").alias("__n")).where("__n > 1").isEmpty():
        return _without(docs, ident, text, how)
    given = docs.where(docs[ident].isNotNull()).withColumn("__hash", F.xxhash64(text))
    rows = numbered(given.select(ident, "__hash").distinct(), "__row", ident, "__hash")
    whole = given.join(rows, [ident, "__hash"]).groupBy("__row").agg(F.min(F.struct(*docs.columns)).alias("__d"))
    single = stored(whole.select("__row", "__d.*"))
    kept = _without(single, "__row", text, how).drop("__row")
    return kept.unionByName(docs.where(docs[ident].isNull()))


def _without(docs: DataFrame, ident: str, text: str, how: dict) -> DataFrame:
    """The rows whose id, of which each has one at most, is the least of its group."""
    extra = near_components(docs, ident, text, **how).where(F.col("component_id") < F.col(ident)).select(F.col(ident).alias("__gone")).distinct()
    extra = stored(extra)  # Spark sees its size: few ids are broadcast, and texts then stay where they are
    return docs.join(extra, docs[ident] == extra["__gone"], "left_anti")


def op8_simhash_mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")
