"""Best-fit packing into bins of several permitted capacities.

A text of w words is w + 1 units long (its end is a unit); texts longer than the largest capacity are cut into pieces of
that capacity. Pieces are dealt to blocks of about ``BLOCK`` pieces by a hash of id and piece, so which pieces meet depends on the table
and not on its splits. In a block pieces go from the longest to the shortest, each into the open bin that it leaves the least room in
(best fit); where none has room, a bin is opened. Which capacities bins may be opened at is chosen for the block as a whole: every
choice that has the largest capacity is tried, a new bin takes the least of its capacities that holds the piece, every bin finally shrinks to the
smallest permitted capacity that holds its contents, and the choice of least total cost wins.

Cases. Null or empty text: one piece of length 1. Ids may be of any type that can be hashed. Repeated rows and ties are placed one by one, in order
of length, then hash, then place in the block; rows of one id in a batch are dealt to different blocks, so a common id fills no block. A very long
text: its pieces are rows of their own. Empty table: no rows. Extra columns are ignored. Memory: a task holds a block of ``2 * BLOCK`` pieces, or of
``BLOCK_CHARS`` characters, at most; a block of more is packed in parts, in order of hash.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as hashed
from .common import table, thrifty

CAPACITIES = (512, 1024, 2048, 4096)
BLOCK, BLOCK_CHARS = 8192, 48 << 20
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cost(capacity: int) -> float:
    """Units of work of a sequence: linear layers, and attention, which grows with the square."""
    return capacity * (1 + capacity / 16384)


def best_fit_bins(lengths: Sequence[int], order: Sequence[int], openers: Sequence[int]) -> list[list[int]]:
    """Indices of each bin's pieces. order: indices from the longest piece on; openers: capacities that bins are opened at, ascending.

    Open bins are kept by the room they have; a whole number's bits tell which rooms occur.
    """
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0
    for i in order:
        n = lengths[i]
        above = rooms >> n
        if above:
            room = n + (above & -above).bit_length() - 1
            own = by_room[room]
            b = own.pop()
            if not own:
                rooms ^= 1 << room
        else:
            room, b = next(c for c in openers if c >= n), len(bins)
            bins.append([])
        bins[b].append(i)
        if room > n:
            rooms |= 1 << (room - n)
            by_room.setdefault(room - n, []).append(b)
    return bins


def pack(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, price: Callable[[int], float] = cost) -> list[tuple[int, list[int]]]:
    """Bins (capacity, indices of the pieces in order); every length is at least 1 and at most the largest capacity."""
    sizes = sorted(set(capacities))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    best: tuple[float, list[tuple[int, list[int]]]] | None = None
    for k in range(len(sizes)):
        for some in combinations(sizes[:-1], k):
            bins = best_fit_bins(lengths, order, (*some, sizes[-1]))
            shrunk = [(next(c for c in sizes if c >= used), members) for members in bins for used in [sum(lengths[i] for i in members)]]
            total = sum(price(c) for c, _ in shrunk)
            if best is None or total < best[0]:
                best = total, shrunk
    return best[1] if best else []


def pieces(text: str | None, largest: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """piece, first word, words, length and the piece's characters; the last piece has the end's unit."""
    text = text or ""
    at = [m.start() for m in _WORD.finditer(text)]
    n = len(at)
    for k, start in enumerate(range(0, n + 1, largest)):
        stop = min(start + largest, n)
        begin = 0 if not k else at[start] if start < n else len(text)
        yield k, start, stop - start, min(start + largest, n + 1) - start, begin, at[stop] if stop < n else len(text)


def best_fit(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, ident: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """A row for each piece: its document, words, bin, the bin's capacity and fill, and its offset in the bin."""
    largest = max(capacities)
    kind = docs.schema[ident].dataType.simpleString()
    rows = docs.select(docs[ident].alias("id"), docs[text].alias("text"))
    bits = max(0, math.ceil(math.log2(max(1, rows.count()) / BLOCK)))
    cut_names = ["id", "again", "piece", "first_word", "n_words", "length", *["text"] * with_text]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32())

    def rows_of(chunk: pa.RecordBatch, at: list[int], again: list[int], values: list, bodies: pa.Array) -> pa.RecordBatch:
        cols = [pa.array(again, pa.int64()), *(pa.array(v, k) for v, k in zip(values, kinds, strict=True))]
        return pa.RecordBatch.from_arrays([chunk.column(0).take(pa.array(at, pa.int64())), *cols, *([bodies] if with_text else [])], names=cut_names)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, int] = {}
            for chunk in hashed.chunks(batch, 1):
                again = []
                for key in map(repr, chunk.column(0).to_pylist()):
                    seen[key] = seen.get(key, -1) + 1
                    again.append(seen[key])
                texts = chunk.column(1).fill_null("")
                n = np.diff(hashed.split(texts).starts)
                whole = np.flatnonzero(n < largest)  # most texts are one piece
                none = np.zeros(len(whole), np.int64)
                yield rows_of(chunk, whole.tolist(), [again[i] for i in whole], [none.astype(np.int32), none, n[whole], (n[whole] + 1).astype(np.int32)], texts.take(pa.array(whole)))
                found = [(i, *p) for i in np.flatnonzero(n >= largest).tolist() for p in pieces(texts[i].as_py(), largest)]
                if found:
                    at, *values, begin, end = map(list, zip(*found, strict=True))
                    bodies = [texts[i].as_py() for i in at] if with_text else []
                    yield rows_of(chunk, at, [again[i] for i in at], values, pa.array([t[x:y] for t, x, y in zip(bodies, begin, end, strict=True)] if with_text else [], pa.string()))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = chars = 0
        block, made = None, 0
        for batch in batches:
            blocks = batch.column("block").to_pylist()
            sizes = pa.compute.utf8_length(batch.column("text")).to_pylist() if with_text else None
            start = 0
            for i in range(len(blocks)):
                if blocks[i] != block or n + i - start >= 2 * BLOCK or chars >= BLOCK_CHARS:
                    held.append(batch.slice(start, i - start))
                    for out in _filled(held, block, made):
                        yield out
                        made = out.column("bin_id")[-1].as_py() - (block << 34) + 1
                    made = made if blocks[i] == block else 0
                    held, n, chars, start, block = [], 0, 0, i, blocks[i]
                chars += sizes[i] if sizes else 0
            held.append(batch.slice(start))
            n += len(blocks) - start
        yield from _filled(held, block, made)

    def _filled(held: list[pa.RecordBatch], block: int | None, made: int) -> Iterator[pa.RecordBatch]:
        held[:] = [b for b in held if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held).combine_chunks()
        held.clear()  # the copy is enough
        lengths = whole.column("length").to_pylist()
        order, ids, caps, used, offsets = [], [], [], [], []
        for i, (capacity, members) in enumerate(pack(lengths, capacities)):
            at = 0
            own = sum(lengths[m] for m in members)
            for m in members:
                for col, v in zip((order, ids, caps, used, offsets), (m, (block << 34) + made + i, capacity, own, at), strict=True):
                    col.append(v)
                at += lengths[m]
        for i in range(0, len(order), 512):
            own = slice(i, i + 512)
            took = whole.take(pa.array(order[own], pa.int64())).combine_chunks()
            col = lambda name, took=took: took.column(name).combine_chunks()
            extra = [pa.array(ids[own], pa.int64()), pa.array(caps[own], pa.int32()), pa.array(used[own], pa.int32()), pa.array(offsets[own], pa.int32())]
            yield pa.RecordBatch.from_arrays([col("id"), col("piece"), col("first_word"), col("n_words"), *extra, *([col("text")] if with_text else [])], names=names)

    names = [ident, "piece", "first_word", "n_words", "bin_id", "bin_capacity", "bin_used", "bin_offset", *["text"] * with_text]
    text_field = ", text string" * with_text
    cut_rows = rows.mapInArrow(thrifty(cut_up), f"id {kind}, again long, piece int, first_word long, n_words long, length int{text_field}")
    h = F.xxhash64("id", "piece", "again")
    block = F.expr(f"shiftrightunsigned(h, {64 - bits})") if bits else F.lit(0).cast("long")
    dealt = cut_rows.withColumn("h", h).select(block.alias("block"), "h", *cut_names)
    ready = dealt.repartition("block").sortWithinPartitions("block", "h", "piece", "length").drop("again", "h")
    schema = f"`{ident}` {kind}, piece int, first_word long, n_words long, bin_id long, bin_capacity int, bin_used int, bin_offset int{text_field}"
    return ready.mapInArrow(thrifty(fill), schema)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(table(spark, sf_dir, "documents"))
