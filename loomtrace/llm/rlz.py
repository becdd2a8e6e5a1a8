"""Substring deduplication by relative Lempel-Ziv parsing.

The corpus is put into reference blocks of about ``BLOCK_BYTES`` of text, as its tasks read it. A block's index is its
suffixes in the order of their first ``WINDOW`` words (by hash; a match of fewer words never counts), each with the document
and word where they begin. A document is factored greedily from left to right: where its next ``WINDOW`` words begin in a document of a
smaller id, or earlier in the same document, the first such place of all blocks is the source, and the factor grows for as long as
the document and the source go on alike. A window across a factor's end has its own source and begins a factor of its own, so none that straddles two
factors is missed. The words of all factors are duplicates.

To find the first place in all blocks, blocks ask in two steps, and no block is compared with another. Every window has an anchor, the
least hash of the ``ANCHOR``-word runs in it; equal windows have equal anchors. Blocks send their anchors to segments of the hash range and learn
which of them other texts have too; then windows under shared anchors only, with their first place in the block. A block sends each key once
however often it has it, so neither a common passage nor a large group of copies is a hot key.

Cases. Null or empty text: no words. Fewer than ``WINDOW`` words: nothing is removed. Rows of equal id do not make each
other's words duplicates. Ids are whole numbers; a null id counts as larger than every other. Ties: the first place by id, then word. A very long text is a
block of its own, held in one task (about 200 bytes a word). Empty table: no rows. Extra columns are ignored. Windows
are compared by 64 bits of hashes within a block, and by over 80 across blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import packed, table, text_bytes, texts_in
from .words import batch_of, by_halves, cut_by, found_at, from_bytes, from_halves, narrow, remix, rows_of, to_bytes

WINDOW, ANCHOR = 20, 5  # a window has 16 anchor positions
BLOCK_BYTES, SEGMENT_TEXT = 3 << 20, 1 << 22
LAST = (1 << 63) - 1
_SALT = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
NAMES = ["bucket", "segment", "what", "a", "b", "c", "d"]
KINDS = (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4)
FIELDS = "bucket long, segment int, what int, a binary, b binary, c binary, d binary"


class Block:
    """The windows of a block's texts, in order: text number, first word, hashes and anchor."""

    def __init__(self, ids: pa.Array, texts: pa.Array, bits: int):
        self.ids = np.asarray(ids.fill_null(LAST)).astype(np.int64)
        self.words = words.split(texts)
        at, self.text = words.windows(self.words, WINDOW)
        self.start = (at - self.words.starts[self.text]).astype(np.uint32)
        h = self.words.hashes
        if len(at):
            first = words.runs(h, WINDOW, _SALT[0])[at]
            second = words.runs(remix(h), WINDOW, _SALT[1])[at]
            self.first, self.second, self.both = narrow(first, bits), (second >> np.uint64(32)).astype(np.uint32), first ^ (second << np.uint64(1))
            least = words.runs(h, ANCHOR, _SALT[2])
            for step in (1, 2, 4, 8):
                least = np.minimum(least[:-step], least[step:])
            self.anchor = narrow(remix(least[at]), bits)  # the least of 16 are small; mixed again they spread over the segments
        else:
            self.first = self.both = self.anchor = np.empty(0, np.uint64)
            self.second = np.empty(0, np.uint32)
        self.d = self.ids[self.text]

    def anchors(self) -> np.ndarray:
        return np.unique(self.anchor)

    def _alike(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """These windows: those that no other of them equals, and the rest."""
        order = np.argsort(self.both[of])
        key = self.both[of[order]]
        same = key[1:] == key[:-1]
        several = np.r_[False, same] | np.r_[same, False] if len(of) else np.empty(0, bool)
        return of[order[~several]], of[order[several]]

    def _leads(self, order: np.ndarray) -> np.ndarray:
        return np.r_[True, self.both[order[1:]] != self.both[order[:-1]]] if len(order) else np.empty(0, bool)

    def first_places(self, of: np.ndarray) -> np.ndarray:
        """Of these windows the first of each hash, by id, then word."""
        alone, several = self._alike(of)
        several = several[np.lexsort((self.start[several], self.d[several], self.both[several]))]
        found = np.r_[alone, several[self._leads(several)]]
        return found[np.argsort(self.first[found])]

    def sources(self, key: np.ndarray, second: np.ndarray, d: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each window the first place where it begins before: id and word, -1 where it does not.

        key and what follows: windows that other blocks have first, sorted by key.
        """
        n = len(self.first)
        src, word = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        _, several = self._alike(np.arange(n))
        # Earlier in the same text.
        order = several[np.lexsort((self.start[several], self.text[several], self.both[several]))]
        lead = self._leads(order)
        lead[1:] |= self.text[order[1:]] != self.text[order[:-1]]
        head = order[np.flatnonzero(lead)][np.cumsum(lead) - 1]
        src[order[~lead]], word[order[~lead]] = self.d[order[~lead]], self.start[head[~lead]]
        # In another text of the block that has a smaller id.
        order = several[np.lexsort((self.start[several], self.d[several], self.both[several]))]
        lead = self._leads(order)
        head = order[np.flatnonzero(lead)][np.cumsum(lead) - 1]
        less = self.d[head] < self.d[order]
        src[order[less]], word[order[less]] = self.d[head[less]], self.start[head[less]]
        # In another block. Keys of equal first hashes stand in a row.
        at, there = found_at(key, self.first)
        while there.any():
            i, j = np.flatnonzero(there), at[there]
            better = (second[j] == self.second[i]) & (d[j] < self.d[i]) & ((src[i] < 0) | (d[j] < src[i]) | (d[j] == src[i]) & (start[j] < word[i]))
            src[i[better]], word[i[better]] = d[j[better]], start[j[better]]
            at = at + 1
            there &= at < len(key)
            there[there] = key[at[there]] == self.first[there]
        return src, word


def factors(src: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The greedy factors of one text: first word, words, source and the source's first word, a row each."""
    n = len(src)
    on = np.r_[False, (src[1:] >= 0) & (src[1:] == src[:-1]) & (word[1:] == word[:-1] + 1)] if n else np.empty(0, bool)
    first = np.flatnonzero((src >= 0) & ~on)
    if not len(first):
        return np.empty((0, 4), np.int64)
    stop = np.flatnonzero(np.r_[~on[1:], True] & (src >= 0))
    return np.stack([first, stop - first + WINDOW, src[first], word[first]], 1)


def covered(src: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in a window that has a source."""
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(src >= 0)
    edge[at] += 1
    edge[at + WINDOW] -= 1
    return np.cumsum(edge)[:n] > 0


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("source", pa.int64()), ("source_start", pa.int64())]))


def _with_texts(answers: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each block's answers by segment, then the block itself."""
    none = [F.lit(None).cast(blocks.schema[c].dataType).alias(c) for c in ("ids", "texts")]
    own = [F.lit(None).cast("int").alias("segment"), F.lit(9).alias("what"), *[F.lit(None).cast("binary").alias(c) for c in "abcd"]]
    both = answers.select(*NAMES, *none).unionByName(blocks.select("bucket", *own, "ids", "texts"))
    return both.repartition("bucket").sortWithinPartitions("bucket", "what", "segment")


def _blocks(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[tuple[int, Block, list[tuple]]]:
    """Of ``_with_texts``: a block's number, its windows, and the answers."""
    said: list[tuple] = []
    for batch in batches:
        what = batch.column(2).to_pylist()
        for i in range(batch.num_rows):
            if what[i] != 9:
                said.append(tuple(batch.column(k)[i].as_py() for k in range(7)))
                continue
            yield batch.column(0)[i].as_py(), Block(batch.column(7)[i].values, texts_in(batch.column(8)[i]), bits), said
            said = []


def dedup_substrings(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """ident, n_words, factors (first word, words, source document and its first word; neighbours may overlap), n_removed, and kept_text."""
    rows = docs.select(docs[ident].cast("long").alias("id"), docs[text].alias("text"))
    bits = words.segment_bits(text_bytes(rows, "text"), SEGMENT_TEXT)
    blocks = packed(rows, BLOCK_BYTES)

    def ask_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                anchors, bucket = Block(batch.column(1)[i].values, texts_in(batch.column(2)[i]), bits).anchors(), batch.column(0)[i].as_py()
                yield batch_of([(bucket, s, 0, to_bytes(anchors[at], bits), None, None, None) for s, at in cut_by(anchors, bits)], NAMES, KINDS)

    def shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segment, own in groupby(rows_of(batches), lambda r: r[1]):
            asked = [(r[0], from_bytes(r[3], segment, bits)) for r in own]
            key = np.sort(np.concatenate([a for _, a in asked]))
            several = np.unique(key[1:][key[1:] == key[:-1]])
            found = [(bucket, segment, 0, np.packbits(found_at(several, a)[1]).tobytes(), len(a).to_bytes(8, "little"), None, None) for bucket, a in asked]
            yield batch_of(found, NAMES, KINDS)

    def ask_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, block, said in _blocks(batches, bits):
            flags = [np.unpackbits(np.frombuffer(r[3], np.uint8), count=int.from_bytes(r[4], "little")) for r in said]
            shared = block.anchors()[np.concatenate([np.empty(0, np.uint8), *flags]).astype(bool)]
            own = block.first_places(np.flatnonzero(found_at(shared, block.anchor)[1]))
            cols = block.first[own], block.second[own], block.d[own], block.start[own]
            yield batch_of([(bucket, s, 1, to_bytes(cols[0][at], bits), *(by_halves(c[at]) for c in cols[1:])) for s, at in cut_by(cols[0], bits)], NAMES, KINDS)

    def first_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segment, own in groupby(rows_of(batches), lambda r: r[1]):
            asked = list(own)
            part = np.repeat(np.arange(len(asked)), [len(r[3]) // words.KEY for r in asked])
            key = np.concatenate([from_bytes(r[3], segment, bits) for r in asked])
            second, d, start = (np.concatenate([from_halves(r[k], kind) for r in asked]) for k, kind in ((4, np.uint32), (5, np.int64), (6, np.uint32)))
            order = np.lexsort((start, d, second, key))
            lead = np.r_[True, (key[order][1:] != key[order][:-1]) | (second[order][1:] != second[order][:-1])]
            best = np.empty(len(order), np.int64)
            best[order] = order[np.flatnonzero(lead)][np.cumsum(lead) - 1]
            gone = d[best] < d
            ends = np.searchsorted(part, np.arange(len(asked) + 1))
            found = []
            for i, r in enumerate(asked):
                at = ends[i] + np.flatnonzero(gone[ends[i] : ends[i + 1]])
                if len(at):
                    found.append((r[0], segment, 1, to_bytes(key[at], bits), by_halves(second[at]), by_halves(d[best[at]]), by_halves(start[best[at]])))
            yield batch_of(found, NAMES, KINDS)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block, said in _blocks(batches, bits):
            key = np.concatenate([np.empty(0, np.uint64), *(from_bytes(r[3], r[1], bits) for r in said)])
            others = [np.concatenate([np.empty(0, k), *(from_halves(r[i], k) for r in said)]) for i, k in ((4, np.uint32), (5, np.int64), (6, np.uint32))]
            src, word = block.sources(key, *others)
            w, out = block.words, []
            edge = np.searchsorted(block.text, np.arange(len(block.ids) + 1))
            some = np.bincount(block.text[src >= 0], minlength=len(block.ids))
            for i, ident_ in enumerate(block.ids.tolist()):
                own, n = slice(edge[i], edge[i + 1]), int(w.starts[i + 1] - w.starts[i])
                ident_ = None if ident_ == LAST else ident_
                if not some[i]:
                    out.append((ident_, n, [], 0, w.text(i).decode()))
                    continue
                gone = covered(src[own], n)
                spans = [{"start": a, "length": b, "source": None if c == LAST else c, "source_start": e} for a, b, c, e in factors(src[own], word[own]).tolist()]
                out.append((ident_, n, spans, int(gone.sum()), w.text(i, ~gone).decode()))
            yield batch_of(out, ["id", "n_words", "factors", "n_removed", "kept_text"], (pa.int64(), pa.int64(), SPANS, pa.int64(), pa.string()))

    def answered(asks: DataFrame, answer) -> DataFrame:
        return asks.repartition("segment").sortWithinPartitions("segment", "bucket").mapInArrow(answer, FIELDS)

    shared = answered(blocks.mapInArrow(ask_anchors, FIELDS), shared_anchors)
    places = answered(_with_texts(shared, blocks).mapInArrow(ask_windows, FIELDS), first_places)
    spans = "array<struct<start:long,length:long,source:long,source_start:long>>"
    found = _with_texts(places, blocks).mapInArrow(parse, f"id long, n_words long, factors {spans}, n_removed long, kept_text string")
    return found.select(F.col("id").alias(ident), "n_words", "factors", "n_removed", "kept_text")


def op5_rlz_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS phrase FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
g AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY phrase ORDER BY doc_id, i) AS n FROM p) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS i FROM g),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT x.doc_id, count(c.i) AS n_removed, list(x.word ORDER BY x.i) FILTER (c.i IS NULL) AS kept FROM x LEFT JOIN c USING (doc_id, i) GROUP BY x.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
