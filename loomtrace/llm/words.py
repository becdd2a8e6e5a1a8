"""Words of many texts at once, as 64-bit hashes in NumPy arrays; and sorted runs of such hashes as binary columns.

A word is a run of bytes other than the ASCII white space 09-0D and 20; its hash is a polynomial over random values of
its bytes, worked out for all words of a chunk by prefix sums, so no word becomes a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19  # bytes of text that a task turns into hashes at once; a longer text is a chunk of its own
_B = 0xD6E8FEB86659FD95
_INVERSE = pow(_B, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _VALUE.copy()
_LOWER[65:91] = _VALUE[97:123]


def remix(hashes: np.ndarray) -> np.ndarray:
    """Other hashes from these, one to one."""
    with np.errstate(over="ignore"):
        h = hashes ^ (hashes >> np.uint64(30))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h = h * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


class _Held(dict):
    """What a process has worked out for itself: it doesn't travel with functions that use it."""

    def __reduce__(self) -> tuple:
        return _Held, ()


_POWERS = _Held()  # by base; a cached function would be pickled by name, and workers have no copy of this package


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo 2 ** 64."""
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        held = np.full(max(2 * CHUNK, 1 << max(0, n - 1).bit_length()), base, np.uint64)
        held[0] = 1
        _POWERS[base] = held = np.multiply.accumulate(held)
    return held[:n]


@dataclass
class Words:
    """Words of some texts: those of text i are starts[i] to starts[i + 1]."""

    hashes: np.ndarray
    starts: np.ndarray
    begin: np.ndarray  # of each word in data
    end: np.ndarray
    data: np.ndarray

    def text(self, i: int, keep: np.ndarray | None = None) -> bytes:
        """The text's words, or those of ``keep`` (a flag for each), joined by one space."""
        own = slice(self.starts[i], self.starts[i + 1])
        begin, end = self.begin[own], self.end[own]
        if keep is not None:
            begin, end = begin[keep], end[keep]
        if not len(begin):
            return b""
        at = int(begin[0])
        raw = self.data[at : end[-1]].tobytes()
        # Words that have one space between them stay as they stand.
        apart = np.flatnonzero((begin[1:] != end[:-1] + 1) | (self.data[end[:-1]] != 32))
        begin, end = np.r_[begin[0], begin[1:][apart]] - at, np.r_[end[:-1][apart], end[-1]] - at
        return b" ".join([raw[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)])


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: none), and where each begins."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    own = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return own, at - at[0]


def split(texts: pa.Array, lower: bool = False) -> Words:
    """The words of the texts; lower: A-Z count as a-z."""
    data, at = _bytes_of(texts)
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = at[:-1][at[:-1] < at[1:]]  # of texts that are not empty
    first[edge] = inside[edge]
    before = edge[edge > 0] - 1
    last[before] = inside[before]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    with np.errstate(over="ignore"):
        value = (_LOWER if lower else _VALUE)[data] * _power(_B, len(data))
        sums = np.r_[np.uint64(0), np.cumsum(value, dtype=np.uint64)]
        raw = (sums[end] - sums[begin]) * _power(_INVERSE, len(data) + 1)[begin]
        hashes = remix(raw + (end - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return Words(hashes, np.searchsorted(begin, at), begin, end, data)


def chunks(batch: pa.RecordBatch, column: int, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about ``size`` bytes; at least a row each."""
    size = size or CHUNK
    texts = batch.column(column)
    n = np.array([0 if v is None else v for v in pa.compute.binary_length(texts).to_pylist()], np.int64)
    total, at = np.cumsum(n), 0
    while at < len(n):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, end - at)
        at = end


def runs(hashes: np.ndarray, width: int, salt: int) -> np.ndarray:
    """A hash of every run of ``width`` neighbours, put together from runs of 1, 2, 4, ..."""
    power = lambda n: np.uint64(pow(salt, n, 1 << 64))
    with np.errstate(over="ignore"):
        out, done, run, size, rest = None, 0, hashes, 1, width
        while rest:
            if rest & 1:
                part = run[done:]
                out = part if out is None else out[: len(part)] * power(size) + part[: len(out)]
                done += size
            rest >>= 1
            if rest:
                run, size = run[:-size] * power(size) + run[size:], 2 * size
        return remix(out[: max(0, len(hashes) - width + 1)])


def windows(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which runs of ``width`` words lie in one text, and that text's number."""
    n = max(0, len(w.hashes) - width + 1)
    of = np.repeat(np.arange(len(w.starts) - 1), np.diff(w.starts))
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero(of[:n] == of[width - 1 :])
    return at, of[at]


KEY = 6  # bytes of a key below its segment's bits that are kept


def narrow(keys: np.ndarray, bits: int) -> np.ndarray:
    """Keys with what lies under ``KEY`` bytes below the segment's bits set to 0."""
    drop = np.uint64(max(0, 64 - bits - 8 * KEY))
    return keys >> drop << drop


def to_bytes(keys: np.ndarray, bits: int) -> bytes:
    shift = np.uint64(max(0, 64 - bits - 8 * KEY))
    return np.ascontiguousarray((keys >> shift).view(np.uint8).reshape(-1, 8)[:, :KEY]).tobytes()


def from_bytes(raw: bytes, segment: int, bits: int) -> np.ndarray:
    out = np.zeros((len(raw) // KEY, 8), np.uint8)
    out[:, :KEY] = np.frombuffer(raw, np.uint8).reshape(-1, KEY)
    low = out.view(np.uint64)[:, 0] << np.uint64(max(0, 64 - bits - 8 * KEY))
    mask = np.uint64((1 << (64 - bits)) - 1)
    return low & mask | np.uint64(segment << (64 - bits))


def by_halves(x: np.ndarray) -> bytes:
    """All lower halves, then all upper ones: where numbers are small, the latter compress to nothing."""
    half = np.dtype(f"u{x.itemsize // 2}")
    return np.ascontiguousarray(np.ascontiguousarray(x).view(half).reshape(-1, 2).T).tobytes()


def from_halves(raw: bytes, kind: type) -> np.ndarray:
    half = np.dtype(f"u{np.dtype(kind).itemsize // 2}")
    return np.ascontiguousarray(np.frombuffer(raw, half).reshape(2, -1).T).view(kind).ravel()


def cut_by(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Segments of sorted keys: those that have the same highest bits."""
    if not len(keys):
        return
    segment = (keys >> np.uint64(64 - bits)).astype(np.int64)
    edge = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
    for a, b in zip(edge, np.r_[edge[1:], len(keys)], strict=True):
        yield int(segment[a]), slice(a, b)


def found_at(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each asked key would stand among the sorted keys, and whether it does."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def batch_of(rows: list[tuple], names: list[str], kinds: tuple) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def segment_bits(n_bytes: int, each: int) -> int:
    """So many bits that a segment stands for about ``each`` bytes of text."""
    return max(2, (max(1, n_bytes // each) - 1).bit_length())
