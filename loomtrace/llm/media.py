"""Matroska: a writer for stored samples and a parser into packet tables.

Cases. A null or empty payload is stored as one block of 64 zero bytes. Bytes that are not Matroska give no
packets and a message in ``error``; packets found before the fault stay. A null file gives no packets and no
error. A block group without a reference to another block is a keyframe. Frames of a lace share their block's duration, or have their track's default one each; without both
the duration is null and the lace has one time. ``encoding`` tells what stored bytes went through (null: nothing): header, whose cut-off bytes are in ``prefix``, zlib, bzlib, lzo or encrypted;
``packet_bytes`` undoes the first two. A wrong CRC-32 is an error. A very long text is one file in one task; an empty table gives no rows. Equal payloads give equal files. Extra columns of the input are kept by ``to_matroska`` (a column named
as the result is replaced) and left out by ``packets``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Element ids of the Matroska specification (RFC 9559).
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
DEFAULT_DURATION, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
CUE_BLOCK_NUMBER, REFERENCE_BLOCK, TRACK_TIMESTAMP_SCALE, CRC_32 = 0x5378, 0xFB, 0x23314F, 0xBF
CONTENT_ENCODINGS, CONTENT_ENCODING, ENCODING_SCOPE, ENCODING_TYPE = 0x6D80, 0x6240, 0x5032, 0x5033
COMPRESSION, COMPRESSION_ALGO, COMPRESSION_SETTINGS = 0x5034, 0x4254, 0x4255
ALGORITHMS = {0: "zlib", 1: "bzlib", 2: "lzo", 3: "header"}

#: 8-bit mono samples: 64 samples are 8 ms, so every frame begins at a whole millisecond.
RATE, UNIT = 8000, 64
FRAME, FRAMES_A_BLOCK, BLOCKS_A_CLUSTER = 512, 8, 32
PACKET_SCHEMA = "track long, cluster int, block int, frame int, lacing string, keyframe boolean, timestamp_ns long, byte_offset long, byte_size long, cued boolean, duration_ns long, cue_ns long, encoding string, prefix binary"
CUE_SCHEMA = "time_ns long, track long, cluster_offset long, block_number long"


def _size(n: int) -> bytes:
    """A length as the shortest EBML number; the all-ones pattern is left for unknown lengths."""
    width = 1
    while n >= (1 << (7 * width)) - 1:
        width += 1
    return (n | 1 << (7 * width)).to_bytes(width, "big")


def _element(ident: int, data: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + _size(len(data)) + data


def _uint(ident: int, n: int) -> bytes:
    return _element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


_HEADER = _element(EBML, _uint(EBML_VERSION, 1) + _uint(EBML_READ_VERSION, 1) + _uint(EBML_MAX_ID, 4) + _uint(EBML_MAX_SIZE, 8) + _element(DOC_TYPE, b"matroska") + _uint(DOC_TYPE_VERSION, 4) + _uint(DOC_TYPE_READ_VERSION, 2))
_INFO = _element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + _element(MUXING_APP, b"loomtrace") + _element(WRITING_APP, b"loomtrace"))
_TRACKS = _element(TRACKS, _element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _element(CODEC_ID, b"A_PCM/INT/LIT") + _uint(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE) + _element(AUDIO, _element(SAMPLING_FREQUENCY, struct.pack(">d", float(RATE))) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))))


def pad(data: bytes) -> bytes:
    """Zero bytes appended up to a positive multiple of 64."""
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def _block(at_ms: int, frames: list[bytes]) -> bytes:
    """A SimpleBlock: equal frames with fixed-size lacing, unequal ones with EBML lacing, one frame without."""
    head = b"\x81" + struct.pack(">h", at_ms)
    if len(frames) == 1:
        return _element(SIMPLE_BLOCK, head + b"\x80" + frames[0])
    if len({len(f) for f in frames}) == 1:
        return _element(SIMPLE_BLOCK, head + b"\x84" + bytes([len(frames) - 1]) + b"".join(frames))
    sizes = _size(len(frames[0]))
    for before, now in zip(frames[:-2], frames[1:-1], strict=True):
        sizes += _signed(len(now) - len(before))
    return _element(SIMPLE_BLOCK, head + b"\x86" + bytes([len(frames) - 1]) + sizes + b"".join(frames))


def _signed(n: int) -> bytes:
    width = 1
    while not -(1 << (7 * width - 1)) < n < (1 << (7 * width - 1)):
        width += 1
    return ((n + (1 << (7 * width - 1)) - 1) | 1 << (7 * width)).to_bytes(width, "big")


def mux(payload: bytes) -> bytes:
    """A Matroska file of one PCM track that holds this payload; its length is a positive multiple of 64."""
    a_block, a_cluster = FRAME * FRAMES_A_BLOCK, FRAME * FRAMES_A_BLOCK * BLOCKS_A_CLUSTER
    body, cues, at = [_INFO, _TRACKS], [], len(_INFO) + len(_TRACKS)
    for start in range(0, len(payload), a_cluster):
        ms = start * 1000 // RATE
        blocks = []
        for b in range(start, min(start + a_cluster, len(payload)), a_block):
            piece = payload[b : min(b + a_block, start + a_cluster)]
            blocks.append(_block(b * 1000 // RATE - ms, [piece[i : i + FRAME] for i in range(0, len(piece), FRAME)]))
        cluster = _element(CLUSTER, _uint(TIMESTAMP, ms) + b"".join(blocks))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, ms) + _element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, at))))
        body.append(cluster)
        at += len(cluster)
    return _HEADER + _element(SEGMENT, b"".join(body) + _element(CUES, b"".join(cues)))


class Fault(ValueError):
    """What is wrong with a file."""


def _number(b: bytes, at: int, end: int, keep: bool) -> tuple[int, int]:
    """An EBML number and what follows it; keep: with its length marker, as ids have it. -1: unknown length."""
    if at >= end or not b[at]:
        raise Fault(f"no EBML number at {at}")
    width = 9 - b[at].bit_length()
    if at + width > end:
        raise Fault(f"cut off at {at}")
    n = int.from_bytes(b[at : at + width], "big")
    if keep:
        return n, at + width
    n -= 1 << (7 * width)
    return (-1 if n == (1 << (7 * width)) - 1 else n), at + width


def _children(b: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """id, start of the element, start and end of its data. An unknown length reaches to the parent's end."""
    while at < end:
        ident, p = _number(b, at, end, True)
        n, p = _number(b, p, end, False)
        stop = end if n < 0 else p + n
        if n < 0 and ident == CLUSTER:  # it ends where the next element of its own level begins
            stop = p
            while stop < end:
                inner, q = _number(b, stop, end, True)
                if inner in (CLUSTER, CUES, TRACKS, INFO):
                    break
                m, q = _number(b, q, end, False)
                stop = end if m < 0 else q + m
        if stop > end:
            raise Fault(f"an element at {at} passes its parent's end")
        yield ident, at, p, stop
        at = stop


def _frames(b: bytes, p: int, end: int) -> tuple[int, int, int, str, list[tuple[int, int]]]:
    """track, relative time, flags, lacing and the byte ranges of a block's frames."""
    track, p = _number(b, p, end, False)
    if p + 3 > end:
        raise Fault(f"a block's head is cut off at {p}")
    at, flags = struct.unpack(">hB", b[p : p + 3])
    p += 3
    kind = flags >> 1 & 3
    if not kind:
        return track, at, flags, "none", [(p, end - p)]
    if p >= end:
        raise Fault(f"a lace is cut off at {p}")
    n, p, sizes = b[p] + 1, p + 1, []
    if kind == 2:
        if (end - p) % n:
            raise Fault(f"a fixed-size lace at {p} doesn't divide")
        sizes = [(end - p) // n] * n
    else:
        for i in range(n - 1):
            if kind == 1:
                size = 0
                while p < end and b[p] == 255:
                    size, p = size + 255, p + 1
                if p >= end:
                    raise Fault(f"a lace is cut off at {p}")
                size, p = size + b[p], p + 1
            else:
                width = 9 - b[p].bit_length() if p < end and b[p] else 0
                size, p = _number(b, p, end, False)
                if i:
                    size += sizes[-1] - ((1 << (7 * width - 1)) - 1)
            sizes.append(size)
        sizes.append(end - p - sum(sizes))
    if min(sizes) < 0 or p + sum(sizes) > end:
        raise Fault(f"a lace's sizes pass the block's end at {p}")
    out = []
    for size in sizes:
        out.append((p, size))
        p += size
    return track, at, flags, ("none", "xiph", "fixed", "ebml")[kind], out


def demux(b: bytes | None) -> tuple[list[dict], str | None]:
    """The packets of a file in order of their bytes, and what is wrong with it."""
    rows: list[dict] = []
    if b is None:
        return rows, None
    try:
        _walk(b, rows)
    except Fault as e:
        return rows, str(e)
    return rows, None


def _uint_of(b: bytes, p: int, q: int) -> int:
    if q - p > 8:
        raise Fault(f"a number of {q - p} bytes at {p}")
    return int.from_bytes(b[p:q], "big")


def _bounded(*numbers: int | None) -> None:
    if any(n is not None and abs(n) >= 1 << 62 for n in numbers):
        raise Fault("times or places past 62 bits")


def _inner(b: bytes, p: int, q: int) -> Iterator[tuple[int, int, int, int]]:
    """Children whose CRC-32, if they begin with one, is right."""
    if q - p >= 6 and b[p] == CRC_32 and b[p + 1] == 0x84 and zlib.crc32(b[p + 6 : q]) != int.from_bytes(b[p + 2 : p + 6], "little"):
        raise Fault(f"a wrong CRC-32 at {p}")
    return _children(b, p, q)


class Track:
    """What a track entry says of its blocks."""

    def __init__(self, b: bytes = b"", p: int = 0, q: int = 0):
        self.number, self.each, self.scale, self.encoding, self.prefix = 0, 0, 1.0, None, None
        for k, _, x, y in _children(b, p, q):
            if k == TRACK_NUMBER:
                self.number = _uint_of(b, x, y)
            elif k == DEFAULT_DURATION:
                self.each = _uint_of(b, x, y)
            elif k == TRACK_TIMESTAMP_SCALE and y - x in (4, 8):
                self.scale = struct.unpack(">f" if y - x == 4 else ">d", b[x:y])[0]
                if not 0 < self.scale < 1e9:
                    raise Fault(f"no scale of times at {x}")
            elif k == CONTENT_ENCODINGS:
                found = [self._encoding(b, u, v) for m, _, u, v in _children(b, x, y) if m == CONTENT_ENCODING]
                names = [name for name, _ in found if name]
                self.encoding, self.prefix = "+".join(names) or None, found[0][1] if names == ["header"] else None

    def _encoding(self, b: bytes, p: int, q: int) -> tuple[str | None, bytes | None]:
        had = {k: (x, y) for k, _, x, y in _children(b, p, q)}
        if ENCODING_SCOPE in had and not _uint_of(b, *had[ENCODING_SCOPE]) & 1:
            return None, None  # frames stay as they are
        if ENCODING_TYPE in had and _uint_of(b, *had[ENCODING_TYPE]):
            return "encrypted", None
        inner = {k: (x, y) for k, _, x, y in _children(b, *had[COMPRESSION])} if COMPRESSION in had else {}
        algo = _uint_of(b, *inner[COMPRESSION_ALGO]) if COMPRESSION_ALGO in inner else 0
        x, y = inner.get(COMPRESSION_SETTINGS, (0, 0))
        return ALGORITHMS.get(algo, f"algorithm {algo}"), b[x:y] if algo == 3 else None


def _blocks_of(b: bytes, kind: int, p: int, q: int) -> Iterator[tuple[int, int, bool | None, int | None]]:
    """Start and end of a cluster's block, whether it is a keyframe (null: its flags tell), and its duration in ticks of its track."""
    if kind == SIMPLE_BLOCK:
        yield p, q, None, None
    elif kind == BLOCK_GROUP:
        inner = list(_children(b, p, q))
        lasts = next((_uint_of(b, x, y) for k, _, x, y in inner if k == BLOCK_DURATION), None)
        for k, _, x, y in inner:
            if k == BLOCK:
                yield x, y, not any(m[0] == REFERENCE_BLOCK for m in inner), lasts


def _cue_points(b: bytes, p: int, q: int) -> Iterator[tuple[int, int, int, int | None]]:
    """Time in ticks, track, place of the cluster in the segment, and the block's number there, from 1."""
    for kind, _, x, y in _inner(b, p, q):
        inner = list(_children(b, x, y)) if kind == CUE_POINT else []
        time = next((_uint_of(b, u, v) for k, _, u, v in inner if k == CUE_TIME), 0)
        for k, _, u, v in inner:
            if k == CUE_TRACK_POSITIONS:
                at = {m: _uint_of(b, s, t) for m, _, s, t in _children(b, u, v)}
                if CUE_CLUSTER_POSITION in at:
                    _bounded(time, *at.values())
                    yield time, at.get(CUE_TRACK, 0), at[CUE_CLUSTER_POSITION], at.get(CUE_BLOCK_NUMBER)


def _segments(b: bytes) -> Iterator[tuple[int, int]]:
    top = _children(b, 0, len(b))
    if next(top, (0,))[0] != EBML:
        raise Fault("no EBML header")
    for ident, _, begin, end in top:
        if ident == SEGMENT:
            yield begin, end


def _scale(b: bytes, p: int, q: int, had: int) -> int:
    return next((_uint_of(b, x, y) for k, _, x, y in _inner(b, p, q) if k == TIMESTAMP_SCALE), had)


def _walk(b: bytes, rows: list[dict]) -> None:
    for begin, end in _segments(b):
        scale, tracks, cues, cluster, first = 1_000_000, {}, set(), -1, len(rows)
        for kind, start, p, q in _children(b, begin, end):
            if kind == INFO:
                scale = _scale(b, p, q, scale)
            elif kind == TRACKS:
                tracks |= {t.number: t for t in (Track(b, x, y) for k, _, x, y in _inner(b, p, q) if k == TRACK_ENTRY)}
            elif kind == CUES:
                cues |= {(time, track, place) for time, track, place, _ in _cue_points(b, p, q)}
            elif kind == CLUSTER:
                cluster, base, count = cluster + 1, 0, 0
                for k, _, x, y in _inner(b, p, q):
                    if k == TIMESTAMP:
                        base = _uint_of(b, x, y)
                        continue
                    for u, v, key, lasts in _blocks_of(b, k, x, y):
                        number, at, flags, lacing, ranges = _frames(b, u, v)
                        of = tracks.get(number) or Track()
                        tick = scale if of.scale == 1 else scale * of.scale
                        each = of.each or None if lasts is None else int(lasts * tick) // len(ranges)
                        when = base * scale + int(at * tick)
                        _bounded(when, (each or 0) << 8)
                        rows += [
                            {
                                "track": number, "cluster": cluster, "block": count, "frame": i, "lacing": lacing, "keyframe": flags >= 128 if key is None else key, "timestamp_ns": when + i * (each or 0),
                                "byte_offset": s, "byte_size": n, "cued": start - begin, "duration_ns": each, "cue_ns": when, "encoding": of.encoding, "prefix": of.prefix,
                            }
                            for i, (s, n) in enumerate(ranges)
                        ]
                        count += 1
        clusters = {place for _, _, place in cues}
        times = {(time * scale, track, place) for time, track, place in cues}
        for r in rows[first:]:
            place = r["cued"]
            r["cued"], r["cue_ns"] = place in clusters, r["cue_ns"] if (r["cue_ns"], r["track"], place) in times else None


def packet_bytes(b: bytes, row: dict) -> bytes:
    """A packet as its codec takes it; raises for encodings other than cut-off headers and zlib."""
    stored = b[row["byte_offset"] : row["byte_offset"] + row["byte_size"]]
    if row["encoding"] is None:
        return stored
    if row["encoding"] == "header":
        return row["prefix"] + stored
    if row["encoding"] == "zlib":
        return zlib.decompress(stored)
    raise Fault(f"packets are stored by {row['encoding']}")


def cue_rows(b: bytes | None) -> tuple[list[dict], str | None]:
    """The cue points of a file: time, track, place of the cluster in the file, number of the block in it (null where it isn't told), and what is wrong with the file."""
    rows: list[dict] = []
    try:
        for begin, end in _segments(b) if b is not None else ():
            scale, found = 1_000_000, []
            for kind, _, p, q in _children(b, begin, end):
                if kind == INFO:
                    scale = _scale(b, p, q, scale)
                elif kind == CUES:
                    found += _cue_points(b, p, q)
            _bounded(*(time * scale for time, *_ in found))
            rows += [{"time_ns": time * scale, "track": track, "cluster_offset": begin + place, "block_number": block} for time, track, place, block in found]
    except Fault as e:
        return rows, str(e)
    return rows, None


def to_matroska(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Adds the stored form of each text's UTF-8 bytes."""
    kept = docs.drop(media) if media in docs.columns else docs
    where = kept.columns.index(text)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [mux(pad(b"" if x is None else x)) for x in batch.column(where).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(files, pa.binary())], names=[*batch.schema.names, media])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), f"`{media}` binary"])
    return kept.mapInArrow(store, schema)


def _rows_of(files: DataFrame, ident: str, media: str, schema: str, read: Callable[[bytes | None], tuple[list[dict], str | None]]) -> DataFrame:
    """What ``read`` finds in each file, a row each; faults as rows with an error."""
    fields = [x.strip().split(" ") for x in schema.split(",")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for i, data in enumerate(batch.column(1).to_pylist()):
                found, fault = read(data)
                found = [r | {"error": None} for r in found] + ([dict.fromkeys(f[0] for f in fields) | {"error": fault}] if fault else [])
                ids += [i] * len(found)
                rows += found
            cols = [pa.array([r[n] for r in rows], kinds[k]) for n, k in [*fields, ["error", "string"]]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), *cols], names=[ident, *(f[0] for f in fields), "error"])

    kind = files.schema[ident].dataType.simpleString()
    return files.select(ident, media).mapInArrow(parse, f"`{ident}` {kind}, {schema}, error string")


def packets(files: DataFrame, ident: str, media: str = "media") -> DataFrame:
    """A row for each packet: track, cluster, block, frame, lacing, time, byte range, duration, cue and encoding."""
    return _rows_of(files, ident, media, PACKET_SCHEMA, demux)


def cues(files: DataFrame, ident: str, media: str = "media") -> DataFrame:
    """A row for each cue point and track: time, place of the cluster in the file, and block."""
    return _rows_of(files, ident, media, CUE_SCHEMA, cue_rows)


def features(payload: bytes, rows: list[dict]) -> str:
    """Packets, milliseconds, sum, energy about the middle, and changes of the side of the middle."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    turns = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"packets={len(rows)};ms={len(x) * 1000 // RATE};sum={int(x.sum())};energy={int((x * x).sum())};turns={turns}"


def media_digest(files: DataFrame, ident: str, n_bytes: str, media: str = "media") -> DataFrame:
    """Reads each file back by its packet table and digests what it holds."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for data in batch.column(2).to_pylist():
                rows, fault = demux(data)
                if fault:
                    raise Fault(fault)
                payload = b"".join([packet_bytes(data, r) for r in rows])
                for col, v in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), features(payload, rows)), strict=True):
                    col.append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=[ident, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = files.schema[ident].dataType.simpleString()
    schema = f"`{ident}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return files.select(ident, n_bytes, media).mapInArrow(digest, schema)


def op9_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    return media_digest(to_matroska(docs).drop("text"), "doc_id", "n_bytes")
