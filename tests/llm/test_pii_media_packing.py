"""Spans against the plain patterns, files by round trip, bins by what must hold of them."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtrace.llm import media, packing, pii

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_base(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 12 <= len(digits) <= 19 and pii.luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15
            if ok:
                out.append((m.start(), k, kind, m.end()))
    return [(s, kind, e) for s, _, kind, e in sorted(out)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1@. -+()0945%é", max_size=60))
def test_base_spans_equal_the_plain_patterns(text):
    assert [x for x in pii.propose(text) if x[1] in pii.BASE] == plain_base(text)


def test_checksums():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")


def test_spans_scores_and_masks():
    text = "Mail bob@mail.example.com, card 4111 1111 1111 1111, from 10.0.0.256 or 10.0.0.25, +1 (603) 555-8791, iban GB82 WEST 1234 5698 7654 32; 123-45-6789 x"
    kinds = [k for _, k, _, _ in pii.scan(text)]
    assert kinds == ["email", "card", "ip", "phone", "iban"]
    assert [k for _, k, _, _ in pii.scan("ssn 123-45-6789")] == ["id"]  # the word nearby makes the difference
    assert pii.mask("x bob@mail.example.com y") == "x <email> y"
    assert pii.mask(None) is None and pii.mask("") == "" and pii.scan(None) == []


def test_long_texts_are_linear():
    for text in ("1" * 300_000, "1." * 150_000, "a@" * 100_000, "+1" * 100_000, "A1" * 100_000, "a" * 300_000 + "@", "1-" * 150_000, "GB82" + " A" * 100_000):
        pii.scan(text)


def test_redact_keeps_columns(spark):
    data = [(1, "at bob@mail.example.com", "e", None, 99), (None, None, None, "s", None), (2, "", "e", "s", 0)]
    df = spark.createDataFrame(data, "doc_id long, text string, spans string, source string, n_chars long")
    got = {r["doc_id"]: r for r in pii.redact(df).collect()}
    assert got[1]["text"] == "at <email>" and got[1]["n_chars"] == 10 and got[1]["spans"] == "e"
    assert got[None]["text"] is None and got[None]["n_chars"] is None and got[2]["text"] == ""
    assert pii.redact(df.limit(0)).count() == 0


def test_op4_rows(spark, tmp_path):
    data = [(1, "é bob@mail.example.com +1 (603) 555-8791"), (2, None), (3, ""), (3, ""), (4, "no")]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = sorted(pii.op4_pii(spark, str(tmp_path)).collect(), key=lambda r: r["doc_id"])
    assert len(rows) == 5 and rows[0]["n_email"] == 1 and rows[0]["n_phone"] == 1
    base = "email:2:22,phone:23:40"
    assert rows[0]["spans"] == base and rows[0]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    assert rows[1]["base_sha256"] == hashlib.sha256(b"").hexdigest() and rows[1]["spans"] == ""


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 511, 512, 513, 4096, 4160, 131072, 131136, 300_001])
def test_media_round_trip(n):
    data = random.Random(n).randbytes(n)
    payload = media.pad(data)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload[: len(data)] == data and not any(payload[len(data) :])
    file = media.mux(payload)
    rows, fault = media.demux(file)
    assert fault is None and b"".join(file[r["byte_offset"] : r["byte_offset"] + r["byte_size"]] for r in rows) == payload
    assert all(r["cued"] and r["track"] == 1 for r in rows)
    times = [r["timestamp_ns"] for r in rows]
    at = 0
    for r, t in zip(rows, times, strict=True):
        assert t == at * 1_000_000_000 // media.RATE
        at += r["byte_size"]


def element(ident, data):
    return media._element(ident, data)


def file_of(*blocks, size=None):
    cluster = media._uint(media.TIMESTAMP, 7) + b"".join(blocks)
    body = element(media.CLUSTER, cluster) if size is None else media.CLUSTER.to_bytes(4, "big") + b"\x01\xff\xff\xff\xff\xff\xff\xff" + cluster
    return element(media.EBML, element(media.DOC_TYPE, b"matroska")) + element(media.SEGMENT, body)


def test_every_lacing_and_unknown_size():
    head = b"\x81" + struct.pack(">h", -2)
    xiph = element(media.SIMPLE_BLOCK, head + b"\x02" + bytes([2, 255, 45, 3]) + b"a" * 300 + b"b" * 3 + b"c" * 5)
    fixed = element(media.SIMPLE_BLOCK, head + b"\x04" + bytes([1]) + b"d" * 8)
    ebml = element(media.SIMPLE_BLOCK, head + b"\x06" + bytes([2]) + media._size(500) + media._signed(-100) + b"e" * 500 + b"f" * 400 + b"g" * 7)
    group = element(media.BLOCK_GROUP, element(media.BLOCK, head + b"\x00" + b"h" * 9) + media._uint(media.BLOCK_DURATION, 3))
    for size in (None, "unknown"):
        file = file_of(xiph, fixed, ebml, group, size=size)
        rows, fault = media.demux(file)
        assert fault is None
        assert [(r["lacing"], r["byte_size"]) for r in rows] == [("xiph", 300), ("xiph", 3), ("xiph", 5), ("fixed", 4), ("fixed", 4), ("ebml", 500), ("ebml", 400), ("ebml", 7), ("none", 9)]
        assert {r["timestamp_ns"] for r in rows} == {5_000_000}
        assert "".join(chr(file[r["byte_offset"]]) for r in rows) == "abcddefgh"


def test_faults_are_told():
    good = media.mux(media.pad(b"x" * 5000))
    for bad in (b"", b"junk", good[:100], good[:-20], b"\x00" * 50):
        rows, fault = media.demux(bad)
        assert fault
    assert media.demux(None) == ([], None)
    for cut in range(len(good) - 1, 0, -37):
        media.demux(good[:cut])  # never raises
    rng = random.Random(1)
    for _ in range(300):
        b = bytearray(good)
        b[rng.randrange(len(b))] ^= 1 << rng.randrange(8)
        media.demux(bytes(b))


def tracks(*more):
    entry = element(media.TRACK_ENTRY, media._uint(media.TRACK_NUMBER, 1) + b"".join(more))
    return element(media.TRACKS, entry)


def whole(*parts):
    return element(media.EBML, element(media.DOC_TYPE, b"matroska")) + element(media.SEGMENT, b"".join(parts))


def test_block_groups():
    """No reference: a keyframe. A lace shares its block's duration; other blocks have the track's."""
    lace = element(media.BLOCK, b"\x81\x00\x0a\x04\x01" + b"ab" * 4)
    plain = element(media.BLOCK, b"\x81\x00\x28\x00" + b"c")
    cluster = media._uint(media.TIMESTAMP, 100)
    cluster += element(media.BLOCK_GROUP, lace + media._uint(media.BLOCK_DURATION, 20)) + element(media.BLOCK_GROUP, plain + element(media.REFERENCE_BLOCK, b"\xf6"))
    for entry, last in ((b"", None), (media._uint(media.DEFAULT_DURATION, 5_000_000), 5_000_000)):
        rows, fault = media.demux(whole(tracks(entry), element(media.CLUSTER, cluster)))
        assert fault is None and [r["keyframe"] for r in rows] == [True, True, False]
        assert [r["timestamp_ns"] for r in rows] == [110_000_000, 120_000_000, 140_000_000]
        assert [r["duration_ns"] for r in rows] == [10_000_000, 10_000_000, last]
    # Times of blocks and durations go by the track's scale.
    scaled = media._uint(media.DEFAULT_DURATION, 5_000_000) + element(media.TRACK_TIMESTAMP_SCALE, b"\x40\x00\x00\x00")
    rows, _ = media.demux(whole(tracks(scaled), element(media.CLUSTER, cluster)))
    assert [r["timestamp_ns"] for r in rows] == [120_000_000, 140_000_000, 180_000_000]


def test_encodings_and_checks():
    def encoded(algo, settings=b"", scope=None):
        inner = media._uint(media.COMPRESSION_ALGO, algo) + (element(media.COMPRESSION_SETTINGS, settings) if settings else b"")
        one = element(media.COMPRESSION, inner) + (media._uint(media.ENCODING_SCOPE, scope) if scope is not None else b"")
        return tracks(element(media.CONTENT_ENCODINGS, element(media.CONTENT_ENCODING, one)))

    def cluster(data):
        return element(media.CLUSTER, media._uint(media.TIMESTAMP, 0) + element(media.SIMPLE_BLOCK, b"\x81\x00\x00\x80" + data))

    for entry, stored, name in ((encoded(3, b"\x01\x02"), b"xyz", "header"), (encoded(0), zlib.compress(b"\x01\x02xyz"), "zlib"), (tracks(), b"\x01\x02xyz", None), (encoded(3, b"\x09", scope=2), b"\x01\x02xyz", None)):
        file = whole(entry, cluster(stored))
        (row,), fault = media.demux(file)
        assert fault is None and row["encoding"] == name and file[row["byte_offset"] :][: row["byte_size"]] == stored
        assert media.packet_bytes(file, row) == b"\x01\x02xyz"
    file = whole(encoded(2), cluster(b"xyz"))
    with pytest.raises(media.Fault, match="lzo"):
        media.packet_bytes(file, media.demux(file)[0][0])
    # Numbers that no table holds are faults.
    huge = element(media.INFO, media._uint(media.TIMESTAMP_SCALE, (1 << 64) - 1)) + element(media.CLUSTER, media._uint(media.TIMESTAMP, 9) + element(media.SIMPLE_BLOCK, b"\x81\x00\x00\x80x"))
    assert "62 bits" in media.demux(whole(huge))[1]
    # A CRC-32 stands for what follows it.
    inner = media._uint(media.TIMESTAMP, 3) + element(media.SIMPLE_BLOCK, b"\x81\x00\x00\x80x")
    crc = element(media.CRC_32, zlib.crc32(inner).to_bytes(4, "little"))
    rows, fault = media.demux(whole(cluster(b"a"), element(media.CLUSTER, crc + inner)))
    assert fault is None and [r["timestamp_ns"] for r in rows] == [0, 3_000_000]
    rows, fault = media.demux(whole(cluster(b"a"), element(media.CLUSTER, crc + inner[:-1] + b"y")))
    assert "CRC-32" in fault and len(rows) == 1


def test_cue_points(spark):
    n = 3 * media.FRAME * media.FRAMES_A_BLOCK * media.BLOCKS_A_CLUSTER
    file = media.mux(media.pad(b"z" * (n - 100)))
    rows, _ = media.demux(file)
    found, fault = media.cue_rows(file)
    assert fault is None and len(found) == 3 and all(r["track"] == 1 and r["block_number"] is None for r in found)
    assert all(file[r["cluster_offset"] :][:4] == media.CLUSTER.to_bytes(4, "big") for r in found)
    # Those of the first block of each cluster, and of no other.
    assert {r["cue_ns"] for r in rows} == {None, *(r["time_ns"] for r in found)} and all((r["cue_ns"] is not None) == (r["block"] == 0) for r in rows)
    df = spark.createDataFrame([(1, bytearray(file), 7), (2, bytearray(b"junk"), 7), (3, None, 7)], "id long, media binary, track int")
    table = media.cues(df, "id").collect()
    assert [r["time_ns"] for r in table if r["id"] == 1] == [r["time_ns"] for r in found]
    assert [r["error"] is not None for r in table if r["id"] == 2] == [True] and not [r for r in table if r["id"] == 3]
    assert media.cues(df.limit(0), "id").count() == 0 and "cue_ns" in media.packets(df, "id").columns


def test_packet_table(spark):
    df = spark.createDataFrame([(1, bytearray(media.mux(media.pad(b"abc" * 1000)))), (2, bytearray(b"junk")), (3, None)], "id long, media binary")
    rows = media.packets(df, "id").collect()
    assert sum(r["byte_size"] for r in rows if r["id"] == 1) == 3008 and [r["error"] is not None for r in rows if r["id"] == 2] == [True] and not [r for r in rows if r["id"] == 3]


def test_op9_rows(spark, tmp_path):
    data = [(1, "é" * 100), (2, None), (3, ""), (4, "é" * 100)]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in media.op9_matroska(spark, str(tmp_path)).collect()}
    assert rows[1]["n_bytes"] == 200 and rows[1]["payload_bytes"] == 256
    assert rows[1]["payload_sha256"] == hashlib.sha256(("é" * 100).encode() + bytes(56)).hexdigest()
    assert rows[1][2:] == rows[4][2:] and rows[2][1:] == rows[3][1:] and rows[2]["payload_bytes"] == 64


def check_bins(lengths, bins, capacities):
    assert sorted(i for _, members in bins for i in members) == list(range(len(lengths)))
    for capacity, members in bins:
        used = sum(lengths[i] for i in members)
        assert used <= capacity == min(c for c in capacities if c >= used)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_bins_hold_everything(lengths):
    bins = packing.pack(lengths, (8, 16, 32, 64))
    check_bins(lengths, bins, (8, 16, 32, 64))


def exact_cost(lengths, capacities):
    """The least cost of all partitions of few pieces."""
    best = [float("inf")]

    def go(i, sums, total):
        if i == len(lengths):
            best[0] = min(best[0], sum(packing.cost(min(c for c in capacities if c >= s)) for s in sums))
            return
        for j in range(len(sums)):
            if sums[j] + lengths[i] <= max(capacities):
                go(i + 1, [*sums[:j], sums[j] + lengths[i], *sums[j + 1 :]], total)
        go(i + 1, [*sums, lengths[i]], total)

    go(0, [], 0)
    return best[0]


def test_bins_are_near_the_best():
    rng = random.Random(3)
    ratios = []
    for _ in range(40):
        lengths = [rng.randint(1, 64) for _ in range(7)]
        got = sum(packing.cost(c) for c, _ in packing.pack(lengths, (16, 32, 64)))
        ratios.append(got / exact_cost(lengths, (16, 32, 64)))
    assert max(ratios) < 1.6 and sum(ratios) / len(ratios) < 1.15


def test_packed_documents(spark):
    texts = {1: "a " * 9000, 2: None, 3: "", 4: "one two", 5: "w " * 4096, 6: "  lead\nand trail  "}
    data = [(i, t, "odd", 5) for i, t in texts.items()] + [(4, "one two", "odd", 5), (None, "x", None, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, bin_id string, piece int")
    rows = packing.best_fit(df, with_text=True).collect()
    joined = {}
    for r in sorted(rows, key=lambda r: r["piece"]):
        joined.setdefault(r["doc_id"], []).append(r["text"])
    for i, t in texts.items():
        if i != 4:
            assert "".join(joined[i]) == (t or "")
    assert joined[4] == ["one two"] * 2 and joined[None] == ["x"]
    bins = {}
    for r in rows:
        bins.setdefault(r["bin_id"], []).append(r)
    for members in bins.values():
        members.sort(key=lambda r: r["bin_offset"])
        ends = [r["bin_offset"] + r["n_words"] for r in members]
        assert all(a["bin_offset"] >= e for a, e in zip(members[1:], ends, strict=False)) and members[0]["bin_used"] <= members[0]["bin_capacity"]
    assert Counter(r["doc_id"] for r in rows)[5] == 2  # 4096 words and an end
    assert sum(r["n_words"] for r in rows if r["doc_id"] == 1) == 9000
    assert packing.best_fit(df.limit(0)).count() == 0


@pytest.mark.parametrize("after", [" BIC COBADEFFXXX", " EUR", " 5 times", " BIC COBADEFF", "", ".", " GB29 NWBK 6016 1331 9268 19"])
@pytest.mark.parametrize("number", ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00"])
@pytest.mark.parametrize("before", ["", "AB12 ", "to "])
def test_iban_next_to_capitals_and_numbers(before, number, after):
    text = before + number + after
    found = [text[s:e] for s, k, e, _ in pii.scan(text) if k == "iban"]
    assert found == [number, *([after[1:]] if after.startswith(" GB") else [])]
