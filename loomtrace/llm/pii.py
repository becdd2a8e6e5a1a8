"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

The four base kinds (email, ip, card, phone) are accepted by their pattern and validator alone, whatever their score.
Further kinds need a score of at least ``ACCEPT``: ``iban`` (mod 97) and ``id`` (nine digits in groups of 3, 2 and 4),
whose score words such as "account" or "security" within ``REACH`` code points raise.

Cases. Null text: no spans. Empty text: no spans. Very long texts: every pattern is linear in the text's length.
Repeated rows: each gets its own result. Offsets are code points, ends exclusive. Extra columns are kept by
``redact``; ``find_pii`` keeps those named.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, thrifty

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "id")
ACCEPT, REACH = 0.6, 40

# The patterns of the base kinds, and words that speak for a kind.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
NINE = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("address", "host", "server", "ip"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile"),
    "iban": ("iban", "account", "bank", "transfer"),
    "id": ("ssn", "social", "security", "number"),
}
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "id": 0.4}
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved, rest = iban[4:] + iban[:4], 0
    for c in moved:
        n = int(c, 36)
        rest = (rest * (100 if n > 9 else 10) + n) % 97
    return rest == 1


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: from the start of the run of address characters before an @, but not within the last match."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def _ibans(text: str) -> list[tuple[int, int]]:
    """Leftmost matches; of each, the longest part up to a space or its end that passes its check. Where none does, the search goes on
    after the match's first character, so a word before a number hides nothing."""
    out, m = [], IBAN.search(text)
    while m:
        start, end = m.span()
        while len(own := text[start:end].replace(" ", "")) >= 15 and not mod97(own):
            end = max(start, text.rfind(" ", start, end))
        if len(own) >= 15:
            out.append((start, end))
        m = IBAN.search(text, end if len(own) >= 15 else start + 1)
    return out


def _digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def propose(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the spans that pass their validators, in order of start, then kind as listed."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    out += [(s, 4, e) for s, e in _ibans(text)]
    if "-" in text:
        out += [(m.start(), 5, m.end()) for m in NINE.finditer(text)]
    return [(s, KINDS[k], e) for s, k, e in sorted(out)]


def score(text: str, start: int, kind: str, end: int) -> float:
    """The kind's prior, raised by 0.25 if one of its words lies nearby."""
    around = (text[max(0, start - REACH) : start] + " " + text[end : end + REACH]).lower()
    words = re.findall(r"[a-z]+", around)
    return min(1.0, PRIOR[kind] + 0.25 * any(w.startswith(c) for w in words for c in CONTEXT[kind]))


def scan(text: str | None) -> list[tuple[int, str, int, float]]:
    """Accepted spans with their scores."""
    if not text:
        return []
    scored = [(s, k, e, score(text, s, k, e)) for s, k, e in propose(text)]
    return [x for x in scored if x[1] in BASE or x[3] >= ACCEPT]


def mask(text: str | None) -> str | None:
    """The text with each accepted span replaced by its kind; spans that overlap become one, of the first kind."""
    found = scan(text)
    if not found:
        return text
    out, at = [], 0
    for start, kind, end, _ in found:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


SLICE = 512  # rows whose texts are Python strings at a time
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32()), ("score", pa.float64())]))


def find_pii(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The named columns and ``spans``: accepted spans with start, kind, end and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[{"start": s, "kind": k, "end": e, "score": x} for s, k, e, x in scan(t)] for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(rows, SPANS)], names=[*keep, "spans"])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "spans array<struct<start:int,kind:string,end:int,score:double>>"])
    return docs.select(*[docs[c] for c in keep], docs[text].alias("__text")).mapInArrow(thrifty(run, SLICE), schema)


def redact(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The same columns; accepted spans are masked, and ``n_chars``, where it exists, follows the new text."""
    names, where = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, cols = [mask(t) for t in batch.column(where).to_pylist()], list(batch.columns)
            cols[where] = pa.array(new, cols[where].type)
            if n_chars in names:
                i = names.index(n_chars)
                cols[i] = pa.array([None if t is None else len(t) for t in new], pa.int64()).cast(cols[i].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(thrifty(run, SLICE), docs.schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans counted and digested, and all spans as text."""
    found = find_pii(table(spark, sf_dir, "documents"), ["doc_id"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[(s["start"], s["kind"], s["end"]) for s in spans] for spans in batch.column(1).to_pylist()]
            said = lambda spans: ",".join([f"{k}:{s}:{e}" for s, k, e in spans])
            counts = [pa.array([sum(k == kind for _, k, _ in r) for r in rows], pa.int64()) for kind in BASE]
            sha = [hashlib.sha256(said([x for x in r if x[1] in BASE]).encode()).hexdigest() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(sha, pa.string()), pa.array([said(r) for r in rows], pa.string())], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return found.mapInArrow(digest, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
