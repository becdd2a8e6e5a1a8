"""Toxicity by a support vector machine on a gap-weighted subsequence kernel, with Nyström landmarks.

The kernel of two words counts the three-letter subsequences they share, each weighted by ``DECAY`` to the power of the
stretch it spans (``SPAN`` letters at most); it is normalised and raised to the whole number ``POWER``, which is a kernel again. A letter
inserted, dropped or changed leaves a good part of it. The kernel of two texts is the sum over all pairs of their distinct words: a
convolution kernel, positive semidefinite like that of words, and with no threshold in it. A landmark is a text of one word. The Nyström map
turns a text's kernel values with the landmarks into coordinates, a linear machine with squared hinge loss separates
them, and a sigmoid fitted to its margins gives the score. Since sums run over words, so do margins: each word adds a number of its own, which is worked out once.

Landmarks are words and stems (beginnings of words) of labelled rows: those that toxic rows have far more often than
chance allows, and some frequent others. Misspelt copies of the toxic landmarks (a letter inserted, doubled or dropped) count as toxic
examples, so that the margin leaves room for them. The constants were chosen by folds 1 to 4 within the learning rows, fold 0 never among them.

Words keep A-Z letters, lower-cased, and signs for the later bytes of other letters (a small and a capital letter mostly share theirs); punctuation and digits inside them go,
and three or more single letters in a row are one word ("i d i o t"). Words over ``LONGEST`` letters count as their
overlapping windows. Learning uses at most ``TRAIN_ROWS`` labelled rows, those of least hash of their id.

Cases. Null or empty text: the score of a text without any word. No labels, or of one kind only, or no word that sets
toxic rows apart: every text gets the share of toxic rows (0 without labels). Null labels and ids are not learned from. A
doc_id with several labels counts as toxic if one says so. Repeated rows: alike; of rows with one id the least text is learned from. Very long texts: read whole.
Empty table: no rows. Extra columns, whatever their names, are kept if named.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, cut, table, thrifty

DECAY, SPAN, LONGEST, STRIDE, POWER = 0.6, 8, 16, 6, 3
TRAIN_ROWS, TOXIC_LANDMARKS, OTHER_LANDMARKS, MISSPELT = 8000, 128, 12, 12
CHANCE = 2.5  # a toxic landmark's log-likelihood ratio at least, in logs of the number of words; the most extreme by chance has some 2
STEM, SAME = range(3, 9), 0.965  # lengths of stems; landmarks more alike than this are one
SOFT = 3.0  # the machine's constant
FOLDS = 5
PART, CACHED, CELLS = 500, 200_000, 1 << 22  # texts scored at once, words held, and values held
_SIGNS = 30
_TABLE = bytes(32 if c in b" \t\n\r\x0b\x0c" else c + 32 if 65 <= c <= 90 else c if c < 128 else 123 + c % 4 for c in range(256))
_DROPPED = bytes(c for c in range(256) if not (65 <= c <= 90 or 97 <= c <= 122 or c in b" \t\n\r\x0b\x0c" or 128 <= c < 192))
_SPACED = re.compile(rb"(?<![^ ])[a-z](?: +[a-z]){2,}(?![^ ])")


def words_of(text: str | None) -> set[bytes]:
    """The distinct words of a text as the kernel sees them."""
    body = (text or "").encode().translate(_TABLE, _DROPPED)
    return set(_SPACED.sub(lambda m: m[0].replace(b" ", b""), body).split())


def landmark_words(text: str | None) -> set[bytes]:
    """The distinct words and stems of a text that may be landmarks."""
    every = {x for w in words_of(text) for x in (w, *(w[:k] for k in STEM if len(w) > k))}
    return {x for x in every if STEM[0] <= len(x) <= LONGEST}


def _triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions i < j < k of a word of n letters that span at most ``SPAN``, and their weights."""
    found = [(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, min(n, i + SPAN))]
    i, j, k = np.array(found, np.int64).reshape(-1, 3).T
    return i, j, k, DECAY ** (k - i + 1.0)


def _sparse(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, subsequence and weight, in order of both, for words of one length."""
    n = len(words[0])
    i, j, k, weight = _triples(n)
    a = np.minimum(np.frombuffer(b"".join(words), np.uint8).reshape(-1, n).astype(np.int64) - 97, _SIGNS - 1)
    code = (a[:, i] * _SIGNS + a[:, j]) * _SIGNS + a[:, k] + np.arange(len(words))[:, None] * _SIGNS**3
    u, inverse = np.unique(code.ravel(), return_inverse=True)
    value = np.bincount(inverse, np.tile(weight, len(words)), len(u))
    return u // _SIGNS**3, u % _SIGNS**3, value


class Landmarks:
    """Normalised kernel values of many words with a few landmarks."""

    def __init__(self, words: list[bytes]):
        self.words = words
        rows = np.zeros((_SIGNS**3, len(words)), np.float32)
        for col, w in enumerate(words):
            _, code, value = _sparse([w])
            rows[code, col] = value / math.sqrt((value**2).sum())
        used = np.flatnonzero(rows.any(1))
        self.at = np.zeros(_SIGNS**3, np.int32)
        self.at[used] = np.arange(1, len(used) + 1)
        self.rows = np.concatenate([np.zeros((1, len(words)), np.float32), rows[used]])

    def kernel(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros((len(words), len(self.words)), np.float32)
        by: dict[int, list[tuple[int, bytes]]] = {}
        for i, w in enumerate(words):
            if len(w) > LONGEST:
                for s in sorted({*range(0, len(w) - LONGEST, STRIDE), len(w) - LONGEST}):
                    by.setdefault(LONGEST, []).append((i, w[s : s + LONGEST]))
            elif len(w) > 2:
                by.setdefault(len(w), []).append((i, w))
        for n, group in by.items():
            step = max(1, 8000 // len(_triples(n)[0]))  # so that a block of values with all landmarks stays small
            for s in range(0, len(group), step):
                part = group[s : s + step]
                row, code, value = _sparse([w for _, w in part])
                norm = np.sqrt(np.bincount(row, value**2, len(part)))
                shared = np.flatnonzero(self.at[code])
                if not len(shared):
                    continue
                row, code, value = row[shared], code[shared], value[shared]
                first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                sums = np.add.reduceat(self.rows[self.at[code]] * value[:, None].astype(np.float32), first, axis=0)
                of = np.array([i for i, _ in part])[row[first]]
                values = (sums / norm[row[first], None]).astype(np.float32) ** POWER
                if n == LONGEST:
                    np.add.at(out, of, values)
                else:
                    out[of] = values
        return out


class Memo:
    """Values of the words met so far, ``width`` for each, worked out once. It starts anew when it is full."""

    def __init__(self, values: Callable[[list[bytes]], np.ndarray], width: int):
        self.values, self.width = values, width
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.rows = np.zeros((0, self.width), np.float32)

    def sums(self, texts: list[str | None]) -> np.ndarray:
        """For each text, the sums over its distinct words."""
        words = [words_of(t) for t in texts]
        met = set().union(*words)
        if len(self.at) + len(met) > min(CACHED, CELLS // self.width):
            self.clear()
        new = sorted(met - self.at.keys())
        self.at.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
        self.rows = np.concatenate([self.rows, self.values(new)])
        at, out = self.at, np.zeros((len(texts), self.width))
        for i, own in enumerate(words):
            out[i] = np.sort(self.rows[[at[w] for w in own]], axis=0).sum(0, dtype=np.float64) if own else 0
        return out


@dataclass
class Model:
    """score = sigmoid(slope * (sum over words of kernel values . weights + bias) + shift); without landmarks, ``constant``."""

    landmarks: list[bytes] = field(default_factory=list)
    weights: np.ndarray | None = None
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    constant: float = 0.0

    def memo(self) -> Memo:
        """What each word adds to the margin."""
        marks = Landmarks(self.landmarks)
        return Memo(lambda words: (marks.kernel(words) @ self.weights).astype(np.float32)[:, None], 1)

    def score(self, texts: list[str | None], memo: Memo | None = None) -> np.ndarray:
        margin = (memo or self.memo()).sums(texts)[:, 0] + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))


def nystrom(marks: Landmarks) -> np.ndarray:
    """The map from kernel values with the landmarks to coordinates: the inverse root of their own kernel matrix."""
    own = marks.kernel(marks.words).astype(np.float64)
    value, vector = np.linalg.eigh((own + own.T) / 2 + 1e-3 * np.eye(len(own)))
    return vector @ np.diag(np.maximum(value, 1e-3) ** -0.5) @ vector.T


def train_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = SOFT) -> np.ndarray:
    """Squared hinge loss by Newton steps; the last entry is the bias. y: -1 or 1."""
    x = np.c_[x, np.ones(len(x))]
    w, keep = np.zeros(x.shape[1]), np.eye(x.shape[1])
    keep[-1, -1] = 1e-6
    for _ in range(50):
        gap = 1 - y * (x @ w)
        on = gap > 0
        grad = keep @ w - 2 * c * x[on].T @ (weight[on] * y[on] * gap[on])
        step = np.linalg.solve(keep + 2 * c * (x[on] * weight[on, None]).T @ x[on], grad)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the sigmoid, with smoothed targets."""
    pos, neg = weight[y > 0].sum(), weight[y < 0].sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, w = np.c_[margin, np.ones(len(margin))], np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (weight * (p - target)) + 1e-6 * w)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def misspell(word: bytes, n: int) -> list[bytes]:
    """The word with a letter inserted (twice as often), doubled or dropped; the same each time."""
    rng, out = random.Random(word.decode()), []
    for i in range(n):
        at = rng.randrange(1, len(word))
        extra = [bytes([rng.choice(range(97, 123))]), bytes([rng.choice(range(97, 123))]), word[at : at + 1], b""][i % 4]
        out.append(word[:at] + extra + word[at + (not extra) :])
    return out


def apart(words: list[bytes], most: int) -> list[bytes]:
    """The first words that are not much alike."""
    like = Landmarks(words).kernel(words) > SAME**POWER
    kept: list[int] = []
    for i in range(len(words)):
        if len(kept) < most and not like[i, kept].any():
            kept.append(i)
    return [words[i] for i in kept]


def train(docs: DataFrame, labels: DataFrame, ident: str, text: str, toxic: str) -> Model:
    """docs and labels hold the rows that may be learned from."""
    known = labels.select(labels[ident].alias("i"), labels[toxic].cast("int").alias("toxic")).where("i is not null and toxic is not null").groupBy("i").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("i"), "i").limit(TRAIN_ROWS)
    texts = docs.select(docs[ident].alias("d"), docs[text].alias("text"))
    one = texts.join(F.broadcast(chosen), F.col("d") == F.col("i")).groupBy("i").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    sample = cut(one.select("text", "toxic"))  # TRAIN_ROWS at most
    counts = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_all = counts.get(1, 0), sum(counts.values())
    if not n_toxic or n_toxic == n_all:
        return Model(constant=n_toxic / n_all if n_all else 0.0)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in (batch.slice(i, 32) for i in range(0, batch.num_rows, 32)):
                found = [landmark_words(t) for t in some.column(0).to_pylist()]
                at = np.repeat(np.arange(len(found)), [len(w) for w in found])
                yield pa.RecordBatch.from_arrays([pa.array([x.decode() for w in found for x in w], pa.string()), some.column(1).take(pa.array(at))], names=["word", "toxic"])

    seen = cut(sample.select("text", "toxic").mapInArrow(split, "word string, toxic int").groupBy("word").agg(F.sum("toxic").alias("a"), F.count("*").alias("df")))
    share = n_toxic / n_all
    part = lambda n, p: F.when(n > 0, n * F.ln(n / (F.col("df") * p))).otherwise(0.0)
    against = 2 * (part(F.col("a"), share) + part(F.col("df") - F.col("a"), 1 - share))  # log-likelihood ratio
    least = CHANCE * math.log(max(seen.count(), 2))
    rated = seen.withColumn("g", against).withColumn("more", F.col("a") > F.col("df") * share)
    bad = [r["word"].encode() for r in rated.where(F.col("more") & (F.col("g") >= least)).orderBy(F.desc("g"), F.length("word"), "word").limit(20 * TOXIC_LANDMARKS).collect()]
    other = [r["word"].encode() for r in rated.where(~F.col("more")).orderBy(F.desc("df"), "word").limit(OTHER_LANDMARKS).collect()]
    if not bad:
        return Model(constant=share)
    bad = apart(bad, TOXIC_LANDMARKS)
    marks = Landmarks(bad + other)
    rows = _kernels(sample.select("toxic", "text"), "toxic", marks.words).collect()
    kernels, y = np.array([r["kernels"] for r in rows], np.float64), np.array([2 * r["toxic"] - 1 for r in rows], np.float64)
    spelt = marks.kernel([v for w in bad for v in misspell(w, MISSPELT)])
    project = nystrom(marks)
    x = np.concatenate([kernels, spelt]) @ project
    labels_ = np.r_[y, np.ones(len(spelt))]
    weight = np.r_[np.where(y > 0, 0.5 / n_toxic, 0.5 / (n_all - n_toxic)) * n_all / 2, np.full(len(spelt), n_all / 8 / len(spelt))]
    w = train_svm(x, labels_, weight)
    beta = project @ w[:-1]
    slope, shift = platt(np.r_[kernels, spelt] @ beta + w[-1], labels_, np.r_[np.ones(len(y)), np.full(len(spelt), n_toxic / 4 / len(spelt))])
    return Model(marks.words, beta, float(w[-1]), slope, shift)


def _kernels(rows: DataFrame, keep: str, landmarks: list[bytes]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Landmarks(landmarks)
        memo = Memo(marks.kernel, len(landmarks))
        for batch in batches:
            for part in (batch.slice(i, 50) for i in range(0, batch.num_rows, 50)):
                found = memo.sums(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(found), pa.list_(pa.float64()))], names=[keep, "kernels"])

    return rows.mapInArrow(thrifty(run), f"{keep} {rows.schema[keep].dataType.simpleString()}, kernels array<double>")


def score_texts(docs: DataFrame, model: Model, keep: list[str], text: str = "text", out: str = "score") -> DataFrame:
    """The named columns and the score."""
    kept = [docs[c] for c in keep]
    if not model.landmarks:
        return docs.select(*kept, F.lit(model.constant).alias(out))

    at = keep.index(text) if text in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = model.memo()
        for batch in batches:
            for part in (batch.slice(i, PART) for i in range(0, batch.num_rows, PART)):
                score = model.score(part.column(at).to_pylist(), memo)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(score, pa.float64())], names=[*keep, out])
        memo.clear()

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), f"`{out}` double"])
    rows = docs.select(*kept) if text in keep else docs.select(*kept, docs[text].alias("__text"))
    return rows.mapInArrow(thrifty(run), schema)


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    """The model learned from the labelled documents outside fold 0."""
    learn = crc_mod("doc_id", FOLDS) != 0
    return train(docs.where(learn), table(spark, sf_dir, "labels").where(learn), "doc_id", "text", "toxic")


def op3_string_kernel_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_texts(docs, fitted(spark, docs, sf_dir), ["doc_id"])
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", FOLDS) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
