"""Whitening of embeddings from an exact scatter matrix, summed in residue numbers.

Entries become whole numbers. Each task multiplies its block of vectors with itself modulo several primes: residues lie so near 0 that a
product of doubles is exact whatever the order of its sums. Residues add up over tasks, and Chinese remaindering gives the sums of
products as whole numbers, so the scatter doesn't depend on how rows are dealt. One more prime checks them. The covariance is
rounded once, from the exact quotient, and an eigendecomposition in doubles gives the components.

Only matrices with a side of the vectors' length reach the driver, whatever the number of rows. The list of distinct vectors is written
to the shared folder; the scatter and the whitened rows' covariance are sums over it.

Cases. Rows whose vector is null, empty, or holds null or non-finite entries are left out; so are those of another length than most distinct vectors
have (of equals the longer). Whole numbers beyond 63 bits count as the largest. Null ids stay, repeated rows are whitened
like any other and count once in the fit. Components whose eigenvalue is 0 but for rounding are left out: a table of one vector, or of none, gives no rows. A
deviation beyond 63 bits is null, and ``deviation_exact`` has it up to 38 digits. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let_go, stored, table

SCALE, COMPONENTS = 256, 4
TOP = 1 << 21  # primes lie below; residues within 2**20 of 0, so that ROWS products add up to under 2**53
ROWS = 4096


def primes(product: int) -> list[int]:
    """The largest primes below ``TOP``, at least two, whose product passes the bound; and one more as a check."""
    sieve = np.ones(TOP, bool)
    sieve[:2] = False
    for i in range(2, int(TOP**0.5) + 1):
        if sieve[i]:
            sieve[i * i :: i] = False
    out, reached = [], 1
    for p in np.flatnonzero(sieve)[::-1].tolist():
        out.append(p)
        if reached > product and len(out) > 2:
            return out
        reached *= p
    raise ValueError("too large a bound")


def whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * value), within a long."""
    scaled = np.floor(values.astype(np.float64) * SCALE)
    big = float(1 << 63)
    inside = np.clip(scaled, -big, np.nextafter(big, 0)).astype(np.int64)
    return np.where(scaled >= big, np.iinfo(np.int64).max, inside)


def usable(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Whether each vector has entries and all of them are finite numbers; and the entries of all vectors that are not null."""
    n = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    flat = lists.flatten()
    good = flat.is_valid().to_numpy(zero_copy_only=False) & np.isfinite(flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64))
    sums = np.r_[0, np.cumsum(~good)]
    end = np.cumsum(n)
    return (n > 0) & (sums[end] == sums[end - n]), flat


def integers(vectors: DataFrame, ident: str, vector: str) -> DataFrame:
    """id, x: the whole numbers of each usable vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(pa.array(usable(batch.column(1))[0]))
            lists = kept.column(1)
            sizes = lists.value_lengths().to_numpy().astype(np.int64)
            x = whole(lists.flatten().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([kept.column(0), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(x))], names=["id", "x"])

    kind = vectors.schema[ident].dataType.simpleString()
    return vectors.select(vectors[ident], vectors[vector]).mapInArrow(run, f"id {kind}, x array<bigint>")


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p, between -p / 2 and p / 2, as doubles."""
    r = x % p
    return np.where(r > p // 2, r - p, r).astype(np.float64)


def modular_scatter(x: np.ndarray, p: int) -> np.ndarray:
    """The sums of products of columns, modulo p."""
    total = np.zeros((x.shape[1], x.shape[1]), np.int64)
    for i in range(0, len(x), ROWS):
        r = residues(x[i : i + ROWS], p)
        total = (total + (r.T @ r).astype(np.int64)) % p
    return total


def remaindered(by_prime: dict[int, np.ndarray]) -> np.ndarray:
    """The whole numbers, of the least distance from 0, that leave these remainders."""
    value, product = np.zeros(next(iter(by_prime.values())).shape, object), 1
    for p, left in by_prime.items():
        value = value + product * ((left.astype(object) - value) * pow(product, -1, p) % p)
        product *= p
    return np.where(value > product // 2, value - product, value)


def exact_scatter(fit: DataFrame, d: int, largest: int, n: int) -> np.ndarray:
    """Sums of products of the columns of x and a last column of ones, as whole numbers."""
    chosen = primes(2 * max(1, n) * max(1, largest) ** 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {p: np.zeros((d + 1, d + 1), np.int64) for p in chosen}
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, d)
            x = np.c_[x, np.ones(len(x), np.int64)]
            for p in chosen:
                sums[p] = (sums[p] + modular_scatter(x, p)) % p
        i, j = np.triu_indices(d + 1)
        for p in chosen:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), p)), pa.array(i), pa.array(j), pa.array(sums[p][i, j])], names=["prime", "i", "j", "s"])

    parts = fit.select("x").mapInArrow(run, "prime long, i long, j long, s long")
    found = parts.groupBy("prime", "i", "j").agg((F.sum("s") % F.col("prime")).alias("s")).toPandas()  # a few matrices
    by_prime = {}
    for p in chosen:
        own = found[found["prime"] == p]
        by_prime[p] = np.zeros((d + 1, d + 1), np.int64)
        by_prime[p][own["i"], own["j"]] = by_prime[p][own["j"], own["i"]] = own["s"]
    check = by_prime.pop(chosen[-1])
    scatter = remaindered(by_prime)
    if not np.array_equal(scatter % chosen[-1], check):
        raise ArithmeticError("the remainders of the scatter do not agree")
    return scatter


@dataclass
class Whitener:
    """n and the sums of the fit list; unit components by column, their eigenvalues, and the covariance's trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n times the distance from the mean, exact: longs, or Python's integers where those might not do."""
        most = self.n * int(np.abs(x.astype(object)).max(initial=0)) + max(map(abs, self.sums), default=0)
        if most < 1 << 62:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def project(self, y: np.ndarray) -> np.ndarray:
        return y.astype(np.float64) @ self.vectors / (self.n * np.sqrt(self.values))


def solve(scatter: np.ndarray, components: int) -> Whitener:
    d = len(scatter) - 1
    n, sums = int(scatter[d, d]), scatter[d, :d]
    exact = n * scatter[:d, :d] - sums[:, None] * sums[None, :]
    covariance = np.array([[int(v) / (n * n) for v in row] for row in exact])
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = min(components, int((values > max(values.max(), 0) * d * np.finfo(float).eps * 16).sum()))
    return Whitener(n, [int(v) for v in sums], vectors[:, :kept].copy(), values[:kept].copy(), sum(int(exact[i, i]) for i in range(d)) / (n * n))


def identity_error(fit: DataFrame, model: Whitener) -> float:
    """The largest entry of the whitened fit list's covariance less the identity."""
    k, d = len(model.values), len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = model.project(model.centred(batch.column(0).flatten().to_numpy().reshape(-1, d)))
            total[:k] += w.T @ w
            total[k] += w.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["place", "s"])

    found = fit.select("x").mapInArrow(run, "place long, s double").groupBy("place").agg(F.sum("s").alias("s")).orderBy("place").toPandas()["s"].to_numpy().reshape(k + 1, k) / model.n
    return float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max(initial=0.0))


def _squares(y: np.ndarray) -> list[int]:
    """Sums of squares by row, exact."""
    most = int(np.abs(y).max(initial=0))
    if y.dtype != object and y.shape[1] * most * most < 1 << 63:
        return (y * y).sum(1).tolist()
    y = y.astype(object)
    return (y * y).sum(1).tolist()


def whiten(vectors: DataFrame, ident: str, vector: str, components: int = COMPONENTS) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error and deviation_exact of each usable row and component."""
    rows = integers(vectors, ident, vector)
    kind = vectors.schema[ident].dataType.simpleString()
    fields = f"`{ident}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
    every = stored(rows.select("x").distinct())
    lengths = every.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"), F.max(F.greatest(F.array_max("x"), -F.greatest(F.array_min("x"), F.lit(1 - (1 << 63))))).alias("largest"))
    shape = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    empty = vectors.sparkSession.createDataFrame([], fields)
    if shape is None:
        let_go(vectors.sparkSession, every)
        return empty
    d, fit = shape["d"], every.where(F.size("x") == shape["d"])
    model = solve(exact_scatter(fit, d, shape["largest"] + 1, shape["n"]), components)
    k = len(model.values)
    if not k:
        let_go(vectors.sparkSession, every)
        return empty
    error = identity_error(fit, model)
    let_go(vectors.sparkSession, every)
    limit, wide = (1 << 63) - 1, 10**38 - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = model.centred(batch.column(1).flatten().to_numpy().reshape(-1, d))
            far, w = _squares(y), model.project(y)
            of = np.repeat(np.arange(len(far)), k)
            longs = pa.array([v if v <= limit else None for v in far], pa.int64())
            exact = longs.cast(pa.decimal128(38, 0)) if not longs.null_count else pa.array([Decimal(v) if v <= wide else None for v in far], pa.decimal128(38, 0))
            places = np.tile(np.arange(1, k + 1, dtype=np.int32), len(far))
            cols = [batch.column(0).take(pa.array(of)), pa.array(places), pa.array(np.full(len(of), model.n)), longs.take(pa.array(of)), pa.array(w.ravel()), pa.array(np.tile(model.values / model.trace, len(far))), pa.array(np.full(len(of), error)), exact.take(pa.array(of))]
            yield pa.RecordBatch.from_arrays(cols, names=[ident, "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"])

    return rows.where(F.size("x") == d).mapInArrow(run, fields)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
