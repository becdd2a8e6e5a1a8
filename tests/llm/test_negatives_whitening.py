"""Hard negatives and whitening against plain models, and their odd inputs."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrace.llm import negatives, whitening

FIELDS = "vec_id long, embedding array<float>, label int, block long, d string, x long"


def made(n, seed, d=8, labels=3):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(v) for v in rng.normal(0, 0.3, d).astype(np.float32)], int(rng.integers(labels)), 7, "d", 1) for i in rng.permutation(n)]
    return rows + [rows[3], rows[4], (None, [0.5] * d, 1, 7, "d", 1), (n + 1, None, 1, 7, "d", 1), (n + 2, [0.5] * d, None, 7, "d", 1), (n + 3, [0.5] * (d - 1) + [None], 1, 7, "d", 1), (n + 4, [float("nan")] + [0.1] * (d - 1), 1, 7, "d", 1), (n + 5, [math.inf] + [0.1] * (d - 1), 1, 7, "d", 1), (n + 6, [], 1, 7, "d", 1), (n + 7, [0.5] * (d + 1), 1, 7, "d", 1)]


def usable(v, d):
    return v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)


def plain_negatives(rows, d, every, positives, k):
    rows = [(i, [math.floor(256 * c) for c in v], lab) for i, v, lab, *_ in rows if i is not None and lab is not None and usable(v, d)]
    out = []
    for a, (ai, av, al) in enumerate(rows):
        if ai % every:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(av, v, strict=True)), i, lab) for b, (i, v, lab) in enumerate(rows) if b != a), key=lambda t: t[:2])
        for s, i, _ in [t for t in scored if t[2] == al][:positives]:
            hits = [t for t in scored if t[2] != al and 30 * -s <= 100 * -t[0] <= 90 * -s][:k]
            out += [(ai, i, r, t[1], -s, -t[0]) for r, t in enumerate(hits, 1)]
    return sorted(out)


def read(df):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


@pytest.mark.parametrize(("block", "group"), [(2048, 8192), (16, 5)])
def test_negatives_match_a_plain_sort(spark, monkeypatch, block, group):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "GROUP", group)
    monkeypatch.setattr(negatives, "PENDING", 40)
    rows = made(240, 1)
    df = spark.createDataFrame(rows, FIELDS).repartition(5)
    got = read(negatives.mine(df, "vec_id", "embedding", F.col("label"), positives=3, negatives=4, every=6))
    assert got == plain_negatives(rows, 8, 6, 3, 4)
    assert len(got) > 100


def test_negatives_of_odd_tables(spark):
    mine = lambda rows: read(negatives.mine(spark.createDataFrame(rows, FIELDS), "vec_id", "embedding", F.col("label")))
    row = lambda i, v, lab: (i, v, lab, 0, "", 0)
    assert mine([]) == []
    assert mine([row(None, None, None)]) == []
    assert mine([row(0, [1.0, 0.0], 1), row(1, [1.0, 0.0], 1)]) == []  # one label
    assert mine([row(1, [1.0], 1), row(2, [1.0], 2)]) == []  # no anchor
    # Ties by id; an anchor's equal row is its positive; scores of 0 allow negatives of 0 only.
    ties = [row(100, [1.0], 1), row(100, [1.0], 1), row(9, [0.5], 2), row(4, [0.5], 2), row(5, [0.95], 2), row(6, [0.25], 3)]
    assert mine(ties) == sorted([(100, 100, 1, 4, 65536, 32768), (100, 100, 2, 9, 65536, 32768)] * 2)
    assert mine([row(0, [0.0], 1), row(1, [1.0], 1), row(2, [0.0], 2), row(3, [-1.0], 2)]) == [(0, 1, 1, 2, 0, 0), (0, 1, 2, 3, 0, 0)]
    # Products past 53 bits stay exact.
    big = [row(0, [float(2**20)] * 2, 1), row(1, [float(2**20 + 8)] * 2, 1), row(2, [float(2**19), float(2**19 + 4)], 2)]
    assert mine(big) == [(0, 1, 1, 2, 2 * 2**28 * (2**28 + 2048), 2**28 * (2**28 + 1024))]


def plain_whitening(rows, d, components):
    kept = [(r[0], tuple(math.floor(256 * float(c)) for c in r[1])) for r in rows if usable(r[1], d)]
    fit = sorted({x for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    cov = np.array([[float(Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in fit), n**3)) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = {}
    for i, x in kept:
        y = [n * a - s for a, s in zip(x, sums, strict=True)]
        w = np.array([float(Fraction(v, n)) for v in y]) @ vectors / np.sqrt(values)
        out[i, x] = n, sum(v * v for v in y), w, values / np.trace(cov)
    return kept, out


@pytest.mark.parametrize("scale", [1.0, 3e9])
def test_whitening_matches_exact_sums(spark, scale):
    rows = [(i, None if v is None else [c if c is None or not math.isfinite(c) else float(np.float32(c * scale)) for c in v], *more) for i, v, *more in made(150, 2)]
    kept, want = plain_whitening(rows, 8, 4)
    got = whitening.whiten(spark.createDataFrame(rows, FIELDS).repartition(3), "vec_id", "embedding").collect()
    assert len(got) == 4 * len(kept)
    x_of = {}
    for i, x in kept:
        x_of.setdefault(i, x)
    signs = {}
    for r in got:
        n, far, w, explained = want[r["vec_id"], x_of[r["vec_id"]]]
        c = r["component"] - 1
        assert r["n"] == n
        assert int(r["deviation_exact"]) == far
        assert r["deviation"] == (far if far < 1 << 63 else None)
        assert math.isclose(r["explained"], explained[c], rel_tol=1e-12)
        assert r["identity_error"] < 1e-12
        sign = signs.setdefault(c, 1 if r["whitened"] * w[c] > 0 else -1)
        assert math.isclose(r["whitened"], sign * w[c], rel_tol=1e-9, abs_tol=1e-9)


def test_whitening_of_odd_tables(spark):
    run = lambda rows: whitening.whiten(spark.createDataFrame(rows, FIELDS), "vec_id", "embedding").collect()
    row = lambda i, v: (i, v, 0, 0, "", 0)
    assert run([]) == []
    assert run([row(1, None), row(2, []), row(3, [None])]) == []
    assert run([row(1, [0.5, 0.5])] * 3) == []  # one distinct vector has no variance
    two = run([row(1, [0.0, 0.0]), row(2, [1.0, 0.0]), row(2, [1.0, 0.0]), row(None, [1.0, 0.0]), row(4, [1.0])])
    assert sorted((r["vec_id"] or 0, r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"]) for r in two) == [(0, 1, 2, 65536, 1.0, 1.0), (1, 1, 2, 65536, 1.0, 1.0), (2, 1, 2, 65536, 1.0, 1.0), (2, 1, 2, 65536, 1.0, 1.0)]


def test_residues_give_exact_sums():
    rng = np.random.default_rng(3)
    x = rng.integers(-(1 << 40), 1 << 40, (9000, 5))
    exact = x.astype(object).T @ x.astype(object)
    chosen = whitening.primes(2 * 9000 * (1 << 80))
    assert len(set(chosen)) == len(chosen) >= 3
    assert all(p < whitening.TOP and all(p % q for q in range(2, 1449)) for p in chosen)
    by_prime = {p: whitening.modular_scatter(x, p) for p in chosen[:-1]}
    assert (whitening.remaindered(by_prime) == exact).all()
    assert (exact % chosen[-1] == whitening.modular_scatter(x, chosen[-1])).all()
