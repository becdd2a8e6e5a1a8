"""Ranks, correlations and draws against plain models, in one group and in many."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrace.operators import stats


def plain_ranks(values):
    order = sorted(values, key=lambda v: (v is not None, math.isnan(v) if v is not None else False, v if v is not None and not math.isnan(v) else 0.0))
    place = {}
    for i, v in enumerate(order, 1):
        place.setdefault("nan" if v is not None and math.isnan(v) else v, []).append(i)
    return {k: sum(p) / len(p) for k, p in place.items()}


def plain_rho(pairs):
    rx, ry = plain_ranks([a for a, _ in pairs]), plain_ranks([b for _, b in pairs])
    a, b = np.array([rx[x] for x, _ in pairs]), np.array([ry[y] for _, y in pairs])
    return None if len(set(a)) < 2 or len(set(b)) < 2 else float(np.corrcoef(a, b)[0, 1])


@pytest.fixture
def spread_out(spark):
    """Parts stay apart, however small."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ranks_of_hot_groups_nulls_and_nans(spark, spread_out):
    rng = random.Random(1)
    rows = [("hot", float(rng.randint(0, 900))) for _ in range(3000)] + [("hot", None)] * 5 + [("hot", math.nan)] * 3 + [(f"g{i % 7}", float(i % 5)) for i in range(60)] + [(None, 1.0), (None, 2.0), ("one", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {(r["g"], "nan" if r["value"] is not None and math.isnan(r["value"]) else r["value"]): r["rank"] for r in stats.ranks(df.groupBy("g", "v").agg(F.count("*").alias("n")), ["v"], "g").collect()}
    want = {(g, v): rank for g in {g for g, _ in rows} for v, rank in plain_ranks([v for h, v in rows if h == g]).items()}
    assert got == want


def test_a_large_group_is_dealt_to_all_tasks(spark, spread_out, monkeypatch):
    tables = []
    monkeypatch.setattr(stats, "written", lambda df, put=stats.written: tables.append(put(df)) or tables[-1])
    df = spark.range(20000).select(F.lit("all").alias("g"), (F.col("id") * 7919 % 20011).alias("x"), (F.col("id") % 100).alias("y"))
    out = stats.spearman(df, "x", "y", "g")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("part#" in w.split("windowspecdefinition(")[1] for w in windows)
    sizes = [r["count"] for r in next(t for t in tables if "part" in t.columns).where("which = 0").groupBy("part").count().collect()]
    assert len(sizes) >= 3
    assert max(sizes) < 12000
    pairs = [(i * 7919 % 20011, i % 100) for i in range(20000)]
    assert out.first()["n"] == 20000
    assert math.isclose(out.first()["rho"], plain_rho(pairs), rel_tol=1e-9)


@pytest.mark.parametrize("group", [["g"], []])
def test_correlations_match_numpy(spark, group):
    rng = random.Random(2)
    rows = [(rng.choice("ab") if group else "a", float(rng.randint(0, 9)), float(rng.randint(0, 30)), rng.random()) for _ in range(400)] + ([("flat", 1.0, float(i), 0.5) for i in range(4)] if group else [])
    df = spark.createDataFrame(rows, "g string, x double, y double, z double")
    for r in stats.spearman(df, "x", "y", *group).collect():
        want = plain_rho([(x, y) for g, x, y, _ in rows if not group or g == r["g"]])
        assert r["rho"] is want or math.isclose(r["rho"], want, rel_tol=1e-9)
    for r in stats.partial_spearman(df, "x", "y", "z", *group).collect():
        own = [row[1:] for row in rows if not group or row[0] == r["g"]]
        xy, xz, yz = (plain_rho([(t[a], t[b]) for t in own]) for a, b in ((0, 1), (0, 2), (1, 2)))
        want = None if None in (xy, xz, yz) else (xy - xz * yz) / math.sqrt((1 - xz * xz) * (1 - yz * yz))
        assert r["partial_rho"] is want or math.isclose(r["partial_rho"], want, rel_tol=1e-9)


def test_draws_are_the_same_in_spark_numpy_and_python(spark):
    got = spark.range(2000).select(stats.drawn(F.lit(977), 5, F.col("id") % 40, F.col("id")).alias("d")).collect()
    ids = np.arange(2000, dtype=np.int64)
    want = stats.drawn(977, 5, ids % 40, ids)
    assert [r["d"] for r in got] == want.tolist() == [stats.drawn(977, 5, i % 40, i) for i in range(2000)]
    # As even as chance: 977 cells, and no rep like another.
    cells = np.bincount(stats.drawn(10, 0, np.arange(100000, dtype=np.int64) // 1000, np.arange(100000, dtype=np.int64) % 1000), minlength=10)
    assert abs(cells - 10000).max() < 500
    assert len({tuple(stats.drawn(1000, 0, np.int64(r), np.arange(50, dtype=np.int64))) for r in range(200)}) == 200


def plain_interval(pairs, reps, seed):
    out = []
    for rep in range(reps):
        some = [pairs[stats.drawn(len(pairs), seed, rep, slot)] for slot in range(len(pairs))]
        if (rho := plain_rho(some)) is not None:
            out.append(rho)
    return [float(np.percentile(out, q)) for q in (2.5, 97.5)] if out else [None, None]


def test_bootstrap_by_weights_and_by_rows(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(g, i, float(rng.randint(0, 6)), float(rng.randint(0, 9))) for g, n in (("a", 40), ("b", 25), (None, 12)) for i in range(n)] + [("flat", i, 1.0, float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, i int, x double, y double")
    want = {g: plain_interval([(x, y) for h, _, x, y in rows if h == g], 30, 4) for g in ("a", "b", None, "flat")}
    for limit in (1 << 22, 20, 1):
        monkeypatch.setattr(stats, "GROUP_ROWS", limit)
        for r in stats.bootstrap_spearman(df, "x", "y", "i", "g", reps=30, seed=4).collect():
            low, high = want[r["g"]]
            assert r["ci_low"] is low or math.isclose(r["ci_low"], low, rel_tol=1e-9)
            assert r["ci_high"] is high or math.isclose(r["ci_high"], high, rel_tol=1e-9)


def test_bootstrap_of_a_million_items(spark):
    """Rows are dealt once for each share of the repetitions, not once for each repetition."""
    df = spark.range(1 << 20).select(F.col("id").alias("i"), (F.col("id") % 1000).cast("double").alias("x"), (F.col("id") % 1000 + F.pmod(F.hash("id"), F.lit(500))).cast("double").alias("y"))
    r = stats.bootstrap_spearman(df, "x", "y", "i", reps=8).first()
    assert 0.85 < r["ci_low"] <= r["ci_high"] < 0.95
    assert r["n_reps"] == 8


def test_rows_are_numbered_in_order(spark, spread_out):
    df = spark.range(5000).select((F.col("id") * 37 % 5003).alias("k"), F.lit("x").alias("__odd")).repartition(6)
    got = stats.numbered(df, "place", "k").collect()
    assert [r["k"] for r in sorted(got, key=lambda r: r["place"])] == sorted(i * 37 % 5003 for i in range(5000))
    assert sorted(r["place"] for r in got) == list(range(5000))
    assert stats.numbered(df.limit(0), "place", "k").count() == 0


def test_groups_have_draws_in_common(monkeypatch):
    """Weights are those of ``drawn`` for any n and seed, kept or not; 20 groups of nearly one size make the hashes of one."""
    reps = np.array([0, 3, 50, 1999])
    for kept in (1 << 24, 100):
        monkeypatch.setattr(stats, "KEPT", kept)
        for seed in (0, 5):
            draws = stats._Draws(seed, reps)
            for n in (1, 2, 3, 700, 701, 701, 5000, 70001):
                got = np.concatenate(list(draws.of(n)))
                want = [np.bincount(stats.drawn(n, seed, np.int64(r), np.arange(n, dtype=np.int64)), minlength=n) for r in reps]
                assert (got == want).all()
    monkeypatch.setattr(stats, "KEPT", 1 << 24)
    made, plain = [], stats._hashes
    monkeypatch.setattr(stats, "_hashes", lambda seed, some, since, upto: made.append(len(some) * (upto - since)) or plain(seed, some, since, upto))
    draws = stats._Draws(0, reps)
    for n in range(1000, 1020):
        list(draws.of(n))
    assert sum(made) < 1.2 * len(reps) * 1000


def test_a_comparison_reads_its_traces_once(spark):
    from loomtrace.operators import drivers

    seen = spark.sparkContext.accumulator(0)

    def counted(parts):
        for part in parts:
            seen.add(len(part))
            yield part

    rows = [(s, kind, i / 8, i / 16) for i, s in enumerate(("AC", "ACD", "ACDE", "A")) for kind in drivers.KINDS]
    answers = spark.createDataFrame(rows, "seq string, kind string, strength double, toughness double").mapInPandas(counted, "seq string, kind string, strength double, toughness double")
    fitted = spark.createDataFrame([(s, i / 4, i / 2, 1.0 * i, -1.0 * i) for i, s in enumerate(("AC", "ACD", "ACDE", "A"))], "seq string, strength double, log10_toughness double, pred_strength double, pred_log10_toughness double")
    data = spark.createDataFrame([("AC", 0.1, 0.2), ("W", 0.3, 0.4)], "seq string, strength_norm double, toughness_norm double")
    drivers.compare(answers, {"ridge": fitted}, data, reps=2)
    assert seen.value == len(rows)
