"""Rank correlations, bootstrap intervals and hold-out errors over long frames (group, item, values)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compat import running_sums
from ..sources.scratch import written

REPS, LOW, HIGH = 2000, 0.025, 0.975
GROUP_ROWS, BLOCKS = 1 << 22, 50  # items of a group that one task draws from; parts that the repetitions are cut into at most
AT_ONCE, KEPT = 1 << 15, 1 << 24  # items times repetitions that are counted at once; hashes that a task keeps
PRIME = (1 << 31) - 1


def _same(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> Column:
    """Equal keys, nulls included; keys: names on the left and on the right."""
    return reduce(Column.__and__, [left[a].eqNullSafe(right[b]) for a, b in keys.items()])


def ranks(counted: DataFrame, values: list[str], *group: str) -> DataFrame:
    """group, which (a value's place among ``values``), value and rank: average ranks, from 1, of each group's values. counted: with ``n``, how often each row counts.

    Distinct values are dealt by range, so that a large group spreads over all tasks. Their counts are summed within each part, and a part starts where the parts before
    it end: only those sums, one for each group and part, meet. A null ranks below all numbers, NaN above them.
    """
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("which"), F.col(v).cast("double").alias("value")) for i, v in enumerate(values)]))
    long = counted.select(*group, "n", each.alias("x")).select(*group, "n", "x.*").groupBy(*group, "which", "value").agg(F.sum("n").alias("n"))
    # Written, since another run could draw the ranges' bounds otherwise.
    ranged = written(long.repartitionByRange(*group, "which", "value").withColumn("part", F.spark_partition_id()))
    key = [*group, "which"]
    parts = ranged.groupBy(*key, "part").agg(F.sum("n").alias("n")).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("part", "n"))).alias("parts"))
    before = F.explode(F.zip_with("parts", running_sums(F.col("parts.n")), lambda p, upto: F.struct(p["part"].alias("part"), (upto - p["n"]).alias("before"))))
    starts = parts.select(*key, before.alias("x")).select(*[F.col(k).alias(f"__{k}") for k in key], F.col("x.part").alias("__part"), "x.before")
    within = ranged.withColumn("upto", F.sum("n").over(Window.partitionBy(*key, "part").orderBy("value")))
    placed = within.join(starts, _same(within, starts, {k: f"__{k}" for k in [*key, "part"]}))
    return placed.select(*key, "value", (F.col("before") + F.col("upto") - (F.col("n") - 1) / 2.0).alias("rank"))


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """The rows, as a table, with their places (from 0) in the order. Rows are sorted by range, each task its own; a part starts where those before it end."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(ranged.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__place")))
    parts = rows.groupBy("__part").agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.struct("__part", "n"))).alias("p"))  # as many entries as there are tasks
    starts = parts.select(F.map_from_entries(F.zip_with("p", running_sums(F.col("p.n")), lambda p, upto: F.struct(p["__part"], upto - p["n"]))).alias("__starts"))
    return rows.crossJoin(F.broadcast(starts)).withColumn(name, F.col("__place") + F.try_element_at("__starts", F.col("__part"))).select(*df.columns, name)  # one row


def _counted(df: DataFrame, values: list[str], *group: str) -> DataFrame:
    """Rows of equal values put together, as a table: ``n`` tells how many they are."""
    return written(df.select(*group, *[F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(values)]).groupBy(*group, *[f"v{i}" for i in range(len(values))]).agg(F.count("*").alias("n")))


def _ranked(df: DataFrame, values: list[str], *group: str) -> DataFrame:
    """group, n and the average ranks r0, r1, ... of each combination of values."""
    rows = _counted(df, values, *group)
    every = ranks(rows, [f"v{i}" for i in range(len(values))], *group)
    for i in range(len(values)):
        side = every.where(F.col("which") == i).select(*[F.col(g).alias(f"__{g}") for g in group], F.col("value").alias("__value"), F.col("rank").alias(f"r{i}"))
        rows = rows.join(side, _same(rows, side, {**{g: f"__{g}" for g in group}, f"v{i}": "__value"})).drop(*[f"__{g}" for g in group], "__value")
    return rows


def safe_corr(a: Column, b: Column, n: Column) -> Column:
    """Pearson of rows that count n times; null where one side does not vary."""
    flat = (F.max(a) <= F.min(a)) | (F.max(b) <= F.min(b))
    all_, sa, sb = F.sum(n), F.sum(n * a), F.sum(n * b)
    top = all_ * F.sum(n * a * b) - sa * sb
    below = F.sqrt(all_ * F.sum(n * a * a) - sa * sa) * F.sqrt(all_ * F.sum(n * b * b) - sb * sb)
    return F.when(~flat, F.try_divide(top, below))


def spearman(df: DataFrame, x: str, y: str, *group: str) -> DataFrame:
    n = F.col("n")
    return _ranked(df, [x, y], *group).groupBy(*group).agg(F.sum(n).alias("n"), safe_corr(F.col("r0"), F.col("r1"), n).alias("rho"))


def partial_spearman(df: DataFrame, x: str, y: str, z: str, *group: str) -> DataFrame:
    """Correlation of the ranks of x and y once the rank of z is regressed out of both."""
    r = _ranked(df, [x, y, z], *group)
    three = r.groupBy(*group).agg(*[safe_corr(F.col(a), F.col(b), F.col("n")).alias(name) for name, a, b in (("xy", "r0", "r1"), ("xz", "r0", "r2"), ("yz", "r1", "r2"))])
    below = F.sqrt((1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz")))
    return three.select(*group, F.try_divide(F.col("xy") - F.col("xz") * F.col("yz"), below).alias("partial_rho"))


def _mixed(x: Column | np.ndarray, first: int, second: int, rep: Column | np.ndarray) -> Column | np.ndarray:
    """Fifth powers modulo a prime (one to one there), twice."""
    fifth = lambda h: h * h % PRIME * (h * h % PRIME) % PRIME * h % PRIME
    return fifth((fifth((x + first) % PRIME) * 48271 + rep + second) % PRIME)


def drawn(n: Column | np.ndarray, seed: int, rep: Column | np.ndarray, slot: Column | np.ndarray) -> Column | np.ndarray:
    """An index from 0 to n - 1 for each repetition and slot, in whole numbers below 2**63 only: the same as a column, in NumPy, and in any SQL."""
    x = rep % PRIME * 16807 + slot % PRIME * 69621 + seed % PRIME
    return (_mixed(x, 12345, 7, rep) * PRIME + _mixed(x, 54321, 11, rep)) % n


def drawn_sql(n: str, seed: int, rep: str, slot: str) -> str:
    """``drawn`` as SQL."""
    fifth = lambda h: f"(({h}) * ({h}) % {PRIME} * (({h}) * ({h}) % {PRIME}) % {PRIME} * ({h}) % {PRIME})"
    x = f"({rep} % {PRIME} * 16807 + {slot} % {PRIME} * 69621 + {seed % PRIME})"
    mixed = lambda first, second: fifth(f"({fifth(f'({x} + {first}) % {PRIME}')} * 48271 + {rep} + {second}) % {PRIME}")
    return f"(({mixed(12345, 7)} * {PRIME} + {mixed(54321, 11)}) % {n})"


def _sized(df: DataFrame, *group: str) -> DataFrame:
    """Adds ``__n``, the number of the group's rows."""
    sizes = df.groupBy(*group).agg(F.count("*").alias("__n")).select(*[F.col(g).alias(f"__{g}") for g in group], "__n")
    return df.join(sizes, _same(df, sizes, {g: f"__{g}" for g in group})).drop(*[f"__{g}" for g in group]) if group else df.crossJoin(F.broadcast(sizes))  # one row


def resample(df: DataFrame, item: str, group: list[str], reps: int, seed: int) -> DataFrame:
    """Each group's rows drawn with replacement, ``reps`` times over, with a column ``rep``; the same draws for every group of n items.

    item: numbers 0 to n - 1 in each group. A draw is an index by hash, so draws are made where they are joined.
    """
    draws = _sized(df.select(*group, item), *group).select(*group, "__n", F.col(item).cast("bigint").alias("slot"), F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    draws = draws.select(*[F.col(g).alias(f"__{g}") for g in group], "rep", drawn(F.col("__n"), seed, F.col("rep").cast("bigint"), F.col("slot")).alias("__item"))
    rows = df.withColumn(item, F.col(item).cast("bigint"))
    return draws.join(rows, _same(rows, draws, {**{g: f"__{g}" for g in group}, item: "__item"})).drop(*[f"__{g}" for g in group], "__item")


def interval(each: DataFrame, value: str, *group: str) -> DataFrame:
    """2.5 and 97.5 percentiles, with linear interpolation, of a statistic of each rep."""
    return each.groupBy(*group).agg(F.percentile(value, F.lit(LOW)).alias("ci_low"), F.percentile(value, F.lit(HIGH)).alias("ci_high"), F.count(value).alias("n_reps"))


def _mixed_all(x: np.ndarray, first: int, second: int, rep: np.ndarray) -> np.ndarray:
    """``_mixed`` of an array, each square once. The prime is 2**31 - 1, so digits of 31 bits are added up; only the last step needs the least remainder."""

    def reduced(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            high = x >> 31
            x &= PRIME
            x += high
        return x

    def fifth(h: np.ndarray) -> np.ndarray:
        square = reduced(h * h)
        return reduced(reduced(square * square) * h)

    return fifth(reduced(fifth(reduced(x + first)) * 48271 + (rep + second))) % PRIME


def _hashes(seed: int, reps: np.ndarray, since: int, upto: int) -> tuple[np.ndarray, np.ndarray]:
    """The two digits of what ``drawn`` takes modulo n, a row for each repetition and a column for each slot: the same for groups of any n."""
    rep, slot = reps.astype(np.int64)[:, None], np.arange(since, upto, dtype=np.int64)
    x = rep % PRIME * 16807 + slot % PRIME * 69621 + seed % PRIME
    return _mixed_all(x, 12345, 7, rep), _mixed_all(x, 54321, 11, rep)


def _weights(high: np.ndarray, low: np.ndarray, n: int) -> np.ndarray:
    """How often each of n items is drawn, a row for each repetition; n is below 2**22 or so, which keeps all steps whole."""
    at = (high % np.uint32(n)).astype(np.int64) * (PRIME % n) + low
    at -= (at / n).astype(np.int64) * n  # the quotient may be rounded up to the next
    at[at < 0] += n
    return np.bincount((at + np.arange(len(at))[:, None] * n).ravel(), minlength=len(at) * n).reshape(-1, n)


def _weighted(code: np.ndarray, weight: np.ndarray, distinct: int) -> tuple[np.ndarray, np.ndarray]:
    """Average ranks of items that count ``weight`` times, a row for each repetition, and n**2 times their variance, null where they do not vary; code: each item's place among the distinct values.

    Ranks of n items add up to n * (n + 1) / 2.
    """
    n = weight.shape[1]
    counts = np.bincount((code + np.arange(len(weight))[:, None] * distinct).ravel(), weight.ravel(), len(weight) * distinct).reshape(-1, distinct)
    ranked = np.cumsum(counts, axis=1)
    ranked -= (counts - 1) / 2.0
    varies = np.count_nonzero(counts, axis=1) > 1
    counts *= ranked
    spread = n * np.einsum("ij,ij->i", counts, ranked) - (n * (n + 1) / 2.0) ** 2
    return np.take(ranked, code, axis=1), np.where(varies, spread, np.nan)


def _statistics(codes: list[tuple[np.ndarray, int]], weight: np.ndarray) -> np.ndarray:
    """Spearman of two values, partial of three, of each repetition: draws become weights of the items. NaN where a side does not vary."""
    n = weight.shape[1]
    r = [_weighted(code, weight, k) for code, k in codes]

    def corr(i: int, j: int) -> np.ndarray:
        (a, va), (b, vb) = r[i], r[j]
        return (n * np.einsum("ij,ij->i", weight * a, b) - (n * (n + 1) / 2.0) ** 2) / (np.sqrt(va) * np.sqrt(vb))

    rho = corr(0, 1)
    if len(r) == 3:
        xz, yz = corr(0, 2), corr(1, 2)
        with np.errstate(invalid="ignore", divide="ignore"):
            below = np.sqrt((1 - xz * xz) * (1 - yz * yz))
            return np.where(below > 0, (rho - xz * yz) / below, np.nan)
    return rho


class _Draws:
    """Weights of a share of the repetitions for one group after another. Hashes are kept for the next group, up to ``KEPT`` of them, and weights for a next group of as many items."""

    def __init__(self, seed: int, reps: np.ndarray) -> None:
        self.seed, self.reps, self.n = seed, reps, 0
        self.high = self.low = np.empty((len(reps), 0), np.uint32)
        self.weights: list[np.ndarray] = []

    def _extend(self, n: int, step: int) -> None:
        """Hashes of n slots."""
        since, room = self.high.shape[1], (len(self.reps), n)
        high, low = np.empty(room, np.uint32), np.empty(room, np.uint32)
        high[:, :since], low[:, :since] = self.high, self.low
        for i in range(0, len(self.reps), step):
            high[i : i + step, since:], low[i : i + step, since:] = _hashes(self.seed, self.reps[i : i + step], since, n)
        self.high, self.low = high, low

    def of(self, n: int) -> Iterator[np.ndarray]:
        """Weights of n items, a few repetitions at a time, in their order."""
        step = max(1, AT_ONCE // n)
        if len(self.reps) * n > KEPT:
            for i in range(0, len(self.reps), step):
                high, low = _hashes(self.seed, self.reps[i : i + step], 0, n)
                yield _weights(high.astype(np.uint32), low, n).astype(np.float64)
            return
        if n != self.n:
            if self.high.shape[1] < n:
                self._extend(min(n + n // 16, KEPT // len(self.reps)), step)
            self.weights = [_weights(self.high[i : i + step, :n], self.low[i : i + step, :n], n).astype(np.uint32) for i in range(0, len(self.reps), step)]
            self.n = n
        yield from (w.astype(np.float64) for w in self.weights)


def _reps_of_small(df: DataFrame, values: list[str], item: str, group: list[str], reps: int, seed: int) -> DataFrame:
    """group, rep and the statistic. A task gets a group's items, ``GROUP_ROWS`` at most, for a share of the repetitions; it turns values into places among the distinct ones
    once, and each repetition into weights. Groups follow one another within a share, so that they have its draws in common."""
    spark = df.sparkSession
    blocks = min(BLOCKS, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), reps)
    dealt = df.select(*group, F.col(item).cast("bigint").alias("__item"), *values).withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition("__block").sortWithinPartitions("__block", *group, "__item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key: tuple | None = None
        draws: dict[int, _Draws] = {}

        def out() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held)
            codes = []
            for v in values:
                distinct, code = np.unique(whole.column(v).to_numpy(), return_inverse=True)
                codes.append((code, len(distinct)))
            own = np.arange(key[-1], reps, blocks)
            if key[-1] not in draws:
                draws.clear()
                draws[key[-1]] = _Draws(seed, own)
            found = np.concatenate([_statistics(codes, w) for w in draws[key[-1]].of(whole.num_rows)])
            keys = [pa.array([key[i]] * len(own), whole.schema.field(g).type) for i, g in enumerate(group)]
            return pa.RecordBatch.from_arrays([*keys, pa.array(own, pa.int64()), pa.array(found, pa.float64(), from_pandas=True)], names=[*group, "rep", "value"])

        for batch in batches:
            if not batch.num_rows:
                continue
            names = [*group, "__block"]
            changed = np.zeros(batch.num_rows, bool)
            for name in names:
                c = batch.column(name)
                code = c.dictionary_encode(null_encoding="encode").indices.to_numpy()
                changed[1:] |= code[1:] != code[:-1]
            edges = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                now = tuple(batch.column(name)[a].as_py() for name in names)
                if now != key and held:
                    yield out()
                    held = []
                key = now
                held.append(batch.slice(a, b - a))
        if held:
            yield out()

    fields = ", ".join([*(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in group), "rep long, value double"])
    return dealt.mapInArrow(run, fields)


def _bootstrap(df: DataFrame, values: list[str], item: str, group: list[str], reps: int, seed: int, by_rows: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Groups of at most ``GROUP_ROWS`` items in one task for a share of the repetitions, larger ones by rows that Spark deals; both draw the same."""
    sized = _sized(df, *group)
    each = _reps_of_small(sized.where(f"__n <= {GROUP_ROWS}"), values, item, group, reps, seed)
    if sized.where(f"__n > {GROUP_ROWS}").take(1):
        large = by_rows(resample(sized.where(f"__n > {GROUP_ROWS}").drop("__n"), item, group, reps, seed))
        each = each.unionByName(large.select(*group, F.col("rep").cast("long").alias("rep"), "value"))
    return interval(each, "value", *group)


def bootstrap_spearman(df: DataFrame, x: str, y: str, item: str, *group: str, reps: int = REPS, seed: int = 0) -> DataFrame:
    rows = df.select(*group, item, F.col(x).cast("double").alias("vx"), F.col(y).cast("double").alias("vy"))
    return _bootstrap(rows, ["vx", "vy"], item, list(group), reps, seed, lambda d: spearman(d, "vx", "vy", *group, "rep").withColumnRenamed("rho", "value"))


def bootstrap_partial(df: DataFrame, x: str, y: str, z: str, item: str, *group: str, reps: int = REPS, seed: int = 0) -> DataFrame:
    rows = df.select(*group, item, *[F.col(c).cast("double").alias(v) for c, v in ((x, "vx"), (y, "vy"), (z, "vz"))])
    return _bootstrap(rows, ["vx", "vy", "vz"], item, list(group), reps, seed, lambda d: partial_spearman(d, "vx", "vy", "vz", *group, "rep").withColumnRenamed("partial_rho", "value"))


def bootstrap(df: DataFrame, statistic: Callable[[DataFrame], DataFrame], item: str, *group: str, reps: int = REPS, seed: int = 0) -> DataFrame:
    """Interval of any statistic: a function from rows with the group's columns and ``rep`` to a row for each of these, with ``value``."""
    return interval(statistic(resample(df, item, list(group), reps, seed)), "value", *group)


def metric_matrix(wide: DataFrame, item: str, predictors: list[str], targets: list[str]) -> DataFrame:
    """predictor, target, item, pred, truth: a row for each combination of the columns."""
    longer = lambda names, key, value: F.explode(F.array(*[F.struct(F.lit(n).alias(key), F.col(n).cast("double").alias(value)) for n in names]))
    preds = wide.select(item, longer(predictors, "predictor", "pred").alias("p"), *[F.col(t).alias(t) for t in targets])
    return preds.select(item, "p", longer(targets, "target", "truth").alias("t")).select("p.predictor", "t.target", item, "p.pred", "t.truth")


def align(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of both sides by key; raises where a key repeats, since then the sides would multiply."""
    for name, side in (("left", left), ("right", right)):
        if twice := side.groupBy(key).count().where("count > 1").take(1):
            raise ValueError(f"{key} {twice[0][0]!r} repeats in the {name} input")
    return left.join(right, key)


def holdout(all_rows: DataFrame, held: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is held out, and the others."""
    keys = held.select(key).distinct()
    return all_rows.join(keys, key, "left_semi"), all_rows.join(keys, key, "left_anti")


def mean_baseline(rows: DataFrame, base: DataFrame, pred: str, truth: str) -> DataFrame:
    """One row: mean absolute error of the prediction, and of the mean of the base rows' truth."""
    mean = base.agg(F.avg(truth).alias("m"))
    return rows.crossJoin(F.broadcast(mean)).agg(F.count("*").alias("n"), F.avg(F.abs(F.col(pred) - F.col(truth))).alias("mae"), F.avg(F.abs(F.col("m") - F.col(truth))).alias("mean_mae"))


def within(rows: DataFrame, errors: list[Column], tolerance: float, *group: str) -> DataFrame:
    """Share of rows whose mean error is within the tolerance."""
    total = errors[0]
    for e in errors[1:]:
        total = total + e
    return rows.groupBy(*group).agg(F.count("*").alias("n"), F.avg((total / len(errors) <= tolerance).cast("double")).alias("within_fraction"))
