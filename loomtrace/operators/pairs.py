"""Preference pairs of traces of one prompt, within a budget.

Pairs are chosen as pairs of keys; texts join in once the pairs are known. Pairs of a prompt that any trace of one bucket may form with any of another are never put
together: they are numbered, and the first few of a seeded permutation of the numbers are taken. Random choices follow an MD5 of the seed
and the keys, so they do not depend on the order or number of partitions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compat import hashed_index, running_sums, seeded
from ..sources.scratch import written

GROUNDED_CORRECT, SHORTCUT_CORRECT, GROUNDED_INCORRECT, SHORTCUT_INCORRECT = "grounded_correct", "shortcut_correct", "grounded_incorrect", "shortcut_incorrect"


@dataclass(frozen=True)
class same_answer:  # noqa: N801
    """Two property maps agree if they share properties and differ nowhere by more than the tolerance."""

    tolerance: float

    def __call__(self, a: Column, b: Column) -> Column:
        shared = F.array_intersect(F.map_keys(a), F.map_keys(b))
        return (F.size(shared) > 0) & F.forall(shared, lambda k: F.abs(F.try_element_at(a, k) - F.try_element_at(b, k)) <= self.tolerance)

    def cells(self, answer: Column, reach: int) -> Column:
        """Each property with its value's cell, and cells up to ``reach`` away: values within the tolerance of each other lie in neighbouring ones."""
        width = (self.tolerance or 1.0) * 1.001
        cell = lambda v: F.floor(F.greatest(F.least(v.cast("double") / width, F.lit(1e18)), F.lit(-1e18)))
        known = F.filter(F.map_entries(answer), lambda e: e["value"].isNotNull() & ~F.isnan(e["value"].cast("double")))
        return F.flatten(F.transform(known, lambda e: F.array(*[F.struct(e["key"].alias("prop"), (cell(e["value"]) + by).alias("cell")) for by in range(-reach, reach + 1)])))

    def meets_at(self, a: Column, b: Column) -> Column:
        """The property by whose cells a pair is found, once."""
        return F.array_min(F.array_intersect(F.map_keys(a), F.map_keys(b)))


@dataclass(frozen=True)
class PairConfig:
    threshold: float = 0.7
    max_pairs: int = 4
    anti_ratio: float = 0.25
    agree: Callable[[Column, Column], Column] = Column.__eq__
    seed: int = 0


def bucket(score: Column, correct: Column, threshold: float) -> Column:
    grounded = score >= threshold
    return F.when(correct & grounded, GROUNDED_CORRECT).when(correct, SHORTCUT_CORRECT).when(grounded, GROUNDED_INCORRECT).otherwise(SHORTCUT_INCORRECT)


def diversity(traces: DataFrame, prompt: str) -> DataFrame:
    """One row: prompts, those with traces in several buckets, and their share."""
    per = traces.groupBy(prompt).agg(F.countDistinct("bucket").alias("n"))
    return per.agg(F.count("*").alias("n_prompts"), F.count_if(F.col("n") > 1).alias("n_diverse"), F.coalesce(F.try_divide(F.count_if(F.col("n") > 1), F.count("*")), F.lit(0.0)).alias("diverse_fraction"))


ROUNDS = 4
SMALL = 64  # traces of a prompt that is put together as one row
BUCKETS = [GROUNDED_CORRECT, SHORTCUT_CORRECT, GROUNDED_INCORRECT, SHORTCUT_INCORRECT]
_ENTRIES = "array<struct<pair_type:string,r:bigint,at:bigint,p:bigint,d:bigint,chosen:{key},rejected:{key}>>"
#: Types of pairs in order: name, and the buckets of the chosen and of the rejected trace.
SAME = ("same_answer", GROUNDED_CORRECT, SHORTCUT_CORRECT)
LIMITED = [("anti_shortcut", GROUNDED_INCORRECT, SHORTCUT_INCORRECT), ("standard", GROUNDED_CORRECT, SHORTCUT_INCORRECT), ("standard_fallback", SHORTCUT_CORRECT, GROUNDED_INCORRECT)]


def permuted(rows: DataFrame, *salt: Column) -> DataFrame:
    """Adds i and j: where a permutation of the p * d pairs, drawn by the salt, puts pair number r, as a place below p and one below d. rows: with r, p and d.

    Each round moves one place by a hash of the other, which can be undone, so no two numbers meet. A column for each step: nested, they would be worked out over and over.
    """
    rows = rows.withColumn("i", F.floor(F.col("r") / F.col("d")).cast("bigint")).withColumn("j", F.pmod("r", "d"))
    for turn in range(ROUNDS):
        for side, n, other in (("i", "p", "j"), ("j", "d", "i")):
            rows = rows.withColumn(side, F.pmod(F.col(side) + hashed_index(F.col(n), *salt, F.lit(turn), F.lit(side), F.col(other)), n))
    return rows


def _same(slim: DataFrame, prompt: str, key: str, answer: str, config: PairConfig) -> DataFrame:
    """prompt, chosen, rejected and rnd of all pairs of equal answers. Where answers have cells, only those in neighbouring ones meet."""
    side = lambda bucket_, name: slim.where(F.col("bucket") == bucket_).select(F.col(prompt).alias("p"), F.col(key).alias(name), F.col(answer).alias(f"{name}_answer"))
    a, b = side(SAME[1], "chosen"), side(SAME[2], "rejected")
    agree, on = config.agree(F.col("chosen_answer"), F.col("rejected_answer")), ["p"]
    if isinstance(config.agree, same_answer):
        a = a.select("*", F.explode(config.agree.cells(F.col("chosen_answer"), 0)).alias("c")).select("*", "c.*").drop("c")
        b = b.select("*", F.explode(config.agree.cells(F.col("rejected_answer"), 1)).alias("c")).select("*", "c.*").drop("c")
        agree, on = agree & (F.col("prop") == config.agree.meets_at(F.col("chosen_answer"), F.col("rejected_answer"))), ["p", "prop", "cell"]
    found = a.join(b, on).where(agree)
    return found.select(F.col("p").alias(prompt), "chosen", "rejected", seeded(config.seed, F.lit(SAME[0]), F.col("chosen"), F.col("rejected")).alias("rnd"))


def build_pairs(traces: DataFrame, prompt: str, key: str, config: PairConfig = PairConfig(), answer: str = "final_answer") -> DataFrame:  # noqa: B008
    """prompt, pair_type, chosen, rejected, pair_rank. traces: prompt, unique key, bucket and answer.

    Per prompt: pairs of equal answers (correct and grounded against correct shortcut), without limit; then
    ``max_pairs * anti_ratio`` (half-even) of wrong but grounded against wrong shortcut; then grounded against
    wrong shortcut of the correct ones for what is left of the budget, and correct shortcut against wrong grounded for what that leaves.
    The list is cut to the budget; a budget of 0 cuts nothing. Traces of a null prompt make no pairs.

    Of limited types only the pairs that are kept are made: as numbers, turned into places within the two buckets, and these into
    keys. A prompt of up to ``SMALL`` traces is one row, so its traces are shuffled once. Of larger ones a bucket's places run through parts by hash of the key, so a
    prompt with many traces spreads over tasks.
    """
    slim = traces.where(F.col(prompt).isNotNull()).select(prompt, key, "bucket", answer)
    large = written(slim.groupBy(prompt).agg(F.count("*").alias("n")).where(f"n > {SMALL}").select(prompt))
    if large.isEmpty():
        return _pairs_within(slim, prompt, key, answer, config)
    few, many = (slim.join(large, prompt, how) for how in ("left_anti", "left_semi"))
    return _pairs_within(few, prompt, key, answer, config).unionByName(_pairs_across(many, prompt, key, answer, config))


def _part(key: Column) -> Column:
    """Places in a bucket are by this, then by key."""
    return F.substring(F.md5(key.cast("string").cast("binary")), 1, 2)


def _pairs_within(slim: DataFrame, prompt: str, key: str, answer: str, config: PairConfig) -> DataFrame:
    """``build_pairs`` with a row for each prompt."""
    budget = config.max_pairs
    trace = F.struct(_part(F.col(key)).alias("part"), F.col(key).alias("k"), F.col(answer).alias("answer"))
    held = slim.groupBy(F.col(prompt).alias("p")).agg(*[F.collect_list(F.when(F.col("bucket") == b, trace)).alias(b) for b in BUCKETS])
    with_seed = lambda x, y: F.struct(seeded(config.seed, F.lit(SAME[0]), x["k"], y["k"]).alias("rnd"), x["k"].alias("chosen"), y["k"].alias("rejected"))
    one = lambda x: F.transform(F.filter(SAME[2], lambda y: config.agree(x["answer"], y["answer"])), lambda y: with_seed(x, y))
    same = F.array_sort(F.flatten(F.transform(SAME[1], one)))
    if budget <= 0:
        found = held.select("p", F.posexplode_outer(same).alias("at", "s")).where("s is not null")
        return found.select(F.col("p").alias(prompt), F.lit(SAME[0]).alias("pair_type"), "s.chosen", "s.rejected", (F.col("at") + 1).alias("pair_rank"))
    places = lambda b: F.transform(F.array_sort(F.transform(b, lambda x: F.struct(x["part"], x["k"]))), lambda x: x["k"]).alias(b)
    sized = held.select("p", F.slice(same, 1, budget).alias("same"), *[places(b) for b in BUCKETS])
    total = {b: F.size(b).cast("bigint") for b in BUCKETS}
    limits, before = _limits(config, F.size("same").cast("bigint"), {name: total[a] * total[b] for name, a, b in LIMITED}), F.size("same").cast("bigint")
    kept = F.transform("same", lambda s, i: F.struct(F.lit(SAME[0]).alias("pair_type"), i.cast("bigint").alias("r"), i.cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("p"), F.lit(None).cast("bigint").alias("d"), s["chosen"].alias("chosen"), s["rejected"].alias("rejected")))
    null = F.lit(None).cast(slim.schema[key].dataType)
    wanted = [kept]
    for name, a, b in LIMITED:
        entry = (lambda name, a, b, before: lambda r: F.struct(F.lit(name).alias("pair_type"), r.alias("r"), (before + r).alias("at"), total[a].alias("p"), total[b].alias("d"), null.alias("chosen"), null.alias("rejected")))(name, a, b, before)
        wanted.append(F.when(limits[name] > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), limits[name] - 1), entry)).otherwise(F.array().cast(_ENTRIES.format(key=slim.schema[key].dataType.simpleString()))))
        before = before + limits[name]
    # Outer: otherwise Spark filters by the list's size below, where it works out every part of it anew.
    each = sized.select(F.col("p").alias("prompt"), *BUCKETS, F.explode_outer(F.concat(*wanted)).alias("w")).where(f"w.at < {budget}").select("prompt", *BUCKETS, "w.*")
    placed = permuted(each, F.lit(str(config.seed)), F.col("pair_type"), F.col("prompt").cast("string"))
    at = lambda side, place: reduce(lambda c, x: c.when(F.col("pair_type") == x[0], F.get(F.col(x[side]), F.col(place).cast("int"))), LIMITED, F.when(F.col("pair_type") == SAME[0], F.col("chosen" if side == 1 else "rejected")))
    # Exploded: otherwise a filter on a key, such as a join's for nulls, would have Spark work the whole permutation out again below.
    met = placed.select("prompt", "pair_type", "at", F.explode_outer(F.array(F.struct(at(1, "i").alias("chosen"), at(2, "j").alias("rejected")))).alias("x"))
    return met.select(F.col("prompt").alias(prompt), "pair_type", "x.chosen", "x.rejected", (F.col("at") + 1).cast("int").alias("pair_rank"))


def _limits(config: PairConfig, n_same: Column, every: dict[str, Column]) -> dict[str, Column]:
    """How many pairs of each limited type a prompt gets. every: how many there are."""
    anti_limit = max(0, round(config.max_pairs * config.anti_ratio))
    remaining = F.greatest(F.lit(0), F.lit(config.max_pairs - anti_limit) - n_same)
    limits = {"anti_shortcut": F.least(F.lit(anti_limit).cast("bigint"), every["anti_shortcut"]), "standard": F.least(remaining, every["standard"])}
    return limits | {"standard_fallback": F.least(remaining - limits["standard"], every["standard_fallback"])}


def _pairs_across(slim: DataFrame, prompt: str, key: str, answer: str, config: PairConfig) -> DataFrame:
    """``build_pairs`` with traces as rows that meet."""
    budget = config.max_pairs
    per = Window.partitionBy(prompt).orderBy("rnd", "chosen", "rejected")
    same = _same(slim, prompt, key, answer, config).withColumn("pair_rank", F.row_number().over(per))
    out = [prompt, "pair_type", "chosen", "rejected", "pair_rank"]
    if budget <= 0:
        return same.select(prompt, F.lit(SAME[0]).alias("pair_type"), "chosen", "rejected", "pair_rank")
    same = same.where(f"pair_rank <= {budget}")
    keyed = slim.select(F.col(prompt).alias("p"), "bucket", _part(F.col(key)).alias("part"), F.col(key).alias("k"))
    sizes = keyed.groupBy("p", "bucket", "part").agg(F.count("*").alias("n")).groupBy("p").agg(F.array_sort(F.collect_list(F.struct("bucket", "part", "n"))).alias("parts"))  # 1024 at most
    counts = same.groupBy(F.col(prompt).alias("p")).agg(F.count("*").alias("n_same"))
    sized = sizes.join(counts, "p", "left").withColumn("n_same", F.coalesce("n_same", F.lit(0)).cast("bigint"))
    for b in BUCKETS:
        own = F.filter("parts", (lambda b: lambda x: x["bucket"] == b)(b))
        sized = sized.withColumn(b, F.zip_with(own, running_sums(F.transform(own, lambda x: x["n"])), lambda x, upto: F.struct(x["part"].alias("part"), (upto - x["n"]).alias("start"), upto.alias("end"))))
    total = lambda b: F.coalesce(F.get(F.col(b), F.size(b) - 1)["end"], F.lit(0))
    every = {name: total(a) * total(b) for name, a, b in LIMITED}
    limits = _limits(config, F.col("n_same"), every)
    before, wanted = F.col("n_same"), []
    for name, a, b in LIMITED:
        wanted.append(F.struct(F.lit(name).alias("pair_type"), limits[name].alias("limit"), before.alias("before"), F.lit(a).alias("a_bucket"), F.lit(b).alias("b_bucket"), F.col(a).alias("a"), F.col(b).alias("b")))
        before = before + limits[name]
    each = sized.select("p", F.explode(F.array(*wanted)).alias("w")).select("p", "w.*").where("limit > 0")
    numbered = each.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("limit") - 1)).alias("r")).where(F.col("before") + F.col("r") < budget)
    size = lambda c: F.get(F.col(c), F.size(c) - 1)["end"]
    placed = permuted(numbered.withColumnRenamed("p", "prompt").withColumn("p", size("a")).withColumn("d", size("b")), F.lit(str(config.seed)), F.col("pair_type"), F.col("prompt").cast("string"))
    at = lambda parts, place: F.get(F.filter(parts, lambda x: F.col(place) < x["end"]), F.lit(0))
    picked = placed.withColumn("a", at("a", "i")).withColumn("b", at("b", "j")).select(
        F.col("prompt").alias("p"), "pair_type", (F.col("before") + F.col("r") + 1).cast("int").alias("pair_rank"), "a_bucket", F.col("a.part").alias("a_part"), (F.col("i") - F.col("a.start")).alias("a_at"),
        "b_bucket", F.col("b.part").alias("b_part"), (F.col("j") - F.col("b.start")).alias("b_at"),
    )
    placed = keyed.withColumn("at", F.row_number().over(Window.partitionBy("p", "bucket", "part").orderBy("k")) - 1)
    for s, name in (("a", "chosen"), ("b", "rejected")):
        own = placed.select(F.col("p").alias("__p"), F.col("bucket").alias("__bucket"), F.col("part").alias("__part"), F.col("at").cast("bigint").alias("__at"), F.col("k").alias(name))
        # Plain equality would have Spark check places for nulls, by working the whole permutation out again below.
        met = [picked[a].eqNullSafe(own[b]) for a, b in (("p", "__p"), (f"{s}_bucket", "__bucket"), (f"{s}_part", "__part"), (f"{s}_at", "__at"))]
        picked = picked.join(own, met).drop("__p", "__bucket", "__part", "__at")
    rest = picked.select(F.col("p").alias(prompt), "pair_type", "chosen", "rejected", "pair_rank")
    return same.withColumn("pair_type", F.lit(SAME[0])).select(*out).unionByName(rest)


def with_texts(pairs: DataFrame, traces: DataFrame, key: str, text: str = "trace_text") -> DataFrame:
    """The pairs with both texts, and structs of correctness and grounding."""
    side = lambda name: traces.select(F.col(key).alias(name), F.col(text).alias(f"{name}_text"), F.struct(F.col("is_correct").alias("correct"), F.col("grounding_score").alias("grounding")).alias(f"{name}_meta"))
    return pairs.join(side("chosen"), "chosen").join(side("rejected"), "rejected")


def summarize(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts by type; and one row: all pairs, and the share whose chosen trace is wrong, which the type tells."""
    by_type = pairs.groupBy("pair_type").agg(F.count("*").alias("n_pairs"))
    total = pairs.agg(F.count("*").alias("n_pairs"), F.coalesce(F.try_divide(F.count_if(F.col("pair_type") == "anti_shortcut"), F.count("*")), F.lit(0.0)).alias("chosen_incorrect_fraction"))
    return by_type, total
