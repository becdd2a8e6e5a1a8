"""Rank statistics, splits and hold-out errors over parts, orders and documents, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.compat import py_round
from ..operators import drivers, stats
from ..sources import sinks
from ..sources.scratch import scratch
from . import bridge

REPS = stats.REPS


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_size").cast("double").alias("pred"), F.col("p_retailprice").alias("truth"), F.length("p_name").cast("double").alias("len"))


def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.spearman(_parts(spark, sf_dir), "pred", "truth", "p_brand").withColumn("rho", py_round(F.col("rho"), 6))


def partial_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size against price, given the length of the type."""
    rows = bridge.table(spark, sf_dir, "part").select("p_brand", F.col("p_size").alias("x"), F.col("p_retailprice").alias("y"), (F.col("p_partkey") % 101).alias("z"))
    return stats.partial_spearman(rows, "x", "y", "z", "p_brand").withColumn("partial_rho", py_round(F.col("partial_rho"), 6))


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir).withColumn("item", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1)
    out = stats.bootstrap_spearman(rows, "pred", "truth", "item", "p_brand", reps=REPS)
    return out.select("p_brand", py_round(F.col("ci_low"), 6).alias("ci_low"), py_round(F.col("ci_high"), 6).alias("ci_high"), "n_reps")


def metric_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations of two predictors with two targets: lines of an order."""
    wide = bridge.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.avg("l_quantity").alias("mean_quantity"), F.count("*").cast("double").alias("n_lines"), F.max("l_extendedprice").alias("max_price"), F.min("l_discount").alias("min_discount"))
    matrix = stats.metric_matrix(wide, "l_orderkey", ["mean_quantity", "n_lines"], ["max_price", "min_discount"])
    return stats.spearman(matrix, "pred", "truth", "predictor", "target").withColumn("rho", py_round(F.col("rho"), 5))


def mean_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean answer of each prompt and kind."""
    rows = bridge.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.avg("l_discount").alias("strength"), F.avg("l_tax").alias("toughness"))
    return rows.select("l_orderkey", "l_returnflag", py_round(F.col("strength"), 6).alias("strength"), py_round(F.col("toughness"), 6).alias("toughness"))


def align_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with their length, by an inner join of unique keys."""
    docs = bridge.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return stats.align(docs, bridge.table(spark, sf_dir, "labels"), "doc_id")


def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by whether they are labelled, and source."""
    held, rest = stats.holdout(bridge.table(spark, sf_dir, "documents").select("doc_id", "source"), bridge.table(spark, sf_dir, "labels"), "doc_id")
    both = held.select("source", F.lit("held").alias("part")).unionByName(rest.select("source", F.lit("rest").alias("part")))
    return both.groupBy("source", "part").agg(F.count("*").alias("n"))


def mean_baseline_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions against the mean of what is held out."""
    rows = bridge.table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("pred"), F.col("l_discount").alias("d"), (F.col("l_tax") * 100).alias("truth"))
    out = stats.mean_baseline(rows, rows.where("d > 0.05"), "pred", "truth")
    return out.select("n", py_round(F.col("mae"), 4).alias("mae"), py_round(F.col("mean_mae"), 4).alias("mean_mae"))


def within_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bridge.table(spark, sf_dir, "lineitem").select("l_returnflag", F.abs(F.col("l_discount") - F.col("l_tax")).alias("e1"), F.abs(F.col("l_quantity") / 50 - F.col("l_discount")).alias("e2"))
    return stats.within(rows, [F.col("e1"), F.col("e2")], 0.1, "l_returnflag").withColumn("within_fraction", py_round(F.col("within_fraction"), 5))


def length_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length of a text as predictor of its label, by source."""
    rows = bridge.table(spark, sf_dir, "documents").join(bridge.table(spark, sf_dir, "labels"), "doc_id").select("source", F.length("text").alias("len"), "quality")
    return stats.spearman(rows, "len", "quality", "source").withColumn("rho", py_round(F.col("rho"), 6))


#: A sequence for a number and a count: digits as letters, then the count as a run of other letters. The same text in both engines.
SEQ = "'{head}' || translate(CAST({key} AS {text}), '0123456789', 'ACDEFGHIKL') || repeat('PY', CAST({count} AS INT))"
#: Each supplier's predictions: of the first table those with a balance, of the second all.
FITTED = {"ridge": ("s_suppkey * 37 % 101", "s_acctbal", "s_acctbal > 0"), "deep": ("floor(s_acctbal / 500)", "s_nationkey * s_nationkey % 7", "true")}
COMPARISON = "section string, label string, target string, metric string, value double"


def compare_predictors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison over files: order lines as traces about their supplier's sequence, two tables of fitted predictions, and a dataset of suppliers and customers."""
    path = scratch(spark)
    sup = bridge.table(spark, sf_dir, "supplier").withColumn("seq", F.expr(SEQ.format(head="M", key="s_suppkey", count="s_nationkey", text="STRING")))
    lines = bridge.table(spark, sf_dir, "lineitem").join(sup.select("s_suppkey", "seq"), F.col("l_suppkey") == F.col("s_suppkey"))
    # Whole 128ths, so that means are the same in any order. Lines of one piece have no answer.
    answer = F.when(F.col("l_quantity") > 1, F.struct((F.round(F.col("l_discount") * 100) / 128).alias("strength"), (F.round(F.col("l_tax") * 100) / 128).alias("toughness")))
    kind = F.when(F.col("l_linestatus") == "F", "grounded").otherwise("shortcut")
    trace = F.struct(F.struct(F.col("seq").alias("sequence"), kind.alias("trace_kind")).alias("metadata"), answer.alias("final_answer"))
    pools = lines.groupBy(F.expr("l_orderkey div 4096").alias("file")).agg(F.to_json(F.struct(F.collect_list(trace).alias("scored_traces"))).alias("value"))
    pools.select("value").write.option("maxRecordsPerFile", 1).text(f"{path}/pools")
    for name, (strength, toughness, where) in FITTED.items():
        fitted = sup.where(where).selectExpr("seq", "s_acctbal AS strength", "s_nationkey AS log10_toughness", f"{strength} AS pred_strength", f"{toughness} AS pred_log10_toughness")
        fitted.write.option("header", True).csv(f"{path}/{name}")
    known = sup.selectExpr("lower(seq) AS seq", "s_nationkey / 32 AS strength_norm", "s_suppkey % 64 / 64 AS toughness_norm").unionByName(sup.selectExpr("seq", "s_suppkey % 32 / 32 AS strength_norm", "CAST(NULL AS DOUBLE) AS toughness_norm"))
    others = bridge.table(spark, sf_dir, "customer").selectExpr(SEQ.format(head="W", key="c_custkey", count="c_nationkey", text="STRING") + " AS seq", "c_nationkey / 32 AS strength_norm", "c_custkey % 64 / 64 AS toughness_norm")
    known.unionByName(others).write.option("header", True).csv(f"{path}/dataset")
    inputs = drivers.read_comparison_inputs(spark, f"{path}/pools", {name: f"{path}/{name}" for name in FITTED}, f"{path}/dataset")
    sinks.write_comparison(f"{path}/comparison", drivers.compare(*inputs, reps=REPS))
    return spark.read.schema(COMPARISON).json(f"{path}/comparison").withColumn("value", py_round(F.col("value"), 5))


def _rank(col: str, group: str) -> str:
    return f"(rank() OVER (PARTITION BY {group} ORDER BY {col}) + (count(*) OVER (PARTITION BY {group}, {col}) - 1) / 2.0::DOUBLE)"


def _rho(a: str, b: str) -> str:
    n = f"count(*)::DOUBLE * sum({a} * {b}) - sum({a}) * sum({b})"
    v = lambda x: f"sqrt(count(*)::DOUBLE * sum({x} * {x}) - sum({x}) * sum({x}))"
    return f"CASE WHEN max({a}) > min({a}) AND max({b}) > min({b}) THEN ({n}) / ({v(a)} * {v(b)}) END"


def _r(x: str, d: int) -> str:
    return f"(printf('%.{d}f', {x})::DOUBLE + 0.0::DOUBLE)"


def _compare_sql() -> str:
    pairs = {(label, t): (f"{label}_{t}" if label != "length" else "len", f"truth_{t}") for label in [*drivers.KINDS, *FITTED, "length"] for t in drivers.TARGETS}
    llm = {k: v for k, v in pairs.items() if k[0] in drivers.KINDS}
    values = ["len", *[f"truth_{t}" for t in drivers.TARGETS], *[x for (label, _), (x, _) in pairs.items() if label != "length"]]
    partial = lambda x, y: f"({_rho(x, y)} - {_rho(x, 'len')} * {_rho(y, 'len')}) / nullif(sqrt((1 - pow({_rho(x, 'len')}, 2)) * (1 - pow({_rho(y, 'len')}, 2))), 0)"
    entry = lambda section, label, t, metric, value: f"{{'section': '{section}', 'label': '{label}', 'target': '{t}', 'metric': '{metric}', 'value': ({value})::DOUBLE}}"
    once = [entry("spearman", *k, m, v) for k, (x, y) in pairs.items() for m, v in (("rho", _rho(x, y)), ("n", "count(*)"))]
    once += [entry("length", *k, m, v) for k, (x, y) in llm.items() for m, v in (("pred_vs_length", _rho(x, "len")), ("truth_vs_length", _rho(y, "len")), ("partial_rho", partial(x, y)))]
    each = [entry("spearman", *k, "", _rho(x, y)) for k, (x, y) in pairs.items()] + [entry("length", *k, "", partial(x, y)) for k, (x, y) in llm.items()]
    guess = {"constant_mean": {t: f"mean_{t}" for t in drivers.TARGETS}} | {k: {t: f"{k}_{t}" for t in drivers.TARGETS} for k in drivers.KINDS}
    judged = [entry("absolute_error", label, t, "mae", f"avg(abs(norm_{t} - {g}))") for label, by in guess.items() for t, g in by.items()]
    judged += [entry("within_tolerance", label, "both", "share", f"avg(((abs(norm_strength - {by['strength']}) + abs(norm_toughness - {by['toughness']})) / 2 <= 0.1::DOUBLE)::INT)") for label, by in guess.items()]
    means = ", ".join(f"avg(round({col} * 100) / 128) FILTER (l_linestatus {'=' if kind == 'grounded' else '<>'} 'F') AS {kind}_{t}" for kind in drivers.KINDS for t, col in zip(drivers.TARGETS, ("l_discount", "l_tax"), strict=True))
    fitted = ", ".join(f"({f[i]})::DOUBLE AS {name}_{t}" for name, f in FITTED.items() for i, t in enumerate(drivers.TARGETS))
    return f"""WITH sup AS (SELECT *, {SEQ.format(head='M', key='s_suppkey', count='s_nationkey', text='VARCHAR')} AS seq FROM supplier),
m AS (SELECT l_suppkey AS s_suppkey, {means} FROM lineitem WHERE l_quantity > 1 GROUP BY 1 HAVING count(DISTINCT l_linestatus = 'F') = 2),
ev AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS item, length(seq)::DOUBLE AS len, s_acctbal AS truth_strength, s_nationkey::DOUBLE AS truth_toughness, {fitted}, count(*) OVER () AS n FROM sup JOIN m USING (s_suppkey) WHERE {FITTED['ridge'][2]}),
one AS (SELECT {', '.join(f"{_rank(v, '1')} AS {v}" for v in values)} FROM ev),
d AS (SELECT rep, {stats.drawn_sql('n', 0, 'rep', 'item')} AS item FROM ev, range(0, {REPS}) g(rep)),
many AS (SELECT rep, {', '.join(f"{_rank(v, 'rep')} AS {v}" for v in values)} FROM d JOIN ev USING (item)),
drawn AS (SELECT unnest([{', '.join(each)}]) AS x FROM many GROUP BY rep),
norms AS (SELECT ev.*, (s_nationkey / 32 + s_suppkey % 32 / 32) / 2 AS norm_strength, s_suppkey % 64 / 64 AS norm_toughness FROM ev),
outside AS (SELECT s_nationkey / 32 AS a, s_suppkey % 64 / 64 AS b FROM sup WHERE seq NOT IN (SELECT seq FROM ev) UNION ALL SELECT s_suppkey % 32 / 32, NULL FROM sup WHERE seq NOT IN (SELECT seq FROM ev) UNION ALL SELECT c_nationkey / 32, c_custkey % 64 / 64 FROM customer),
away AS (SELECT avg(a) AS mean_strength, avg(b) AS mean_toughness FROM outside),
rows AS (SELECT unnest([{', '.join(once)}]) AS x FROM one UNION ALL SELECT unnest([{', '.join(judged)}]) FROM norms, away
UNION ALL SELECT {{'section': x.section, 'label': x.label, 'target': x.target, 'metric': 'ci_low', 'value': quantile_cont(x.value, 0.025)}} FROM drawn GROUP BY x.section, x.label, x.target
UNION ALL SELECT {{'section': x.section, 'label': x.label, 'target': x.target, 'metric': 'ci_high', 'value': quantile_cont(x.value, 0.975)}} FROM drawn GROUP BY x.section, x.label, x.target)
SELECT x.section, x.label, x.target, x.metric, {_r('x.value', 5)} AS value FROM rows"""


ORACLES = {
    "compare_predictors": _compare_sql(),
    "spearman": f"WITH r AS (SELECT p_brand, {_rank('p_size', 'p_brand')} AS x, {_rank('p_retailprice', 'p_brand')} AS y FROM part) SELECT p_brand, count(*) AS n, {_r(_rho('x', 'y'), 6)} AS rho FROM r GROUP BY p_brand",
    "partial_spearman": f"""WITH p AS (SELECT p_brand, p_size AS x, p_retailprice AS y, p_partkey % 101 AS z FROM part), r AS (SELECT p_brand, {_rank('x', 'p_brand')} AS x, {_rank('y', 'p_brand')} AS y, {_rank('z', 'p_brand')} AS z FROM p),
c AS (SELECT p_brand, {_rho('x', 'y')} AS xy, {_rho('x', 'z')} AS xz, {_rho('y', 'z')} AS yz FROM r GROUP BY p_brand) SELECT p_brand, {_r('(xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz))', 6)} AS partial_rho FROM c""",
    "bootstrap_ci": f"""WITH p AS (SELECT p_brand, p_size::DOUBLE AS vx, p_retailprice AS vy, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS item, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
d AS (SELECT p_brand, rep, {stats.drawn_sql('n', 0, 'rep', 'item')} AS pick FROM p, range(0, {REPS}) g(rep)), v AS (SELECT d.p_brand, d.rep, p.vx, p.vy FROM d JOIN p ON p.p_brand = d.p_brand AND p.item = d.pick),
r AS (SELECT p_brand, rep, {_rank('vx', 'p_brand, rep')} AS x, {_rank('vy', 'p_brand, rep')} AS y FROM v), c AS (SELECT p_brand, rep, {_rho('x', 'y')} AS rho FROM r GROUP BY 1, 2)
SELECT p_brand, {_r('quantile_cont(rho, 0.025)', 6)} AS ci_low, {_r('quantile_cont(rho, 0.975)', 6)} AS ci_high, count(rho) AS n_reps FROM c GROUP BY 1""",
    "metric_matrix": f"""WITH w AS (SELECT l_orderkey, avg(l_quantity) AS mean_quantity, count(*)::DOUBLE AS n_lines, max(l_extendedprice) AS max_price, min(l_discount) AS min_discount FROM lineitem GROUP BY 1),
m AS (SELECT p.predictor, t.target, p.pred, t.truth FROM w, LATERAL (VALUES ('mean_quantity', mean_quantity), ('n_lines', n_lines)) p(predictor, pred), LATERAL (VALUES ('max_price', max_price), ('min_discount', min_discount)) t(target, truth)),
r AS (SELECT predictor, target, {_rank('pred', 'predictor, target')} AS x, {_rank('truth', 'predictor, target')} AS y FROM m) SELECT predictor, target, count(*) AS n, {_r(_rho('x', 'y'), 5)} AS rho FROM r GROUP BY 1, 2""",
    "mean_by_kind": f"SELECT l_orderkey, l_returnflag, {_r('avg(l_discount)', 6)} AS strength, {_r('avg(l_tax)', 6)} AS toughness FROM lineitem GROUP BY 1, 2",
    "align_sequences": "SELECT d.doc_id, n_chars, quality, toxic FROM documents d JOIN labels l USING (doc_id)",
    "holdout_split": "SELECT source, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'held' ELSE 'rest' END AS part, count(*) AS n FROM documents GROUP BY 1, 2",
    "mean_baseline_mae": f"WITH t AS (SELECT l_quantity AS pred, l_discount AS d, l_tax * 100 AS truth FROM lineitem), m AS (SELECT avg(truth) AS m FROM t WHERE d > 0.05::DOUBLE) SELECT count(*) AS n, {_r('avg(abs(pred - truth))', 4)} AS mae, {_r('avg(abs(m - truth))', 4)} AS mean_mae FROM t, m",
    "within_tolerance": f"SELECT l_returnflag, count(*) AS n, {_r('avg(((abs(l_discount - l_tax) + abs(l_quantity / 50 - l_discount)) / 2 <= 0.1::DOUBLE)::INT)', 5)} AS within_fraction FROM lineitem GROUP BY 1",
    "length_baseline": f"WITH d AS (SELECT source, length(text) AS len, quality FROM documents JOIN labels USING (doc_id)), r AS (SELECT source, {_rank('len', 'source')} AS x, {_rank('quality', 'source')} AS y FROM d) SELECT source, count(*) AS n, {_r(_rho('x', 'y'), 6)} AS rho FROM r GROUP BY 1",
}
QUERIES = [spearman, partial_spearman, bootstrap_ci, metric_matrix, mean_by_kind, align_sequences, holdout_split, mean_baseline_mae, within_tolerance, length_baseline, compare_predictors]
