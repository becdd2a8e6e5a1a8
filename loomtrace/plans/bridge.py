"""Views that let the operators run over the shared tables; every view has the same meaning in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKS = ["AAAAAAAAGA", "GGAGGYGGQGGL", "GPGQQGPGGYGPGXX", "PAPAPAPPAP", ""]
EDGES = ["", "A", "ACD", "GGXA", "AAAAA", "KRDEKR", "ggaggy", "A1C-D.E", "XBZXBZXB", "AAAAAAAAA", "VVVVVVIIIIII", "GPGGPGGPG", "ACACACACAC", "RRRRDDDD"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt out anew where a small input has fewer splits than there are cores; large inputs stay as they are."""
    spark = df.sparkSession
    cores = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(cores, key) if len(df.inputFiles()) < cores else df


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source, seq: the letters A to Z of every document and benchmark text, in upper case."""
    seq = F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("seq")
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id").select(F.col("doc_id").alias("id"), "source", seq)
    return docs.unionByName(table(spark, sf_dir, "benchmark").select((F.col("item_id") + 100000000).alias("id"), F.lit("benchmark").alias("source"), seq))


SEQUENCES = """
sequences AS (SELECT doc_id AS id, source, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq FROM documents
  UNION ALL SELECT item_id + 100000000, 'benchmark', upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) FROM benchmark)"""


def silk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, seq: sequences with a block of motifs at both ends, chosen by id; and edge cases."""
    block = F.element_at(F.array(*[F.lit(b) for b in BLOCKS]), (F.col("id") % 5 + 1).cast("int"))
    rows = sequences(spark, sf_dir).select("id", F.concat(block, "seq", block).alias("seq"))
    edges = spark.createDataFrame([(-i - 1, e) for i, e in enumerate(EDGES)], "id long, seq string")
    cleaned = F.regexp_replace(F.upper("seq"), r"[^\p{L}]", "")
    return rows.unionByName(edges.select("id", cleaned.alias("seq")))


_EDGES = ", ".join(f"({-i - 1}, '{e}')" for i, e in enumerate(EDGES))
_BLOCKS = "[" + ", ".join(f"'{b}'" for b in BLOCKS) + "]"
SILK = f"""{SEQUENCES},
silk AS (SELECT id, {_BLOCKS}[(id % 5 + 1)::INT] || seq || {_BLOCKS}[(id % 5 + 1)::INT] AS seq FROM sequences
  UNION ALL SELECT id, regexp_replace(upper(seq), '[^A-Z]', '', 'g') FROM (VALUES {_EDGES}) e(id, seq))"""


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored traces from order lines: prompt, unique key, bucket's inputs and the answer."""
    key = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("prompt_id"), key.alias("trace_key"), F.concat(F.lit("trace "), key).alias("trace_text"), (F.col("l_quantity") / 50).alias("grounding_score"),
        (F.col("l_discount") <= 0.05).alias("is_correct"), F.create_map(F.lit("strength"), "l_discount", F.lit("toughness"), "l_tax").alias("final_answer"),
    )


TRACES = """
traces AS (SELECT l_orderkey AS prompt_id, concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d')) AS trace_key,
  l_quantity / 50 AS grounding_score, l_discount <= 0.05::DOUBLE AS is_correct, l_discount AS strength, l_tax AS toughness FROM lineitem),
bucketed AS (SELECT *, CASE WHEN is_correct AND grounding_score >= 0.7::DOUBLE THEN 'grounded_correct' WHEN is_correct THEN 'shortcut_correct'
  WHEN grounding_score >= 0.7::DOUBLE THEN 'grounded_incorrect' ELSE 'shortcut_incorrect' END AS bucket FROM traces)"""

#: Completions are put together from parts, so the claims in them are known without reading them. a, b, c: numbers by id.
BODY = """CASE t WHEN 0 THEN concat('The mean value is 0.', a + 100, ' overall. Because of that, residues ', a, '-', a + b + 1, ' fold into a beta-sheet.')
    WHEN 1 THEN concat('1. A poly-alanine run spans positions ', a, ' to ', a + b, '.', nl, nl, '12. Therefore the share is ', c, '% of it.')
    WHEN 2 THEN concat('The chain lacks an alpha-helix here and shows nothing else that one could name at all in the whole of this rather long sentence. Charge is -', b + 100, ' in total.')
    WHEN 3 THEN concat('Only one step with energy ', a, '.5 kcal/mol at residue ', c)
    WHEN 4 THEN concat('The text has no tags but an amorphous region at ', a, '-', a + 3, ', and a random coil.')
    WHEN 5 THEN concat('Nothing follows. Zebra quartz. Jumping vixens. residue 0.', b + 1000)
    WHEN 6 THEN concat('The spacer is glycine rich. The spacer is proline-rich turn like, since ', c + 1000, ' of them show.')
    ELSE '' END"""
ANSWER = """CASE c % 6 WHEN 0 THEN concat('<answer>{"strength": 0.', a + 10, ', "toughness": 0.', b + 10, '}</answer>')
    WHEN 1 THEN concat('<answer>{"strength": "0.', a + 10, '", "toughness": true, "note": null}</answer>')
    WHEN 2 THEN '<answer>{"strength": "strong", "toughness": 0.5}</answer>'
    WHEN 3 THEN '<answer>[0.1, 0.2]</answer>'
    WHEN 4 THEN concat('<answer>{"toughness": 0.', b + 10, '}</answer>')
    ELSE '<answer>{"strength": 0.5, </answer>' END"""
CONFIDENCE = """CASE c % 5 WHEN 0 THEN concat(' Confidence: ', c, '%') WHEN 1 THEN ' with very high confidence' WHEN 2 THEN ' at low confidence' WHEN 3 THEN ' I am confident of 250 %' ELSE '' END"""
COMPLETIONS = f"""SELECT id, t, a, b, c, {BODY} AS body,
  concat(CASE WHEN t IN (4, 7) THEN '' ELSE '<reasoning>' END, {BODY}, CASE WHEN t IN (4, 7) THEN '' ELSE '</reasoning>' END, {ANSWER}, {CONFIDENCE}) AS completion,
  round(a / 37, 2) AS truth_strength, round(b / 53, 2) AS truth_toughness FROM parts"""


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, the numbers, body, completion and truth."""
    parts = spread(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").selectExpr("doc_id AS id", "doc_id % 8 AS t", "doc_id % 37 AS a", "doc_id % 53 AS b", "doc_id % 97 AS c", "char(10) AS nl")
    found = parts.selectExpr("id", "t", "a", "b", "c", f"{BODY} AS body", f"concat(IF(t IN (4, 7), '', '<reasoning>'), {BODY}, IF(t IN (4, 7), '', '</reasoning>'), {ANSWER}, {CONFIDENCE}) AS completion", "round(a / 37, 2) AS truth_strength", "round(b / 53, 2) AS truth_toughness")
    return found.withColumn("truth", F.create_map(F.lit("strength"), "truth_strength", F.lit("toughness"), "truth_toughness"))


COMPLETIONS_SQL = f"""
parts AS (SELECT doc_id AS id, doc_id % 8 AS t, (doc_id % 37)::INT AS a, (doc_id % 53)::INT AS b, (doc_id % 97)::INT AS c, chr(10) AS nl FROM documents),
completions AS ({COMPLETIONS})"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions with two small tool outputs each, so that every kind of claim is sometimes borne out."""
    tools = """array(
      named_struct('name', 'first', 'numbers', array(cast(c AS double), 0.1D + a / 1000.0D, cast(a + 0.5D AS double)), 'ranges', array(named_struct('lo', cast(0 AS int), 'hi', cast(50 AS int))), 'text', IF(b % 2 = 0, 'polyalanineglycinerich', 'none'), 'keys', array('turn')),
      named_struct('name', 'second', 'numbers', array(cast(-b - 101 AS double), cast(c + 1020 AS double)), 'ranges', array(named_struct('lo', cast(a AS int), 'hi', cast(a + 20 AS int))), 'text', 'randomcoil', 'keys', IF(b % 3 = 0, array('meanbetapropensity', 'meanalphapropensity'), array('other'))))"""
    return completions(spark, sf_dir).withColumn("tools", F.expr(tools))
