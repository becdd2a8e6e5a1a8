"""Datasets written from the shared tables as CSV, JSON and JSON lines, and loaded again; pools and pilots over them. With SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.compat import py_round
from ..functions.text import MOTIF_TERMS
from ..operators import drivers, grounding, traces
from ..sources import datasets, parts, sinks
from ..sources.scratch import scratch, written
from . import bridge, sequence_queries, trace_queries

#: Fields of a raw record by document; the SQL below has the same. Every tenth record has no sequence.
FIELDS = [
    "doc_id AS id", "IF(doc_id % 10 = 0, '', upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', ''))) AS s", "concat('family', char(10), doc_id % 4) AS family",
    "CASE doc_id % 5 WHEN 0 THEN '0.5' WHEN 1 THEN 'abc' WHEN 2 THEN '' WHEN 3 THEN '1e-1' ELSE '0.25' END AS strength", "IF(doc_id % 3 = 0, '', '0.75') AS strength_norm", "CAST(doc_id % 8 / 8.0D AS STRING) AS toughness",
]


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.spread(bridge.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").selectExpr(*FIELDS)


def _loaded(samples: DataFrame) -> DataFrame:
    truth = lambda k: F.try_element_at("ground_truth", F.lit(k)).alias(k)
    return samples.select("sequence", "family", "genus", "protein_category", truth("strength"), truth("toughness"))


def _csv(spark: SparkSession, sf_dir: str) -> str:
    """Two label columns: the normalised one counts even where it is empty. No genus; a name in upper case."""
    path = f"{scratch(spark)}.csv"
    raw = _raw(spark, sf_dir).select(F.col("strength").alias("Strength"), F.col("s").alias("FASTA"), "family", F.col("strength_norm").alias("STRENGTH_NORM"), "toughness", F.concat(F.lit("cat"), F.col("id") % 3).alias("category"))
    raw.write.option("header", True).csv(path)
    return path


def load_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(datasets.load_dataset(spark, _csv(spark, sf_dir))[0])


def load_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows kept, rows skipped, and rows with a truth."""
    samples, skipped = datasets.load_dataset(spark, _csv(spark, sf_dir))
    kept = samples.agg(F.count("*").alias("n_samples"), F.count_if(F.size("ground_truth") > 0).alias("n_with_truth"))
    return kept.withColumn("n_skipped", F.lit(skipped).cast("long"))


def _record() -> Column:
    """Ragged: the sequence's name depends on the record, the category is null in some, and others lack it."""
    one = F.to_json(F.struct(F.col("s").alias("seq"), "family", "strength", F.col("toughness").cast("double").alias("toughness")))
    two = F.to_json(F.struct(F.col("s").alias("Sequence"), F.lit("none").alias("seq"), F.lit(None).cast("string").alias("category"), F.col("strength_norm").alias("strength_norm"), "toughness"), {"ignoreNullFields": "false"})
    return F.when(F.col("id") % 2 == 0, one).otherwise(two)


def load_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}.jsonl"
    _raw(spark, sf_dir).select(_record().alias("value")).write.text(path)
    return _loaded(datasets.load_dataset(spark, path)[0])


def load_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of an object each, whose ``data`` lists records: those of up to 256 ids."""
    path = f"{scratch(spark)}.json"
    lists = _raw(spark, sf_dir).groupBy(F.expr("id div 256").alias("file")).agg(F.array_join(F.collect_list(_record()), ",").alias("r"))
    lists.select(F.concat(F.lit('{"data":['), "r", F.lit("]}")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return _loaded(datasets.load_dataset(spark, path)[0])


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridge sequences as prompts, as a table; two of three have a truth."""
    truth = F.when(F.col("id") % 3 != 0, F.create_map(F.lit("strength"), F.pmod("id", F.lit(7)) / 10.0, F.lit("toughness"), F.pmod("id", F.lit(5)) / 10.0))
    rows = bridge.silk(spark, sf_dir).withColumn("ground_truth", truth)
    return written(rows.select(F.col("id").cast("string").alias("prompt_id"), F.col("seq").alias("sequence"), *[F.lit("").alias(c) for c in ("family", "genus", "species", "protein_category")], "ground_truth"))


def scored_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two grounded and one shortcut completion for each prompt with a truth, scored; written and read again."""
    path = scratch(spark)
    pool = traces.scored_pool(_samples(spark, sf_dir), 2, 1)
    sinks.write_pool(path, {"k_samples": 2}, {"pool": pool})
    pool = sinks.read_pool(spark, path, "pool")[0]
    return pool.select("prompt_id", "trace_kind", F.col("k").cast("int").alias("k"), py_round(F.col("mae"), 4).alias("mae"), "is_correct", py_round(F.col("grounding_score"), 4).alias("grounding_score"))


def _spacer(prompt: str) -> str:
    """With the tools' outputs a claim that they may bear out, without them one that they can't."""
    claim = "glycine-rich spacer" if "Tool outputs" in prompt else "random coil"
    return f'<reasoning>It has a {claim}.</reasoning><answer>{{"strength": 0.5, "toughness": 0.5}}</answer>'


def _spacer_at_times(prompt: str) -> str:
    if prompt.partition("Sequence: ")[2][:1] in ("A", "P"):
        raise ConnectionError("no answer")
    return _spacer(prompt)


def backfilled_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool whose connector fails for some sequences, completed in place: counts from all of its tables, as read back, and of parts that keep their files."""
    path = scratch(spark)
    slots = traces.slots(_samples(spark, sf_dir), 2, 1)
    drivers.start_pool(spark, path, slots, _spacer_at_times, {"k_samples": 2})
    first = parts.manifest(spark, path)["tables"]["pool"]["files"]
    n_failed = drivers.backfill(spark, path, slots, _spacer, {"k_samples": 2})
    last = parts.manifest(spark, path)["tables"]["pool"]["files"]
    counts = spark.createDataFrame([("failed at first", n_failed), ("parts that stay", sum(last.get(p) == v for p, v in first.items()))], "name string, n long")
    read = lambda name: parts.read(spark, path, name)
    n = F.count("*").alias("n")
    more = [
        read("pool").groupBy(F.concat_ws(" ", F.lit("pool"), "trace_kind", "is_correct", F.col("grounding_score").cast("int")).alias("name")).agg(n),
        read("errors").groupBy(F.lit("errors").alias("name")).agg(n),
        read("pairs").groupBy(F.concat(F.lit("pairs "), "pair_type").alias("name")).agg(n),
        read("pairs_by_type").select(F.concat(F.lit("by type "), "pair_type").alias("name"), F.col("n_pairs").alias("n")),
        read("pairs_total").select(F.lit("total").alias("name"), F.col("n_pairs").alias("n")),
        read("diversity").select(F.lit("diverse").alias("name"), F.col("n_diverse").alias("n")),
    ]
    return reduce(DataFrame.unionByName, more, counts)


def pilot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pilot's JSON: claims and grounded claims by kind, as read from its traces."""
    path = scratch(spark)
    rows = bridge.facts(spark, sf_dir).select(F.col("id").alias("trace_id"), "body", "tools")
    claims = grounding.ground(grounding.explode_claims(rows, "body")).drop("tools", "body")
    reports = grounding.report(claims, "trace_id")
    sinks.write_pilot(path, reports, claims, spark.createDataFrame([], "trace_id string, error string"), grounding.audit(reports))
    saved = spark.read.json(f"{path}/traces").select(F.explode("claims").alias("c"))
    return saved.groupBy(F.col("c.kind").alias("kind"), F.col("c.role").alias("role")).agg(F.count("*").alias("n"), F.count_if("c.grounded").alias("n_grounded"))


def claims_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motif terms in the whole texts of documents and conversations, counted by source."""
    docs = bridge.spread(bridge.table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id").select("text", "source")
    turns = bridge.table(spark, sf_dir, "conversations").select("text", F.col("role").alias("source"))
    rows = grounding.explode_claims(docs.unionByName(turns), "text")
    return rows.groupBy("source").agg(F.count_if(F.col("kind") == "motif").alias("n_motif"), F.count_if((F.col("kind") == "numeric") & F.col("raw").contains("%")).alias("n_percent"))


_FIELDS = """raw AS (SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN '' ELSE upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) END AS s, concat('family', chr(10), doc_id % 4) AS family,
CASE doc_id % 5 WHEN 0 THEN 0.5::DOUBLE WHEN 3 THEN 0.1::DOUBLE WHEN 4 THEN 0.25::DOUBLE END AS strength, CASE WHEN doc_id % 3 <> 0 THEN 0.75::DOUBLE END AS strength_norm, doc_id % 8 / 8.0::DOUBLE AS toughness FROM documents)"""
_CSV = f"""WITH {_FIELDS}, csv AS (SELECT s AS sequence, family, '' AS genus, concat('cat', id % 3) AS protein_category, strength_norm AS strength, CASE WHEN strength_norm IS NOT NULL THEN toughness END AS toughness FROM raw WHERE s <> '')"""
_RECORDS = f"""WITH {_FIELDS} SELECT s AS sequence, CASE WHEN id % 2 = 0 THEN family ELSE '' END AS family, '' AS genus, CASE WHEN id % 2 = 0 THEN '' ELSE 'None' END AS protein_category,
CASE WHEN id % 2 = 0 THEN strength ELSE strength_norm END AS strength, CASE WHEN (CASE WHEN id % 2 = 0 THEN strength ELSE strength_norm END) IS NOT NULL THEN toughness END AS toughness FROM raw WHERE s <> ''"""
_cte = lambda sql: sql.removeprefix(f"WITH {bridge.SILK}, ")
#: What the fixed completion of the injected model says: a motif, two numbers (one of them the position's) and a position, held against all that the tools give.
_MOCK = f"""WITH {bridge.SILK}, {_cte(sequence_queries._SPANS)}, {_cte(sequence_queries._HYD)}, {sequence_queries._values("b", sequence_queries._PARTS[1], 1.0)}, {sequence_queries._slide("b", 6)},
hot AS (SELECT id, pos - 1 AS i, pos - row_number() OVER (PARTITION BY id ORDER BY pos) AS island FROM b_w WHERE s >= 630 AND n >= 6), rr AS (SELECT id, min(i)::INT AS lo, (max(i) + 5)::INT AS hi FROM hot GROUP BY id, island),
ranges AS (SELECT id, lo, lo + n - 1 AS hi FROM spans UNION ALL SELECT id, lo, hi FROM rr UNION ALL SELECT id, i, i + w - 1 FROM y UNION ALL SELECT id, j, j + w - 1 FROM y),
numbers AS (SELECT id, length(seq) AS v FROM silk UNION ALL SELECT id, lo FROM ranges UNION ALL SELECT id, hi FROM ranges
  UNION ALL SELECT id, plus FROM (SELECT id, {sequence_queries._CHARGE} FROM silk) UNION ALL SELECT id, minus FROM (SELECT id, {sequence_queries._CHARGE} FROM silk) UNION ALL SELECT id, plus - minus FROM (SELECT id, {sequence_queries._CHARGE} FROM silk)),
hits AS (SELECT id, 1 AS hit FROM numbers WHERE abs(v - 98765.4::DOUBLE) <= greatest(0.02::DOUBLE, abs(v) * 0.03::DOUBLE) UNION SELECT id, 4 FROM numbers WHERE abs(v - 9876.0::DOUBLE) <= greatest(0.02::DOUBLE, abs(v) * 0.03::DOUBLE) UNION SELECT id, 2 FROM ranges WHERE lo <= 9876 AND hi >= 9876 UNION SELECT id, 3 FROM spans WHERE motif = 'glycine_rich_spacer'),
mock AS (SELECT silk.id, count(hit) AS n FROM silk LEFT JOIN hits USING (id) GROUP BY silk.id)"""


def _texts_sql() -> str:
    """Motif terms and percentages of whole texts, without looking behind: chr(2) closes each sign that a number may follow, chr(1) opens the place after it."""
    blank, digit, a, b = r"[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]", r"\p{Nd}", r"\x01", r"\x02"
    marker = lambda text, n: f"regexp_replace({text}, '(?m)^({blank}*){digit}{{{n}}}\\.({blank})', '\\1' || repeat(chr(2), {n + 1}) || '\\2', 'g')"
    number = f"{a}-?{digit}+(?:\\.{b})?(?:{a}?{digit}+)?(?:{a}?{blank}{b})*(?:{a}?%)?"
    terms = "|".join(t.replace("-", "\\-") for t in MOTIF_TERMS)
    return f"""WITH t AS (SELECT source, text FROM documents UNION ALL SELECT role, text FROM conversations), plain AS (SELECT source, translate(text, chr(1) || chr(2), '') AS text FROM t),
masked AS (SELECT source, translate({marker(marker("text", 2), 1)}, chr(2), ' ') AS text FROM plain),
c AS (SELECT source, len(regexp_extract_all(text, '(?i){terms}')) AS motifs, len(list_filter(regexp_extract_all(chr(1) || regexp_replace(text, '([^{digit}-])', '\\1' || chr(2) || chr(1), 'g'), '{number}'), lambda x: contains(x, '%'))) AS percents FROM masked)
SELECT source, coalesce(sum(motifs), 0)::BIGINT AS n_motif, coalesce(sum(percents), 0)::BIGINT AS n_percent FROM c GROUP BY source"""


_r = trace_queries._r
ORACLES = {
    "claims_in_texts": _texts_sql(),
    "load_csv": f"{_CSV} SELECT * FROM csv",
    "load_counts": f"{_CSV} SELECT count(*) AS n_samples, count(*) FILTER (strength IS NOT NULL) AS n_with_truth, (SELECT count(*) FROM raw) - count(*) AS n_skipped FROM csv",
    "load_jsonl": _RECORDS,
    "load_json": _RECORDS,
    "mock_pilot": f"{_MOCK} SELECT id, 4::BIGINT AS n_direct, n AS n_direct_grounded, 0::BIGINT AS n_contrastive, 0::BIGINT AS n_contrastive_grounded, n / 4 AS grounding_score, NULL::DOUBLE AS contrastive_score FROM mock",
    "scored_pool": f"""{_MOCK} SELECT id::VARCHAR AS prompt_id, s.trace_kind, s.k::INT AS k, {_r("mae")} AS mae, mae <= 0.1::DOUBLE AS is_correct, {_r("n / 4")} AS grounding_score
FROM (SELECT *, (abs(0.5::DOUBLE - ((id % 7) + 7) % 7 / 10.0::DOUBLE) + abs(0.5::DOUBLE - ((id % 5) + 5) % 5 / 10.0::DOUBLE)) / 2 AS mae FROM mock WHERE id % 3 <> 0), (VALUES ('grounded', 0), ('grounded', 1), ('shortcut', 0)) s(trace_kind, k)""",
    "backfilled_pool": f"""WITH {bridge.SILK}, {_cte(sequence_queries._SPANS)}, has AS (SELECT DISTINCT id FROM spans WHERE motif = 'glycine_rich_spacer'),
p AS (SELECT id::VARCHAR AS prompt_id, substr(seq, 1, 1) IN ('A', 'P') AS fails, id IN (SELECT id FROM has) AS hit, (abs(0.5::DOUBLE - ((id % 7) + 7) % 7 / 10.0::DOUBLE) + abs(0.5::DOUBLE - ((id % 5) + 5) % 5 / 10.0::DOUBLE)) / 2 <= 0.1::DOUBLE AS ok,
  ('0x' || substr(md5(id::VARCHAR), 1, 4))::INT % {parts.PARTS} AS part FROM silk WHERE id % 3 <> 0),
pool AS (SELECT p.*, kind, CASE WHEN kind = 'grounded' AND hit THEN 1 ELSE 0 END AS score FROM p, (VALUES ('grounded'), ('grounded'), ('shortcut')) v(kind)),
pair AS (SELECT 'same_answer' AS pair_type, 2 * count(*) AS n FROM p WHERE ok AND hit UNION ALL SELECT 'anti_shortcut', count(*) FROM p WHERE NOT ok AND hit),
t AS (SELECT 'failed at first' AS name, 3 * count(*) AS n FROM p WHERE fails UNION ALL SELECT 'parts that stay', count(*) FROM (SELECT part FROM p GROUP BY part HAVING NOT bool_or(fails))
UNION ALL SELECT concat_ws(' ', 'pool', kind, ok, score), count(*) FROM pool GROUP BY ALL UNION ALL SELECT 'pairs ' || pair_type, n FROM pair WHERE n > 0 UNION ALL SELECT 'by type ' || pair_type, n FROM pair WHERE n > 0
UNION ALL SELECT 'total', sum(n) FROM pair UNION ALL SELECT 'diverse', count(*) FROM p WHERE hit) SELECT name, n::BIGINT AS n FROM t""",
    "pilot_files": f"{trace_queries._ALL} SELECT kind, role, count(*) AS n, count(*) FILTER (grounded) AS n_grounded FROM every GROUP BY kind, role",
}
QUERIES = [load_csv, load_counts, load_jsonl, load_json, scored_pool, backfilled_pool, pilot_files, claims_in_texts]
