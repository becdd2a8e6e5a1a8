"""The corpus pipeline: toxic texts go, one text of each near-duplicate group stays, personal data is masked, sources are
mixed to equal shares, and what is left is packed into sequences.

Near-duplicates are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Multi-index hashing of their fingerprints gives the
first candidates; what it can't find shares a shingle of the sets' prefixes, as all such pairs do. Each candidate is compared exactly. Of texts of more than a few shingles those are spared the exact look whose fingerprints differ in over
96 of 256 bits: a bit of such a pair differs with probability 3/16 at most, so 96 lie 7.7 standard deviations above the mean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomtrace.llm import mixing, packing, pii, simhash, toxicity
from loomtrace.llm.common import let_go, stored

SIMILARITY, SHINGLE, WORDS = 0.8, 5, 4
LIMIT = 96


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score under a half; the model is learned from labelled rows of this input."""
    model = toxicity.fitted(spark, docs, sf_dir)
    return toxicity.score_texts(docs, model, docs.columns, out="__toxicity").where("__toxicity < 0.5").drop("__toxicity")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of least doc_id of each group."""
    return simhash.keep_one(docs, shingle=SHINGLE, limit=LIMIT, words=WORDS, repeats=False, least=SIMILARITY)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies, dealt and sorted by the shuffle key; every source gets the same expected share."""
    return mixing.mix(docs).drop("copy", "shuffle_key")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a text: its place in its sequence, and its characters."""
    return packing.best_fit(docs, with_text=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        if before:
            let_go(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
