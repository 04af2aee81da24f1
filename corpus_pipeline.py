"""Corpus pipeline: documents to token shards in five stages.

A null text is an empty one in every stage, texts are read whole, repeated rows
are copies of one document (one stays), and an empty table passes through to an
empty result; rows without an id pass the filters by their text alone. Columns
beside those of documents stay in the first four stages, whatever their names.
Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns
is written as Parquet and read again as the next stage's documents. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from habitrace.llm import decontaminate, mixing, quality_rules, queries, simhash, tokenbin
from habitrace.llm.store import table, written

#: The learnt rules and the raking have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go."""
    model = quality_rules.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_rules.score_documents(docs, model).filter("predicted = 1").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays."""
    return simhash.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn with the raked probabilities."""
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards, read back: (doc_id, start, n_tokens, ids_crc32)."""
    path = tokenbin.write_shards(docs.select("doc_id", "text"), queries.word_encoder, queries.END_ID, 2)
    return tokenbin.read_shards(spark, path, digest=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing to target weights", mix),
    ("token-ID output", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", F.col("n_chars"))
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
