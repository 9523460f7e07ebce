"""A corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is
written as Parquet in the shared folder and read again as the next stage's
docs.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laconic.llm.common import materialise, remainder, table
from laconic.llm.decontaminate import decontaminate
from laconic.llm.jaccard import keep_one
from laconic.llm.mixing import mixed
from laconic.llm.sharding import sharded
from laconic.llm.toxicity import fit, toxicity


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled part of these documents, doesn't predict as toxic."""
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_text"))
    return toxicity(rows, fit(docs, labels), text="_text").where("predicted = 0").select("_row.*")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8 or more): the one with the smallest id."""
    return keep_one(docs, n=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as the mix takes them, repeated and in the order of training."""
    return mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with their shard and slot, in eight shards of equal counts."""
    return sharded(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The classifier's floating-point scores and the similarity groups have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
