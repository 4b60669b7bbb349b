"""Corpus pipeline: documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's documents. All but the last return the columns of documents.

1. toxicity: documents scored 0.5 or more go.
2. exact_dedup: of equal texts (white space normalised) the smallest doc_id stays.
3. near_dedup: of documents linked at a similarity of 0.8 on five-word shingles the smallest doc_id stays.
4. mixing: sources mixed by temperature to 0.92 of the greatest entropy, as many tokens as there are; a
   document appears as often as the mix takes it.
5. encoding: byte-level BPE ids of each text, with digests of the ids and of what they decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blockweave.llm import bpe, exact_dedup, minhash, mixing, toxicity
from blockweave.llm.common import new_path, table
from blockweave.session import ship


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return exact_dedup.drop_exact_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return minhash.drop_near_copies(docs, minhash.Banding(words=5, percent=80))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.take_mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe.digests(bpe.encode(docs.select("doc_id", "text"), *bpe.default_vocabulary(), decoded=True))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: The toxicity model is no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table documents; what each returns is written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
