"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again for the next.

A stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns they came with;
the last returns the encoded corpus.

Edge cases: null, empty and short texts fail the quality rules, so later stages see texts of fifty words and more from there on; each stage takes
them all the same. Rows without an id or of one id are told apart by their text; of equal rows one stays. Extra columns come through all
stages but the last. An empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import alike, decontam, linededup, quality, sampling
from marginalia.llm.common import passing, work_path
from marginalia.sources.shipping import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return alike.keep_one(docs, shingle=5, least=0.8, radius=4)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    encoded = sampling.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.drop("text", "ids_crc32")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("encode_pieces", encode_pieces),
]

#: Fingerprints, windows and sampled pieces are beyond SQL; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents below `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = work_path(spark, f"pipeline-{name}")
        with passing(spark):  # what a stage's operators wrote goes when the stage is written
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
