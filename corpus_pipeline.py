"""A corpus from raw documents: quality rules, exact dedup, near dedup, mixing, and sampled segmentations.

Each stage works on all rows that its predecessor kept. The first four return documents with the columns they
came with (after mixing, a document has a row for each of its copies); the last returns the sampled segmentations of each row:
(doc_id, sample, n_pieces, log_prob, log_inclusion, ids). Nulls, empty texts, repeated rows and empty tables are treated
as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.llm import exact_dedup, mixing, piece_sampling, quality, simhash
from setweave.llm.common import save


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def piece_samples(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return piece_sampling.segmentations(docs, model).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("source_mix", source_mix),
    ("piece_samples", piece_samples),
]

#: Neither the hashes that rank and sample nor the near-copy links can be had in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir).select(F.col("doc_id"), "sample", "n_pieces", "log_prob", "log_inclusion", "ids")
