"""Training-data pipeline: each stage works on what the one before kept, written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamhis.llm import bpe, decontamination, language_id, near_dedup, quality_rules
from tamhis.llm.common import stored
from tamhis.llm.queries import RANKS


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known language; rank-order profiles are learned from the documents themselves."""
    return language_id.keep_identified(docs)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the text rules and are not depleted without their host's frequent lines."""
    return quality_rules.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the least id."""
    return near_dedup.keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, number and digest of the token ids, and digest of the bytes decoded from them."""
    # Stored, so that a task holds the tables of the encoder or of the decoder, not two Python workers with both.
    encoded = stored(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), "token-ids")
    decoded = bpe.decode(encoded, RANKS, ["doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256")])
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", identify_language),
    ("quality rules", apply_quality_rules),
    ("near-dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("BPE", encode),
]
#: SQL has neither rank-order profiles, nor order MinHash, nor BPE; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
