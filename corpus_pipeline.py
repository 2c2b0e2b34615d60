"""The corpus pipeline: quality, exact duplicates, near duplicates, packing.

``run`` writes what each stage returns as Parquet in the shared folder and reads it again as
the next one's documents. Once a result is written, the tables that led to it are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from causeway.llm import exact_dedup, packing, quality, resemblance
from causeway.llm.token_ids import public_tokenizer
from causeway.session import let_go, materialize, tables_written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each text."""
    return exact_dedup.drop_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of texts linked by a five-word similarity of 0.8 or more."""
    return resemblance.drop_near_duplicates(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces of sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", exact_duplicates),
    ("simhash near-dedup", near_duplicates),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with tables_written() as tables:
        for _, stage in STAGES:
            docs = materialize(stage(spark, docs, sf_dir))
            let_go(spark, tables[:-1])  # all but the stage's result
            del tables[:-1]
    return docs
