"""A corpus pipeline over documents in stages; each stage's rows are written and reread as the next one's.

All stages but the last return the columns of documents and keep or drop whole rows; mixing repeats rows. Null texts and ids, empty
tables, repeated rows and extra columns are treated as each stage's operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from farelane.llm import decontam, mixing, near_dedup, quality, sstable
from farelane.llm.common import materialize
from farelane.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the compression classifier rejects."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group (5-word shingles, similarity 0.8)."""
    return near_dedup.representatives(docs, k=5, percent=80)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark."""
    return decontam.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and drop documents so that sources come near their target weights."""
    return mixing.mixed(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token ids as sorted-string-table shards and list what they hold."""
    return sstable.encode_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", keep_one_of_each),
    ("benchmark decontamination", keep_uncontaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", token_shards),
]

#: The stages classify, cluster, align, round and tokenise: SQL can't express them. Tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
