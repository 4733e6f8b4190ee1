"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from farelane.llm import decontam, licenses, maxent, mixing, near_dedup, oracles, pjpeg, quality, secrets, sharding, sstable


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items found in all documents, with alignment scores."""
    return decontam.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents over 2-word shingles at similarity 0.8."""
    return near_dedup.cluster(documents(spark, sf_dir), k=2, percent=80)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: named patterns and windows of high entropy."""
    return secrets.scan(documents(spark, sf_dir))


def op4_diagonal_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and passages in all documents."""
    return licenses.scan(documents(spark, sf_dir))


def op5_sstable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as sorted-string-table shards and read back from them."""
    return sstable.encode_documents(documents(spark, sf_dir), tokenizer_path())


def op6_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by the compression classifier, learnt from the labels table."""
    docs = documents(spark, sf_dir)
    return quality.scores(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op7_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihood of all documents under the maximum-entropy model learnt from nine tenths of them."""
    return maxent.score_documents(documents(spark, sf_dir))


def op8_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as progressive JPEG images and read back."""
    return pjpeg.store_texts(documents(spark, sf_dir))


def op9_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document in a mix with target words for each source."""
    return mixing.taken(documents(spark, sf_dir))


def op10_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document in a weighted hash tree of 24 shards, and its shard with one more."""
    return sharding.assign(documents(spark, sf_dir), 24)


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_minhash_near_dedup, op3_entropy_secrets, op4_diagonal_licenses, op5_sstable_tokens, op6_compression_quality, op7_maxent_lm, op8_progressive_jpeg, op9_pivotal_mixing, op10_hash_tree_sharding)}

ORACLES = {"op2_minhash_near_dedup": oracles.NEAR_DEDUP, "op4_diagonal_licenses": oracles.LICENSES}
