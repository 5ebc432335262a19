"""The training-corpus pipeline: filter by language, deduplicate, decontaminate, tokenise.

``STAGES`` are applied in order to ``documents``; each stage's result is written to the shared folder and read again
before the next one. All stages but the last return the columns of documents; the last adds the number of tokens and
digests of the ids and of the decoded bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm import byte_bpe, decontaminate, exact_dedup, language_id, near_dedup
from lumenframe.llm.common import bounded_batches, stored


def keep_recognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language; those rejected (no letters, or no language likelier than not) go."""
    bounded_batches(spark)
    return language_id.recognised(docs, language_id.train(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the smallest id."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component (five words, similarity 0.8), the one with the smallest id."""
    bounded_batches(spark)
    return near_dedup.near_dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    bounded_batches(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with n_tokens, ids_sha256 and decoded_sha256."""
    import public_tokenizers

    bounded_batches(spark)
    return byte_bpe.round_trip(docs, byte_bpe.Ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


STAGES = [
    ("language_id", keep_recognised),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte_bpe", tokenise),
]

#: The language model and the tokenizer can't be said in SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
