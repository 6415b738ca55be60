"""From raw documents to token files: five stages, each over all that the one before kept.

1. quality         importance resampling drops what it rejects
2. deduplication   one document of each near-duplicate group stays
3. decontamination documents that hold a benchmark passage go
4. mixing          documents are repeated or left out until sources have their shares
5. tokens          shard files of token ids; a row per document read back from them

The oracle is None: neither sampling by a trained model nor a tokenizer is SQL.
tests/llm/test_pipeline.py holds each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakewarden.llm.common import read_table, written
from lakewarden.llm.decontamination import drop_contaminated
from lakewarden.llm.jaccard_join import drop_near_duplicates
from lakewarden.llm.mixing import mixed_documents
from lakewarden.llm.quality import keep_sampled
from lakewarden.llm.wavelet import tokenize_to_shards

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_sampled(docs, read_table(spark, sf_dir, "labels"))


def deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenize_to_shards(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2).drop("path")


STAGES = [("quality", quality), ("deduplication", deduplication), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
