"""A corpus from raw documents to packed sequences: quality, near duplicates, benchmark, secrets, packing.

Each stage is a function of (spark, docs, sf_dir) that works on all its predecessor kept; ``run`` writes every
stage's result to the shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inboxlake.llm import common, decontaminate, packing, quality, secrets, simhash

#: SQL has neither the fingerprints, the forest nor the tokenizer: tests/llm holds the stages against brute force.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on them and the labels, doesn't reject."""
    _, model = quality.classify(docs, common.table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def keep_firsts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near duplicates."""
    return simhash.keep_firsts(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced."""
    return secrets.redact(docs, secrets.scan(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences."""
    import public_tokenizers
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", keep_good), ("near_dedup", keep_firsts), ("decontaminate", drop_contaminated),
          ("secrets", redact_secrets), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents."""
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.stored(docs, name)
    return docs
