"""The corpus pipeline: five stages over whole documents, each written and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siftwork.llm import common, neardup, packing, pii, quality, toxicity


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose perplexity under the model of trusted text is within their language's threshold."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model, trained on the labelled rows that are left, does not flag."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five-word shingles, similarity of 0.8 or more)."""
    return neardup.keep_one(docs, words=5, percent=80)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same rows with personal data masked."""
    return pii.masked(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("near-duplicates", dedup_stage),
    ("personal data", pii_stage),
    ("packing", packing_stage),
]

#: No SQL can say the models of the first two stages; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written to the shared folder and read by the next."""
    scratch = common.Scratch(spark)
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        out = stage(spark, docs, sf_dir)
        kept = scratch.keep(out)
        common.release(out)  # what the stage itself wrote
        if k:
            scratch.free(docs)
        docs = kept
    return scratch.tie(STAGES[-1][1](spark, docs, sf_dir))
