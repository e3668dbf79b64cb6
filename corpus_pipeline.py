"""Corpus preparation: quality rules, near-duplicate removal, secret redaction, mixing, token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from palisade.llm import byte_bpe, jaccard_join, mixing, quality, secrets_ledger
from palisade.llm.common import made, remove, written
from palisade.llm.queries import ledger


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near copies: 0.8 of five-word shingles in common."""
    return jaccard_join.one_of_each(docs, num=4, den=5, size=5)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with [kind] in place of each secret, and n_chars counted anew for those."""
    return secrets_ledger.redact(docs, length="n_chars", folder=ledger(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids; each text is decoded again, and one that doesn't come back fails the job."""
    return byte_bpe.add_checked_ids(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: Expectation-maximisation, seeded hashes and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table documents, each on what the one before it kept."""
    docs, inputs = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        others = set(made()) - set(inputs)
        docs = written(stage(spark, docs, sf_dir), name.split()[0].replace("-", "_"))
        *used, result = [folder for folder in made() if folder not in others]
        remove(spark, used)  # the stage's input and own tables
        inputs = [result]
    return STAGES[-1][1](spark, docs, sf_dir)
