"""A corpus pipeline of operators from ``locusloom.llm``: each stage's result is a table that the next one reads.

Language ID, near-duplicate removal, benchmark decontamination, mixing of sources, token files. All stages but the
last return the columns of ``documents``. The mix reads some documents more than once, so an id may come back; its
readings stand next to each other in the token files.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from locusloom.llm import decontam, langid, mixing, neardup, tokenbin
from locusloom.llm.common import discard, materialise, recall_shipped, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is recognised."""
    return langid.keep_known(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    return neardup.keep_one(docs)


def no_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that leak an item of ``benchmark``."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Read each source's documents as often as its weight asks, within a budget of as many tokens as there are."""
    return mixing.resample(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token files and return what is read back: doc_id, start, n_tokens, ids_crc32."""
    return tokenbin.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("langid", known_language),
    ("neardup", one_of_each),
    ("decontam", no_benchmarks),
    ("mixing", mixed_sources),
    ("tokenbin", token_files),
]

#: The stages learn, sketch, sample and tokenise: SQL can't say them. tests/llm holds the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each one's result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(docs)  # and what the stage shipped to the executors
        recall_shipped()
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
