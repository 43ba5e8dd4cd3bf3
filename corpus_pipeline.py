"""A corpus pipeline: each stage calls one text operator on all rows its predecessor kept.

All stages but the last return the columns of `documents`. The last gives token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from priorkit.llm.common import staged, table
from priorkit.llm.mixing import OUT, mix_sources
from priorkit.llm.ngram_join import keep_one
from priorkit.llm.pii import redact
from priorkit.llm.sentencepiece_bpe import encode_documents
from priorkit.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go. Each row is judged by its text; null ids, null and empty texts are kept where the score of no text is."""
    return drop_toxic(spark, docs, sf_dir)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by near-equal shingle sets stays: that with the smallest id. Rows without words or without an id all stay."""
    return keep_one(spark, docs, sf_dir)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become tags. Null texts stay null; no row goes."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, or left out, to the target weights of their sources, and shuffled. A null source is one of its own; rows of one id draw alike."""
    return mix_sources(docs).drop(*OUT)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens) of every row; a null or empty text has the end id alone."""
    return encode_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("n-gram Jaccard join", ngram_join),
    ("PII", pii),
    ("mixing sources to target weights", mixing),
    ("SentencePiece encoding and decoding", encoding),
]

#: Training, components and encoding are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents` in order, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = staged(docs)
    return docs
