"""Corpus pipeline: language ID, near-duplicate removal, secret redaction, source mixing, tokenisation.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept; ``run`` writes each stage's
result as Parquet to the shared folder and rereads it.  All but the last return the columns of documents, in their
order, whatever further columns there are and however they are named.  Stages decide by row, not by doc_id: repeated
and missing ids lose no row.  Every stage takes null, empty and very long texts and empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftline.llm import bpe, langid, mixing, ngram_join, secretscan
from siftline.llm.queries import vocabulary
from siftline.llm.runtime import dropped, materialise, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose n-grams belong to a learned language; nulls and texts without letters go."""
    return langid.accept(docs, langid.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of linked texts: that of the least doc_id, rows without an id last (ties: by a hash of
    the row; of wholly equal rows one).  Rows of one doc_id whose texts do not link all stay, and so do empty texts."""
    return ngram_join.keep_first(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; every row stays, null and empty texts as they are."""
    return secretscan.redact(docs, secretscan.learn(secretscan.labelled_table(spark)))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each row as often as the mix takes it; rows that it doesn't take, and those without words, go."""
    return mixing.take(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256), a row each row: ids as little-endian uint32 bytes, and the SHA-256 of the
    bytes that they decode to, which are the text's; null texts count as empty."""
    return bpe.encode(docs, *vocabulary(), then=bpe.digester(*vocabulary(), carried=True))


STAGES = [("language ID", language), ("n-gram Jaccard join", near_duplicates), ("secret scans", secrets), ("mixing", mixture), ("byte-level BPE", tokens)]

#: The classifiers and the Newton iterations have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), "stage")
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
