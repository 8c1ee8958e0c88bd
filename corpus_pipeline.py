"""Corpus pipeline: STAGES are applied in order, each on all rows that the one before has written.

All stages but the last return the columns of documents (and any other columns that came in):
language ID drops documents without letters or with a label less likely than LEAST_SCORE; the n-gram
Jaccard join (shingles of NEAR_WORDS words, NEAR_SIMILARITY per cent) keeps the document with the
smallest id of each component; benchmark decontamination
drops documents that hold SIMILARITY of an item's windows; secret scans replace secrets by <secret>;
SentencePiece encoding returns the ids of each document, decoded and compared.
Null texts are dropped by the first stage; an empty table stays empty throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbgrid.llm import decontaminate, jaccard, langid, pieces, secrets
from kerbgrid.llm.common import table, written

#: On the calibrated scale: a text whose words say nothing scores 1 over the number of labels, a quarter in the tables here.
LEAST_SCORE = 0.3
#: Words of a shingle, and per cent of the union that near copies share.
NEAR_WORDS, NEAR_SIMILARITY = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier recognises; learned from docs' own labelled rows."""
    return langid.recognised(docs, langid.train(docs), LEAST_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by near copies; texts without words all stay."""
    return jaccard.deduplicated(docs, NEAR_WORDS, NEAR_SIMILARITY)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, verbatim or with other values in its slots."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with <secret> in the place of each secret span."""
    return secrets.redacted(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, ids and lossless of each document."""
    return pieces.round_trips(docs).select("doc_id", "n_bytes", F.size("ids").cast("long").alias("n_tokens"), "ids", "lossless")


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("secret_scan", redact_secrets),
    ("sentencepiece", encode_pieces),
]
#: SQL can express neither the classifier nor the segmentation; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
