"""A training-corpus pipeline: each stage takes the documents that the one before kept.

Toxic documents go, one document of each near-duplicate class stays, personal data are masked, sources are
mixed to their targets, and what is left is tokenized. Stages are written as Parquet and read again by run().
All stages but the last return the columns of the documents given, also such that they do not know.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isopleth.llm import bagminhash, bpe_duckdb, mixing, pii, zstd_toxicity
from isopleth.llm.common import free_name, shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under one half; the model learns from the labels of the documents given.

    A null or empty text gets the score of no windows; without labels of both kinds every score is the share of
    label 1. Repeated rows share their fate, and a label at a half is toxic. No documents, no rows.
    """
    model = zstd_toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    score = free_name(docs, "toxicity")
    return zstd_toxicity.score_toxicity(docs, model, out=score).where(F.col(score) < 0.5).select(docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each near-duplicate class of texts.

    Rows without words or without a doc_id are kept, rows alike in doc_id and text count once, rows that share
    a doc_id but not their text are judged apart. No documents, no rows.
    """
    return bagminhash.deduplicate(docs)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data replaced by their kind; n_chars follows the text. Null texts stay null, every row is kept."""
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents as the source weights ask for, in the order of the mix.

    A null source is a source of its own; documents without words are never served. No words, no rows.
    """
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every copy; a null text counts as empty. No documents, no rows."""
    return bpe_duckdb.token_digests(docs, memory=32_000_000)  # the executor's heap is full of the stages before


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_each),
    ("pii", mask_pii),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: Signatures, compression lengths and recursive encoding are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's files go once the next stage has written its own; the last stage's stay."""
    docs, held = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{number}-{name}")
        if held:
            _remove(spark, held)
        docs, held = spark.read.parquet(path), path
    return docs
