"""A training corpus from `documents`: each stage is written as Parquet and read again by the next.

Each stage works on all its predecessor kept and takes (spark, docs, sf_dir);
all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lading.llm import decontaminate, pieces, pii, simhash, toxicity
from lading.llm.common import shared_folder, table

PII_KEY = "a key of this corpus's own"
#: No SQL: the stages hash, train and sample.  tests/llm/test_pipeline.py holds them against plain versions.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5; it learns from those of docs that have labels."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter("predicted = 0").select(docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by SimHash, as op10_simhash links them."""
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def with_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced, and their length counted anew."""
    masked = pii.mask(docs, PII_KEY).withColumn("n_chars", F.length("text").cast("bigint"))
    return masked.select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, seeded by its doc_id; `lossless` says that they decode to its text."""
    out = pieces.encode(docs.select("doc_id", "lang", "source", "text"), pieces.read_model())
    return out.select("doc_id", "lang", "source", F.size("ids").alias("n_pieces"), "lossless", "ids")


STAGES = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("pii", with_surrogates),
    ("sentencepiece", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what lies between is written to the shared folder."""
    folder = f"{shared_folder(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
