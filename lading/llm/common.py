"""What several of the operators share: text access, folds, bounded samples, the shared folder."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text; a null one is empty."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def fold(column: str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo the number of folds (null: fold 0)."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % folds, F.lit(0))


def balanced_sample(df: DataFrame, label: str, key: str, per_class: int) -> DataFrame:
    """About `per_class` rows of each label value, the same ones on every run.

    Only the class sizes reach the driver.  A class with fewer rows is taken
    whole; rows with a null label are left out.  The choice follows a hash of
    `key`, so it doesn't depend on partitioning.
    """
    sizes = df.filter(F.col(label).isNotNull()).groupBy(label).count().collect()
    wanted = F.lit(False)
    for row in sizes:
        share = min(1.0, per_class / row["count"])
        edge = math.floor(share * 1_000_000)
        chosen = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1_000_000)) < edge
        wanted = wanted | ((F.col(label) == F.lit(row[label])) & chosen)
    return df.filter(wanted)


def agreed_labels(labels: DataFrame, label: str) -> DataFrame:
    """One 0/1 label a document; null labels and documents with both values are left out."""
    return (
        labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("__other"))
        .filter(F.col("y") == F.col("__other"))
        .select("doc_id", "y")
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or on one machine a new one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="lading-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder
