"""Cutting lineage: results used several times are computed once.

`cut` writes a reliable checkpoint to the folder the cluster names in
spark.checkpoint.dir, so the loss of an executor loses nothing.  `stored`
writes Parquet files there: its readers take only the columns they need, and
the planner knows how large the result is, so small ones are broadcast.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame


def _checkpoint_folder(df: DataFrame) -> None:
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="lading-")  # one machine: tests, laptops
    context.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    _checkpoint_folder(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """`cut` for large rows read in parts; what Parquet can't hold is checkpointed."""
    _checkpoint_folder(df)
    at = f"{df.sparkSession.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    try:
        df.write.parquet(at)
    except AnalysisException:
        return cut(df)
    return df.sparkSession.read.schema(df.schema).parquet(at)
