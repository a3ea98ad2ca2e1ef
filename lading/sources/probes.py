"""Parquet probes: footers and content, read on executors.

pyarrow gives what Spark's reader widens away (unsigned, half, ns types) and
the footer's key/values.  Every probe yields rows per file as it goes; errors
become rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lading.functions.dtypes import arrow_dtype_code
from lading.sources.files import open_filesystem, spread

_FOOTER = (
    "path string, kind string, ix int, name string, dtype string, "
    "key string, value string, size bigint"
)
_FIELDS = [f.strip().split(" ")[0] for f in _FOOTER.split(",")]
Row = dict


def _open(root: str, path: str) -> pq.ParquetFile:
    filesystem, full = open_filesystem(f"{root.rstrip('/')}/{path}" if root else path)
    return pq.ParquetFile(filesystem.open_input_file(full))


def _footer_rows(root: str, path: str) -> Iterator[Row]:
    try:
        with _open(root, path) as file:
            metadata, leaf = file.metadata, 0
            columns = []
            for ix, field in enumerate(file.schema_arrow):
                physical = file.schema.column(leaf).physical_type
                code = arrow_dtype_code(field, physical, pa.types.is_nested(field.type))
                columns.append({"kind": "column", "ix": ix, "name": field.name, "dtype": code})
                leaf += _n_leaves(field.type)
            yield from columns
            for key, value in (metadata.metadata or {}).items():
                yield {"kind": "meta", "key": key.decode("utf-8"), "value": value.decode("utf-8")}
            for ix in range(metadata.num_row_groups):
                size = metadata.row_group(ix).total_byte_size
                yield {"kind": "row_group", "ix": ix, "size": size}
    except Exception as problem:  # any failure to read is a finding about the file
        yield {"kind": "error", "value": f"{type(problem).__name__}: {problem}"}


def _n_leaves(data_type: pa.DataType) -> int:
    if not pa.types.is_nested(data_type):
        return 1
    return sum(_n_leaves(data_type.field(i).type) for i in range(data_type.num_fields))


def probe_footers(files: DataFrame, root: str) -> DataFrame:
    """One row per column, footer key/value, row group or error of each file.

    Only footers are read (O5), whatever the file's size, so files are spread
    by their path alone.
    """
    once = spread(files.select("path").distinct(), "path")

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                rows = [{"path": path, **row} for row in _footer_rows(root, path)]
                if rows:
                    yield pd.DataFrame(rows, columns=_FIELDS, dtype=object)

    return once.mapInPandas(probe, _FOOTER)


def columns_of(footers: DataFrame) -> DataFrame:
    """COLUMNS; a Parquet file is one object and its columns are scalar."""
    return footers.filter(F.col("kind") == "column").select(
        "path",
        F.lit(0).alias("obj_ix"),
        F.col("ix").alias("col_ix"),
        "name",
        "dtype",
        F.lit(0).alias("ndim"),
    )


def metadata_of(footers: DataFrame) -> DataFrame:
    """META_KV of the footers."""
    return footers.filter(F.col("kind") == "meta").select(
        "path",
        F.lit(0).alias("obj_ix"),
        F.lit(0).alias("pos"),
        "key",
        "value",
        F.lit("str").alias("value_type"),
    )


def load_errors(footers: DataFrame) -> DataFrame:
    """PROBE_ERRORS of files that could not be opened or described."""
    return footers.filter(F.col("kind") == "error").select(
        "path", F.lit("load").alias("stage"), F.col("value").alias("message")
    )


def probe_parquet(files: DataFrame, root: str) -> DataFrame:
    """COLUMNS of Parquet files."""
    return columns_of(probe_footers(files, root))


def probe_parquet_metadata(files: DataFrame, root: str) -> DataFrame:
    """META_KV of Parquet files."""
    return metadata_of(probe_footers(files, root))


def scan_parquet_integrity(footers: DataFrame, root: str) -> DataFrame:
    """PROBE_ERRORS of files whose content does not decode.

    The unit of work is a row group, shuffled by (path, row group): a file that
    holds most of the bytes is read by many tasks, batch by batch.
    """
    groups = spread(footers.filter(F.col("kind") == "row_group").select("path", "ix"), "path", "ix")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, ix in zip(batch["path"], batch["ix"]):
                try:
                    with _open(root, path) as file:
                        for _ in file.iter_batches(row_groups=[int(ix)]):
                            pass
                except Exception as problem:
                    message = f"row group {ix}: {type(problem).__name__}: {problem}"
                    yield pd.DataFrame(
                        {"path": [path], "stage": ["data"], "message": [message]}, dtype=object
                    )

    return groups.mapInPandas(scan, "path string, stage string, message string")
