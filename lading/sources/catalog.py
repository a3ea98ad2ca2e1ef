"""Decoded object catalogues of FITS and ASDF files.

Decoding those formats is left to the tools that own them; the engine takes
their output as four tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lading import schemas

TABLES = {
    "objects": schemas.OBJECTS,
    "columns": schemas.COLUMNS,
    "meta": schemas.META_KV,
    "nodes": schemas.NODES,
}


@dataclass(frozen=True)
class Catalog:
    objects: DataFrame
    columns: DataFrame
    meta: DataFrame
    nodes: DataFrame


def load_object_catalog(spark: SparkSession, path: str, format: str = "parquet") -> Catalog:
    """A folder with objects, columns, meta and nodes."""
    return Catalog(
        **{
            name: spark.read.schema(layout).format(format).load(f"{path}/{name}")
            for name, layout in TABLES.items()
        }
    )


def empty_catalog(spark: SparkSession) -> Catalog:
    return Catalog(**{n: spark.createDataFrame([], s) for n, s in TABLES.items()})
