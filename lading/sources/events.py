"""Event logs: batch and streaming readers and writers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType, VariantType

from lading import schemas
from lading.functions.scalars import nested_to_text, utc_millis

_CORRUPT = "__bad_row"
_OPTIONS = {
    "sep": "\t",
    "quote": '"',
    "escape": '"',
    "multiLine": True,
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": _CORRUPT,
}


def _parse(raw: DataFrame) -> DataFrame:
    """Text fields are never NULL; `problem` tells a malformed row."""
    fields = {f: F.coalesce(F.col(f), F.lit("")) for f in schemas.EVENT_FIELDS}
    blank = [
        F.when(fields[f] == "", F.lit(f)) for f in schemas.EVENT_REQUIRED
    ]
    missing = F.array_join(F.array(*blank), ", ")
    problem = F.when(
        F.col(_CORRUPT).isNotNull(), F.lit("wrong number of columns")
    ).when(missing != "", F.concat(F.lit("missing required fields: "), missing))
    return raw.select(
        *[c.alias(f) for f, c in fields.items()],
        problem.alias("problem"),
        F.col("_metadata.file_path").alias("chunk"),
    )


def _schema() -> str:
    return f"{schemas.EVENTS}, {_CORRUPT} string"


def read_events(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """A log (file or folder of chunks) as text columns.

    Malformed rows come back with a `problem`; `strict` raises on them.
    """
    rows = _parse(
        spark.read.schema(_schema())
        .options(**_OPTIONS, recursiveFileLookup=True)
        .csv(path)
    )
    return enforce_event_format(rows, strict)


def stream_events(
    spark: SparkSession, path: str, strict: bool = False, chunks_per_batch: int = 1000
) -> DataFrame:
    """Follow a folder of immutable chunk files.

    `chunks_per_batch` bounds a micro-batch, and with it the rows any one key
    can bring into one.  Malformed rows keep their `problem`.
    """
    rows = _parse(
        spark.readStream.schema(_schema())
        .options(**_OPTIONS, recursiveFileLookup=True)
        .option("maxFilesPerTrigger", chunks_per_batch)
        .csv(path)
    )
    return enforce_event_format(rows, strict)


def enforce_event_format(rows: DataFrame, strict: bool = False) -> DataFrame:
    """With `strict`, a malformed row fails the batch that holds it."""
    if not strict:
        return rows
    failed = F.raise_error(F.concat(F.col("problem"), F.lit(" in "), F.col("chunk")))
    # a filter, as a column nobody reads would be pruned with its check
    return rows.filter(F.when(F.col("problem").isNotNull(), failed.cast("boolean")).otherwise(True))


def good_rows(rows: DataFrame) -> DataFrame:
    """Well-formed rows, as EVENTS."""
    return rows.filter(F.col("problem").isNull()).select(*schemas.EVENT_FIELDS)


def quarantined(rows: DataFrame) -> DataFrame:
    """Malformed rows with their chunk and problem."""
    return rows.filter(F.col("problem").isNotNull())


def rejected_chunks(rows: DataFrame) -> DataFrame:
    """Chunks with any malformed row; as a whole they are not valid."""
    return (
        quarantined(rows)
        .groupBy("chunk")
        .agg(F.count(F.lit(1)).alias("n_bad"), F.min("problem").alias("problem"))
    )


def format_events(
    rows: DataFrame, fixed: Mapping[str, str] | None = None, now: Column | None = None
) -> DataFrame:
    """Rows in log layout.

    Adds a UTC timestamp and the fixed fields; nested values become JSON.
    Rows may not override a fixed field, bring unknown ones or lack a
    required one.
    """
    fixed = dict(fixed or {})
    given = set(rows.columns)
    unknown = (given | set(fixed)) - set(schemas.EVENT_FIELDS)
    if unknown:
        raise ValueError(f"not event fields: {', '.join(sorted(unknown))}")
    if given & set(fixed):
        raise ValueError(f"fixed fields given: {', '.join(sorted(given & set(fixed)))}")
    missing = set(schemas.EVENT_REQUIRED) - given - set(fixed) - {"time"}
    if missing:
        raise ValueError(f"required fields missing: {', '.join(sorted(missing))}")
    stamp = utc_millis(F.current_timestamp() if now is None else now)
    types = {f.name: f.dataType for f in rows.schema.fields}

    def field(name: str) -> Column:
        if name in fixed:
            return F.lit(fixed[name])
        if name not in types:
            return stamp if name == "time" else F.lit(None).cast("string")
        if isinstance(types[name], (StructType, MapType, ArrayType, VariantType)):
            return nested_to_text(F.col(name))
        if isinstance(types[name], StringType):
            return F.col(name)
        return F.col(name).cast("string")

    return rows.select(*[field(n).alias(n) for n in schemas.EVENT_FIELDS])


def write_events(
    rows: DataFrame,
    path: str,
    fixed: Mapping[str, str] | None = None,
    batch_id: int | None = None,
) -> None:
    """Append rows to a log folder.

    With a `batch_id` (of a micro-batch) the rows go to a folder of their own
    that a repeated attempt overwrites, so a retried batch writes them once.
    """
    writer = format_events(rows, fixed).write.options(
        sep="\t", quote='"', escape='"', emptyValue=""
    )
    if batch_id is None:
        writer.mode("append").csv(path)
    else:
        writer.mode("overwrite").csv(f"{path}/batch-{batch_id:010d}")
