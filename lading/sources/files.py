"""File listings, manifests and reports."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lading.functions.content import crc32_text
from lading.functions.names import relative_path
from lading.operators.manifest import check_index_header


def spread(work: DataFrame, *keys: str) -> DataFrame:
    """Rows that each stand for the opening of a file, dealt over all cores.

    The number of partitions is given, as adaptive execution would otherwise
    put many rows of few bytes into one task.
    """
    spark = work.sparkSession
    cores = spark.sparkContext.defaultParallelism
    number = 2 * max(cores, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return work.repartition(number, *keys)


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """`path` (relative), `length`, `mtime` of all files below a root.

    Works for local roots and any Hadoop URI (s3a://bucket/prefix).  Content
    is not read: the column is pruned.  Spark's listing skips names that start
    with ``_`` or ``.``; use `from_manifest` to take those from an index.
    """
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    )
    return listing.select(
        relative_path(root, F.col("path")).alias("path"),
        F.col("length"),
        F.col("modificationTime").alias("mtime"),
    )


def from_manifest(index: DataFrame, root: str) -> DataFrame:
    """File records for the paths of a manifest, hidden files included.

    Sizes are looked up on executors, one metadata call per path.
    """

    def stat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            infos = [file_info(f"{root.rstrip('/')}/{p}") for p in batch["path"]]
            found = [i.type == pafs.FileType.File for i in infos]
            yield pd.DataFrame(
                {
                    "path": batch["path"],
                    "length": [i.size if ok else None for i, ok in zip(infos, found)],
                    "mtime": [i.mtime if ok else None for i, ok in zip(infos, found)],
                },
                dtype=object,
            )[found]

    return spread(index.select("path"), "path").mapInPandas(stat, "path string, length bigint, mtime timestamp")


def open_filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow file system and path of a URI; Hadoop's s3a is Arrow's s3."""
    uri = uri.replace("s3a://", "s3://", 1)
    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    if uri.startswith("/"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def file_info(uri: str) -> pafs.FileInfo:
    filesystem, path = open_filesystem(uri)
    return filesystem.get_file_info(path)


def read_index(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """S3: a manifest CSV.  `strict` wants the header the server accepts;
    otherwise a `path` column is enough."""
    columns = spark.read.csv(path, header=True).columns
    if strict:
        problems = check_index_header(columns)
    else:
        problems = [] if "path" in columns else ["a 'path' column is required"]
    if problems:
        raise ValueError("bad file index: " + "; ".join(problems))
    layout = ", ".join(
        f"`{c}` {'boolean' if c == 'will_transfer' else 'string'}" for c in columns
    )
    return spark.read.schema(layout).csv(path, header=True, enforceSchema=False)


def write_index(index: DataFrame, path: str) -> None:
    """`path[, checksum][, will_transfer]` as CSV."""
    columns = [c for c in ("path", "checksum", "will_transfer") if c in index.columns]
    index.select(*columns).write.mode("overwrite").csv(path, header=True)


def write_filetype_report(report: DataFrame, path: str) -> None:
    """`path, filetypes` as CSV."""
    report.select("path", "filetypes").write.mode("overwrite").csv(path, header=True)


def dump_file_state(states: DataFrame, path: str) -> None:
    """`file, state, message` as CSV."""
    states.select(F.col("path").alias("file"), "state", "message").write.mode(
        "overwrite"
    ).csv(path, header=True)


def report_message(report: DataFrame) -> DataFrame:
    """A delivery report as one JSON text per delivery."""
    return report.select(F.to_json(F.struct("*")).alias("value"))


def write_report(report: DataFrame, errors: DataFrame, path: str) -> None:
    """Report messages, and the errors they count as a table of their own."""
    report_message(report).write.mode("overwrite").text(f"{path}/report")
    errors.write.mode("overwrite").json(f"{path}/errors")


# --- checksums ---------------------------------------------------------------

_POLYNOMIAL = 0xEDB88320  # CRC-32, reversed (fixed value)


def _times(matrix: list[int], vector: int) -> int:
    out, row = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[row]
        vector >>= 1
        row += 1
    return out


def crc32_combine(first: int, second: int, second_length: int) -> int:
    """CRC of two adjoining pieces from their CRCs.

    Appending n zero bytes is a linear map of the 32 state bits, applied here
    by repeated squaring.
    """
    shift = [_POLYNOMIAL] + [1 << i for i in range(31)]  # one zero bit
    for _ in range(3):  # eight zero bits
        shift = [_times(shift, row) for row in shift]
    while second_length:
        if second_length & 1:
            first = _times(shift, first)
        shift = [_times(shift, row) for row in shift]
        second_length >>= 1
    return first ^ second


def add_checksums(files: DataFrame, root: str, piece: int = 128 << 20) -> DataFrame:
    """`files` (path, length) with `checksum`, the base64 CRC-32 of each file.

    Files are read in pieces of at most `piece` bytes spread over all tasks, so
    one huge file is shared among executors; piece CRCs are then combined in
    order.  Empty files have one empty piece.
    """
    pieces = files.select(
        "path",
        "length",
        F.explode(
            F.sequence(F.lit(0), F.floor(F.greatest(F.col("length") - 1, F.lit(0)) / piece))
        ).alias("ix"),
    )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, length, ix in zip(batch["path"], batch["length"], batch["ix"]):
                size = max(0, min(piece, int(length) - int(ix) * piece))
                rows.append((path, int(ix), size, _range_crc(root, path, int(ix) * piece, size)))
            yield pd.DataFrame(rows, columns=["path", "ix", "size", "crc"], dtype=object)

    crcs = spread(pieces, "path", "ix").mapInPandas(read, "path string, ix bigint, size bigint, crc bigint")

    @F.pandas_udf("string")
    def joined(pieces_of_file: pd.Series) -> pd.Series:
        def combine(rows) -> str:
            crc = 0
            for row in rows:
                crc = crc32_combine(crc, int(row["crc"]), int(row["size"]))
            return crc32_text(crc)

        return pieces_of_file.map(combine)

    sums = crcs.groupBy("path").agg(
        F.array_sort(F.collect_list(F.struct("ix", "size", "crc"))).alias("__pieces")
    )
    return files.join(
        sums.select("path", joined("__pieces").alias("checksum")), "path", "left"
    )


def _range_crc(root: str, path: str, offset: int, size: int) -> int:
    filesystem, full = open_filesystem(f"{root.rstrip('/')}/{path}")
    crc = 0
    with filesystem.open_input_file(full) as stream:
        stream.seek(offset)
        while size > 0:
            block = stream.read(min(size, 1 << 20))
            if not block:
                raise OSError(f"{path} is shorter than its listing says")
            crc = zlib.crc32(block, crc)
            size -= len(block)
    return crc


def read_magic(files: DataFrame, root: str) -> DataFrame:
    """`magic`, the first bytes of each file, read on executors."""
    from lading.functions.content import LONGEST_MAGIC

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            heads = []
            for path in batch["path"]:
                filesystem, full = open_filesystem(f"{root.rstrip('/')}/{path}")
                with filesystem.open_input_file(full) as stream:
                    heads.append(stream.read(LONGEST_MAGIC))
            yield pd.DataFrame({"path": batch["path"], "magic": heads}, dtype=object)

    return spread(files.select("path"), "path").mapInPandas(read, "path string, magic binary")
