"""Checksums and compression, from content bytes."""

from __future__ import annotations

import base64
import struct
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lading.functions.names import basename

# Magic number -> canonical extension, longest first.
COMPRESSION_MAGIC = (
    (b"\x89LZO\x00\r\n\x1a\n", ".lzo"),
    (b"\xfd7zXZ\x00", ".xz"),
    (b"7z\xbc\xaf\x27\x1c", ".7z"),
    (b"Rar!\x1a\x07", ".rar"),
    (b"\x28\xb5\x2f\xfd", ".zst"),
    (b"\x04\x22\x4d\x18", ".lz4"),
    (b"LZIP", ".lz"),
    (b"PK\x03\x04", ".zip"),
    (b"\x5d\x00\x00", ".lzma"),
    (b"\x1f\x8b\x08", ".gz"),
    (b"BZh", ".bz2"),
    (b"BZ0", ".bz"),
    (b"\x1f\x1e", ".z"),
    (b"\x1f\x1f", ".z"),
    (b"\x1f\x8b", ".z"),
    (b"\x1f\x9d", ".z"),
    (b"\x1f\x9e", ".z"),
    (b"\x1f\x9f", ".z"),
    (b"\x1f\xa0", ".z"),
    (b"\x1f\xa1", ".z"),
    (b"\x1f\xff", ".z"),
)
LONGEST_MAGIC = 9
# What is said when name and content differ, or of a format that isn't taken.
VERDICT_TEXTS = {
    "differs": "file extension indicates contents %s but they %s",
    "refused": "files in %s format are not accepted",
}
# Extension -> name of the format.
COMPRESSION_NAMES = {
    ".gz": "gzip", ".bz2": "bzip2", ".lz4": "LZ4", ".lzo": "LZO", ".xz": "XZ",
    ".zst": "Zstandard", ".zip": "(PK)Zip", ".7z": "7-Zip", ".bz": "bzip 1",
    ".lz": "LZ", ".lzma": "LZMA", ".rar": "(Win)RAR", ".z": "compress(1)",
}


def crc32_base64(content: Column) -> Column:
    """base64 of the four big-endian CRC-32 bytes, e.g. ``yH2GHg==``."""
    return F.base64(F.unhex(F.lpad(F.hex(F.crc32(content)), 8, "0")))


def crc32_text(crc: int) -> str:
    """The same rendering for a CRC held as a Python integer."""
    return base64.b64encode(struct.pack(">I", crc)).decode("ascii")


def compression_of(magic: Column) -> Column:
    """extension of the compression whose magic number starts `magic`."""

    def clause(tail: Column, entry: tuple[bytes, str]) -> Column:
        code, extension = entry
        hit = magic.startswith(F.lit(code))
        if extension == ".bz2":  # a block size digit 1-9 follows
            hit = hit & F.substring(magic, len(code) + 1, 1).between(F.lit(b"1"), F.lit(b"9"))
        return F.when(hit, F.lit(extension)).otherwise(tail)

    return reduce(clause, reversed(COMPRESSION_MAGIC), F.lit(None).cast("string"))


def _format_name(extension: Column) -> Column:
    return reduce(
        lambda tail, kv: F.when(extension == kv[0], F.lit(kv[1])).otherwise(tail),
        COMPRESSION_NAMES.items(),
        F.lit(None).cast("string"),
    )


def check_compression(path: Column, magic: Column) -> Column:
    """struct(extension, problem): do name and content agree, is it allowed?

    An empty file, or one whose content isn't known, is taken at its suffix;
    only gzip is accepted.
    """
    suffix = F.lower(F.regexp_extract(basename(path), r"[^.](\.[^.]+)$", 1))
    suffix = F.when(suffix.isin(*COMPRESSION_NAMES), suffix)
    empty = F.coalesce(F.length(magic), F.lit(0)) == 0
    content = F.when(empty, suffix).otherwise(compression_of(magic))
    verdict = F.when(~content.eqNullSafe(suffix), "differs").when(suffix != ".gz", "refused").otherwise("fine")

    def state(extension: Column, plain: str) -> Column:
        used = F.format_string("use %s compression", _format_name(extension))
        return F.when(extension.isNull(), plain).otherwise(used)

    states = state(suffix, "should be uncompressed"), state(content, "are uncompressed")
    problem = F.when(
        verdict == "differs", F.format_string(VERDICT_TEXTS["differs"], *states)
    ).when(verdict == "refused", F.format_string(VERDICT_TEXTS["refused"], _format_name(suffix)))
    return F.struct(F.when(verdict != "differs", suffix).alias("extension"), problem.alias("problem"))
