"""dtype codes: canonical form, support per standard, Arrow and Spark types."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Supported codes.
NUMERIC_CODES = "f2 f4 f8 u1 u2 u4 u8 i1 i2 i4 i8".split()
COMPLEX_CODES = "c8 c16".split()
OTHER_CODES = ["O", "b1", "V[1-9][0-9]*"]
TIME_UNITS = r"\[(?:[1-9][0-9]*)?(?:[YMWDhms]|[munpfa]s)\]"
FITS_ARRAY_CODES = "f8 f4 i8 i4 i2 u8 u4 u2 u1".split()

DTYPE_PATTERNS = {
    "any": NUMERIC_CODES
    + COMPLEX_CODES
    + OTHER_CODES
    + ["M8" + TIME_UNITS, "m8" + TIME_UNITS],
    "parquet": NUMERIC_CODES
    + OTHER_CODES
    + [r"M8\[(?:D|[mun]s)\]", r"m8\[(?:s|[mun]s)\]"],
    "fits_array": FITS_ARRAY_CODES,
    "fits": FITS_ARRAY_CODES + COMPLEX_CODES + OTHER_CODES,
}

# Parquet physical types (fixed values).  BOOLEAN is b1 as documented.
PHYSICAL_CODES = {
    "BOOLEAN": "b1",
    "INT32": "i4",
    "INT64": "i8",
    "FLOAT": "f4",
    "DOUBLE": "f8",
    "BYTE_ARRAY": "O",
}


def dtype_supported(code: Column, standard: str = "any") -> Column:
    """is a dtype code allowed for a standard?"""
    alternatives = "|".join(DTYPE_PATTERNS.get(standard, DTYPE_PATTERNS["any"]))
    return code.rlike(rf"\A(?:{alternatives})\z")


def normalise_dtype(code: Column) -> Column:
    """F1 on text: canonical code of a numpy-style type string.

    Byte order is dropped, ``?`` and ``bool`` become ``b1``, ``Sn`` becomes
    ``Vn``, ``Un`` becomes ``Vn`` and a multiplier of one disappears.
    """
    bare = F.regexp_replace(F.trim(code), r"^[<>=|]", "")
    bare = F.regexp_replace(bare, r"^([Mm])8?\[1([a-zA-Z]+)\]$", "$18[$2]")
    return (
        F.when(bare.isin("?", "bool", "b1", "bool_"), F.lit("b1"))
        .when(bare.isin("O", "O8", "object"), F.lit("O"))
        .when(bare.rlike(r"^[SUa]\d+$"), F.regexp_replace(bare, "^[SUa]", "V"))
        .otherwise(bare)
    )


_SPARK_CODES = {
    T.BooleanType: "b1",
    T.ByteType: "i1",
    T.ShortType: "i2",
    T.IntegerType: "i4",
    T.LongType: "i8",
    T.FloatType: "f4",
    T.DoubleType: "f8",
    T.DateType: "M8[D]",
    T.TimestampType: "M8[us]",
    T.TimestampNTZType: "M8[us]",
    T.DayTimeIntervalType: "m8[us]",
}


def dtype_code(data_type: T.DataType) -> str:
    """code of a Spark type (Spark has no unsigned or half types)."""
    return _SPARK_CODES.get(type(data_type), "O")


# Code of each Arrow type, by type id; {t} is the type.
_ARROW_CODES = {
    pa.bool_().id: "b1",
    pa.uint8().id: "u1",
    pa.uint16().id: "u2",
    pa.uint32().id: "u4",
    pa.uint64().id: "u8",
    pa.int8().id: "i1",
    pa.int16().id: "i2",
    pa.int32().id: "i4",
    pa.int64().id: "i8",
    pa.float16().id: "f2",
    pa.float32().id: "f4",
    pa.float64().id: "f8",
    pa.date32().id: "M8[D]",
    pa.date64().id: "M8[D]",
    pa.timestamp("s").id: "M8[{t.unit}]",
    pa.duration("s").id: "m8[{t.unit}]",
    pa.time32("s").id: "O",
    pa.time64("us").id: "O",
    pa.binary().id: "O",
    pa.binary(1).id: "V{t.byte_width}",
}


def arrow_dtype_code(field: pa.Field, physical_type: str, nested: bool) -> str:
    """code of one Parquet column: by its Arrow type, nested ones ``O``.

    What has neither (texts, decimals, dictionaries) is stored as its physical
    type says; a physical type without a code is an error.
    """
    by_storage = PHYSICAL_CODES | {"FIXED_LEN_BYTE_ARRAY": "V{t.byte_width}"}
    code = _ARROW_CODES.get(field.type.id) or ("O" if nested else by_storage.get(physical_type))
    if code is None:
        raise TypeError(f"{field.name}: no dtype code for physical type {physical_type}")
    return code.format(t=field.type)
