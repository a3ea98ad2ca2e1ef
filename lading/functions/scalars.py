"""Scalar parsers; a failed parse gives a problem text instead of an error."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Powers of ten / of 1024 behind each scale suffix.
SI_EXPONENTS = {
    "da": 1, "h": 2, "k": 3, "K": 3, "M": 6, "G": 9, "T": 12, "P": 15,
    "E": 18, "Z": 21, "Y": 24, "R": 27, "Q": 30,
}
IEC_PREFIXES = "K M G T P E Z Y R Q".split()

# Texts of sizes and addresses that can't be taken; %s is what was written.
SIZE_TEXTS = {
    "unread": "invalid number '%s'",
    "negative": "may not be negative",
    "bits": "cannot scale from bits to bytes",
    "unit": "unrecognized scale suffix '%s'",
    "zero": "may not be zero",
    "large": "too large",
}
EMAIL_TEXTS = {
    "whole": "'%s' has no @domain component",
    "local": "'%s' has forbidden characters in the user@ part",
    "domain": "'%s' doesn't end with a fully qualified domain name",
    "parts": "'%s' contains too many @-signs",
}

_BIG = "decimal(38,0)"


def _units() -> dict[str, int]:
    """Bytes of every unit, with and without its final B."""
    bare = {"": 1, "ki": 1024} | {s: 10**e for s, e in SI_EXPONENTS.items()}
    bare |= {f"{p}i": 1024**n for n, p in enumerate(IEC_PREFIXES, 1)}
    return bare | {f"{unit}B": n for unit, n in bare.items()}


def _first_text(texts: dict[str, str], written: Column, faults: dict[str, Column]) -> Column:
    """Text of the first fault that holds, NULL if none does."""
    found = [F.when(faults[k], F.format_string(texts[k], written)) for k in faults]
    return F.coalesce(*found)


def parse_bytes(text: Column) -> Column:
    """F8: struct(bytes decimal(38,0), problem) of a size such as ``5 MiB``.

    Blanks and the marks that group digits are taken out, but not inside or
    behind the unit; a sign, digits and a unit must be left.
    """
    compact = F.regexp_replace(text, r"\s+$|(?<![a-zA-Z])[\s',._]+", "")
    unit = F.regexp_extract(compact, "[a-zA-Z]*$", 0)
    number = F.regexp_extract(compact, "[0-9]+", 0).try_cast(_BIG)
    known = [F.lit(x) for kv in _units().items() for x in (kv[0], str(kv[1]))]
    scale = F.create_map(*known)[unit].cast(_BIG)  # a literal map once folded
    product = F.try_multiply(number, scale).try_cast(_BIG)
    faults = {
        "unread": ~compact.rlike("^[-−+]?[0-9]+[a-zA-Z]*$"),
        "negative": compact.rlike("^[-−]"),
        "bits": scale.isNull() & unit.endswith("b"),
        "unit": scale.isNull(),
        "zero": number == 0,
        "large": product.isNull(),
    }
    written = F.when(compact.rlike("^[-−+]?[0-9]+[a-zA-Z]*$"), unit).otherwise(text)
    problem = F.when(text.isNotNull(), _first_text(SIZE_TEXTS, written, faults))
    return F.struct(
        F.when(problem.isNull(), product).alias("bytes"), problem.alias("problem")
    )


def email_problem(address: Column) -> Column:
    """what is syntactically wrong with an e-mail address (NULL if nothing).

    The part before the @ may hold what the HTML standard's e-mail fields
    take, and letters and digits of any script.
    """
    parts = F.split(address, "@")
    faults = {
        "whole": F.size(parts) < 2,
        "local": ~parts[0].rlike(r"^[\p{L}\p{N}.!#$%&'*+/=?^_`{|}~-]+\z"),
        "domain": ~F.array_join(F.slice(parts, 2, 1 << 30), "@").contains("."),
        "parts": F.size(parts) > 2,
    }
    return F.when(address.isNotNull(), _first_text(EMAIL_TEXTS, address, faults))


# What a scalar could not be parsed as (fixed values).
_KINDS = {
    "int": "an integer", "float": "a real number", "bool": "a boolean value", "date": "a date",
    "null": "an explicit null value", "regex": "a regex",
}


def _bad(text: Column, what: str) -> Column:
    return F.concat(
        F.lit("bad value; '"), text, F.lit(f"' could not be parsed as {what}")
    )


def parse_bool(text: Column) -> Column:
    """true/1/false/0 in any case, surrounding blanks ignored."""
    return F.when(text.rlike(r"(?is)\A\s*(?:1|true)\s*\z"), True).when(
        text.rlike(r"(?is)\A\s*(?:0|false)\s*\z"), False
    )


_INT_FORMS = {
    10: r"(?:0(?:_?0)*|[1-9](?:_?[0-9])*)",
    16: r"0[xX](?:_?[0-9a-fA-F])+",
    8: r"0[oO](?:_?[0-7])+",
    2: r"0[bB](?:_?[01])+",
}


def is_integer(text: Column) -> Column:
    """an integer literal of any size, with 0x/0o/0b prefixes and _ separators."""
    body = F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), "^[+-]", "")
    return body.rlike("^(?:" + "|".join(_INT_FORMS.values()) + r")\z")


def parse_int(text: Column) -> Column:
    """value of an integer literal; NULL for others and beyond 63 bits (see `is_integer`)."""
    bare = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    sign = F.regexp_extract(bare, r"^([+-]?)", 1)
    body = F.regexp_replace(bare, r"^[+-]", "")
    digits = F.regexp_replace(body, "_", "")
    value = F.when(body.rlike(f"^{_INT_FORMS[10]}$"), digits)
    for base in (16, 8, 2):
        value = value.when(
            body.rlike(f"^{_INT_FORMS[base]}$"), F.conv(F.substring(digits, 3, 64), base, 10)
        )
    return F.concat(F.when(sign == "-", "-").otherwise(""), value).try_cast("bigint")


_FLOAT = (
    r"(?i)\A\s*[+-]?(?:(?:[0-9](?:_?[0-9])*)?\.?(?:[0-9](?:_?[0-9])*)"
    r"(?:\.)?(?:e[+-]?[0-9](?:_?[0-9])*)?|inf(?:inity)?|nan)\s*\z"
)


def parse_float(text: Column) -> Column:
    """floating point literal including inf and nan."""
    bare = F.lower(F.regexp_replace(F.trim(text), "_", ""))
    bare = F.regexp_replace(bare, r"^([+-]?)inf(?:inity)?$", "$1Infinity")
    bare = F.regexp_replace(bare, r"^[+-]?nan$", "NaN")
    return F.when(text.rlike(_FLOAT), bare.try_cast("double"))


def parse_date(text: Column) -> Column:
    """ISO date (a time of day after it is dropped)."""
    day = F.regexp_extract(text, r"\A\s*(\d{4}-\d{2}-\d{2})(?:[T ].*)?\s*\z", 1)
    return F.when(day != "", day).try_cast("date")


def is_explicit_null(text: Column) -> Column:
    """null/undefined/none in any case."""
    return text.rlike(r"(?is)\A\s*(?:null|undefined|none)\s*\z")


def scalar_problem(text: Column, kind: str) -> Column:
    """L14 for one property: why `text` is not a valid `kind` (NULL if it is)."""
    holds = {
        "int": is_integer, "null": is_explicit_null, "regex": is_regex,
        "float": lambda t: parse_float(t).isNotNull(),
        "bool": lambda t: parse_bool(t).isNotNull(),
        "date": lambda t: parse_date(t).isNotNull(),
    }
    if kind not in _KINDS:
        return F.lit(None).cast("string")
    return F.when(text.isNotNull() & ~holds[kind](text), _bad(text, _KINDS[kind]))


def is_regex(text: Column) -> Column:
    """Does Python take the text as a pattern?"""

    @F.pandas_udf("boolean")
    def compiles(patterns: pd.Series) -> pd.Series:
        def good(pattern: str | None) -> bool | None:
            if pattern is None:
                return None
            try:
                re.compile(pattern)
            except (re.error, OverflowError, RecursionError):
                return False
            return True

        return patterns.map(good)

    return compiles(text)


def scalar_type(text: Column) -> Column:
    """Type a free label scalar takes: int, float, null, bool, then str."""
    return (
        F.when(text.isNull(), F.lit(None).cast("string"))
        .when(is_integer(text), "int")
        .when(parse_float(text).isNotNull(), "float")
        .when(is_explicit_null(text), "null")
        .when(parse_bool(text).isNotNull(), "bool")
        .otherwise("str")
    )


def coerce_meta(text: Column, wanted: Column) -> Column:
    """struct(value, problem) of a footer string read as the wanted type.

    The value stays text in a canonical form (``true``, ``12``, ``1.5``).
    """
    as_bool = F.when(text.rlike(r"(?i)\A(?:t(?:rue)?|yes|on|1)\z"), "true").when(
        text.rlike(r"(?i)\A(?:f(?:alse)?|no|off|0)\z"), "false"
    )
    int_digits = F.when(
        F.trim(text).rlike(r"\A[+-]?[0-9](?:_?[0-9])*\z"),
        F.regexp_replace(F.trim(text), "_", ""),
    )
    as_int = int_digits.try_cast(_BIG).cast("string")
    value = (
        F.when(wanted == "bool", as_bool)
        .when(wanted == "int", as_int)
        .when(wanted == "float", parse_float(text).cast("string"))
        .otherwise(text)
    )
    problem = F.when(
        text.isNotNull() & value.isNull(),
        F.concat(
            F.lit("could not interpret '"), text, F.lit("' as "), F.coalesce(wanted, F.lit("str"))
        ),
    )
    return F.struct(value.alias("value"), problem.alias("problem"))


def utc_millis(ts: Column) -> Column:
    """ISO text of a UTC timestamp at millisecond precision."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()),
                         "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def event_time(text: Column) -> Column:
    """timestamp of a log row, NULL when it is not one."""
    return F.try_to_timestamp(text)


def nested_to_text(column: Column) -> Column:
    """JSON text of a struct, map, array or variant."""
    return F.to_json(column)


def failure_text(object_: Column, check: Column, key: Column, message: Column) -> Column:
    """indented rendering of one failure: its place, then its message."""
    place = F.concat_ws(
        "/", F.nullif(object_, F.lit("")), F.nullif(check, F.lit("")), F.nullif(key, F.lit(""))
    )
    return F.concat(
        F.repeat(F.lit(" "), F.lit(2)), place, F.lit("\n"),
        F.repeat(F.lit(" "), F.lit(4)), F.regexp_replace(message, "\n", "\n    "),
    )
