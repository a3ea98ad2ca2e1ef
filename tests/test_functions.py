"""Scalar functions against Python's own behaviour."""

import base64
import re
import struct
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lading.functions import content, scalars
from lading.functions.dtypes import dtype_supported, normalise_dtype
from lading.functions.names import infer_standard, order_patterns, split_exclusion, split_stem
from lading.functions.regex import escape_regex, regex_portable, regex_test, regex_test_by_row
from lading.sources.files import crc32_combine

PORTABLE = [
    r"a.c$", r"^\d{2,3}_(?P<x>\w+)\.fits\Z", r"(?i)straße", r"[]a-c]+", r"[^\d\s]x", r"x{,2}y",
    r"a{b}", r"\bword\b", r"(?s)a.b", r"[a[b]&&c]", r"(a|b)\1", r"\w+\W\S", r"(?<!x)y(?=z)", r"\x41\v?",
]
PYTHON_ONLY = [r"(?x) a b", r"(?m)^a$", r"[\W]", r"(a)(?(1)b|c)", r"(?P<a_b>x)"]
SUBJECTS = [
    "abc", "abc\n", "12_data.fits", "123_dätä.fits\n", "STRASSE", "STRAßE", "]a", "a\rb", "a\nb",
    "xxy", "a{b}", "a word.", "awordb", "a", "b", "[", "&c", "aa", "ab", "éa b!", "yz", "xyz",
    "A\x0b", "٣٤_x.fits", "a b", "x", "", "a b", "a\n", "b\na",
]


@pytest.mark.parametrize("mode", ["search", "match", "fullmatch"])
def test_regex_like_python(spark, mode):
    subjects = spark.createDataFrame([(s,) for s in SUBJECTS], "s string")
    patterns = PORTABLE + PYTHON_ONLY
    tests = [regex_test(F.col("s"), p, mode).alias(f"p{i}") for i, p in enumerate(patterns)]
    for row in subjects.select("s", *tests).collect():
        for i, pattern in enumerate(patterns):
            wanted = getattr(re.compile(pattern), mode)(row.s) is not None
            assert row[f"p{i}"] == wanted, (pattern, row.s, mode)


def test_portability():
    assert all(regex_portable(p) for p in PORTABLE)
    assert not any(regex_portable(p) for p in PYTHON_ONLY)
    with pytest.raises(re.error):
        regex_portable("(")


def test_regex_by_row_and_escape(spark):
    rows = [("a.b", "a.b"), ("axb", "a.b"), ("x(1)", "x(1)"), (None, "a")]
    df = spark.createDataFrame(rows, "s string, p string")
    found = df.select(
        regex_test_by_row(F.col("s"), F.col("p"), "fullmatch").alias("raw"),
        regex_test_by_row(F.col("s"), escape_regex(F.col("p")), "fullmatch").alias("quoted"),
    ).collect()
    assert [tuple(r) for r in found] == [(True, True), (True, False), (False, True), (None, None)]


def _one(spark, column, value, type_="string"):
    df = spark.createDataFrame([(value,)], f"x {type_}")
    return df.select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "text, size, problem",
    [
        ("1_000", 1000, None), ("5 MiB", 5 << 20, None), ("+2kB", 2000, None), ("3 da", 30, None),
        ("1.024'0 Ki", 10240 * 1024, None), ("-3", None, "may not be negative"),
        ("0", None, "may not be zero"), ("8Mb", None, "cannot scale from bits to bytes"),
        ("7 xx", None, "unrecognized scale suffix 'xx'"), ("MiB", None, "invalid number 'MiB'"),
        ("99999999999 Q", None, "too large"),
    ],
)
def test_parse_bytes(spark, text, size, problem):
    got = _one(spark, scalars.parse_bytes, text)
    assert (None if got.bytes is None else int(got.bytes), got.problem) == (size, problem)


INTS = "12 0 -7 +3 0x1F 0b101 0o17 1_000 007 0_0 __1 1__2 1_ abc 1.5 0x 9223372036854775807".split()


def test_scalars_like_python(spark):
    texts = [*INTS, "nan", "-inf", "1e3", ".5", "5.", "1_0.5", "e5", "true", " FALSE ", "1", "none"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    for row in df.select(
        "t", scalars.parse_int(t).alias("i"), scalars.parse_float(t).alias("f"),
        scalars.parse_bool(t).alias("b"), scalars.is_explicit_null(t).alias("n"),
    ).collect():
        assert row.i == _try(lambda s: int(s, base=0), row.t), row.t
        assert repr(row.f) == repr(_try(float, row.t)), row.t
        wanted = {"true": True, "1": True, "false": False, "0": False}.get(row.t.strip().lower())
        assert row.b == wanted and row.n == (row.t == "none")


def _try(parse, text):
    try:
        return parse(text)
    except ValueError:
        return None


def test_emails(spark):
    bad = ["nobody", "a b@c.d", "a@b", "a@b@c.d", "@c.d"]
    good = ["é.x+1@host.org", "o'neil@a.b.c"]
    df = spark.createDataFrame([(a,) for a in bad + good], "a string")
    problems = [r.p for r in df.select(scalars.email_problem(F.col("a")).alias("p")).collect()]
    assert all(problems[: len(bad)]) and not any(problems[len(bad) :])


def test_checksum(spark):
    for data in (b"", b"hello", bytes(range(256)) * 40):
        wanted = base64.b64encode(struct.pack(">I", zlib.crc32(data))).decode()
        assert _one(spark, content.crc32_base64, bytearray(data), "binary") == wanted


@given(st.lists(st.binary(max_size=60), max_size=6))
def test_crc_combine(pieces):
    crc = 0
    for piece in pieces:
        crc = crc32_combine(crc, zlib.crc32(piece), len(piece))
    assert crc == zlib.crc32(b"".join(pieces))


def test_compression(spark):
    cases = [
        ("a.gz", b"\x1f\x8b\x08\x00", ".gz", None), ("a.txt", b"plain", None, None),
        ("a.gz", b"plain", None, "should"), ("a.dat", b"BZh9", None, "should"),
        ("a.bz2", b"BZh9", ".bz2", "not accepted"), ("a.gz", b"", ".gz", None),
        ("a.bz", b"BZ0", ".bz", "not accepted"), ("a.txt", b"BZh0", None, None),
        ("d/.gz", b"text", None, None),
    ]
    df = spark.createDataFrame([(p, bytearray(m)) for p, m, *_ in cases], "p string, m binary")
    found = df.select(content.check_compression(F.col("p"), F.col("m")).alias("c")).collect()
    for (path, _, extension, problem), row in zip(cases, found):
        text = row.c.problem
        if problem == "should":
            assert "file extension indicates" in text, path
        elif problem:
            assert row.c.extension == extension and problem in text, path
        else:
            assert row.c.extension == extension and text is None, path


def test_names(spark):
    assert _one(spark, infer_standard, "a/x.FITS.gz") == "fits"
    assert _one(spark, infer_standard, "x.v1.pqt") == "parquet"
    assert _one(spark, infer_standard, "d.asdf/readme") == "unknown"
    assert _one(spark, infer_standard, ".hidden") == "unknown"
    assert _one(spark, infer_standard, "notes.TXT") == "txt"
    assert tuple(_one(spark, split_stem, "catalog_0_01")) == ("catalog", "_0_01")
    assert _one(spark, split_stem, "flux") is None
    assert tuple(_one(spark, split_exclusion, "(?!)b")) == ("b", False)
    patterns = spark.sql("select array(named_struct('pattern','b','include',false),"
                         "named_struct('pattern','c','include',true),"
                         "named_struct('pattern','a','include',true)) p")  # fmt: skip
    ordered = patterns.select(order_patterns(F.col("p")).alias("o")).first().o
    assert [(r.pattern, r.include) for r in ordered] == [("a", True), ("c", True), ("b", False)]


def test_dtype_codes(spark):
    for text, code in {"<f4": "f4", ">M8[1ns]": "M8[ns]", "?": "b1", "S5": "V5", "|O": "O", "M8[25us]": "M8[25us]"}.items():
        assert _one(spark, normalise_dtype, text) == code
    assert _one(spark, dtype_supported, "M8[250us]") and not _one(spark, dtype_supported, "V0")
    for standard, code, ok in [("fits", "i1", False), ("fits", "c16", True), ("parquet", "c8", False), ("parquet", "m8[ns]", True)]:
        assert _one(spark, lambda c: dtype_supported(c, standard), code) == ok
