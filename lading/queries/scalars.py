"""Scalar functions over values derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lading.functions import content as k
from lading.functions import scalars as s
from lading.functions.dtypes import dtype_supported, normalise_dtype
from lading.functions.names import split_exclusion
from lading.queries.readings import table


def parse_bytes(spark, folder):
    """F8: quantities of line items with a unit by line number."""
    lines = table(spark, folder, "lineitem")
    unit = F.element_at(
        F.array(*[F.lit(u) for u in ("", " kB", "MiB", " Gb", "B", " Q", " xB", "ki")]),
        F.least(F.col("l_linenumber"), F.lit(8)),
    )
    sign = F.when(F.col("l_discount") > 0.09, "-").when(F.col("l_discount") < 0.01, "+").otherwise("")
    digits = F.when(F.col("l_quantity") < 2, "0_0").otherwise(
        F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("_000"))
    )
    text = F.concat(sign, digits, unit)
    parsed = lines.select(text.alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    return parsed.withColumn("p", s.parse_bytes(F.col("text"))).select(
        "text", "n", F.col("p.bytes").cast("string").alias("bytes"), "p.problem"
    )


def email_problems(spark, folder):
    """every word with an @ in the documents, and hosts of pages as domains."""
    words = table(spark, folder, "documents").select(
        F.explode(F.split(F.regexp_replace("text", r"\s", " "), " ")).alias("address")
    )
    host = F.regexp_extract("url", "https?://([^/]+)", 1)
    made = table(spark, folder, "pages").select(
        F.when(F.col("url").contains("utm_"), host)
        .when(F.col("url").contains("#top"), F.concat(F.lit("a b@"), host))
        .when(F.col("url").endswith(".html"), F.concat(F.lit("me@"), F.substring_index(host, ".", 1)))
        .when(F.col("url").endswith("/"), F.concat(F.lit("me@you@"), host))
        .otherwise(F.concat(F.lit("me@"), host))
        .alias("address")
    )
    found = words.filter(F.col("address").contains("@")).unionByName(made)
    return found.select("address", s.email_problem(F.col("address")).alias("problem"))


def compression(spark, folder):
    """customers as files; magic by market segment, suffix by nation."""
    head = (
        F.when(F.col("c_mktsegment") == "BUILDING", F.unhex(F.lit("1F8B0800")))
        .when(F.col("c_mktsegment") == "MACHINERY", F.unhex(F.lit("425A6839")))
        .when(F.col("c_mktsegment") == "HOUSEHOLD", F.encode(F.col("c_name"), "utf-8"))
        .when(F.col("c_mktsegment") == "FURNITURE", F.unhex(F.lit("")))
        .otherwise(F.unhex(F.lit("FD377A585A00")))
    )
    suffix = (
        F.when(F.col("c_nationkey") < 8, ".gz")
        .when(F.col("c_nationkey") < 14, ".BZ2")
        .when(F.col("c_nationkey") < 20, ".xz")
        .otherwise(".dat")
    )
    files = table(spark, folder, "customer").select(
        F.concat("c_name", suffix).alias("path"), head.alias("magic")
    )
    return files.withColumn("c", k.check_compression(F.col("path"), F.col("magic"))).select(
        "path", k.compression_of(F.col("magic")).alias("content"), "c.extension", "c.problem"
    )


def crc_index(spark, folder):
    """checksums of whole document texts."""
    return table(spark, folder, "documents").select(
        "doc_id", k.crc32_base64(F.encode("text", "utf-8")).alias("checksum")
    )


def _price_texts(spark, folder):
    """Prices and sizes of parts written in several ways."""
    size = F.col("p_size")
    text = (
        F.when(size < 5, F.concat(F.lit("0x"), F.lower(F.hex("p_partkey"))))
        .when(size < 10, F.concat(F.lit("0b"), F.bin("p_size")))
        .when(size < 15, F.concat(F.lit(" "), F.col("p_partkey").cast("string"), F.lit("_000 ")))
        .when(size < 20, F.concat(F.lit("0"), F.col("p_size").cast("string")))
        .when(size < 25, F.col("p_retailprice").cast("decimal(12,2)").cast("string"))
        .when(size < 30, F.lit("TRUE"))
        .when(size < 35, F.lit("Null"))
        .when(size < 40, F.col("p_name"))
        .when(size < 45, F.concat(F.lit("-"), F.col("p_partkey").cast("string")))
        .otherwise(F.lit("nan"))
    )
    return table(spark, folder, "part").select("p_partkey", text.alias("text"))


def scalar_types(spark, folder):
    """which type each text has as a label scalar, and its integer value."""
    return _price_texts(spark, folder).select(
        "p_partkey",
        s.scalar_type(F.col("text")).alias("type"),
        s.parse_int(F.col("text")).alias("as_int"),
        s.parse_bool(F.col("text")).alias("as_bool"),
    )


def scalar_problems(spark, folder):
    """L14 as a column: texts that are no integers."""
    return _price_texts(spark, folder).select(
        "p_partkey", s.scalar_problem(F.col("text"), "int").alias("problem")
    )


def coerced_meta(spark, folder):
    """order fields read as bool, int and float."""
    orders = table(spark, folder, "orders")
    wanted = (
        F.when(F.col("o_orderstatus") == "F", "bool")
        .when(F.col("o_orderstatus") == "O", "int")
        .otherwise("str")
    )
    raw = F.element_at(F.split("o_orderpriority", "-"), 1)
    read = s.coerce_meta(raw, wanted)
    return orders.select(
        "o_orderkey", read["value"].alias("value"), read["problem"].alias("problem")
    )


def dtype_codes(spark, folder):
    """type strings made from part types and sizes."""
    text = F.concat(
        F.when(F.col("p_type") == "ECONOMY", "<f")
        .when(F.col("p_type") == "PROMO", ">i")
        .when(F.col("p_type") == "SMALL", "S")
        .when(F.col("p_type") == "LARGE", "|U")
        .otherwise("c"),
        F.col("p_size").cast("string"),
    )
    codes = table(spark, folder, "part").select(text.alias("text")).groupBy("text").agg(
        F.count(F.lit(1)).alias("n")
    )
    code = normalise_dtype(F.col("text"))
    return codes.select(
        "text", "n", code.alias("code"),
        dtype_supported(code).alias("supported"),
        dtype_supported(code, "parquet").alias("in_parquet"),
        dtype_supported(code, "fits").alias("in_fits"),
    )


def split_patterns(spark, folder):
    """Page paths as patterns, excluded when served without https."""
    pattern = F.concat(
        F.when(F.col("url").startswith("https"), "").otherwise("(?!)"),
        F.regexp_extract("url", "https?://[^/]+(.*)$", 1),
    )
    split = split_exclusion(pattern)
    return table(spark, folder, "pages").select(
        "page_id", split["pattern"].alias("pattern"), split["include"].alias("include")
    )


def event_times(spark, folder):
    """event times written to the millisecond and read back."""
    from lading.queries.readings import us

    stamp = s.utc_millis(F.timestamp_micros(us("ts")))
    return table(spark, folder, "events").select(
        "event_id", stamp.alias("time"), F.unix_millis(s.event_time(stamp)).alias("ms")
    )


def failure_texts(spark, folder):
    """labels of doubtful documents as failure texts."""
    labels = table(spark, folder, "labels").filter("quality = 0 or toxic = 1")
    text = s.failure_text(
        F.lit("0"), F.when(F.col("toxic") == 1, "toxic").otherwise("quality"),
        F.lit(""), F.concat(F.lit("document "), F.col("doc_id").cast("string")),
    )
    return labels.select("doc_id", text.alias("text"))


QUERIES = {
    "parse_bytes": parse_bytes,
    "email_problems": email_problems,
    "compression": compression,
    "crc_index": crc_index,
    "scalar_types": scalar_types,
    "scalar_problems": scalar_problems,
    "coerced_meta": coerced_meta,
    "dtype_codes": dtype_codes,
    "split_patterns": split_patterns,
    "event_times": event_times,
    "failure_texts": failure_texts,
}

_PRICES = """
texts AS (
  SELECT p_partkey, p_size, CASE
    WHEN p_size < 5 THEN '0x' || lower(to_hex(p_partkey))
    WHEN p_size < 10 THEN '0b' || bin(p_size)
    WHEN p_size < 15 THEN ' ' || p_partkey || '_000 '
    WHEN p_size < 20 THEN '0' || p_size
    WHEN p_size < 25 THEN CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR)
    WHEN p_size < 30 THEN 'TRUE' WHEN p_size < 35 THEN 'Null' WHEN p_size < 40 THEN p_name
    WHEN p_size < 45 THEN '-' || p_partkey ELSE 'nan' END AS text
  FROM part),
parsed AS (
  SELECT *, CASE WHEN p_size < 5 THEN p_partkey WHEN p_size < 10 THEN p_size
    WHEN p_size < 15 AND p_partkey > 0 THEN p_partkey * 1000 WHEN p_size < 15 THEN 0
    WHEN p_size BETWEEN 40 AND 44 THEN -p_partkey END AS as_int
  FROM texts)
"""

ORACLE = {
    "parse_bytes": """
WITH texts AS (
  SELECT CASE WHEN l_discount > 0.09 THEN '-' WHEN l_discount < 0.01 THEN '+' ELSE '' END AS sign,
    CASE WHEN l_quantity < 2 THEN '0_0' ELSE CAST(l_quantity AS INTEGER) || '_000' END AS digits,
    ['', ' kB', 'MiB', ' Gb', 'B', ' Q', ' xB', 'ki'][least(l_linenumber, 8)] AS unit
  FROM lineitem),
grouped AS (SELECT sign, digits, unit, count(*) AS n FROM texts GROUP BY ALL),
scaled AS (
  SELECT *, sign || digits || unit AS text,
    CASE trim(unit) WHEN '' THEN 1::HUGEINT WHEN 'B' THEN 1 WHEN 'kB' THEN 1000 WHEN 'MiB' THEN 1048576
      WHEN 'ki' THEN 1024 WHEN 'Q' THEN 1000000000000000000000000000000::HUGEINT END AS scale,
    CAST(replace(digits, '_', '') AS HUGEINT) AS num
  FROM grouped),
judged AS (
  SELECT *, CASE WHEN sign = '-' THEN 'may not be negative'
    WHEN scale IS NULL AND unit = ' Gb' THEN 'cannot scale from bits to bytes'
    WHEN scale IS NULL THEN 'unrecognized scale suffix ''' || trim(unit) || ''''
    WHEN num = 0 THEN 'may not be zero' END AS problem
  FROM scaled)
SELECT text, n, CASE WHEN problem IS NULL THEN CAST(num * scale AS VARCHAR) END AS bytes, problem FROM judged
""",
    "email_problems": """
WITH hosts AS (SELECT url, regexp_extract(url, 'https?://([^/]+)', 1) AS host FROM pages),
addresses AS (
  SELECT unnest(string_split(regexp_replace(text, '\\s', ' ', 'g'), ' ')) AS address FROM documents),
all_addresses AS (
  SELECT address FROM addresses WHERE contains(address, '@')
  UNION ALL
  SELECT CASE WHEN contains(url, 'utm_') THEN host WHEN contains(url, '#top') THEN 'a b@' || host
    WHEN url LIKE '%.html' THEN 'me@' || string_split(host, '.')[1]
    WHEN url LIKE '%/' THEN 'me@you@' || host ELSE 'me@' || host END
  FROM hosts)
SELECT address, CASE
  WHEN NOT contains(address, '@') THEN '''' || address || ''' has no @domain component'
  WHEN NOT regexp_matches(address, '^[\\p{L}\\p{N}_.!#$%&''*+/=?^`{|}~-]+@') THEN '''' || address || ''' has forbidden characters in the user@ part'
  WHEN NOT contains(substr(address, instr(address, '@') + 1), '.') THEN '''' || address || ''' doesn''t end with a fully qualified domain name'
  WHEN contains(substr(address, instr(address, '@') + 1), '@') THEN '''' || address || ''' contains too many @-signs'
  END AS problem
FROM all_addresses
""",
    "compression": """
WITH files AS (
  SELECT c_name || CASE WHEN c_nationkey < 8 THEN '.gz' WHEN c_nationkey < 14 THEN '.BZ2' WHEN c_nationkey < 20 THEN '.xz' ELSE '.dat' END AS path,
    CASE WHEN c_nationkey < 8 THEN '.gz' WHEN c_nationkey < 14 THEN '.bz2' WHEN c_nationkey < 20 THEN '.xz' END AS suffix,
    c_mktsegment = 'FURNITURE' AS empty,
    CASE c_mktsegment WHEN 'BUILDING' THEN '.gz' WHEN 'MACHINERY' THEN '.bz2' WHEN 'HOUSEHOLD' THEN NULL
      WHEN 'FURNITURE' THEN NULL ELSE '.xz' END AS content
  FROM customer),
named AS (
  SELECT *, CASE suffix WHEN '.gz' THEN 'gzip' WHEN '.bz2' THEN 'bzip2' WHEN '.xz' THEN 'XZ' END AS sname,
    CASE content WHEN '.gz' THEN 'gzip' WHEN '.bz2' THEN 'bzip2' WHEN '.xz' THEN 'XZ' END AS cname,
    empty OR content IS NOT DISTINCT FROM suffix AS agreed
  FROM files)
SELECT path, content, CASE WHEN agreed THEN suffix END AS extension,
  CASE WHEN NOT agreed THEN 'file extension indicates contents '
      || CASE WHEN suffix IS NULL THEN 'should be uncompressed' ELSE 'use ' || sname || ' compression' END
      || ' but they ' || CASE WHEN content IS NULL THEN 'are uncompressed' ELSE 'use ' || cname || ' compression' END
    WHEN suffix <> '.gz' THEN 'files in ' || sname || ' format are not accepted' END AS problem
FROM named
""",
    "scalar_types": f"""
WITH {_PRICES}
SELECT p_partkey, CASE WHEN as_int IS NOT NULL THEN 'int' WHEN p_size < 25 OR p_size >= 45 THEN 'float'
  WHEN p_size < 30 THEN 'bool' WHEN p_size < 35 THEN 'null' ELSE 'str' END AS type,
  CAST(as_int AS BIGINT) AS as_int, CASE WHEN p_size BETWEEN 25 AND 29 THEN true
    WHEN text = '0' OR text = '-0' AND false THEN false END AS as_bool
FROM parsed
""",
    "scalar_problems": f"""
WITH {_PRICES}
SELECT p_partkey, CASE WHEN as_int IS NULL THEN 'bad value; ''' || text || ''' could not be parsed as an integer' END AS problem
FROM parsed
""",
    "coerced_meta": """
WITH raw AS (SELECT o_orderkey, string_split(o_orderpriority, '-')[1] AS raw,
  CASE o_orderstatus WHEN 'F' THEN 'bool' WHEN 'O' THEN 'int' ELSE 'str' END AS wanted FROM orders)
SELECT o_orderkey, CASE WHEN wanted = 'bool' THEN CASE raw WHEN '1' THEN 'true' WHEN '0' THEN 'false' END ELSE raw END AS value,
  CASE WHEN wanted = 'bool' AND raw NOT IN ('0', '1') THEN 'could not interpret ''' || raw || ''' as bool' END AS problem
FROM raw
""",
    "dtype_codes": """
WITH texts AS (
  SELECT CASE p_type WHEN 'ECONOMY' THEN '<f' WHEN 'PROMO' THEN '>i' WHEN 'SMALL' THEN 'S' WHEN 'LARGE' THEN '|U' ELSE 'c' END AS head,
    CASE p_type WHEN 'ECONOMY' THEN 'f' WHEN 'PROMO' THEN 'i' WHEN 'SMALL' THEN 'V' WHEN 'LARGE' THEN 'V' ELSE 'c' END || p_size AS code,
    p_size FROM part)
SELECT head || p_size AS text, count(*) AS n, code,
  code IN ('f2','f4','f8','i1','i2','i4','i8','c8','c16') OR code LIKE 'V%' AS supported,
  code IN ('f2','f4','f8','i1','i2','i4','i8') OR code LIKE 'V%' AS in_parquet,
  code IN ('f4','f8','i2','i4','i8','c8','c16') OR code LIKE 'V%' AS in_fits
FROM texts GROUP BY ALL
""",
    "split_patterns": """
SELECT page_id, regexp_extract(url, 'https?://[^/]+(.*)$', 1) AS pattern, url LIKE 'https%' AS include FROM pages
""",
    "event_times": """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST((epoch_us(ts) // 1000) % 1000 AS VARCHAR), 3, '0') || 'Z' AS time,
  epoch_us(ts) // 1000 AS ms FROM events
""",
    "failure_texts": """
SELECT doc_id, '  0/' || CASE WHEN toxic = 1 THEN 'toxic' ELSE 'quality' END || chr(10) || '    document ' || doc_id AS text
FROM labels WHERE quality = 0 OR toxic = 1
""",
}
