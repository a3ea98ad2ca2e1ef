"""The test tables read as the engine's own tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lading.materialise import stored
from lading.operators import scans


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def of_row(value: str, column: str) -> Column:
    """A constant type name tied to its row, so that it stays a join key."""
    return F.when(F.col(column).isNotNull(), F.lit(value))


def us(ts: str) -> Column:
    """Microseconds of a timestamp without zone, whatever the session's zone."""
    day = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    minutes = day * 1440 + F.hour(ts) * 60 + F.minute(ts)
    seconds = F.date_part(F.lit("SECOND"), F.col(ts))  # decimal with six digits
    return minutes * 60_000_000 + (seconds * 1_000_000).cast("bigint")


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    """`events` as a transfer log; refs are users, order is (time, seq).

    view: transfer ok, click: transfer failed, purchase: verdict ok,
    error: verdict failed, signup: heartbeat.
    """
    kind = F.col("event_type")
    category = (
        F.when(kind.isin("view", "click"), "transfer")
        .when(kind.isin("purchase", "error"), "validation")
        .otherwise("keepalive")
    )
    return table(spark, folder, "events").select(
        us("ts").alias("time"),
        category.alias("category"),
        F.col("user_id").cast("string").alias("ref"),
        F.when(kind.isin("click", "error"), "failure").otherwise("ok").alias("status"),
        F.when(kind == "error", F.col("props")).alias("message"),
        F.lit("client").alias("agent_id"),
        F.col("event_id").alias("seq"),
    )


ORDER = ("time", "seq")

EVENT_LOG_SQL = """
log AS (
  SELECT epoch_us(ts) AS time,
    CASE WHEN event_type IN ('view','click') THEN 'transfer'
         WHEN event_type IN ('purchase','error') THEN 'validation'
         ELSE 'keepalive' END AS category,
    CAST(user_id AS VARCHAR) AS ref,
    CASE WHEN event_type IN ('click','error') THEN 'failure' ELSE 'ok' END AS status,
    CASE WHEN event_type = 'error' THEN props END AS message,
    event_id AS seq
  FROM events)
"""


def log_bucket() -> Column:
    """A day of the log."""
    return F.floor(F.col("time") / F.lit(86_400_000_000))


def log_time() -> Column:
    return F.timestamp_micros("time")


def session_log(spark: SparkSession, folder: str) -> DataFrame:
    """`events` as one session per user: start, transfers, verdicts, the end.

    signup: start, view: transfer, purchase: verdict, click: heartbeat,
    error: shutdown, in error for values above 15, else a stop row below 1.
    """
    kind, value = F.col("event_type"), F.col("value")
    ending = (kind == "error") & (value >= 1)
    category = (
        F.when(kind == "signup", "start")
        .when(kind == "view", "transfer")
        .when(kind == "purchase", "validation")
        .when(kind == "click", "keepalive")
        .when(ending, "shutdown")
        .otherwise("stop")
    )
    return table(spark, folder, "events").select(
        us("ts").alias("time"),
        category.alias("category"),
        F.col("user_id").cast("string").alias("delivery"),
        F.when(ending & (value > 15), "error").otherwise("ok").alias("status"),
        F.concat(F.lit("value "), F.floor("value").cast("string")).alias("message"),
        F.col("event_id").alias("seq"),
        F.lit(5).cast("bigint").alias("n_expected"),
    )


SESSION_LOG_SQL = """
log AS (
  SELECT epoch_us(ts) AS time,
    CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'transfer'
      WHEN 'purchase' THEN 'validation' WHEN 'click' THEN 'keepalive'
      ELSE CASE WHEN value >= 1 THEN 'shutdown' ELSE 'stop' END END AS category,
    CAST(user_id AS VARCHAR) AS delivery,
    CASE WHEN event_type = 'error' AND value >= 1 AND value > 15 THEN 'error' ELSE 'ok' END AS status,
    'value ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS message,
    event_id AS seq
  FROM events)
"""


def user_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Customers in credit as the manifest of a delivery; paths are their keys."""
    return table(spark, folder, "customer").filter(F.col("c_acctbal") >= 0).select(
        F.col("c_custkey").cast("string").alias("path"),
        (F.col("c_mktsegment") != "BUILDING").alias("will_transfer"),
        F.col("c_custkey").alias("pos"),
    )


USER_MANIFEST_SQL = """
manifest AS (
  SELECT CAST(c_custkey AS VARCHAR) AS path, c_mktsegment <> 'BUILDING' AS will_transfer,
    c_custkey AS pos
  FROM customer WHERE c_acctbal >= 0)
"""


def line_items(
    spark: SparkSession, folder: str, *columns: str, keep: bool = True
) -> DataFrame:
    """Each order as a file, its line items as ordered entries from 0.

    The position is a running count cut into buckets of 4096 line numbers.
    `keep` materialises the result, for readers that use it several times.
    """
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
    lines = table(spark, folder, "lineitem").select(
        *dict.fromkeys(["l_orderkey", *order, *columns])
    )
    counted = scans.running(
        lines, ["l_orderkey"], [F.col(c) for c in order],
        scans.position_bucket(F.col("l_linenumber")), {"__n": ("sum", F.lit(1))},
    )
    items = counted.select("l_orderkey", (F.col("__n") - 1).cast("int").alias("pos"), *columns)
    return stored(items) if keep else items


LINE_ITEMS_SQL = """
lines AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) - 1 AS INTEGER) AS pos
  FROM lineitem)
"""
