"""Manifest operators: customers, orders and events as manifest, log, listing."""

from __future__ import annotations

from pyspark.sql import functions as F

from lading.operators import events as ev
from lading.operators import manifest as m
from lading.queries.readings import (
    EVENT_LOG_SQL,
    ORDER,
    USER_MANIFEST_SQL,
    event_log,
    table,
    user_manifest,
)


def _order_verdicts(spark, folder):
    """Orders as verdicts on their customer: finished orders are ok."""
    orders = table(spark, folder, "orders")
    log = orders.select(
        F.col("o_orderdate").alias("time"),
        F.col("o_orderkey").alias("seq"),
        F.lit("validation").alias("category"),
        F.col("o_custkey").cast("string").alias("ref"),
        F.when(F.col("o_orderstatus") == "F", "ok").otherwise("failure").alias("status"),
        F.col("o_orderpriority").alias("message"),
    )
    return ev.last_verdict(log, order=ORDER)


def _user_listing(spark, folder):
    users = table(spark, folder, "events").groupBy("user_id").agg(F.lit(1).alias("one"))
    return users.select(F.col("user_id").cast("string").alias("path"))


def resume_plan(spark, folder):
    index = user_manifest(spark, folder).select("path")
    return m.resume_plan(index, _order_verdicts(spark, folder), _user_listing(spark, folder))


def resume_summary(spark, folder):
    return m.nothing_to_do(resume_plan(spark, folder))


def _checked_orders(spark, folder):
    """Orders with their price as expected checksum, blank for low priority."""
    price = F.col("o_totalprice").cast("bigint").cast("string")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("path"),
        F.when(F.col("o_orderpriority") == "5-LOW", "")
        .when(F.col("o_orderpriority") == "2-HIGH", F.lit(None))
        .otherwise(price)
        .alias("checksum"),
    )


def _order_listing(spark, folder):
    """Orders that have lines; the checksum found is wrong for large quantities."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.max("l_quantity").alias("most")
    )
    orders = table(spark, folder, "orders")
    price = F.col("o_totalprice").cast("bigint").cast("string")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("l_orderkey").cast("string").alias("path"),
        F.when(F.col("most") >= 50, "0").otherwise(price).alias("checksum"),
    )


def presence_checksum(spark, folder):
    checked = m.check_presence_checksum(
        _checked_orders(spark, folder), _order_listing(spark, folder)
    )
    return checked.select("path", "status", "message")


def missing_targets(spark, folder):
    index = _checked_orders(spark, folder).select("path")
    return m.missing_targets(index, _order_listing(spark, folder))


def unexpected_files(spark, folder):
    transfers = ev.events_of(event_log(spark, folder), ["transfer"])
    return m.unexpected_files(transfers, user_manifest(spark, folder))


def queued_files(spark, folder):
    transfers = ev.events_of(event_log(spark, folder), ["transfer"], ["ok"])
    keys = transfers.select(F.col("ref").alias("path"))
    return m.select_queued(user_manifest(spark, folder), keys).select("path", "will_transfer")


def queue_conflicts(spark, folder):
    log = event_log(spark, folder)
    requested = ev.events_of(log, ["transfer"], ["ok"]).select(F.col("ref").alias("path"))
    judged = ev.events_of(log, ["validation"], ["failure"]).select(F.col("ref").alias("path"))
    index = user_manifest(spark, folder).withColumn(
        "status", F.when(F.col("will_transfer"), "waiting").otherwise("done")
    )
    return m.queue_conflicts(requested, index, judged)


def route_results(spark, folder):
    routed, unknown = ev.route_results(
        event_log(spark, folder), user_manifest(spark, folder), ORDER
    )
    known = routed.select("path", "status", F.lit(True).alias("indexed"))
    other = unknown.select(
        "path", F.lit(None).cast("string").alias("status"), F.lit(False).alias("indexed")
    )
    return known.unionByName(other)


def next_files(spark, folder):
    states = ev.manifest_states(
        user_manifest(spark, folder), ev.file_states(event_log(spark, folder), order=ORDER)
    )
    return m.next_files(states, 100).select("path", "state")


QUERIES = {
    "resume_plan": resume_plan,
    "resume_summary": resume_summary,
    "presence_checksum": presence_checksum,
    "missing_targets": missing_targets,
    "unexpected_files": unexpected_files,
    "queued_files": queued_files,
    "queue_conflicts": queue_conflicts,
    "route_results": route_results,
    "next_files": next_files,
}

_RESUME = f"""
WITH {USER_MANIFEST_SQL},
last AS (
  SELECT CAST(o_custkey AS VARCHAR) AS path, CASE o_orderstatus WHEN 'F' THEN 'ok' ELSE 'failure' END AS verdict
  FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
listing AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS path FROM events),
plan AS (
  SELECT m.path,
    CASE WHEN verdict IS NULL THEN 'new'
         WHEN verdict = 'ok' AND l.path IS NOT NULL THEN 'valid'
         WHEN verdict = 'ok' THEN 'missing' ELSE 'invalid' END AS reason
  FROM manifest m LEFT JOIN last USING (path) LEFT JOIN listing l ON l.path = m.path)
"""
_LISTING = """
listing AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS path,
    CASE WHEN max(l_quantity) >= 50 THEN '0' ELSE CAST(CAST(trunc(max(o_totalprice)) AS BIGINT) AS VARCHAR) END AS found
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey),
indexed AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS path,
    CASE o_orderpriority WHEN '5-LOW' THEN NULL WHEN '2-HIGH' THEN NULL
      ELSE CAST(CAST(trunc(o_totalprice) AS BIGINT) AS VARCHAR) END AS wanted
  FROM orders)
"""

ORACLE = {
    "resume_plan": f"{_RESUME} SELECT path, reason, reason <> 'valid' AS will_transfer FROM plan",
    "resume_summary": f"""{_RESUME}
SELECT count(*) AS n_files, count(*) FILTER (reason = 'valid') AS n_valid,
  count(*) FILTER (reason = 'invalid') AS n_invalid, count(*) FILTER (reason = 'missing') AS n_missing,
  bool_and(reason = 'valid') AS all_valid
FROM plan
""",
    "presence_checksum": f"""
WITH {_LISTING},
checked AS (
  SELECT i.path, CASE WHEN l.path IS NULL THEN 'file not found'
    WHEN wanted IS NOT NULL AND wanted <> found
    THEN 'incorrect crc32 checksum: expected ' || wanted || ', got ' || found END AS message
  FROM indexed i LEFT JOIN listing l ON l.path = i.path)
SELECT path, CASE WHEN message IS NULL THEN 'ok' ELSE 'failure' END AS status, message FROM checked
""",
    "missing_targets": f"""
WITH {_LISTING} SELECT path FROM indexed WHERE path NOT IN (SELECT path FROM listing)
""",
    "unexpected_files": f"""
WITH {EVENT_LOG_SQL}, {USER_MANIFEST_SQL}
SELECT ref, count(*) AS n_reports FROM log
WHERE category = 'transfer' AND ref NOT IN (SELECT path FROM manifest) GROUP BY ref
""",
    "queued_files": f"""
WITH {EVENT_LOG_SQL}, {USER_MANIFEST_SQL}
SELECT path, will_transfer FROM manifest
WHERE path IN (SELECT ref FROM log WHERE category = 'transfer' AND status = 'ok')
""",
    "queue_conflicts": f"""
WITH {EVENT_LOG_SQL}, {USER_MANIFEST_SQL},
req AS (SELECT ref AS path, count(*) AS n FROM log WHERE category = 'transfer' AND status = 'ok' GROUP BY ref),
judged AS (SELECT DISTINCT ref FROM log WHERE category = 'validation' AND status = 'failure')
SELECT path, 'duplicate' AS problem FROM req WHERE n > 1
UNION ALL SELECT path, 'not indexed' FROM req WHERE path NOT IN (SELECT path FROM manifest)
UNION ALL SELECT path, 'already validated' FROM req
  WHERE path IN (SELECT path FROM manifest WHERE NOT will_transfer)
UNION ALL SELECT path, 'already queued' FROM req WHERE path IN (SELECT ref FROM judged)
""",
    "route_results": f"""
WITH {EVENT_LOG_SQL}, {USER_MANIFEST_SQL},
last AS (
  SELECT ref, status FROM log WHERE category = 'validation'
  QUALIFY row_number() OVER (PARTITION BY ref ORDER BY time DESC, seq DESC) = 1)
SELECT path, status, true AS indexed FROM manifest LEFT JOIN last ON ref = path
UNION ALL
SELECT ref, NULL, false FROM last WHERE ref NOT IN (SELECT path FROM manifest)
""",
    "next_files": f"""
WITH {EVENT_LOG_SQL}, {USER_MANIFEST_SQL},
facts AS (
  SELECT ref, count(*) FILTER (category = 'validation') AS nv,
    count(*) FILTER (category = 'transfer' AND status = 'ok') AS sent,
    count(*) FILTER (category = 'transfer' AND status <> 'ok') AS failed
  FROM log GROUP BY ref)
SELECT path, CASE WHEN failed > 0 THEN 'failed' ELSE 'ready' END AS state
FROM manifest LEFT JOIN facts ON ref = path
WHERE coalesce(nv, 0) = 0 AND coalesce(sent, 0) = 0 AND coalesce(failed, 0) < 2
ORDER BY pos LIMIT 100
""",
}
