"""Event-log operators over `events` (see readings.event_log)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lading.functions.names import resolve_path
from lading.functions.scalars import nested_to_text
from lading.operators import events as ev
from lading.operators.manifest import can_transfer, is_complete, no_retry
from lading.queries.readings import (
    EVENT_LOG_SQL,
    ORDER,
    SESSION_LOG_SQL,
    USER_MANIFEST_SQL,
    event_log,
    log_bucket,
    log_time,
    session_log,
    table,
    user_manifest,
)
from lading.sources.files import report_message

FAILURE_LIMIT = 10


def last_verdict(spark, folder):
    return ev.last_verdict(event_log(spark, folder), order=ORDER)


def event_seq(spark, folder):
    numbered = ev.event_seq(event_log(spark, folder), order=ORDER, bucket=log_bucket())
    return numbered.select(F.col("seq").cast("bigint").alias("arrival"), "ref", "time")


def _history(spark, folder):
    return ev.verdict_history(event_log(spark, folder), order=ORDER, bucket=log_bucket())


def double_verdicts(spark, folder):
    return ev.double_verdicts(_history(spark, folder)).select(
        "ref", "seq", F.col("verdict_no").cast("bigint").alias("verdict_no"), "problem"
    )


def premature_verdicts(spark, folder):
    return ev.premature_verdicts(_history(spark, folder)).select("ref", "seq", "problem")


def _states(spark, folder):
    return ev.file_states(event_log(spark, folder), order=ORDER)


def file_states(spark, folder):
    return _states(spark, folder).select("ref", "state", "retries", "message", "n_verdicts")


def transfer_counters(spark, folder):
    return ev.transfer_counters(event_log(spark, folder), user_manifest(spark, folder))


def failed_attempts(spark, folder):
    counted = ev.failed_attempts(event_log(spark, folder), user_manifest(spark, folder))
    return counted.select("path", "n_fail")


def progress(spark, folder):
    states = ev.manifest_states(user_manifest(spark, folder), _states(spark, folder))
    return ev.progress(states, ["will_transfer"])


def delivery_report(spark, folder):
    return ev.delivery_report(
        user_manifest(spark, folder), _states(spark, folder),
        {"dataset": "users", "delivery_id": "1", "transfer_type": "full", "label_path": "s3a://labels/users/1"},
        event_log(spark, folder), F.lit("2026-01-01T00:00:00.000Z"), "stopped by hand",
    )


def delivery_errors(spark, folder):
    return ev.delivery_errors(user_manifest(spark, folder), _states(spark, folder))


def all_keepalive(spark, folder):
    """A18 for batches of an hour."""
    log = event_log(spark, folder).withColumn("batch", F.floor(F.col("time") / F.lit(3_600_000_000)))
    return ev.all_keepalive(log, ["batch"])


def silences(spark, folder):
    found = ev.silences(
        event_log(spark, folder), log_time(), ["ref"], 86_400, 172_800, ORDER
    )
    return found.select("ref", "seq", F.round("gap_seconds", 3).alias("gap_seconds"), "condition")


def sessions(spark, folder):
    return ev.sessions(event_log(spark, folder), log_time(), 43_200, ["ref"], ORDER).select(
        "ref", F.col("session").cast("bigint").alias("session"), "start_us", "end_us", "n_events"
    )


def heartbeat_due(spark, folder):
    due = ev.heartbeat_due(event_log(spark, folder), log_time(), 36_000, ["ref"], ORDER)
    return due.select("ref", "seq")


def failure_trip(spark, folder):
    failed = ev.is_verdict() & (F.col("status") != "ok")
    tripped = ev.failure_trip(
        event_log(spark, folder), failed, ["ref"], FAILURE_LIMIT, ORDER, log_bucket()
    )
    return tripped.select("ref", "seq", "time")


def first_shutdown_reason(spark, folder):
    return ev.first_shutdown_reason(session_log(spark, folder), ["delivery"], ORDER)


def session_status(spark, folder):
    return ev.session_status(
        session_log(spark, folder), F.col("n_expected"), ["delivery"], ORDER, log_bucket()
    )


def protocol_errors(spark, folder):
    return ev.protocol_errors(session_log(spark, folder), ["delivery"], ORDER)


def failed_verdicts(spark, folder):
    log = ev.events_of(event_log(spark, folder), ["validation"], list(ev.FAILED))
    return log.select("ref", "time", "message")


def appended_log(spark, folder):
    """The log put together from one chunk per category."""
    log = event_log(spark, folder)
    chunks = [ev.events_of(log, [c]) for c in ("transfer", "validation", "keepalive")]
    return (
        ev.append_events(*chunks)
        .groupBy("category", "status")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def file_flags(spark, folder):
    """What may still happen to each file of the manifest."""
    states = ev.manifest_states(user_manifest(spark, folder), _states(spark, folder))
    return states.select(
        resolve_path("s3a://bucket/users/", F.col("path")).alias("path"),
        can_transfer().alias("can_transfer"),
        no_retry().alias("no_retry"),
        is_complete().alias("is_complete"),
    )


def report_messages(spark, folder):
    """The delivery report as a message."""
    return report_message(delivery_report(spark, folder))


def nested_messages(spark, folder):
    """nested values in log texts."""
    events = table(spark, folder, "events")
    nested = F.struct(F.col("event_type").alias("type"), F.array("user_id", "event_id").alias("ids"))
    return events.select("event_id", nested_to_text(nested).alias("message"))


QUERIES = {
    "file_flags": file_flags,
    "report_messages": report_messages,
    "nested_messages": nested_messages,
    "last_verdict": last_verdict,
    "event_seq": event_seq,
    "double_verdicts": double_verdicts,
    "premature_verdicts": premature_verdicts,
    "file_states": file_states,
    "transfer_counters": transfer_counters,
    "failed_attempts": failed_attempts,
    "progress": progress,
    "delivery_report": delivery_report,
    "delivery_errors": delivery_errors,
    "all_keepalive": all_keepalive,
    "silences": silences,
    "sessions": sessions,
    "heartbeat_due": heartbeat_due,
    "failure_trip": failure_trip,
    "first_shutdown_reason": first_shutdown_reason,
    "session_status": session_status,
    "protocol_errors": protocol_errors,
    "failed_verdicts": failed_verdicts,
    "appended_log": appended_log,
}

_HISTORY = f"""
WITH {EVENT_LOG_SQL},
history AS (
  SELECT *,
    sum(CASE WHEN category = 'validation' THEN 1 ELSE 0 END) OVER w AS verdict_no,
    max(CASE WHEN category = 'transfer' AND status = 'ok' THEN 1 ELSE 0 END) OVER w AS sent
  FROM log WINDOW w AS (PARTITION BY ref ORDER BY time, seq ROWS UNBOUNDED PRECEDING))
"""
_DOUBLE = "improper double validation"
_EARLY = "validator reported success before transfer complete"
STATES_SQL = f"""
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY ref, category ORDER BY time, seq) AS rn FROM log),
facts AS (
  SELECT ref,
    min((time, seq)) FILTER (category = 'transfer' AND status = 'ok') AS sent,
    min((time, seq)) FILTER (category = 'validation') AS judged,
    max(status) FILTER (category = 'validation' AND rn = 1) AS first_status,
    max(message) FILTER (category = 'validation' AND rn = 1) AS first_message,
    count(*) FILTER (category = 'validation') AS n_verdicts,
    count(*) FILTER (category = 'transfer' AND status <> 'ok') AS retries
  FROM ranked GROUP BY ref),
states AS (
  SELECT ref, retries, n_verdicts,
    CASE WHEN n_verdicts > 1 THEN 'invalid'
         WHEN n_verdicts = 1 AND (sent IS NULL OR sent > judged) THEN 'invalid'
         WHEN n_verdicts = 1 AND first_status = 'ok' THEN 'valid'
         WHEN n_verdicts = 1 THEN 'invalid'
         WHEN sent IS NOT NULL THEN 'done'
         WHEN retries > 0 THEN 'failed' ELSE 'ready' END AS state,
    CASE WHEN n_verdicts > 1 THEN '{_DOUBLE}'
         WHEN n_verdicts = 1 AND (sent IS NULL OR sent > judged) THEN '{_EARLY}'
         WHEN n_verdicts = 1 AND first_status <> 'ok' THEN first_message END AS message
  FROM facts)
"""
_MANIFEST_STATES = f"""
WITH {EVENT_LOG_SQL}, {USER_MANIFEST_SQL}, {STATES_SQL},
known AS (
  SELECT path, will_transfer, coalesce(state, 'ready') AS state, coalesce(retries, 0) AS retries, message
  FROM manifest LEFT JOIN states ON ref = path)
"""
_GAPS = f"""
WITH {EVENT_LOG_SQL},
gaps AS (
  SELECT *, (time - lag(time) OVER w) / 1000000.0 AS gap, (lead(time) OVER w - time) / 1000000.0 AS ahead,
    time - lag(time) OVER w AS gap_us
  FROM log WINDOW w AS (PARTITION BY ref ORDER BY time, seq))
"""

_STRAYS = (
    "(SELECT count(*) FROM log WHERE category = 'transfer'"
    " AND NOT EXISTS (SELECT 1 FROM manifest WHERE path = log.ref))"
)

ORACLE = {
    "file_flags": f"""{_MANIFEST_STATES}
SELECT 's3a://bucket/users/' || path AS path,
  state = 'ready' OR (state = 'failed' AND retries < 2) AS can_transfer,
  state = 'failed' AND retries >= 2 AS no_retry,
  state IN ('valid', 'invalid') OR (state = 'failed' AND retries >= 2) AS is_complete
FROM known
""",
    "report_messages": f"""{_MANIFEST_STATES},
c AS (
  SELECT count(*) AS n, count(*) FILTER (state IN ('valid','invalid')) AS done,
    count(*) FILTER (state = 'invalid') AS bad, CAST(sum(retries) AS BIGINT) + {_STRAYS} AS failed
  FROM known WHERE will_transfer)
SELECT '{{"dataset":"users","delivery_id":"1","transfer_type":"full","label_path":"s3a://labels/users/1","files_expected":' || n || ',"files_validated":' || done
  || ',"n_errors":' || bad || ',"total_failures":' || (bad + failed) || ',"validation_result":"'
  || CASE WHEN done <> n THEN 'incomplete' WHEN bad > 0 THEN 'failure' ELSE 'success' END
  || '","completed_at":"2026-01-01T00:00:00.000Z","pipeline_exception":"stopped by hand"}}' AS value
FROM c
""",
    "nested_messages": """
SELECT event_id, '{"type":"' || event_type || '","ids":[' || user_id || ',' || event_id || ']}' AS message FROM events
""",
    "last_verdict": f"""
WITH {EVENT_LOG_SQL}
SELECT ref, status, message FROM log WHERE category = 'validation'
QUALIFY row_number() OVER (PARTITION BY ref ORDER BY time DESC, seq DESC) = 1
""",
    "event_seq": f"""
WITH {EVENT_LOG_SQL}
SELECT row_number() OVER (PARTITION BY ref ORDER BY time, seq) AS arrival, ref, time FROM log
""",
    "double_verdicts": f"""{_HISTORY}
SELECT ref, seq, CAST(verdict_no AS BIGINT) AS verdict_no, '{_DOUBLE}' AS problem
FROM history WHERE category = 'validation' AND verdict_no > 1
""",
    "premature_verdicts": f"""{_HISTORY}
SELECT ref, seq, '{_EARLY}' AS problem
FROM history WHERE category = 'validation' AND verdict_no = 1 AND sent = 0
""",
    "file_states": f"""
WITH {EVENT_LOG_SQL}, {STATES_SQL}
SELECT ref, state, retries, message, n_verdicts FROM states
""",
    "transfer_counters": f"""
WITH {EVENT_LOG_SQL}, {USER_MANIFEST_SQL},
t AS (SELECT status, ref IN (SELECT path FROM manifest) AS known FROM log WHERE category = 'transfer')
SELECT count(*) FILTER (NOT known) AS n_wrong,
  count(*) FILTER (known AND status <> 'ok') AS n_failed,
  count(*) FILTER (known AND status = 'ok') AS n_ok
FROM t
""",
    "failed_attempts": f"""
WITH {EVENT_LOG_SQL}, {USER_MANIFEST_SQL}
SELECT path, count(ref) AS n_fail FROM manifest
LEFT JOIN log ON ref = path AND category = 'transfer' AND status <> 'ok' GROUP BY path
""",
    "progress": f"""{_MANIFEST_STATES}
SELECT will_transfer, count(*) AS n_files,
  count(*) FILTER (state IN ('valid','invalid') OR (state = 'failed' AND retries >= 2)) AS n_complete,
  count(*) FILTER (state = 'valid') AS n_valid,
  count(*) FILTER (state = 'failed' AND retries >= 2) AS n_given_up,
  bool_and(NOT (state = 'ready' OR (state = 'failed' AND retries < 2))) AS transfer_complete,
  bool_and(state IN ('valid','invalid') OR (state = 'failed' AND retries >= 2)) AS validation_complete
FROM known GROUP BY will_transfer
""",
    "delivery_report": f"""{_MANIFEST_STATES},
c AS (
  SELECT count(*) AS files_expected, count(*) FILTER (state IN ('valid','invalid')) AS files_validated,
    count(*) FILTER (state = 'invalid') AS n_errors, CAST(sum(retries) AS BIGINT) + {_STRAYS} AS failed
  FROM known WHERE will_transfer)
SELECT 'users' AS dataset, '1' AS delivery_id, 'full' AS transfer_type, 's3a://labels/users/1' AS label_path,
  files_expected, files_validated, n_errors, n_errors + failed AS total_failures,
  CASE WHEN files_validated <> files_expected THEN 'incomplete'
       WHEN n_errors > 0 THEN 'failure' ELSE 'success' END AS validation_result,
  '2026-01-01T00:00:00.000Z' AS completed_at, 'stopped by hand' AS pipeline_exception
FROM c
""",
    "delivery_errors": f"""{_MANIFEST_STATES}
SELECT path, message FROM known WHERE will_transfer AND state = 'invalid'
""",
    "all_keepalive": f"""
WITH {EVENT_LOG_SQL}
SELECT time // 3600000000 AS batch, bool_and(category = 'keepalive') AS all_keepalive FROM log GROUP BY 1
""",
    "silences": f"""{_GAPS}
SELECT ref, seq, CAST(round(gap, 3) AS DOUBLE) AS gap_seconds,
  CASE WHEN gap > 172800 THEN 'absent' ELSE 'missing' END AS condition
FROM gaps WHERE gap > 86400
""",
    "sessions": f"""{_GAPS},
numbered AS (
  SELECT *, sum(CASE WHEN gap_us IS NULL OR gap_us > 43200000000 THEN 1 ELSE 0 END)
    OVER (PARTITION BY ref ORDER BY time, seq ROWS UNBOUNDED PRECEDING) AS session
  FROM gaps)
SELECT ref, CAST(session AS BIGINT) AS session, min(time) AS start_us, max(time) AS end_us,
  count(*) AS n_events
FROM numbered GROUP BY ref, session
""",
    "heartbeat_due": f"{_GAPS} SELECT ref, seq FROM gaps WHERE ahead > 36000",
    "failure_trip": f"""
WITH {EVENT_LOG_SQL}
SELECT ref, seq, time FROM log WHERE category = 'validation' AND status <> 'ok'
QUALIFY row_number() OVER (PARTITION BY ref ORDER BY time, seq) = {FAILURE_LIMIT + 1}
""",
    "first_shutdown_reason": f"""
WITH {SESSION_LOG_SQL}
SELECT delivery, message AS reason FROM log WHERE category = 'shutdown'
QUALIFY row_number() OVER (PARTITION BY delivery ORDER BY time, seq) = 1
""",
    "session_status": f"""
WITH {SESSION_LOG_SQL},
ends AS (
  SELECT delivery, time, seq, category FROM log
  WHERE category = 'stop' OR (category = 'shutdown' AND status = 'error')
  QUALIFY row_number() OVER (PARTITION BY delivery ORDER BY time, seq) = 1),
lasts AS (
  SELECT delivery, category FROM log
  QUALIFY row_number() OVER (PARTITION BY delivery ORDER BY time DESC, seq DESC) = 1),
facts AS (
  SELECT l.delivery, count(*) AS n_rows, count(*) FILTER (l.category = 'keepalive') AS n_keepalive,
    count(*) FILTER (l.category = 'stop') AS n_stop,
    count(*) FILTER (l.category = 'validation' AND (e.time IS NULL OR (l.time, l.seq) < (e.time, e.seq))) AS n_completed,
    max(e.category) AS how
  FROM log l LEFT JOIN ends e ON e.delivery = l.delivery GROUP BY l.delivery)
SELECT f.delivery,
  CASE WHEN n_stop > 1 THEN 'invalid' WHEN how = 'shutdown' THEN 'crashed'
       WHEN how = 'stop' AND n_completed >= 5 THEN 'done' WHEN how = 'stop' THEN 'quit'
       WHEN lasts.category = 'shutdown' THEN 'shutting_down' ELSE 'working' END AS status,
  n_completed, n_rows, n_keepalive
FROM facts f JOIN lasts ON lasts.delivery = f.delivery
""",
    "protocol_errors": f"""
WITH {SESSION_LOG_SQL},
facts AS (
  SELECT delivery, count(*) FILTER (category = 'stop') AS n_stop,
    min((time, seq)) FILTER (category = 'stop' OR (category = 'shutdown' AND status = 'error')) AS ended,
    max((time, seq)) FILTER (category IN ('transfer', 'start')) AS busy,
    max((time, seq)) FILTER (category = 'keepalive') AS beat
  FROM log GROUP BY delivery)
SELECT delivery, 'too many stop rows' AS problem FROM facts WHERE n_stop > 1
UNION ALL SELECT delivery, 'activity after the end' FROM facts WHERE busy > ended
UNION ALL SELECT delivery, 'heartbeat after the end' FROM facts WHERE beat > ended
""",
    "failed_verdicts": f"""
WITH {EVENT_LOG_SQL}
SELECT ref, time, message FROM log WHERE category = 'validation' AND status = 'failure'
""",
    "appended_log": f"""
WITH {EVENT_LOG_SQL} SELECT category, status, count(*) AS n_rows FROM log GROUP BY 1, 2
""",
}
