"""The event operators as Structured Streaming jobs over the table files.

Each stream reads the whole `events` table in micro-batches, runs until all
is worked off and hands its result table back as a batch DataFrame.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lading.materialise import stored
from lading.operators import events as ev
from lading.operators.classify import classify
from lading.queries import eventlog
from lading.queries.checks import CHECK_LABEL
from lading.queries.readings import (
    EVENT_LOG_SQL,
    ORDER,
    SESSION_LOG_SQL,
    USER_MANIFEST_SQL,
    event_log,
    session_log,
    user_manifest,
)
from lading.sources import events as se
from lading.sources.files import read_index, scan_files, write_index
from lading.sources.tail import tail_events
from lading.spec import Specs
from lading.streaming import session
from lading.streaming.delivery import (
    checkpoint_dir,
    file_state_stream,
    incremental_validate,
    resume,
)


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder on storage all executors share (a local one only in local mode)."""
    if spark.conf.get("spark.checkpoint.dir", None):
        from uuid import uuid4

        return checkpoint_dir(spark, f"{name}-{uuid4().hex}")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix=f"lading-{name}-")


def _arriving(rows: DataFrame, log: str, n: int = 4) -> Iterator[None]:
    """Rows written to a log chunk by chunk, one after the other in time."""
    ends = rows.agg(F.min("time").alias("first"), F.max("time").alias("last")).first()
    step = (ends.last - ends.first) // n + 1
    for i in range(n):
        start = ends.first + i * step
        chunk = rows.filter((F.col("time") >= start) & (F.col("time") < start + step))
        yield chunk.write.mode("append").parquet(log)


def _chunks(rows: DataFrame) -> tuple[str, str]:
    """Rows as a folder of chunk files that arrived one after the other in time."""
    folder = _scratch(rows.sparkSession, "chunks")
    for _ in _arriving(rows, f"{folder}/log"):
        pass
    return folder, f"{folder}/log"


def _follow(rows: DataFrame) -> tuple[DataFrame, str]:
    folder, log = _chunks(rows)
    spark = rows.sparkSession
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(log)
    return stream, folder


def _complete(stream: DataFrame, folder: str) -> DataFrame:
    """Final result of an aggregating stream: its last complete table."""
    spark = stream.sparkSession

    def keep(table: DataFrame, batch_id: int) -> None:
        table.write.mode("overwrite").parquet(f"{folder}/result/batch={batch_id}")

    query = (
        stream.writeStream.outputMode("complete")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(keep)
        .start()
    )
    query.awaitTermination()
    last = query.lastProgress["batchId"]
    return spark.read.schema(stream.schema).parquet(f"{folder}/result/batch={last}")


def stream_file_states(spark, folder):
    """States of all refs after the whole log was streamed."""
    stream, scratch = _follow(event_log(spark, folder))
    states = _complete(file_state_stream(stream, order=ORDER), scratch)
    return states.select("ref", "state", "retries", "message", "n_verdicts")


def stream_progress(spark, folder):
    """Verdicts per user."""
    stream, scratch = _follow(event_log(spark, folder))
    return _complete(session.live_progress(stream, ["ref"]), scratch)


def stream_failures(spark, folder):
    """Failures per user and whether they exceed the limit."""
    stream, scratch = _follow(event_log(spark, folder))
    return _complete(session.trip_on_failures(stream, ["ref"], 25), scratch)


def stream_once_only(spark, folder):
    """Refs ever reported as transferred, each once."""
    stream, scratch = _follow(event_log(spark, folder))
    once = session.once_only(stream.filter(ev.transfer_ok())).select("ref")
    query = (
        once.writeStream.format("parquet")
        .option("path", f"{scratch}/result")
        .option("checkpointLocation", f"{scratch}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(once.schema).parquet(f"{scratch}/result")


def stream_sessions(spark, folder):
    """Sessions folded with state, weeks in parallel; last row per session.

    A chunk of the log may have many files, in which sessions overlap, so each
    chunk is worked off as a whole before the next one arrives.
    """
    log = stored(session_log(spark, folder))
    scratch = _scratch(spark, "chunks")
    week = F.floor(F.col("time") / (7 * 86_400_000_000))

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{scratch}/result/batch={batch_id}")

    for _ in _arriving(log, f"{scratch}/log"):
        stream = spark.readStream.schema(log.schema).parquet(f"{scratch}/log")
        current = session.session_stream(stream, ORDER, timeouts=False, segment=week)
        query = (
            current.writeStream.outputMode("append")
            .option("checkpointLocation", f"{scratch}/checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(keep)
            .start()
        )
        query.awaitTermination()
    rows = spark.read.parquet(f"{scratch}/result")
    last = rows.groupBy("delivery").agg(F.max_by(F.struct("status", "n_rows"), "batch").alias("s"))
    return last.select("delivery", "s.status", "s.n_rows")


def stream_event_text(spark, folder):
    """Events written as a TSV log, streamed back, rows checked."""
    scratch = _scratch(spark, "tsv")
    rows = event_log(spark, folder).select(
        F.col("seq").cast("string").alias("time"), "category",
        F.when(F.col("category") == "keepalive", "").otherwise(F.col("ref")).alias("ref"), "status",
        F.concat(F.lit('says "'), F.coalesce("message", F.lit("-")), F.lit('"\n\tin two lines')).alias("message"),
    )
    se.write_events(rows, f"{scratch}/log", {"agent_id": "client"})
    stream = se.stream_events(spark, f"{scratch}/log")
    query = (
        stream.select("time", "category", "ref", "message", "problem")
        .writeStream.format("parquet")
        .option("path", f"{scratch}/result")
        .option("checkpointLocation", f"{scratch}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    read = spark.read.schema(
        "time string, category string, ref string, message string, problem string"
    ).parquet(f"{scratch}/result")
    return read.select(
        F.col("time").cast("bigint").alias("seq"), "category", "ref", "message", "problem"
    )


def tailed_log(spark, folder):
    """The same log followed by its byte offsets; every seventh row lacks its status."""
    scratch = _scratch(spark, "tail")
    rows = event_log(spark, folder).select(
        F.col("seq").cast("string").alias("time"), "category",
        F.when(F.col("category") == "keepalive", "-").otherwise(F.col("ref")).alias("ref"),
        F.when(F.col("seq") % 7 == 0, "").otherwise(F.col("status")).alias("status"),
        F.concat(F.lit('says "'), F.coalesce("message", F.lit("-")), F.lit('"\n\tin two lines')).alias("message"),
    )
    se.write_events(rows, f"{scratch}/log", {"agent_id": "client"})
    stream = tail_events(spark, f"{scratch}/log", most_bytes=1 << 20)
    query = (
        stream.select("time", "category", "ref", "status", "message", "problem")
        .writeStream.format("parquet")
        .option("path", f"{scratch}/result")
        .option("checkpointLocation", f"{scratch}/checkpoint")
        .start()
    )
    query.processAllAvailable()
    query.stop()
    read = spark.read.schema(
        "time string, category string, ref string, status string, message string, problem string"
    ).parquet(f"{scratch}/result")
    return read.select(F.col("time").cast("bigint").alias("seq"), "category", "ref", "status", "message", "problem")


def incremental_verdicts(spark, folder):
    """The table files reported in a client log, judged as they
    come in; then what a resumed delivery would do with each."""
    scratch = _scratch(spark, "delivery")
    specs = Specs.from_labels(spark, [CHECK_LABEL])
    listing = scan_files(spark, folder)
    index = classify(listing.select("path"), specs).select(
        "path", "type", F.lit(True).alias("will_transfer")
    )
    reports = listing.filter(F.col("path") != "region.parquet").select(
        F.lit("transfer").alias("category"), F.col("path").alias("ref"), F.lit("ok").alias("status")
    )
    se.write_events(reports, f"{scratch}/client", {"agent_id": "client"})
    stream = se.good_rows(se.stream_events(spark, f"{scratch}/client", chunks_per_batch=100))
    incremental_validate(
        stream, index, specs, folder, f"{scratch}/verdicts", f"{scratch}/conflicts", f"{scratch}/checkpoint"
    ).awaitTermination()
    plan = resume(spark, index, f"{scratch}/verdicts", listing)
    return plan.select(F.regexp_replace("path", r"\.parquet$", "").alias("tab"), "reason")


def index_roundtrip(spark, folder):
    """A manifest written as CSV and read back."""
    scratch = _scratch(spark, "index")
    write_index(user_manifest(spark, folder), f"{scratch}/index")
    return read_index(spark, f"{scratch}/index")


QUERIES = {
    "tailed_log": tailed_log,
    "incremental_verdicts": incremental_verdicts,
    "index_roundtrip": index_roundtrip,
    "stream_file_states": stream_file_states,
    "stream_progress": stream_progress,
    "stream_failures": stream_failures,
    "stream_once_only": stream_once_only,
    "stream_sessions": stream_sessions,
    "stream_event_text": stream_event_text,
}

ORACLE = {
    "tailed_log": f"""
WITH {EVENT_LOG_SQL}
SELECT seq, category, CASE WHEN category = 'keepalive' THEN '-' ELSE ref END AS ref,
  CASE WHEN seq % 7 = 0 THEN '' ELSE status END AS status,
  'says "' || coalesce(message, '-') || '"' || chr(10) || chr(9) || 'in two lines' AS message,
  CASE WHEN seq % 7 = 0 THEN 'missing required fields: status' END AS problem
FROM log
""",
    "incremental_verdicts": """
SELECT tab, CASE tab WHEN 'region' THEN 'new' WHEN 'lineitem' THEN 'invalid' WHEN 'nation' THEN 'invalid' ELSE 'valid' END AS reason
FROM (VALUES ('region'), ('nation'), ('customer'), ('supplier'), ('part'), ('orders'), ('lineitem'), ('events'),
  ('documents'), ('embeddings'), ('pages'), ('benchmark'), ('labels'), ('conversations')) t(tab)
""",
    "index_roundtrip": f"WITH {USER_MANIFEST_SQL} SELECT path, will_transfer FROM manifest",
    "stream_file_states": eventlog.ORACLE["file_states"],
    "stream_progress": f"""
WITH {EVENT_LOG_SQL}
SELECT ref, count(*) FILTER (category = 'validation') AS n_completed,
  count(*) FILTER (category = 'validation' AND status = 'ok') AS n_valid
FROM log GROUP BY ref
""",
    "stream_failures": f"""
WITH {EVENT_LOG_SQL}, c AS (
SELECT ref, count(*) FILTER (category IN ('validation', 'transfer') AND status <> 'ok') AS n_failures FROM log GROUP BY ref)
SELECT ref, n_failures, n_failures > 25 AS tripped FROM c
""",
    "stream_once_only": f"""
WITH {EVENT_LOG_SQL} SELECT DISTINCT ref FROM log WHERE category = 'transfer' AND status = 'ok'
""",
    "stream_sessions": f"""
WITH {SESSION_LOG_SQL},
ends AS (
  SELECT delivery, time, seq, category FROM log
  WHERE category = 'stop' OR (category = 'shutdown' AND status = 'error')
  QUALIFY row_number() OVER (PARTITION BY delivery ORDER BY time, seq) = 1),
lasts AS (
  SELECT delivery, category FROM log
  QUALIFY row_number() OVER (PARTITION BY delivery ORDER BY time DESC, seq DESC) = 1),
facts AS (
  SELECT l.delivery, count(*) AS n_rows, count(*) FILTER (l.category = 'stop') AS n_stop,
    count(*) FILTER (l.category = 'validation' AND (e.time IS NULL OR (l.time, l.seq) < (e.time, e.seq))) AS n_completed,
    max(e.category) AS how
  FROM log l LEFT JOIN ends e ON e.delivery = l.delivery GROUP BY l.delivery)
SELECT f.delivery,
  CASE WHEN n_stop > 1 THEN 'invalid' WHEN how = 'shutdown' THEN 'crashed'
       WHEN how = 'stop' AND n_completed >= 5 THEN 'done' WHEN how = 'stop' THEN 'quit'
       WHEN lasts.category = 'shutdown' THEN 'shutting_down' ELSE 'working' END AS status, n_rows
FROM facts f JOIN lasts ON lasts.delivery = f.delivery
""",
    "stream_event_text": f"""
WITH {EVENT_LOG_SQL}
SELECT seq, category, CASE WHEN category = 'keepalive' THEN '' ELSE ref END AS ref,
  'says "' || coalesce(message, '-') || '"' || chr(10) || chr(9) || 'in two lines' AS message,
  CASE WHEN category = 'keepalive' THEN 'missing required fields: ref' END AS problem
FROM log
""",
}
