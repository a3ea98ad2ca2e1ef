"""Event-log operators on batch tables (the streaming side reuses them).

An event log is `time, category, ref, status, message, agent_id`; `order`
names the columns that give arrival order (default: time).  Verdicts are rows
of category ``validation``, transfers rows of category ``transfer``.

Folds are written as mergeable aggregates (min_by, max_by, count_if), which
Spark combines before the shuffle, so the number of rows a ref owns does not
matter.  Where every row needs its own running value, `scans.running` cuts
the rows of a ref into time buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lading.functions.scalars import event_time, utc_millis
from lading.operators import scans
from lading.operators.manifest import can_transfer, is_complete, no_retry

FAILED = ("failure", "error")
MAX_FAILURES = 10  # stop a delivery beyond this many failures
MAX_RETRIES = 2  # transfers tried again per file
DOUBLE = "improper double validation"
PREMATURE = "validator reported success before transfer complete"


def _order(order: Sequence[str]) -> Column:
    return F.struct(*order)


def is_verdict() -> Column:
    return F.col("category") == "validation"


def transfer_ok() -> Column:
    return (F.col("category") == "transfer") & ~F.col("status").isin(*FAILED)


def transfer_failed() -> Column:
    return (F.col("category") == "transfer") & F.col("status").isin(*FAILED)


def events_of(
    events: DataFrame, categories: Sequence[str], statuses: Sequence[str] | None = None
) -> DataFrame:
    """P10: rows of some categories (and statuses)."""
    kept = events.filter(F.col("category").isin(*categories))
    return kept if statuses is None else kept.filter(F.col("status").isin(*statuses))


def append_events(log: DataFrame, *chunks: DataFrame) -> DataFrame:
    """The log with further chunks."""
    for chunk in chunks:
        log = log.unionByName(chunk)
    return log


def last_verdict(
    events: DataFrame, keys: Sequence[str] = ("ref",), order: Sequence[str] = ("time",)
) -> DataFrame:
    """Status and message of the latest verdict per ref."""
    return (
        events.filter(is_verdict())
        .groupBy(*keys)
        .agg(F.max_by(F.struct("status", "message"), _order(order)).alias("__last"))
        .select(*keys, "__last.*")
    )


def event_seq(
    events: DataFrame,
    keys: Sequence[str] = ("ref",),
    order: Sequence[str] = ("time",),
    bucket: Column | None = None,
) -> DataFrame:
    """`seq`, the arrival number (from 1) of each row of a ref."""
    return scans.running(
        events,
        keys,
        [F.col(o) for o in order],
        _bucket(bucket),
        {"seq": ("sum", F.lit(1))},
    )


def _bucket(bucket: Column | None) -> Column:
    if bucket is not None:
        return bucket
    return scans.time_bucket(event_time(F.col("time")))


def verdict_history(
    events: DataFrame,
    keys: Sequence[str] = ("ref",),
    order: Sequence[str] = ("time",),
    bucket: Column | None = None,
) -> DataFrame:
    """Verdict rows with `verdict_no` and `transferred` (a transfer came before).

    Only verdicts and successful transfers are shuffled.
    """
    relevant = events.filter(is_verdict() | transfer_ok())
    numbered = scans.running(
        relevant,
        keys,
        [F.col(o) for o in order],
        _bucket(bucket),
        {
            "verdict_no": ("sum", F.when(is_verdict(), 1).otherwise(0)),
            "__sent": ("max", F.when(transfer_ok(), 1).otherwise(0)),
        },
    )
    return (
        numbered.filter(is_verdict())
        .withColumn("transferred", F.col("__sent") == 1)
        .drop("__sent")
    )


def double_verdicts(history: DataFrame) -> DataFrame:
    """Verdicts on files that already had one."""
    return history.filter(F.col("verdict_no") > 1).withColumn("problem", F.lit(DOUBLE))


def premature_verdicts(history: DataFrame) -> DataFrame:
    """First verdicts on files not transferred before."""
    return history.filter((F.col("verdict_no") == 1) & ~F.col("transferred")).withColumn(
        "problem", F.lit(PREMATURE)
    )


def file_states(
    events: DataFrame,
    keys: Sequence[str] = ("ref",),
    order: Sequence[str] = ("time",),
    max_retries: int = MAX_RETRIES,
) -> DataFrame:
    """T8 (batch and stream): state of every ref seen in the log.

    A file is `done` from its first successful transfer on; its first verdict
    makes it valid or invalid, a verdict before a transfer or a second one
    makes it invalid.  Rows after a verdict change nothing else.
    """
    position = _order(order)
    first_sent = F.min(F.when(transfer_ok(), position))
    verdict = F.when(is_verdict(), position)
    facts = events.groupBy(*keys).agg(
        first_sent.alias("sent"),
        F.min(verdict).alias("judged"),
        F.min_by(F.struct("status", "message"), verdict).alias("first"),
        F.count_if(is_verdict()).alias("n_verdicts"),
        F.count_if(transfer_failed()).alias("retries"),
    )
    premature = F.col("sent").isNull() | (F.col("sent") > F.col("judged"))
    judged = F.col("n_verdicts") > 0
    state = (
        F.when((F.col("n_verdicts") > 1) | (judged & premature), "invalid")
        .when(judged & (F.col("first.status") == "ok"), "valid")
        .when(judged, "invalid")
        .when(F.col("sent").isNotNull(), "done")
        .when(F.col("retries") > 0, "failed")
        .otherwise("ready")
    )
    message = (
        F.when(F.col("n_verdicts") > 1, F.lit(DOUBLE))
        .when(judged & premature, F.lit(PREMATURE))
        .when(judged & (F.col("first.status") != "ok"), F.col("first.message"))
    )
    return facts.select(
        *keys,
        state.alias("state"),
        F.col("retries").cast("bigint").alias("retries"),
        F.lit(max_retries).cast("bigint").alias("max_retries"),
        message.alias("message"),
        F.col("n_verdicts").cast("bigint").alias("n_verdicts"),
    )


def manifest_states(index: DataFrame, states: DataFrame) -> DataFrame:
    """Every manifest row with its state; rows never logged are ready."""
    known = states.withColumnRenamed("ref", "path").drop("n_verdicts")
    kept = index.drop(*[c for c in known.columns if c != "path"])
    return kept.join(known, "path", "left").withColumns(
        {
            "state": F.coalesce("state", F.lit("ready")),
            "retries": F.coalesce("retries", F.lit(0)),
            "max_retries": F.coalesce("max_retries", F.lit(MAX_RETRIES)),
        }
    )


def route_results(
    events: DataFrame, index: DataFrame, order: Sequence[str] = ("time",)
) -> tuple[DataFrame, DataFrame]:
    """(manifest rows with their verdict, refs the manifest does not know).

    Verdicts are reduced to one row per ref before either join.
    """
    verdicts = last_verdict(events, order=order).withColumnRenamed("ref", "path")
    counted = (
        events.filter(is_verdict())
        .groupBy(F.col("ref").alias("path"))
        .agg(F.count(F.lit(1)).alias("n_verdicts"))
    )
    routed = index.drop("status", "message").join(verdicts, "path", "left")
    unknown = counted.join(index.select("path"), "path", "left_anti")
    return routed, unknown


def transfer_counters(
    events: DataFrame, index: DataFrame, keys: Sequence[str] = ()
) -> DataFrame:
    """Wrong (not indexed), failed and ok transfer reports.

    Reports are counted per ref first; the manifest is joined to the counts.
    """
    per_ref = (
        events.filter(F.col("category") == "transfer")
        .groupBy(*keys, "ref")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(transfer_failed()).alias("n_fail"),
        )
    )
    indexed = index.select(F.col("path").alias("ref"), F.lit(True).alias("__indexed"))
    joined = per_ref.join(indexed, "ref", "left")
    known = F.col("__indexed").isNotNull()

    def total(column: str, condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col(column))), F.lit(0)).cast("bigint")

    return joined.groupBy(*keys).agg(
        total("n", ~known).alias("n_wrong"),
        total("n_fail", known).alias("n_failed"),
        (total("n", known) - total("n_fail", known)).alias("n_ok"),
    )


def failed_attempts(events: DataFrame, index: DataFrame) -> DataFrame:
    """Manifest with `n_fail`, the failed transfer attempts per file."""
    per_ref = (
        events.filter(transfer_failed())
        .groupBy(F.col("ref").alias("path"))
        .agg(F.count(F.lit(1)).alias("n_fail"))
    )
    return (
        index.drop("n_fail")
        .join(per_ref, "path", "left")
        .withColumn("n_fail", F.coalesce("n_fail", F.lit(0)))
    )


def progress(states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """How far a delivery is."""
    return states.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(is_complete()).alias("n_complete"),
        F.count_if(F.col("state") == "valid").alias("n_valid"),
        F.count_if(no_retry()).alias("n_given_up"),
        F.bool_and(~can_transfer() & (F.col("state") != "transferring")).alias(
            "transfer_complete"
        ),
        F.bool_and(is_complete()).alias("validation_complete"),
    )


def delivery_report(
    index: DataFrame,
    states: DataFrame,
    delivery: dict[str, str],
    events: DataFrame | None = None,
    completed_at: Column | None = None,
    exception: str | None = None,
) -> DataFrame:
    """One row per delivery; the errors themselves are `delivery_errors`.

    `delivery` are its own fields (dataset, delivery_id, transfer_type,
    label_path).  `completed_at` is the time of the report unless given, as
    UTC; `exception` what ended the run, if something did.  With `events`, each
    transfer of a file that the manifest doesn't know counts among the
    failures too.
    """
    joined = manifest_states(index.filter("will_transfer"), states)
    rows = joined.select("state", "retries", F.lit(True).alias("expected"))
    if events is not None:
        strays = events.filter(F.col("category") == "transfer").join(
            index.select(F.col("path").alias("ref")), "ref", "left_anti"
        )
        rows = rows.unionByName(
            strays.select(
                F.lit("stray").alias("state"), F.lit(1).alias("retries"), F.lit(False).alias("expected")
            )
        )
    counts = rows.agg(
        F.count_if("expected").alias("files_expected"),
        F.count_if(F.col("state").isin("valid", "invalid")).alias("files_validated"),
        F.count_if(F.col("state") == "invalid").alias("n_errors"),
        F.coalesce(F.sum("retries"), F.lit(0)).alias("failed_transfers"),
    )
    result = (
        F.when(F.col("files_validated") != F.col("files_expected"), "incomplete")
        .when(F.col("n_errors") > 0, "failure")
        .otherwise("success")
    )
    return counts.select(
        *[F.lit(v).alias(k) for k, v in delivery.items()],
        "files_expected",
        "files_validated",
        "n_errors",
        (F.col("n_errors") + F.col("failed_transfers")).alias("total_failures"),
        result.alias("validation_result"),
        (utc_millis(F.current_timestamp()) if completed_at is None else completed_at).alias("completed_at"),
        F.lit(exception or "None").alias("pipeline_exception"),
    )


def delivery_errors(index: DataFrame, states: DataFrame) -> DataFrame:
    """`path, message` of every invalid file (a table, not a map)."""
    joined = manifest_states(index.filter("will_transfer"), states)
    return joined.filter(F.col("state") == "invalid").select("path", "message")


def all_keepalive(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Does a batch hold heartbeats only?"""
    return events.groupBy(*keys).agg(
        F.bool_and(F.col("category") == "keepalive").alias("all_keepalive")
    )


def silences(
    events: DataFrame,
    ts: Column,
    keys: Sequence[str] = ("agent_id",),
    missing_timeout: float = 240,
    transfer_timeout: float = 480,
    order: Sequence[str] = ("time",),
    bucket_seconds: int = 86400,
) -> DataFrame:
    """Gaps before a message that exceed a timeout.

    A gap beyond `missing_timeout` makes the sender missing, one beyond the
    longer `transfer_timeout` absent.
    """
    timed = events.withColumn("__us", F.unix_micros(ts.cast("timestamp")))
    linked = scans.neighbours(
        timed,
        keys,
        [F.col("__us"), *[F.col(o) for o in order]],
        F.floor(F.col("__us") / F.lit(bucket_seconds * 1_000_000)),
        F.col("__us"),
        "__before",
    )
    gap = (F.col("__us") - F.col("__before")) / F.lit(1_000_000)
    return (
        linked.withColumn("gap_seconds", gap)
        .filter(F.col("gap_seconds") > min(missing_timeout, transfer_timeout))
        .withColumn(
            "condition",
            F.when(F.col("gap_seconds") > transfer_timeout, "absent").otherwise("missing"),
        )
        .drop("__us", "__before")
    )


def sessions(
    events: DataFrame,
    ts: Column,
    gap_seconds: float,
    keys: Sequence[str] = ("agent_id",),
    order: Sequence[str] = ("time",),
    bucket_seconds: int = 86400,
) -> DataFrame:
    """Stretches of messages whose gaps stay within `gap_seconds`.

    A bucketed scan instead of session_window, which would sort all rows of
    a sender in one task.
    """
    timed = events.withColumn("__us", F.unix_micros(ts.cast("timestamp")))
    by_time = [F.col("__us"), *[F.col(o) for o in order]]
    bucket = F.floor(F.col("__us") / F.lit(bucket_seconds * 1_000_000))
    gap = F.lit(int(gap_seconds * 1_000_000))
    numbered = scans.change_runs(
        timed, keys, by_time, bucket, F.col("__us"), lambda a, b: b - a > gap, "session"
    )
    return numbered.groupBy(*keys, "session").agg(
        F.min("__us").alias("start_us"),
        F.max("__us").alias("end_us"),
        F.count(F.lit(1)).alias("n_events"),
    )


def heartbeat_due(
    events: DataFrame,
    ts: Column,
    threshold: float = 10,
    keys: Sequence[str] = ("agent_id",),
    order: Sequence[str] = ("time",),
    bucket_seconds: int = 86400,
) -> DataFrame:
    """Messages after which the sender stayed silent beyond `threshold`."""
    timed = events.withColumn("__us", F.unix_micros(ts.cast("timestamp")))
    linked = scans.neighbours(
        timed,
        keys,
        [F.col("__us"), *[F.col(o) for o in order]],
        F.floor(F.col("__us") / F.lit(bucket_seconds * 1_000_000)),
        F.col("__us"),
        "__after",
        forward=True,
    )
    return (
        linked.withColumn(
            "silence_seconds", (F.col("__after") - F.col("__us")) / F.lit(1_000_000)
        )
        .filter(F.col("silence_seconds") > threshold)
        .drop("__us", "__after")
    )


def failure_trip(
    events: DataFrame,
    failed: Column,
    keys: Sequence[str] = (),
    limit: int = MAX_FAILURES,
    order: Sequence[str] = ("time",),
    bucket: Column | None = None,
) -> DataFrame:
    """The row with which the failures of a key exceed `limit`."""
    numbered = scans.running(
        events.filter(failed),
        keys,
        [F.col(o) for o in order],
        _bucket(bucket),
        {"n_failures": ("sum", F.lit(1))},
    )
    return numbered.filter(F.col("n_failures") == limit + 1)


def first_shutdown_reason(
    events: DataFrame, keys: Sequence[str] = (), order: Sequence[str] = ("time",)
) -> DataFrame:
    """Message of the first shutdown row."""
    return (
        events.filter(F.col("category") == "shutdown")
        .groupBy(*keys)
        .agg(F.min_by("message", _order(order)).alias("reason"))
    )


def session_status(
    events: DataFrame,
    n_expected: Column,
    keys: Sequence[str] = ("delivery",),
    order: Sequence[str] = ("time",),
    bucket: Column | None = None,
) -> DataFrame:
    """T3 (batch twin): how each session stands at the end of its log.

    The first shutdown error (crashed) or stop row ends a session; a stop is
    `done` when `n_expected` verdicts came before it, else `quit`.  A second
    stop row makes the log invalid.
    """
    position = _order(order)
    crash = (F.col("category") == "shutdown") & F.col("status").isin(*FAILED)
    stop = F.col("category") == "stop"
    facts = events.groupBy(*keys).agg(
        F.min_by(
            F.when(crash, "crashed").otherwise("stop"), F.when(crash | stop, position)
        ).alias("__how"),
        F.count_if(stop).alias("n_stop"),
        F.max_by("category", position).alias("__last"),
        F.count_if(is_verdict()).alias("__n_verdicts"),
        F.count_if(F.col("category") == "keepalive").alias("n_keepalive"),
        F.count(F.lit(1)).alias("n_rows"),
        F.max(n_expected).alias("n_expected"),
    )
    # verdicts before the row that ended the session
    numbered = scans.running(
        events.filter(is_verdict() | crash | stop),
        keys,
        [F.col(o) for o in order],
        _bucket(bucket),
        {"__done": ("sum", F.when(is_verdict(), 1).otherwise(0))},
    )
    at_end = (
        numbered.filter(crash | stop)
        .groupBy(*keys)
        .agg(F.min_by("__done", position).alias("__at_end"))
    )
    completed = F.coalesce("__at_end", "__n_verdicts").cast("bigint")
    status = (
        F.when(F.col("n_stop") > 1, "invalid")
        .when(F.col("__how") == "crashed", "crashed")
        .when((F.col("__how") == "stop") & (completed >= F.col("n_expected")), "done")
        .when(F.col("__how") == "stop", "quit")
        .when(F.col("__last") == "shutdown", "shutting_down")
        .otherwise("working")
    )
    return facts.join(at_end, list(keys), "left").select(
        *keys,
        status.alias("status"),
        completed.alias("n_completed"),
        F.col("n_rows").cast("bigint").alias("n_rows"),
        F.col("n_keepalive").cast("bigint").alias("n_keepalive"),
    )


def protocol_errors(
    events: DataFrame, keys: Sequence[str] = ("delivery",), order: Sequence[str] = ("time",)
) -> DataFrame:
    """More than one stop row; transfers or starts after the end; heartbeats after it."""
    position = _order(order)
    ended = (F.col("category") == "stop") | (
        (F.col("category") == "shutdown") & F.col("status").isin(*FAILED)
    )
    busy = F.col("category").isin("transfer", "initialization", "start")
    facts = events.groupBy(*keys).agg(
        F.count_if(F.col("category") == "stop").alias("n_stop"),
        F.min(F.when(ended, position)).alias("__end"),
        F.max(F.when(busy, position)).alias("__busy"),
        F.max(F.when(F.col("category") == "keepalive", position)).alias("__beat"),
    )
    problems = F.array(
        F.when(F.col("n_stop") > 1, F.lit("too many stop rows")),
        F.when(F.col("__busy") > F.col("__end"), F.lit("activity after the end")),
        F.when(F.col("__beat") > F.col("__end"), F.lit("heartbeat after the end")),
    )
    return facts.select(
        *keys, F.explode(F.filter(problems, lambda p: p.isNotNull())).alias("problem")
    )
