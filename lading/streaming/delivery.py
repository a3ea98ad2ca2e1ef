"""A running delivery: validate what arrives, write verdicts, resume."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from lading import schemas
from lading.operators import events as ev
from lading.operators import manifest
from lading.plans.validate import server_validate
from lading.sources.catalog import Catalog
from lading.sources.events import format_events
from lading.sources.files import from_manifest
from lading.spec import Specs
from lading.streaming.session import STATE_STORE

_BATCH = "batch"  # folder (partition) of a micro-batch's verdicts


def checkpoint_dir(spark: SparkSession, name: str) -> str:
    """A folder below the cluster's shared spark.checkpoint.dir."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return f"{shared.rstrip('/')}/{name}"


def file_state_stream(events: DataFrame, keys: tuple[str, ...] = ("ref",), order=("time",)) -> DataFrame:
    """`events.file_states` of a stream; use output mode update or complete.

    The fold is made of mergeable aggregates, so the state is one row per ref
    and rows of a hot ref are combined before they reach it.
    """
    return ev.file_states(events, keys, order)


def read_verdicts(spark: SparkSession, log: str, before: int | None = None) -> DataFrame:
    """Verdict log of earlier micro-batches (or all), as EVENTS."""
    rows = (
        spark.read.schema(f"{schemas.EVENTS}, {_BATCH} bigint")
        .options(sep="\t", quote='"', escape='"', multiLine=True)
        .csv(log)
    )
    if before is not None:
        rows = rows.filter(F.col(_BATCH) < before)
    return rows.select(
        *[F.coalesce(F.col(f), F.lit("")).alias(f) for f in schemas.EVENT_FIELDS]
    )


def _write_batch(rows: DataFrame, log: str, agent_id: str, batch_id: int) -> None:
    """A retried micro-batch overwrites what its first attempt wrote."""
    format_events(rows, {"agent_id": agent_id}).write.mode("overwrite").options(
        sep="\t", quote='"', escape='"', emptyValue=""
    ).csv(f"{log}/{_BATCH}={batch_id}")


def start_log(spark: SparkSession, log: str, agent_id: str) -> None:
    """First row of a validator log."""
    row = spark.range(1).select(
        F.lit("init").alias("category"),
        F.lit("self").alias("ref"),
        F.lit("ok").alias("status"),
        F.lit("validation started").alias("message"),
    )
    _write_batch(row, log, agent_id, -1)


class _Reports(StatefulProcessor):
    """How often a file was reported in earlier micro-batches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.seen.update((int(initialState["n"].iloc[0]),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.seen.get()[0] if self.seen.exists() else 0
        now = sum(len(frame) for frame in rows)
        self.seen.update((before + now,))
        yield pd.DataFrame({"path": [key[0]], "n_reports": [now], "queued": [before > 0]})

    def close(self) -> None:
        pass


def report_stream(events: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """`path, n_reports, queued` of the files a micro-batch reports as sent.

    `queued` says that an earlier micro-batch reported the file already, or
    that it is among the `judged` paths, the state to begin with.  A
    micro-batch costs what it holds, however long the logs are; the state is a
    number a file.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    known = None
    if judged is not None:
        known = judged.select("path", F.lit(1).cast("long").alias("n")).distinct().groupBy("path")
    sent = events.filter(ev.transfer_ok()).select(F.col("ref").alias("path"))
    return sent.groupBy("path").transformWithStateInPandas(
        _Reports(), "path string, n_reports long, queued boolean", "append", "none", known
    )


def validate_batch(
    batch: DataFrame,
    batch_id: int,
    index: DataFrame,
    specs: Specs,
    root: str,
    log: str,
    conflicts: str,
    agent_id: str = "validator",
    catalog: Catalog | None = None,
    hooks: Mapping | None = None,
    findings: str | None = None,
) -> None:
    """Judge the files a micro-batch reports as transferred.

    `batch` are rows of `report_stream`.  Refs outside the manifest, sent
    twice or reported before go to the conflicts folder; the others are
    validated once and their verdicts written under the batch's own folder,
    as are all FAILURES behind them, if a folder `findings` is given.
    """
    twice = F.explode(F.sequence(F.lit(1), F.least("n_reports", F.lit(2))))  # more than twice is told no other way
    reported = batch.select("path", twice.alias("__report")).drop("__report")
    queued = batch.filter("queued").select("path")
    waiting = manifest_status(index)
    problems = manifest.queue_conflicts(reported, waiting, queued)
    problems.write.mode("overwrite").json(f"{conflicts}/{_BATCH}={batch_id}")
    todo = (
        manifest.select_queued(waiting.filter(F.col("status") == "waiting"), reported)
        .join(queued, "path", "left_anti")
    )
    listing = from_manifest(todo, root).withColumn(
        "checksum", F.lit(None).cast("string")
    )
    if "checksum" in index.columns:
        from lading.sources.files import add_checksums

        # only files whose manifest gives a sum are read for it
        summed = todo.filter(F.coalesce("checksum", F.lit("")) != "")
        summed = add_checksums(from_manifest(summed, root), root)
        bare = listing.join(summed.select("path"), "path", "left_anti")
        listing = summed.unionByName(bare, allowMissingColumns=True)
    verdicts, failures = server_validate(todo, listing, specs, root, catalog, hooks)
    if findings is not None:
        failures.write.mode("overwrite").json(f"{findings}/{_BATCH}={batch_id}")
    rows = verdicts.select(
        F.lit("validation").alias("category"), F.col("path").alias("ref"), "status", "message"
    )
    _write_batch(rows, log, agent_id, batch_id)


def manifest_status(index: DataFrame) -> DataFrame:
    if "status" in index.columns:
        return index
    from lading.operators.classify import init_status

    return init_status(index)


def incremental_validate(
    events: DataFrame,
    index: DataFrame,
    specs: Specs,
    root: str,
    log: str,
    conflicts: str,
    checkpoint: str,
    catalog: Catalog | None = None,
    hooks: Mapping | None = None,
    drain: bool = True,
    findings: str | None = None,
) -> StreamingQuery:
    """Start the validator on a client log.

    With `drain` (T11) it works off all that is reported and ends; otherwise
    it follows the log.  Restarting with the same checkpoint resumes (T13).
    """
    spark = events.sparkSession

    def judge(batch: DataFrame, batch_id: int) -> None:
        validate_batch(
            batch, batch_id, index, specs, root, log, conflicts,
            catalog=catalog, hooks=hooks, findings=findings,
        )

    if not _has_log(spark, log):
        start_log(spark, log, "validator")
    judged = read_verdicts(spark, log).filter(ev.is_verdict()).select(F.col("ref").alias("path"))
    reports = report_stream(events, judged)  # a new checkpoint begins with what the log tells
    writer = reports.writeStream.outputMode("append").foreachBatch(judge).option("checkpointLocation", checkpoint)
    if drain:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def _has_log(spark: SparkSession, log: str) -> bool:
    try:
        spark.read.schema(schemas.EVENTS).csv(log, sep="\t").limit(1).count()
        return True
    except Exception as problem:
        if "PATH_NOT_FOUND" in str(problem):
            return False
        raise


def resume(spark: SparkSession, index: DataFrame, log: str, listing: DataFrame) -> DataFrame:
    """What is left to send, from the validator's log and the listing."""
    verdicts = ev.last_verdict(read_verdicts(spark, log))
    return manifest.resume_plan(index, verdicts, listing)
