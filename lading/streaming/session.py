"""Sessions followed live: status, timeouts and protocol errors."""

from __future__ import annotations

import json
import time
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType, TimestampType

from lading.functions.scalars import event_time
from lading.operators.events import FAILED, MAX_FAILURES, is_verdict
from lading.sources.events import good_rows, stream_events, write_events

MISSING_SECONDS = 240  # silence after which a sender is missing
ABSENT_SECONDS = 480  # silence that ends its session
TERMINAL = ("quit", "done", "crashed", "absent", "invalid")

_STATE = "status string, n_completed long, n_rows long, n_stop long"
_OUT = "delivery string, status string, n_completed long, n_rows long, problem string"
_BUSY = ("transfer", "initialization", "start")
SEGMENT_SECONDS = 600  # rows of a delivery folded by one task of a micro-batch
BUCKETS, PARTS = 256, 32  # of deliveries, and of each bucket's states; checkpoints of finished logs depend on them
KEEP_SECONDS = 30 * 86400  # how long an ended session is remembered
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# What a segment of a session does to the session's state.  Places are numbers
# of rows in the segment, -1 if there is none; `live` ones count if the session
# has not ended before the segment, `dead` ones if it has.
_TABLE = (
    "delivery string, segment long, n_rows long, n_verdicts long, ending string, n_expected long, last string, "
    "n_stop long, first_stop long, second_stop long, live_busy long, live_beat long, dead_busy long, dead_beat long"
)


def segment_tables(rows: pa.Table, order: Sequence[str], keys: Sequence[str] = ()) -> pa.Table:
    """The transition that the rows of each segment, in order, make up together; `keys` tell segments apart."""
    by = {f"key {i}": pc.dictionary_encode(rows[k], null_encoding="encode").combine_chunks().indices for i, k in enumerate(keys)}
    sorting = pa.table(by | {f"order {i}": rows[o] for i, o in enumerate(order)})
    rows = rows.take(places := pc.sort_indices(sorting, sort_keys=[(c, "ascending") for c in sorting.column_names]))  # a stable sort
    n = len(rows)
    cuts = np.arange(n) == 0
    for codes in by.values():
        codes = codes.take(places).to_numpy()
        cuts[1:] |= codes[1:] != codes[:-1]
    starts = np.flatnonzero(cuts)
    sizes = np.diff(starts, append=n)
    place = np.arange(n) - np.repeat(starts, sizes)

    def among(column: str, *values: str) -> np.ndarray:
        return pc.is_in(rows[column], pa.array(values, rows[column].type)).to_numpy()

    def count(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask.astype("int64"), starts)

    def first(mask: np.ndarray) -> np.ndarray:
        found = np.minimum.reduceat(np.where(mask, place, n), starts)
        return np.where(found == n, -1, found)

    shutdown, stop = among("category", "shutdown"), among("category", "stop")
    crash = shutdown & among("status", *FAILED)
    busy, beat = among("category", *_BUSY), among("category", "keepalive")
    end = first(stop | crash)
    open_, at = end < 0, starts + np.maximum(end, 0)
    end_of_row = np.repeat(np.where(open_, sizes, end), sizes)
    ended = place > end_of_row
    first_stop = first(stop)
    columns = {k: rows[k].take(pa.array(starts)) for k in keys} | {
        "n_rows": sizes,
        "n_verdicts": count(among("category", "validation") & (place < end_of_row)),
        "ending": pa.array(np.where(crash[at], "crashed", "stop").astype(object), mask=open_),
        "n_expected": rows["n_expected"].take(pa.array(at, mask=open_)),
        "last": np.where(shutdown[starts + sizes - 1], "shutting_down", "working").astype(object),
        "n_stop": count(stop),
        "first_stop": first_stop,
        "second_stop": first(stop & (place > np.repeat(first_stop, sizes))),
        "live_busy": first(busy & ended),
        "live_beat": first(beat & ended),
        "dead_busy": first(busy),
        "dead_beat": first(beat),
    }
    return pa.table(columns)


def segment_table(rows: pa.Table, order: Sequence[str]) -> dict:
    """The transition of one segment's rows."""
    (table,) = segment_tables(rows, order).to_pylist()
    return table


def follow(state: tuple[str, int, int, int], table) -> tuple[tuple[str, int, int, int], list[str]]:
    """State (status, verdicts, rows, stop rows) after a segment, and the problems it told, in order."""
    status, completed, n_rows, stops = state
    if status in TERMINAL:
        found = [(table.dead_busy, "activity after the end"), (table.dead_beat, "heartbeat after the end")]
        excess = table.first_stop if stops else table.second_stop
    else:
        found = [(table.live_busy, "activity after the end"), (table.live_beat, "heartbeat after the end")]
        excess = table.second_stop
        completed += int(table.n_verdicts)
        if table.ending == "stop":
            expected = table.n_expected
            status = "done" if not pd.isna(expected) and completed >= expected else "quit"
        else:
            status = table.ending or table.last
    found.append((excess, "too many stop rows"))
    if excess >= 0:
        status = "invalid"
    problems = [text for place, text in sorted(found) if place >= 0]
    return (status, completed, n_rows + int(table.n_rows), stops + int(table.n_stop)), problems


def _told(sessions: Iterable[tuple[str | None, tuple[str, int, int, int], list[str]]]) -> pd.DataFrame:
    """Rows of the result: deliveries, their states and problems."""
    rows = [(d, *state[:3], "; ".join(dict.fromkeys(problems)) or None) for d, state, problems in sessions]
    return pd.DataFrame(rows, columns=["delivery", "status", "n_completed", "n_rows", "problem"], dtype=object)


class _Sessions(StatefulProcessor):
    """State of a delivery: four numbers; a timer for its silence."""

    def __init__(self, missing: float, absent: float, keep: float):
        self.missing, self.absent, self.keep = missing, absent, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", _STATE, int(self.keep * 1000))

    def _keep(self, key: tuple, state: tuple, problems: list[str], timers) -> pd.DataFrame:
        self.state.update(state)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if state[0] not in TERMINAL:
            wait = self.absent - self.missing if state[0] == "missing" else self.missing
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + max(1, int(wait * 1000)))
        return _told([(key[0], state, problems)])

    def _known(self) -> tuple[str, int, int, int]:
        return tuple(self.state.get()) if self.state.exists() else ("unchecked", 0, 0, 0)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, problems = self._known(), []
        tables = (table for frame in rows for table in frame.itertuples(index=False))
        for table in sorted(tables, key=lambda t: -1 if pd.isna(t.segment) else t.segment):
            state, told = follow(state, table)
            problems += told
        yield self._keep(key, state, problems, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, *rest = self._known()
        if status not in TERMINAL:
            yield self._keep(key, ("absent" if status == "missing" else "missing", *rest), [], timerValues)

    def close(self) -> None:
        pass


class _Logs(StatefulProcessor):
    """States of a bucket's deliveries, stored in parts of some deliveries each, as a call to the store costs more
    than a state; only parts with new rows are read and written.  No clock."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.parts = handle.getMapState("sessions", "part int", "sessions string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        tables = pd.concat(list(rows)).sort_values("segment", kind="stable", key=lambda s: s.fillna(-1))
        parts: dict[int, dict] = {}
        told: dict[str | None, list[str]] = {}
        for table in tables.itertuples(index=False):
            delivery = None if pd.isna(table.delivery) else table.delivery
            part = zlib.crc32((delivery or "").encode()) % PARTS
            if part not in parts:
                known = self.parts.getValue((part,))
                parts[part] = {d: state for d, *state in json.loads(known[0])} if known else {}
            states = parts[part]
            states[delivery], problems = follow(states.get(delivery, ("unchecked", 0, 0, 0)), table)
            told.setdefault(delivery, []).extend(problems)
        for part, states in parts.items():
            self.parts.updateValue((part,), (json.dumps([(d, *state) for d, state in states.items()]),))
        known = {d: state for states in parts.values() for d, state in states.items()}
        yield _told((d, known[d], problems) for d, problems in told.items())

    def close(self) -> None:
        pass


def session_stream(
    events: DataFrame,
    order: Sequence[str] = ("time",),
    missing_seconds: float = MISSING_SECONDS,
    absent_seconds: float = ABSENT_SECONDS,
    timeouts: bool = True,
    segment: Column | None = None,
    keep_seconds: float = KEEP_SECONDS,
) -> DataFrame:
    """A row per delivery and micro-batch with its current status.

    `events` needs `delivery` and `n_expected` besides the event fields.  Rows
    of a micro-batch are cut into segments, by default ten minutes of their
    time each; `segment`, a number that never falls in `order`, cuts otherwise.
    Segments are folded in parallel, whichever delivery they belong to, each
    to one row that tells what it does to a session; the session's state takes
    up these rows in order.  Silence is told by timers, ended sessions are
    forgotten after `keep_seconds`.  Without `timeouts` the clock plays no
    part, as when a finished log is worked off.

    State is kept in RocksDB, which this sets for the session.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    if segment is None:
        at = F.col(order[0])
        if not isinstance(events.schema[order[0]].dataType, TimestampType):
            at = event_time(at.cast("string"))
        segment = F.floor(F.unix_micros(at.cast("timestamp")) / (SEGMENT_SECONDS * 1_000_000))
    columns = ["delivery", "category", "status", "n_expected", *order]
    slim = events.select(*dict.fromkeys(columns), segment.cast("long").alias("segment"))
    order = list(order)

    def fold(rows: pa.Table) -> pa.Table:
        return segment_tables(rows, order, ["delivery", "segment"]).cast(layout)

    layout = to_arrow_schema(StructType.fromDDL(_TABLE))
    bucket = F.pmod(F.xxhash64("delivery"), F.lit(BUCKETS))
    tables = slim.withColumn("bucket", bucket).groupBy("bucket", "segment").applyInArrow(fold, _TABLE)
    if timeouts:
        timed = _Sessions(missing_seconds, absent_seconds, keep_seconds)
        return tables.groupBy("delivery").transformWithStateInPandas(timed, _OUT, "append", "processingTime")
    by_bucket = tables.withColumn("bucket", bucket).groupBy("bucket")
    return by_bucket.transformWithStateInPandas(_Logs(), _OUT, "append", "none")


class _Pulse(StatefulProcessor):
    """When an agent spoke last; a tick after `seconds` of silence brings a keepalive."""

    def __init__(self, seconds: float):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seen double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        ticked = False
        for frame in rows:
            ticked |= bool(frame["tick"].any())
            seen = frame["seen"].max()
            if not pd.isna(seen):
                last = seen if last is None else max(last, seen)
        now = time.time()
        due = ticked and (last is None or now - last >= self.seconds)
        last = now if due else last
        if last is not None:
            self.last.update((float(last),))
        if due:
            yield pd.DataFrame({"category": ["keepalive"], "ref": ["self"], "status": ["ok"]})

    def close(self) -> None:
        pass


def start_heartbeat(
    spark: SparkSession, log: str, checkpoint: str, agent_id: str, seconds: int = 10
) -> StreamingQuery:
    """T5: append a keepalive to `log` whenever its owner was silent for `seconds`.

    A one-row rate source is the clock.  New rows of the log are streamed and
    the last one's time is kept as state, so a tick costs the same however
    long the log is.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    clock = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    agent = F.lit(agent_id).alias("agent_id")
    ticks = clock.select(agent, F.lit(None).cast("double").alias("seen"), F.lit(True).alias("tick"))
    own = good_rows(stream_events(spark, log)).filter(F.col("agent_id") == agent_id)
    spoken = own.select(agent, event_time(F.col("time")).cast("double").alias("seen"), F.lit(False).alias("tick"))
    pulse = (
        ticks.unionByName(spoken)
        .groupBy("agent_id")
        .transformWithStateInPandas(_Pulse(seconds), "category string, ref string, status string", "append", "none")
    )

    def speak(beats: DataFrame, batch_id: int) -> None:
        if not beats.isEmpty():
            write_events(beats, log, {"agent_id": agent_id})

    return (
        pulse.writeStream.outputMode("append")
        .foreachBatch(speak)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=f"{seconds} seconds")
        .start()
    )


def live_progress(events: DataFrame, keys: Sequence[str] = ("delivery",)) -> DataFrame:
    """Verdicts so far per delivery; combined before the shuffle."""
    return events.groupBy(*keys).agg(
        F.count_if(is_verdict()).alias("n_completed"),
        F.count_if(is_verdict() & (F.col("status") == "ok")).alias("n_valid"),
    )


def trip_on_failures(
    events: DataFrame, keys: Sequence[str] = ("delivery",), limit: int = MAX_FAILURES
) -> DataFrame:
    """Failures so far and whether a delivery must stop."""
    failed = F.col("category").isin("validation", "transfer") & (F.col("status") != "ok")
    counted = events.groupBy(*keys).agg(F.count_if(failed).alias("n_failures"))
    return counted.withColumn("tripped", F.col("n_failures") > limit)


def once_only(transfers: DataFrame, time: str | None = None, within: str | None = None) -> DataFrame:
    """The first report per ref; later ones are dropped.

    With a `time` column (timestamp), refs are forgotten once the stream is
    `within` (as "7 days") past their report, so the state has an end.
    """
    if time is None:
        return transfers.dropDuplicates(["ref"])
    return transfers.withWatermark(time, within).dropDuplicatesWithinWatermark(["ref"])
