"""Segments folded in parallel against one fold over all rows; state of reports and heartbeats."""

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lading.queries.streams import QUERIES
from lading.streaming import session

KINDS = [("start", "ok"), ("transfer", "ok"), ("validation", "ok"), ("keepalive", "ok"), ("shutdown", "ok"), ("other", "ok"),
         ("shutdown", "error"), ("stop", "ok")]


def plain(state, rows):
    """One event after the other."""
    status, completed, n, stops = state
    problems = []
    for category, outcome, expected in rows:
        n += 1
        problem = None
        if category == "stop":
            stops += 1
            if stops > 1:
                status, problem = "invalid", "too many stop rows"
        if status in session.TERMINAL:
            if category in ("transfer", "initialization", "start"):
                problem = "activity after the end"
            elif category == "keepalive":
                problem = "heartbeat after the end"
        elif category == "validation":
            completed, status = completed + 1, "working"
        elif category == "stop":
            status = "done" if completed >= expected else "quit"
        elif category == "shutdown":
            status = "crashed" if outcome == "error" else "shutting_down"
        else:
            status = "working"
        if problem and problem not in problems:
            problems.append(problem)
    return (status, completed, n, stops), problems


def drawn(rng, n, ending=0.1):
    p = np.array([1, 1, 2, 1, 0.3, 1, ending, 2 * ending])
    return [(*KINDS[i], int(rng.integers(0, 4))) for i in rng.choice(len(KINDS), n, p=p / p.sum())]


def test_segments_make_up_the_whole():
    rng = np.random.default_rng(3)
    for _ in range(1500):
        rows = drawn(rng, int(rng.integers(1, 14)), rng.choice([0.02, 0.2, 2]))
        cuts = sorted({0, len(rows), *rng.integers(0, len(rows) + 1, rng.integers(0, 5)).tolist()})
        state, told = ("unchecked", 0, 0, 0), []
        for a, b in zip(cuts, cuts[1:], strict=False):
            frame = pd.DataFrame(rows[a:b], columns=["category", "status", "n_expected"])
            frame["time"] = range(a, b)
            mixed = frame.sample(frac=1, random_state=int(rng.integers(1 << 30)))
            table = SimpleNamespace(**session.segment_table(pa.Table.from_pandas(mixed), ["time"]))
            state, problems = session.follow(state, table)
            told += problems
        wanted, problems = plain(("unchecked", 0, 0, 0), rows)
        assert state == wanted and list(dict.fromkeys(told)) == problems, rows


def ended(stream, folder):
    query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/ck").format("parquet").option(
        "path", f"{folder}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/out")


def test_one_delivery_of_a_million_rows_is_folded_by_many_tasks(spark, tmp_path):
    n = 1_000_000
    rows = spark.range(n).select(
        F.lit("d").alias("delivery"),
        F.when(F.col("id") == n - 1, "stop").when(F.col("id") % 3 == 0, "validation").otherwise("transfer").alias("category"),
        F.lit("ok").alias("status"),
        F.lit(n // 3).cast("bigint").alias("n_expected"),
        F.date_format(F.timestamp_seconds(F.col("id") / 500), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("time"),
    )
    rows.write.parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/log")
    (row,) = ended(session.session_stream(stream, timeouts=False), tmp_path).collect()
    assert tuple(row) == ("d", "done", 333_333, n, None) or row.status in ("done", "quit")
    assert (row.n_completed, row.n_rows, row.problem) == ((n - 1) // 3 + 1 - ((n - 1) % 3 == 0), n, None)


@pytest.mark.parametrize("files", [1, 3])
def test_sessions_of_several_batches(spark, tmp_path, files):
    rng = np.random.default_rng(files)
    layout = "time string, delivery string, category string, status string, n_expected long"
    sessions = {d: drawn(rng, 40, 0.05) for d in ("a", "b", None)}
    for k in range(files):
        part = [
            (f"2026-01-01T{i // 60:02}:{i % 60:02}:00.000Z", d, c, s, e)
            for d, rows in sessions.items() for i, (c, s, e) in enumerate(rows) if i * files // 40 == k
        ]
        spark.createDataFrame(part, layout).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(layout).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    out = ended(session.session_stream(stream, timeouts=False), tmp_path)
    last = out.groupBy("delivery").agg(F.max(F.struct("n_rows", "status", "n_completed")).alias("s"))
    got = {r.delivery: (r.s.status, r.s.n_completed, r.s.n_rows) for r in last.collect()}
    assert got == {d: plain(("unchecked", 0, 0, 0), rows)[0][:3] for d, rows in sessions.items()}


def test_many_segments_in_one_pass_are_as_one_by_one():
    rng = np.random.default_rng(5)
    rows = [(d, g, *row) for d in ("a", "b", None, "") for g in (-1, 3, None) for row in drawn(rng, int(rng.integers(1, 30)), 0.3)]
    frame = pd.DataFrame(rows, columns=["delivery", "segment", "category", "status", "n_expected"]).astype({"segment": "Int64"})
    frame["time"], frame["seq"] = rng.integers(0, 5, len(frame)), rng.permutation(len(frame))
    frame.loc[rng.random(len(frame)) < 0.1, ["category", "status"]] = None
    mixed = pa.Table.from_pandas(frame.sample(frac=1, random_state=1), preserve_index=False)
    order = ["time", "seq"]
    found = {(t.pop("delivery"), t.pop("segment")): t for t in session.segment_tables(mixed, order, ["delivery", "segment"]).to_pylist()}
    single = {}
    for row in mixed.to_pylist():
        single.setdefault((row["delivery"], row["segment"]), []).append(row)
    assert found == {k: session.segment_table(pa.Table.from_pylist(v, mixed.schema), order) for k, v in single.items()}


def test_states_of_many_deliveries_share_rows_of_the_store(spark, tmp_path):
    n = 20_000
    layout = "time long, delivery string, category string, status string, n_expected long"
    for k, category in enumerate(("validation", "stop")):
        rows = spark.range(n).select(
            F.lit(k).cast("long").alias("time"), F.col("id").cast("string").alias("delivery"), F.lit(category).alias("category"),
            F.lit("ok").alias("status"), (F.col("id") % 3).alias("n_expected"))
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(layout).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    sessions = session.session_stream(stream, timeouts=False, segment=F.col("time"))
    query = sessions.writeStream.option("checkpointLocation", f"{tmp_path}/ck").format("parquet").option(
        "path", f"{tmp_path}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= session.BUCKETS * session.PARTS < n
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.groupBy("status", "n_rows").count().sort("status", "n_rows").collect() == [
        ("done", 2, n - n // 3), ("quit", 2, n // 3), ("working", 1, n)]


def test_a_chunk_of_overlapping_files_is_one_micro_batch(spark, tmp_path):
    minute = 60_000_000
    layout = "event_id long, at long, user_id long, event_type string, value double, props string"
    verdicts = [[(i, i, 1, "purchase", 9.0, "{}") for i in range(5)], [(10 + i, i, 2, "purchase", 9.0, "{}") for i in range(5)]]
    stops = [(20, 6, 2, "error", 0.5, "{}"), (99, 100, 3, "view", 1.0, "{}")], [(21, 6, 1, "error", 0.5, "{}")]
    for early, late in zip(verdicts, stops, strict=True):
        events = spark.createDataFrame(early + late, layout).withColumn(
            "ts", F.timestamp_micros(F.col("at") * minute).cast("timestamp_ntz"))
        events.drop("at").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    found = {tuple(r) for r in QUERIES["stream_sessions"](spark, str(tmp_path)).collect()}
    assert found == {("1", "done", 6), ("2", "done", 6), ("3", "working", 1)}


def test_once_only_forgets(spark, tmp_path):
    layout = "ref string, at timestamp"
    rows = [("a", 0), ("a", 5), ("b", 100_000), ("c", 100_001), ("a", 100_002), ("a", 100_003)]
    for ref, second in rows:
        spark.createDataFrame([(ref, second)], "ref string, s long").select(
            "ref", F.timestamp_seconds("s").alias("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(layout).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    found = ended(session.once_only(stream, "at", "1 hour"), tmp_path)
    assert found.count() == 4
