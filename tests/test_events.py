"""Logs on disk, streams and their batch twins, a delivery end to end."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lading import schemas
from lading.operators import events as ev
from lading.sources import events as se
from lading.sources import files as sf
from lading.spec import Specs
from lading.streaming import delivery, session

FIELDS = list(schemas.EVENT_FIELDS)


def _log(spark, rows):
    full = [(f"2026-01-01T00:00:{i:02d}.000Z", c, r, s, m, "a") for i, (c, r, s, m) in enumerate(rows)]
    return spark.createDataFrame(full, schemas.EVENTS)


def test_write_and_read_back(spark, tmp_path):
    rows = spark.createDataFrame(
        [("validation", "a b.txt", "failure", {"x/0": "line 1\nline\t2", "q": 'say "no"'})],
        "category string, ref string, status string, message map<string,string>",
    )
    se.write_events(rows, str(tmp_path / "log"), {"agent_id": "v"})
    se.write_events(rows.drop("message"), str(tmp_path / "log"), {"agent_id": "v"}, batch_id=3)
    se.write_events(rows.drop("message"), str(tmp_path / "log"), {"agent_id": "v"}, batch_id=3)
    read = se.read_events(spark, str(tmp_path / "log"))
    assert se.quarantined(read).count() == 0
    found = se.good_rows(read).orderBy("message").collect()
    assert [r.message for r in found] == ["", '{"x/0":"line 1\\nline\\t2","q":"say \\"no\\""}']
    assert all(r.time.endswith("Z") and len(r.time) == 24 for r in found)


@pytest.mark.parametrize(
    "columns, fixed", [(["category", "odd"], {}), (["category", "ref", "status", "agent_id"], {"agent_id": "x"}), (["category"], {"agent_id": "x"})]
)
def test_write_rules(spark, columns, fixed):
    rows = spark.createDataFrame([tuple("x" for _ in columns)], columns)
    with pytest.raises(ValueError):
        se.format_events(rows, fixed)


def test_bad_rows(spark, tmp_path):
    good = "t1\ttransfer\ta\tok\t\"two\nlines\"\tme\n"
    (tmp_path / "c1.tsv").write_text(good)
    (tmp_path / "c2.tsv").write_text(good + "t2\ttransfer\tb\n")
    (tmp_path / "c3.tsv").write_text("t3\ttransfer\t\tok\t\tme\n")
    (tmp_path / "c4.tsv").write_text("t4\ttransfer\tb\tok\t\tme\tmore\n")
    read = se.read_events(spark, str(tmp_path))
    bad = se.rejected_chunks(read).withColumn("chunk", F.substring_index("chunk", "/", -1))
    assert {(r.chunk, r.problem) for r in bad.collect()} == {
        ("c2.tsv", "wrong number of columns"), ("c3.tsv", "missing required fields: ref"),
        ("c4.tsv", "wrong number of columns"),
    }
    assert se.good_rows(read).filter(F.col("message") == "two\nlines").count() == 2
    with pytest.raises(Exception, match="wrong number of columns|missing required"):
        se.read_events(spark, str(tmp_path), strict=True).select("time").collect()


LOG = [
    ("transfer", "a", "ok", ""), ("transfer", "b", "error", "net"), ("validation", "c", "ok", ""),
    ("transfer", "b", "error", "net"), ("validation", "a", "ok", ""), ("transfer", "c", "ok", ""),
    ("transfer", "d", "ok", ""), ("validation", "d", "failure", "bad dtype"), ("transfer", "e", "ok", ""),
    ("validation", "d", "ok", ""), ("transfer", "f", "error", "net"), ("transfer", "g", "ok", ""),
    ("validation", "g", "failure", "bad"), ("keepalive", "self", "ok", ""),
]
STATES = {
    "a": ("valid", None), "b": ("failed", None), "c": ("invalid", ev.PREMATURE), "d": ("invalid", ev.DOUBLE),
    "e": ("done", None), "f": ("failed", None), "g": ("invalid", "bad"), "self": ("ready", None),
}


def test_states_batch_and_stream(spark, tmp_path):
    log = _log(spark, LOG)
    found = {r.ref: (r.state, r.message) for r in ev.file_states(log).collect()}
    assert found == STATES
    for i in range(3):
        log.filter((F.substring("time", 18, 2).cast("int") / 5).cast("int") == i).write.mode("append").parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(schemas.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    query = delivery.file_state_stream(stream).writeStream.outputMode("complete").format("memory").queryName("states").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.ref: (r.state, r.message) for r in spark.table("states").collect()} == STATES


def test_progress_report_and_next(spark):
    index = spark.createDataFrame([(p, True, i) for i, p in enumerate("abcdefgh")], "path string, will_transfer boolean, pos int")
    states = ev.file_states(_log(spark, LOG))
    known = ev.manifest_states(index, states)
    row = ev.progress(known).first()
    assert (row.n_files, row.n_complete, row.n_valid, row.n_given_up) == (8, 5, 1, 1)
    assert not row.transfer_complete and not row.validation_complete
    from lading.operators.manifest import next_files

    assert [r.path for r in next_files(known, 5).collect()] == ["f", "h"]
    report = ev.delivery_report(index, states, {"dataset": "d"}).first()
    assert (report.files_expected, report.files_validated, report.n_errors) == (8, 4, 3)
    assert report.validation_result == "incomplete"
    assert {r.path for r in ev.delivery_errors(index, states).collect()} == {"c", "d", "g"}


def test_session_timeouts(spark, tmp_path):
    rows = [("s1", "start", "ok"), ("s2", "start", "ok"), ("s2", "stop", "ok")]
    full = [(f"t{i}", d, c, s, 0) for i, (d, c, s) in enumerate(rows)]
    layout = "time string, delivery string, category string, status string, n_expected long"
    spark.createDataFrame(full, layout).write.parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(layout).parquet(f"{tmp_path}/log")
    current = session.session_stream(stream, missing_seconds=1, absent_seconds=3)
    seen = []

    def keep(batch, _):
        seen.extend((r.delivery, r.status) for r in batch.collect())

    query = current.writeStream.outputMode("append").foreachBatch(keep).trigger(processingTime="1 second").start()
    query.awaitTermination(25)
    query.stop()
    assert [s for d, s in seen if d == "s1"] == ["working", "missing", "absent"]
    assert [s for d, s in seen if d == "s2"] == ["done"]


def test_heartbeat(spark, tmp_path):
    log = str(tmp_path / "log")
    row = spark.createDataFrame([("2020-01-01T00:00:00.000Z", "init", "self", "ok")], "time string, category string, ref string, status string")
    se.write_events(row, log, {"agent_id": "v"})
    query = session.start_heartbeat(spark, log, str(tmp_path / "checkpoint"), "v", 2)
    query.awaitTermination(9)
    query.stop()
    beats = se.read_events(spark, log).filter("category = 'keepalive'").count()
    assert 2 <= beats <= 5


def test_delivery_end_to_end(spark, tmp_path):
    root = tmp_path / "data"
    root.mkdir()
    for name, code in (("a", pa.int32()), ("b", pa.int64()), ("_c", pa.int32())):
        pq.write_table(pa.table({"x": pa.array([1], code)}), root / f"{name}.parquet")
    (root / "notes.txt").write_text("hello")
    label = {"dataset": "d", "delivery_id": 1, "filetypes": {
        "t": {"filename": r"\.parquet$", "standard": "parquet", "objects": [{"schema": [{"name": "x", "dtype": "i4"}]}]},
        "n": {"filename": r"\.txt$"}}}
    specs = Specs.from_labels(spark, [label])
    names = ["a.parquet", "b.parquet", "_c.parquet", "notes.txt", "gone.parquet"]
    index = spark.createDataFrame(
        [(n, "n" if n.endswith("txt") else "t", True) for n in names], "path string, type string, will_transfer boolean"
    )
    log, client = str(tmp_path / "verdicts"), str(tmp_path / "client")

    def report(refs):
        rows = spark.createDataFrame([("transfer", r, "ok") for r in refs], "category string, ref string, status string")
        se.write_events(rows.coalesce(1), client, {"agent_id": "client"})

    def run(checkpoint="checkpoint"):
        events = se.good_rows(se.stream_events(spark, client))
        delivery.incremental_validate(
            events, index, specs, str(root), log, str(tmp_path / "conflicts"), str(tmp_path / checkpoint),
            findings=str(tmp_path / "findings"),
        ).awaitTermination()

    report(["a.parquet", "b.parquet", "alien.txt", "a.parquet"])
    run()
    report(["_c.parquet", "notes.txt", "gone.parquet", "a.parquet"])
    run()
    verdicts = delivery.read_verdicts(spark, log).filter("category = 'validation'").collect()
    assert {r.ref: r.status for r in verdicts} == {
        "a.parquet": "ok", "b.parquet": "failure", "_c.parquet": "ok", "notes.txt": "ok", "gone.parquet": "failure",
    }
    assert len(verdicts) == 5
    findings = spark.read.json(str(tmp_path / "findings"))
    assert {(r.path, r.check) for r in findings.collect()} == {("b.parquet", "schema")}
    conflicts = spark.read.json(str(tmp_path / "conflicts"))
    assert {(r.path, r.problem) for r in conflicts.collect()} == {
        ("alien.txt", "not indexed"), ("a.parquet", "duplicate"), ("a.parquet", "already queued"),
    }
    plan = delivery.resume(spark, index, log, sf.scan_files(spark, str(root)))
    assert {r.path: r.reason for r in plan.collect()} == {
        "a.parquet": "valid", "b.parquet": "invalid", "_c.parquet": "missing", "notes.txt": "valid", "gone.parquet": "invalid",
    }


def test_a_new_checkpoint_begins_with_the_verdict_log(spark, tmp_path):
    reports = [("transfer", "a", "ok"), ("transfer", "b", "ok"), ("transfer", "b", "ok"), ("transfer", "c", "failure")]
    rows = spark.createDataFrame(reports, "category string, ref string, status string")
    se.write_events(rows.coalesce(1), f"{tmp_path}/log", {"agent_id": "client"})
    judged = spark.createDataFrame([("a",), ("a",), ("z",)], "path string")
    found = delivery.report_stream(se.good_rows(se.stream_events(spark, f"{tmp_path}/log")), judged)
    query = found.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option(
        "checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(map(tuple, got)) == [("a", 1, True), ("b", 2, False)]


def test_index_files(spark, tmp_path):
    index = spark.createDataFrame([("a.txt", "yH2GHg==", True), ("b.txt", None, False)], "path string, checksum string, will_transfer boolean")
    sf.write_index(index, str(tmp_path / "index"))
    read = sf.read_index(spark, str(tmp_path / "index"))
    assert sorted(tuple(r) for r in read.collect()) == [("a.txt", "yH2GHg==", True), ("b.txt", None, False)]
    for i, header in enumerate(["x,will_transfer", "path,checksum", "path,will_transfer,checksum,x", "path,will_transfer,sum"]):
        (tmp_path / f"{i}.csv").write_text(header + "\n")
        with pytest.raises(ValueError, match="bad file index"):
            sf.read_index(spark, str(tmp_path / f"{i}.csv"))
    assert sf.read_index(spark, str(tmp_path / "1.csv"), strict=False).columns == ["path", "checksum"]


def test_listing_and_magic(spark, tmp_path):
    root = tmp_path / "root"
    (root / "nested").mkdir(parents=True)
    (root / "alpha.gz").write_bytes(b"\x1f\x8b\x08rest")
    (root / "nested" / "beta.txt").write_text("beta")
    (root / "_hidden").write_text("x")
    listed = {r.path: r.length for r in sf.scan_files(spark, str(root)).collect()}
    assert listed == {"alpha.gz": 7, "nested/beta.txt": 4}
    index = spark.createDataFrame([("_hidden",), ("gone",), ("alpha.gz",)], "path string")
    assert {r.path for r in sf.from_manifest(index, str(root)).collect()} == {"_hidden", "alpha.gz"}
    from lading.functions.content import compression_of

    magic = sf.read_magic(sf.scan_files(spark, str(root)), str(root))
    assert {r.path: r.c for r in magic.select("path", compression_of(F.col("magic")).alias("c")).collect()} == {
        "alpha.gz": ".gz", "nested/beta.txt": None,
    }


def test_reports(spark, tmp_path):
    report = spark.createDataFrame([("d", 3, 1)], "dataset string, files_expected long, n_errors long")
    errors = spark.createDataFrame([("a", "bad")], "path string, message string")
    sf.write_report(report, errors, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r" / "report")).first().value == '{"dataset":"d","files_expected":3,"n_errors":1}'
    assert spark.read.json(str(tmp_path / "r" / "errors")).count() == 1
    sf.dump_file_state(errors.withColumn("state", F.lit("invalid")), str(tmp_path / "s"))
    assert spark.read.csv(str(tmp_path / "s"), header=True).columns == ["file", "state", "message"]
    sf.write_filetype_report(spark.createDataFrame([("a", "x;y")], "path string, filetypes string"), str(tmp_path / "f"))
    assert spark.read.csv(str(tmp_path / "f"), header=True).first().filetypes == "x;y"
