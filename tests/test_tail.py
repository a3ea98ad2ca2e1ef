"""The tailing source: growing files, half-written rows, restarts."""

import io

import numpy as np
import pytest

from lading.sources import events as se
from lading.sources import tail


def plain_end(data):
    """End of the last line break outside quotes, byte by byte."""
    end, inside = 0, False
    for i, byte in enumerate(data):
        inside ^= byte == ord('"')
        if byte == 10 and not inside:
            end = i + 1
    return end


@pytest.mark.parametrize("block", [1, 3, 1 << 20])
def test_the_end_of_whole_rows(monkeypatch, block):
    monkeypatch.setattr(tail, "BLOCK", block)
    rng = np.random.default_rng(block)
    for _ in range(400):
        data = bytes(rng.choice(list(b'ab\t"\n'), rng.integers(0, 40)).astype(np.uint8))
        assert tail.whole_rows(io.BytesIO(data), 0, len(data)) == plain_end(data)
        half = plain_end(data[: len(data) // 2])
        assert tail.whole_rows(io.BytesIO(data), half, len(data)) == half + plain_end(data[half:])
    rows = b"a\tb\n" * 100
    assert 40 <= tail.whole_rows(io.BytesIO(rows), 0, len(rows), 40) <= 40 + max(block, 4)


def test_rows_come_once_however_the_log_grows(spark, tmp_path):
    log, out = tmp_path / "log", str(tmp_path / "out")
    (log / "deep").mkdir(parents=True)
    (log / "_hidden").write_text("x\n")

    def drain():
        stream = tail.tail_events(spark, str(log), most_bytes=64)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/ck").start()
        query.processAllAvailable()
        query.stop()
        return sorted((r.time, r.message, r.problem) for r in spark.read.parquet(out).collect())

    def row(time, message):
        return f'{time}\ttransfer\tf\tok\t{message}\tclient\n'

    first, second = log / "a.tsv", log / "deep" / "b.tsv"
    first.write_text(row(1, "one") + row(2, '"two ""quoted""\nlines"') + row(3, '"half\n wri')[:-10])
    assert drain() == [("1", "one", None), ("2", 'two "quoted"\nlines', None)]
    first.write_text(row(1, "one") + row(2, '"two ""quoted""\nlines"') + row(3, '"half\n written"')[:-1])
    second.write_text(row(4, "ünï") + "5\ttransfer\n" + "\ttransfer\t\tok\tm\tclient\n")
    got = drain()
    assert [g for g in got if g[0] != "3"] == [
        ("", "m", "missing required fields: time, ref"), ("1", "one", None), ("2", 'two "quoted"\nlines', None),
        ("4", "ünï", None), ("5", "", "wrong number of columns"),
    ]
    assert not [g for g in got if g[0] == "3"]  # its line has not ended
    with first.open("a") as f:
        f.write("\n" + "".join(row(10 + i, "more") for i in range(20)))
    got = drain()
    assert ("3", "half\n written", None) in got and len(got) == 26 and drain() == got
    assert len([g for g in got if g[1] == "more"]) == 20


def test_strict_reading_refuses_a_malformed_row(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a").write_text("1\ttransfer\n")
    stream = tail.tail_events(spark, str(tmp_path / "log"), strict=True)
    query = stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/ck").start()
    with pytest.raises(Exception, match="wrong number of columns"):
        query.processAllAvailable()


def test_the_same_rows_as_the_batch_reader(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([("transfer", f"f{i}", "ok", 'say "x"\n\there') for i in range(30)], "category string, ref string, status string, message string")
    se.write_events(rows.repartition(3), log, {"agent_id": "c"})
    query = tail.tail_events(spark, log).writeStream.format("parquet").option("path", f"{tmp_path}/out").option(
        "checkpointLocation", f"{tmp_path}/ck").start()
    query.processAllAvailable()
    query.stop()
    fields = ["time", "category", "ref", "status", "message", "agent_id", "problem"]
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/out").select(fields).collect())) == sorted(
        map(str, se.read_events(spark, log).select(fields).collect())
    )
