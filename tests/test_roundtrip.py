"""Parquet files on disk: describe, validate, and single mutations."""

import datetime as dt
import decimal

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lading.operators import hooks, lint
from lading.plans import validate as v
from lading.plans.describe import describe_types
from lading.sources import files as sf
from lading.sources import probes
from lading.spec import Specs, load_specs, write_specs

CODES = {
    "b": (pa.bool_(), "b1"), "i1": (pa.int8(), "i1"), "u1": (pa.uint8(), "u1"),
    "i2": (pa.int16(), "i2"), "u4": (pa.uint32(), "u4"), "u8": (pa.uint64(), "u8"),
    "f2": (pa.float16(), "f2"), "f4": (pa.float32(), "f4"), "f8": (pa.float64(), "f8"),
    "day": (pa.date32(), "M8[D]"), "ns": (pa.timestamp("ns"), "M8[ns]"),
    "us": (pa.timestamp("us"), "M8[us]"), "dur": (pa.duration("ms"), "m8[ms]"),
    "text": (pa.string(), "O"), "raw": (pa.binary(), "O"), "fixed": (pa.binary(5), "V5"),
    "list": (pa.list_(pa.int32()), "O"), "struct": (pa.struct([("a", pa.int32())]), "O"),
    "dec": (pa.decimal128(9, 2), "V16"),
}


def _write(folder, name, fields, rows=3, metadata=None, **options):
    schema = pa.schema([(n, t) for n, t in fields], metadata=metadata)
    table = pa.table([pa.nulls(rows, t) for _, t in fields], schema=schema)
    pq.write_table(table, folder / name, **options)


def _label(**types):
    return {"dataset": "d", "delivery_id": 1, "filetypes": types}


PARQUET = {"filename": r"\.parquet$", "standard": "parquet"}


@pytest.fixture
def folder(tmp_path):
    return tmp_path


def test_codes(spark, folder):
    _write(folder, "all.parquet", [(n, t) for n, (t, _) in CODES.items()])
    _write(folder, "empty.parquet", [("x", pa.int32())], rows=0)
    files = sf.scan_files(spark, str(folder))
    found = probes.probe_parquet(files, str(folder)).orderBy("path", "col_ix").collect()
    assert [(r.name, r.dtype) for r in found if r.path == "all.parquet"] == [
        (n, code) for n, (_, code) in CODES.items()
    ]
    assert [r.name for r in found if r.path == "empty.parquet"] == ["x"]


def test_describe_then_validate(spark, folder):
    columns = [("id", pa.int64()), ("name", pa.string())]
    for i, n in enumerate((2, 3, 5)):
        flux = [(f"flux_{k:02d}", pa.float32()) for k in range(n)]
        _write(folder, f"obs{i}.parquet", [*columns, *flux, (f"end{'abc'[i]}", pa.bool_())])
    _write(folder, "other.parquet", [("x", pa.int32())])
    _write(folder, "other2.parquet", [("x", pa.int64())])
    label = _label(
        obs={"filename": r"^obs\d", "standard": "parquet"},
        other={"filename": "^other", "standard": "parquet"},
        notes={"filename": r"\.txt$", "standard": "text"},
    )
    files = sf.scan_files(spark, str(folder))
    specs, problems = describe_types(files, Specs.from_labels(spark, [label]), str(folder))
    assert {(r.type, r.problem) for r in problems.collect()} == {
        ("other", "column 0: mismatched dtype: i4 vs. i8"),
        ("notes", "no files"),
        ("notes", "text does not support data-level validation"),
    }
    found = [
        (r.name, r.name_regex, r.repeated, r.dtype)
        for r in specs.columns.orderBy("col_ix").collect()
    ]
    assert found == [
        ("id", False, False, "i8"), ("name", False, False, "O"),
        (r"flux((?:_|\d)*\d+)", True, True, "f4"), ("end.", True, False, "b1"),
    ]
    obs = files.filter(F.col("path").startswith("obs"))
    assert v.validate_all(obs, specs, str(folder)).failures.count() == 0
    assert lint.lint_specs(specs).filter("lpath like '/filetypes/obs%'").count() == 0
    write_specs(specs, str(folder / "specs"))
    again = load_specs(spark, str(folder / "specs"))
    assert again.columns.exceptAll(specs.columns).count() == 0
    assert v.validate_all(obs, again, str(folder)).failures.count() == 0


SPEC = [
    {"name": "a", "dtype": "i4"}, {"name": "b", "dtype": "f8"}, {"name": "c", "dtype": "O"},
]
GOOD = [("a", pa.int32()), ("b", pa.float64()), ("c", pa.string())]
MUTATIONS = {
    "good": (GOOD, []),
    "missing": (GOOD[:2], ["field 'c' missing"]),
    "extra": ([*GOOD, ("d", pa.int8())], ["extra field 'd'"]),
    "retyped": ([GOOD[0], ("b", pa.float32()), GOOD[2]], ["wrong dtype: expected f8, got f4"]),
    "renamed": ([("z", pa.int32()), *GOOD[1:]], ["wrong name: expected 'a', got 'z'"]),
    "swapped": (
        [GOOD[1], GOOD[0], GOOD[2]],
        [
            "wrong dtype: expected f8, got i4", "wrong dtype: expected i4, got f8",
            "wrong name: expected 'a', got 'b'", "wrong name: expected 'b', got 'a'",
        ],
    ),
}


def test_mutations(spark, folder):
    for name, (fields, _) in MUTATIONS.items():
        _write(folder, f"{name}.parquet", fields)
    specs = Specs.from_labels(spark, [_label(t={**PARQUET, "objects": [{"schema": SPEC}]})])
    outcome = v.validate_all(sf.scan_files(spark, str(folder)), specs, str(folder))
    found = outcome.failures.collect()
    for name, (_, wanted) in MUTATIONS.items():
        assert sorted(r.message for r in found if r.path == f"{name}.parquet") == wanted
    verdicts = {r.path: r.verdict for r in outcome.files.collect()}
    assert verdicts["good.parquet"] == "ok" and verdicts["extra.parquet"] == "failure"
    counts = v.count_outcomes(outcome).first()
    assert (counts.n_failed, counts.n_files) == (5, 6)
    one = v.validate_file(sf.scan_files(spark, str(folder)), "extra.parquet", specs, str(folder))
    assert [r.path for r in one.files.collect()] == ["extra.parquet"]
    assert [r.path for r in v.validate_all_summary(outcome).collect()] == sorted(
        f"{n}.parquet" for n, (_, wanted) in MUTATIONS.items() if wanted
    )


def test_metadata_and_skips(spark, folder):
    meta = {"n": "12", "flag": "Yes", "bad": "maybe", "x": "1.50", "id": "run-7"}
    _write(folder, "m.parquet", GOOD, metadata=meta)
    wanted = {
        "n": {"value": 12}, "flag": {"value": True}, "bad": {"value": False}, "x": {"value": 2.5},
        "id": {"value": r"run-\d", "value_regex": True}, "gone": {}, "n2": {"value": 1},
    }
    objects = [{"schema": SPEC[:2], "metadata": wanted}]

    def keys(**options):
        label = _label(t={**PARQUET, "objects": objects, "validation_options": options})
        files = sf.scan_files(spark, str(folder))
        rows = v.validate_all(files, Specs.from_labels(spark, [label]), str(folder)).failures
        return sorted(f"{r.check}/{r.key}" for r in rows.collect())

    assert keys() == ["metadata/bad", "metadata/gone", "metadata/n2", "metadata/x", "schema/2"]
    assert keys(skip=["metadata"]) == ["schema/2"]
    assert keys(skip=["all"]) == []


def test_damaged_files(spark, folder):
    rng = np.random.default_rng(1)
    table = pa.table({"a": pa.array(rng.integers(0, 1 << 30, 5000), pa.int32()),
                      "b": rng.random(5000), "c": [str(x) for x in rng.integers(0, 99, 5000)]})
    pq.write_table(table, folder / "whole.parquet", row_group_size=1000, compression="none")
    data = (folder / "whole.parquet").read_bytes()
    (folder / "short.parquet").write_bytes(data[: len(data) // 2])
    broken = bytearray(data)
    broken[4:400] = b"\xff" * 396  # page header of the first row group
    (folder / "broken.parquet").write_bytes(bytes(broken))
    specs = Specs.from_labels(spark, [_label(t={**PARQUET, "objects": [{"schema": SPEC}]})])
    files = sf.scan_files(spark, str(folder))
    found = {(r.path, r.check) for r in v.validate_all(files, specs, str(folder)).failures.collect()}
    assert found == {("short.parquet", "load"), ("broken.parquet", "schema")}
    verdicts, _ = v.server_validate(
        files.select("path", F.lit("t").alias("type")),
        files.withColumn("checksum", F.lit(None).cast("string")), specs, str(folder),
    )
    assert {r.path: r.status for r in verdicts.collect()} == {
        "whole.parquet": "ok", "short.parquet": "failure", "broken.parquet": "failure",
    }


def test_hooks(spark, folder):
    _write(folder, "h.parquet", GOOD, rows=4)
    _write(folder, "k.parquet", GOOD, rows=0)

    def nonempty(data, spec):
        return {} if data.metadata.num_rows else {"rows": "no rows"}

    def crash(data, spec):
        raise RuntimeError("boom")

    files = sf.scan_files(spark, str(folder))

    def run(hook, **options):
        options = {"object_check_hook": hook, **options}
        label = _label(t={**PARQUET, "validation_options": options})
        specs = Specs.from_labels(spark, [label])
        found = v.validate_all(
            files, specs, str(folder), hooks={"nonempty": nonempty, "crash": crash}
        ).failures
        return sorted((r.path, r.check, r.key, r.message) for r in found.collect())

    assert run("nonempty") == [("k.parquet", "hook:nonempty", "rows", "no rows")]
    assert run("nonempty", skip=["hook"]) == []
    assert {m for *_, m in run("crash")} == {"RuntimeError: boom"}
    assert all("ModuleNotFoundError" in m for *_, m in run("no_such_module"))
    clash = spark.createDataFrame([("p", "", "schema", "", "m")], "path string, object string, check string, key string, message string")
    with pytest.raises(Exception, match="collision"):
        hooks.merge_failures(clash, clash).collect()


def test_values_stay_exact(spark, folder):
    table = pa.table({"when": [dt.datetime(2026, 1, 1)], "dec": [decimal.Decimal("1.25")]})
    pq.write_table(table, folder / "v.parquet")
    found = probes.probe_parquet(sf.scan_files(spark, str(folder)), str(folder)).collect()
    assert {r.name: r.dtype for r in found}["when"] == "M8[us]"
