"""Several labels in one job: the pattern index, options by label, content checks by label."""

import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lading import load_specs
from lading.functions.regex import literal_runs
from lading.operators import archive, classify, manifest
from lading.plans import validate as v
from lading.sources.files import scan_files
from lading.spec import Specs, write_specs

PATTERNS = [
    r"\.fits$", r"^raw/", r"(raw|cal)/img", r"img_\d{3}", r"(?i)README", r"a+b", r"(ab)+c", r"(?:xyz)?tail", r"[ab]cde",
    r"v\d+\.\w+", r"(i)mg(?(1)_|x)", r"(?<=raw/)img", r"x{0}cat", r"\Aimg", r"log$", r"(?>cat)_", r"\bdog\b", r"", r".", r"né+e",
]


def test_literal_runs_are_in_every_match():
    rng = np.random.default_rng(0)
    parts = ["raw/", "cal/", "img", "_", "001", "123", ".fits", "README", "readme", "a", "b", "c", "xyz", "tail", "cde", "cat", "dog", "log",
             "v2.x", "née", " "]
    texts = ["".join(rng.choice(parts, rng.integers(1, 8))) for _ in range(3000)]
    for pattern in PATTERNS:
        runs = literal_runs(pattern)
        hits = [m[0] for t in texts if (m := re.search(pattern, t))]
        assert all(run in t for run in runs for t in texts if re.search(pattern, t)), pattern
        assert hits or pattern in (r"\Aimg",), pattern
    assert literal_runs(r"(raw|cal)/img_\d+\.fits$") == ["/img_", ".fits"] and literal_runs("(?i)abc") == []


@pytest.mark.parametrize("match", ["search", "basename", "full"])
def test_types_of_many_labels_as_python_finds_them(spark, match):
    rng = np.random.default_rng(7)
    parts = ["raw/", "cal/", "img", "_001", "123", ".fits", "readme", "ab", "cat", "dog ", "log", "v2.x", "née", "xyz", "\n"]
    paths = sorted({"".join(rng.choice(parts, rng.integers(1, 6))) for _ in range(300)})
    labels, files = [], []
    for d in range(6):
        types = {f"t{k}": rng.choice(PATTERNS, rng.integers(1, 4), replace=False).tolist() for k in range(5)}
        types["t0"].append("(?!)" + str(rng.choice(PATTERNS[:12])))
        labels.append({"dataset": "d", "delivery_id": d, "filetypes": {t: {"filename": p} for t, p in types.items()}})
        files += [("d", str(d), p) for p in paths if rng.random() < 0.5]
    files += [("d", "99", "raw/img"), (None, None, "raw/img"), ("d", "1", None), files[0]]
    df = spark.createDataFrame([(*f, 1) for f in files], "dataset string, delivery_id string, path string, length int")
    specs = Specs.from_labels(spark, labels)
    got = classify.match_types(df, specs, match)
    assert got.columns == ["dataset", "delivery_id", "path", "length", "types"]
    probe = {"search": re.search, "basename": lambda p, t: re.match(p, t.split("/")[-1]), "full": re.fullmatch}[match]

    def wanted(dataset, delivery, path):
        label = next((x for x in labels if str(x["delivery_id"]) == delivery), {"filetypes": {}})
        for name, own in label["filetypes"].items() if path is not None else ():
            include = [p for p in own["filename"] if not p.startswith("(?!)")]
            exclude = [p[4:] for p in own["filename"] if p.startswith("(?!)")]
            if any(probe(p, path) for p in include) and not any(probe(p, path) for p in exclude):
                yield name

    assert sorted((r[0] or "", r[1] or "", r[2] or "", r.types) for r in got.collect()) == sorted(
        (f[0] or "", f[1] or "", f[2] or "", sorted(wanted(*f))) for f in files
    )


def test_an_entry_is_the_piece_fewest_patterns_share(spark):
    patterns = [("d", "1", f"t{i}", rf"data/part_{i}x\.dat", True) for i in range(4)] + [("d", "1", "u", r"\d+", True)]
    rows = spark.createDataFrame(patterns, "dataset string, delivery_id string, type string, pattern string, include boolean")
    found = {r.type: r.gram for r in archive.index_patterns(rows).collect()}
    assert found["u"] is None and len({found[f"t{i}"] for i in range(4)}) == 4
    assert all(str(i) in found[f"t{i}"] for i in range(4))


LABELS = [
    {"dataset": "d", "delivery_id": 1, "filetypes": {
        "a": {"filename": r"^one/", "standard": "parquet", "objects": [{"schema": [{"name": "x", "dtype": "i8"}]}]},
        "b": {"filename": "never"}}},
    {"dataset": "d", "delivery_id": 2, "filetypes": {
        "a": {"filename": r"^two/", "standard": "parquet", "objects": [{"schema": [{"name": "y", "dtype": "i8"}]}]},
        "c": {"filename": "skip", "ignore": True}},
     "delivery_meta": {"global_validation_options": {"missing_filetypes_ok": True}}},
]


def test_one_row_a_file_and_checks_by_its_own_label(spark, tmp_path):
    for path, column in (("one/p", "x"), ("one/q", "y"), ("two/p", "x"), ("two/q", "y"), ("two/skip", "z")):
        (tmp_path / path).parent.mkdir(exist_ok=True)
        pq.write_table(pa.table({column: pa.array([1, 2], pa.int64())}), tmp_path / path)
    specs = load_specs(spark, LABELS)
    delivery = v.F.when(v.F.col("path").startswith("one"), "1").otherwise("2")
    files = scan_files(spark, str(tmp_path)).withColumns({"dataset": v.F.lit("d"), "delivery_id": delivery})
    outcome = v.validate_all(files.filter("path <> 'two/skip'"), specs, str(tmp_path))
    got = {(r.delivery_id, r.path): (r.type, r.verdict) for r in outcome.files.collect()}
    assert got == {("1", "one/p"): ("a", "ok"), ("1", "one/q"): ("a", "failure"), ("2", "two/p"): ("a", "failure"), ("2", "two/q"): ("a", "ok")}
    typed = classify.type_lookup(classify.classify(files, specs), specs)
    assert typed.count() == 5
    _, problems = manifest.check_manifest(files.select("dataset", "delivery_id", "path", v.F.lit(True).alias("will_transfer")), specs, "search")
    assert sorted(map(tuple, problems.collect())) == [
        ("d", "1", "filetype without files", "b"), ("d", "2", "ambiguous filetype", "two/skip"),
    ]
    with pytest.raises(ValueError, match="dataset and delivery_id"):
        classify.classify(files.drop("dataset"), specs)
    write_specs(specs, str(tmp_path / "specs"))
    again = load_specs(spark, str(tmp_path / "specs"))
    assert not again.single and sorted(map(str, again.options.collect())) == sorted(map(str, specs.options.collect()))
    index = files.select("dataset", "delivery_id", "path", v.F.lit("a").alias("type")).filter("path <> 'two/skip'")
    verdicts, _ = v.server_validate(index, scan_files(spark, str(tmp_path)).withColumn("checksum", v.F.lit(None).cast("string")), specs, str(tmp_path))
    told = {r.path: r.message for r in verdicts.collect()}
    assert not told["one/p"] and told["one/q"] == "  0/schema/0\n    wrong name: expected 'x', got 'y'"
