"""Guards that hold whatever a caller reads, and work that spreads by its amount."""

import pytest
from pyspark.sql import functions as F

from lading import load_specs
from lading.operators import events as ev
from lading.operators import hooks, scans
from lading.operators.archive import match_types_by_delivery
from lading.operators.nodes import document_problems, flatten_paths, match_nodes
from lading.sources import events, files


def test_strict_reading_fails_whatever_is_selected(spark):
    rows = spark.createDataFrame(
        [("a", "t", None), ("a", "t", "too few columns")], "chunk string, time string, problem string"
    )
    for columns in (["chunk"], ["time"]):
        with pytest.raises(Exception, match="too few columns"):
            events.enforce_event_format(rows, strict=True).select(*columns).collect()
    assert events.enforce_event_format(rows.filter("problem IS NULL"), strict=True).count() == 1


def test_colliding_hook_failures_are_refused_even_when_counted(spark):
    layout = "path string, object string, check string, key string, message string"
    standard = spark.createDataFrame([("p", "", "schema", "k", "m")], layout)
    good = spark.createDataFrame([("p", "", "hook:x", "k", "m")], layout)
    assert hooks.merge_failures(standard, good).select("path").count() == 2
    with pytest.raises(Exception, match="namespace collision"):
        hooks.merge_failures(standard, standard).select("path").collect()


def test_null_keys_are_one_key(spark):
    log = spark.createDataFrame([(None, 1), (None, 2), ("a", 1), ("a", 9)], "ref string, time bigint")
    counted = scans.running(log, ["ref"], [F.col("time")], F.col("time"), {"n": ("sum", F.lit(1))})
    assert sorted(counted.select("ref", "n").collect(), key=str) == sorted(
        [(None, 1), (None, 2), ("a", 1), ("a", 2)], key=str
    )


def test_ten_thousand_paths_reach_every_core(spark):
    paths = spark.range(10_000).select(F.format_string("f%05d", "id").alias("path"), F.lit(0).alias("ix"))
    for keys in (["path"], ["path", "ix"]):
        used = files.spread(paths, *keys).select(F.spark_partition_id().alias("p")).distinct().count()
        assert used >= spark.sparkContext.defaultParallelism


def test_value_patterns_outlive_inferred_objects(spark):
    label = {
        "dataset": "d", "delivery_id": 1,
        "filetypes": {"t": {"filename": r".*\.parquet", "standard": "parquet", "objects": [
            {"name": "TABLE", "metadata": {"origin": {"value": "GOOD.*", "value_regex": True}}}]}},
    }
    specs = load_specs(spark, label)
    kept = specs.with_objects(specs.objects, specs.columns, frozenset({"other"}))
    assert "GOOD.*" in specs.known_regexes and kept.known_regexes >= specs.known_regexes | {"other"}


def test_documents_of_any_depth_and_bad_ones_are_told(spark):
    deep = "1.5"
    for i in range(40):
        deep = f'[{deep}, "x"]' if i % 2 else f'{{"k`{i}": {deep}}}'
    docs = spark.createDataFrame(
        [(1, '{"a": {"b": {"c": 1}}, "d": [2, [], {}, null, true]}'), (2, "{"), (3, None), (4, "7"), (5, "{}"), (6, deep)], "`own id` int, doc string"
    )
    flat = flatten_paths(docs, "doc", ["own id"])
    rows = {(r[0], "/".join(r.node)): (r.value, r.value_type) for r in flat.filter("`own id` < 6").collect()}
    assert rows == {(1, "a/b/c"): ("1", "int"), (1, "d/0"): ("2", "int"), (1, "d/3"): (None, "null"), (1, "d/4"): ("true", "bool")}
    found = flat.filter("`own id` = 6").collect()
    assert len(found) == 21 and max(len(r.node) for r in found) == 40 and {r.value for r in found} == {"1.5", "x"}
    docs = docs.withColumnRenamed("own id", "id")
    told = {r.id: r.problem for r in document_problems(docs, "doc", ["id"]).collect()}
    assert told == {2: "not a JSON document", 3: "no document", 4: "a single value, not a tree"}


def test_a_pattern_without_jvm_form_is_tested_by_python(spark):
    files = spark.createDataFrame([("d", 1, "ab"), ("d", 1, "ac")], "dataset string, delivery_id int, path string")
    patterns = spark.createDataFrame(
        [("d", 1, "t", "(a)(?(1)b|c)", True)],
        "dataset string, delivery_id int, type string, pattern string, include boolean",
    )
    assert sorted(match_types_by_delivery(files, patterns).select("path", "types").collect()) == [("ab", ["t"]), ("ac", [])]


def test_node_patterns_that_only_python_has(spark):
    names = [["a", "(x)?(?(1)y|z)"], "(q)(?(1)r|s)$", ["b", r"\d+"]]
    label = {"dataset": "d", "delivery_id": 1, "filetypes": {"t": {"filename": ".*", "standard": "asdf", "objects": [
        {"name": n, "name_regex": True} for n in names]}}}
    nodes = [["a", "xy"], ["a", "xz"], ["a", "z"], ["a", "z", "more"], ["c", "qr"], ["b", "12"], ["qs"], []]
    df = spark.createDataFrame([("p", "t", n) for n in nodes], "path string, type string, node array<string>")
    found = {(tuple(r.node), r.obj_ix) for r in match_nodes(df, load_specs(spark, label)).collect()}
    assert found == {(("a", "xy"), 0), (("a", "z"), 0), (("c", "qr"), 1), (("b", "12"), 2)}


def test_transfers_of_unknown_files_are_failures(spark):
    index = spark.createDataFrame([("a", True)], "path string, will_transfer boolean")
    log = spark.createDataFrame(
        [("a", "transfer", "ok", None, 1), ("z", "transfer", "ok", None, 2), ("z", "transfer", "ok", None, 3)],
        "ref string, category string, status string, message string, time int",
    )
    report = ev.delivery_report(index, ev.file_states(log), {"dataset": "d"}, log).first()
    assert (report.files_expected, report.total_failures) == (1, 2)
