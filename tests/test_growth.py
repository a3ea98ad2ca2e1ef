"""What grows with the input: passes over the rows, tables kept by tasks, rounds of a recursion."""

import json
import random

from pyspark.sql import functions as F

from lading.operators import infer, scans
from lading.operators.align import spec_runs
from lading.operators.nodes import flatten_paths


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _items(spark):
    rng = random.Random(5)
    rows = [
        ("s" if f % 2 else "t", f, i, f"{rng.choice('ab')}_{i}", "f4", 0)
        for f in range(40)
        for i in range(rng.randrange(1, 6))
    ]
    return rows, spark.createDataFrame(rows, "scope string, file int, pos int, name string, dtype string, ndim int")


def test_walk_streams(spark):  # F1
    items = spark.createDataFrame(
        [(p, "t", 0, i, n) for p in ("x", "y") for i, n in enumerate(["k", "a", "a", "b"])],
        "path string, type string, obj_ix int, pos int, name string",
    )
    slots = spark.createDataFrame(
        [("t", 0, 0, "k", r"\A(?:k)\z", False), ("t", 0, 1, "a", r"\A(?:a)\z", True)],
        "type string, obj_ix int, slot int, name string, java_name string, repeated boolean",
    )
    walked = spec_runs(items, slots, strict=True)
    assert "collect_list" not in _plan(walked)
    assert sorted((r.path, r.pos, r.slot) for r in walked.collect()) == [
        (p, i, s) for p in ("x", "y") for i, s in enumerate([0, 1, 1, 2])
    ]


def test_short_files_are_shuffled_once(spark):  # F2, F4
    rows, items = _items(spark)
    runs = scans.change_runs(
        items, ["file"], [F.col("pos")], scans.position_bucket(F.col("pos")),
        F.substring("name", 1, 1), lambda a, b: a != b, "run",
    )
    assert _plan(runs).count("Exchange hashpartitioning") == 1
    totals = scans.running(
        items, ["file"], [F.col("pos")], scans.position_bucket(F.col("pos")), {"n": ("sum", F.lit(1))}
    )
    assert _plan(totals).count("Exchange hashpartitioning") == 1
    assert all(r.n == r.pos + 1 for r in totals.collect())


def test_properties_are_compared_by_distinct_value(spark):  # F2
    rows, items = _items(spark)
    grouped = items.withColumns({"group_id": F.col("pos"), "stem": F.lit(None).cast("string")})
    unified = infer.unify_groups(grouped, ["scope"], "group_id", ["file"], ["dtype", "ndim"])
    below = _plan(unified).split("\n")
    scan = [line for line in below if "SortAggregate(key=[scope" in line and "file" in line]
    assert not scan
    found = {(r.scope, r.group_id): (r.dtype, r.ndim, r.failure) for r in unified.collect()}
    for (scope, group), (dtype, ndim, failure) in found.items():
        files = {r[1] for r in rows if r[0] == scope}
        have = {r[1] for r in rows if r[0] == scope and r[2] == group}
        assert (dtype, ndim) == ("f4", "0")
        assert failure == (None if have == files else "incompatible group count")


def test_variants_in_one_pass_without_tables_of_items(spark):  # F3
    rows, items = _items(spark)
    rows = rows + [("s", 90, 0, None, "f4", 0), ("s", 90, 1, None, "f4", 0), (None, 91, 0, "a", "f4", 0)]
    items = spark.createDataFrame(rows, items.schema)
    found = infer.structure_variants(items, ["scope"], ["file"])
    plan = _plan(found)
    assert plan.count("Scan ExistingRDD") == 1
    first = plan.split("Exchange")[-1]  # what is done before the rows are dealt out
    assert "HashAggregate" not in first
    wanted = {}
    for scope in ("s", "t"):
        files = {}
        for row in rows:
            if row[0] == scope:
                files.setdefault(row[1], []).append(row[3])
        wanted[scope] = (len({len(n) for n in files.values()}), len({frozenset(n) for n in files.values()}))
    assert {r.scope: (r.n_sizes, r.n_sets) for r in found.collect()} == wanted


def test_stems_of_nodes_are_not_written_again(spark):  # F5
    nodes = spark.createDataFrame(
        [("t", f, ["a", f"n_{i}"]) for f in range(4) for i in range(f + 1)],
        "type string, path int, node array<string>",
    )
    grouped = infer.stem_sets(nodes, ["type"], ["path"])
    plan = _plan(grouped.groupBy("parent", "stem").count())
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert "node#" not in plan  # only what is asked for is read
    assert {(r.parent, r.stem) for r in grouped.collect()} == {('["a"]', "n")}


def test_documents_take_a_round_per_eight_levels(spark):  # F6
    def nest(depth, leaf):
        for i in range(depth):
            leaf = {"k": leaf, "e": {}} if i % 2 else [leaf, [], i]
        return leaf

    docs = {d: nest(d, leaf) for d, leaf in [(1, "x"), (7, None), (8, 1.5), (9, True), (16, "y"), (17, 3), (30, "z")]}

    def leaves(tree, path=()):
        if isinstance(tree, dict | list):
            for k, v in tree.items() if isinstance(tree, dict) else enumerate(tree):
                yield from leaves(v, (*path, str(k)))
        else:
            yield path, tree

    df = spark.createDataFrame([(d, json.dumps(t)) for d, t in docs.items()], "id int, doc string")
    flat = flatten_paths(df, "doc", ["id"])
    assert flat._jdf.queryExecution().analyzed().toString().count("Generate variant_explode") == 8
    names = {str: "str", int: "int", float: "float", bool: "bool", type(None): "null"}
    found = sorted((r.id, tuple(r.node), r.value_type) for r in flat.collect())
    assert found == sorted((d, p, names[type(v)]) for d, t in docs.items() for p, v in leaves(t))
