"""Bucketed scans and slot walks against brute force, with one hot key."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lading.operators import scans
from lading.operators.align import spec_runs


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out, seen = [], {}
    for _ in range(3000):
        key = "hot" if rng.random() < 0.34 else f"k{rng.randrange(40)}"
        seen[key] = seen.get(key, -1) + 1
        out.append((key, seen[key], rng.randrange(5), rng.choice("aab")))
    return out


def _by_key(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row)
    return groups


def test_running(spark, rows):
    df = spark.createDataFrame(rows, "k string, pos int, v int, s string")
    got = scans.running(
        df, ["k"], [F.col("pos")], scans.position_bucket(F.col("pos"), 16),
        {"total": ("sum", F.col("v")), "top": ("max", F.col("v")), "low": ("min", F.col("v"))},
    )
    found = {(r.k, r.pos): (r.total, r.top, r.low) for r in got.collect()}
    assert len(found) == len(rows)
    for key, group in _by_key(rows).items():
        values = []
        for _, pos, v, _ in group:
            values.append(v)
            assert found[key, pos] == (sum(values), max(values), min(values))


@pytest.mark.parametrize("forward", [False, True])
def test_neighbours(spark, rows, forward):
    df = spark.createDataFrame(rows, "k string, pos int, v int, s string")
    got = scans.neighbours(
        df, ["k"], [F.col("pos")], scans.position_bucket(F.col("pos"), 16), F.col("s"), "near", forward
    )
    found = {(r.k, r.pos): r.near for r in got.collect()}
    for key, group in _by_key(rows).items():
        for i, (_, pos, _, _) in enumerate(group):
            j = i + 1 if forward else i - 1
            assert found[key, pos] == (group[j][3] if 0 <= j < len(group) else None)


def test_change_runs(spark, rows):
    df = spark.createDataFrame(rows, "k string, pos int, v int, s string")
    got = scans.change_runs(
        df, ["k"], [F.col("pos")], scans.position_bucket(F.col("pos"), 16),
        F.col("s"), lambda a, b: a != b, "run",
    )
    found = {(r.k, r.pos): r.run for r in got.collect()}
    for key, group in _by_key(rows).items():
        run = 0
        for i, (_, pos, _, s) in enumerate(group):
            run += i == 0 or group[i - 1][3] != s
            assert found[key, pos] == run


SLOTS = [("key", False), ("a+", True), ("b", True), ("c", False), ("[ab]", True)]


def _greedy(names, strict):
    slot, first, out = -1, True, []
    for name in names:
        repeated = 0 <= slot < len(SLOTS) and SLOTS[slot][1]
        hit = repeated and re.fullmatch(SLOTS[slot][0], name)
        slot = slot if hit and (first or not strict) else slot + 1
        inside = slot < len(SLOTS) and SLOTS[slot][1]
        first = bool(inside and re.fullmatch(SLOTS[slot][0], name))
        out.append(slot)
    return out


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("portable", [False, True])
def test_spec_runs(spark, strict, portable):
    rng = random.Random(3)
    files = {f"f{i}": ["key", *rng.choices(["a", "b", "c"], k=rng.randrange(9))] for i in range(60)}
    files["hot"] = ["key", *["aa"] * 40, *["b"] * 70, "c", *rng.choices(["a", "b"], k=90), "c", "c"]
    files["odd"] = ["x", "b", *["a"] * 30]
    items = spark.createDataFrame(
        [(f, "t", 0, i, n) for f, names in files.items() for i, n in enumerate(names)],
        "path string, type string, obj_ix int, pos int, name string",
    )
    slots = spark.createDataFrame(
        [("t", 0, i, p, rf"\A(?:{p})\z", r) for i, (p, r) in enumerate(SLOTS)],
        "type string, obj_ix int, slot int, name string, java_name string, repeated boolean",
    )
    got = spec_runs(items, slots, portable, strict, width=8)
    found = {(r.path, r.pos): r.slot for r in got.collect()}
    for path, names in files.items():
        assert [found[path, i] for i in range(len(names))] == _greedy(names, strict), path
