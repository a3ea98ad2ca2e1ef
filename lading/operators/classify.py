"""Assign files to declared types by include/exclude patterns.

With one label known when the plan is built, every pattern becomes part of
one projection: no join, no shuffle, the regexes run inside codegen.  With
several labels files carry `dataset` and `delivery_id`, and the index of
`archive` finds the patterns of their own label; the operators here then take
everything by those keys, so labels may share type names.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lading.functions.regex import regex_test
from lading.operators.archive import ANCHORING, DELIVERY, match_types_by_delivery
from lading.spec import DATA_STANDARDS, Specs


def label_keys(files: DataFrame, specs: Specs) -> list[str]:
    """Columns that name a file's label: none with a single label."""
    if specs.single:
        return []
    if set(DELIVERY) <= set(files.columns):
        return DELIVERY
    raise ValueError("with several labels, files need the columns dataset and delivery_id")


def covers(
    path: Column, patterns: Iterable[tuple[str, bool]], match: str = "search"
) -> Column:
    """Some include pattern matches and no exclude pattern does."""
    subject, mode = ANCHORING[match]
    text = subject(path)
    tests = [(regex_test(text, p, mode), include) for p, include in patterns]
    included = [t for t, include in tests if include]
    excluded = [~t for t, include in tests if not include]
    return reduce(and_, excluded, reduce(or_, included, F.lit(False)))


def match_types(files: DataFrame, specs: Specs, match: str = "search") -> DataFrame:
    """Add `types`, the array of all types (of the file's label) that cover each path."""
    if label_keys(files, specs):
        return match_types_by_delivery(files, specs.patterns, match)
    hits = [
        F.when(covers(F.col("path"), patterns, match), F.lit(type_))
        for type_, patterns in specs.patterns_by_type.items()
    ]
    if not hits:
        return files.withColumn("types", F.array().cast("array<string>"))
    return files.withColumn(
        "types", F.filter(F.array(*hits), lambda t: t.isNotNull())
    )


def classify(files: DataFrame, specs: Specs, match: str = "search") -> DataFrame:
    """`types`, the single `type` (NULL otherwise) and a classification."""
    n_types = F.size("types")
    return match_types(files, specs, match).withColumns(
        {
            "type": F.when(n_types == 1, F.element_at("types", 1)),
            "assignment": F.when(n_types == 0, "unassigned")
            .when(n_types == 1, "assigned")
            .otherwise("ambiguous"),
        }
    )


def covered_only(files: DataFrame, specs: Specs, match: str = "search") -> DataFrame:
    """P5: files some type covers."""
    if label_keys(files, specs):
        return match_types(files, specs, match).filter(F.size("types") > 0).drop("types")
    tests = [
        covers(F.col("path"), patterns, match)
        for patterns in specs.patterns_by_type.values()
    ]
    return files.filter(reduce(or_, tests, F.lit(False)))


def exempt_label_file(
    matched: DataFrame, label_file: str = "CONTENTS.YML"
) -> DataFrame:
    """Drop the label itself (at the root) unless some type covers it."""
    return matched.filter((F.size("types") > 0) | (F.col("path") != label_file))


def drop_ignored(classified: DataFrame, specs: Specs) -> DataFrame:
    """Files of types marked `ignore` are neither checked nor sent."""
    keys = [*label_keys(classified, specs), "type"]
    return classified.join(specs.types.filter("ignore").select(keys), keys, "left_anti")


def init_status(index: DataFrame) -> DataFrame:
    """Initial state of a manifest row."""
    return index.withColumns(
        {
            "status": F.when(F.col("will_transfer"), "waiting").otherwise("done"),
            "n_fail": F.lit(0),
        }
    )


def unassigned_files(classified: DataFrame) -> DataFrame:
    """A2: files without a type."""
    return classified.filter(F.size("types") == 0)


def ambiguous_files(classified: DataFrame) -> DataFrame:
    """A3: files with two types or more."""
    return classified.filter(F.size("types") > 1)


def missing_types(classified: DataFrame, specs: Specs) -> DataFrame:
    """A1: types of the label (of each label) without any file."""
    keys = label_keys(classified, specs)
    used = classified.select(*keys, F.explode("types").alias("type")).groupBy(*keys, "type").agg(
        F.count(F.lit(1)).alias("n")
    )
    return specs.types.join(used, [*keys, "type"], "left_anti").select(
        "dataset", "delivery_id", "type"
    )


def filetype_report(classified: DataFrame) -> DataFrame:
    """A4: `path, filetypes` (`;`-joined, blank if none) and a status."""
    return classified.select(
        "path",
        F.array_join(F.array_sort("types"), ";").alias("filetypes"),
        F.col("assignment").alias("status"),
    )


def sorted_problem_report(classified: DataFrame) -> DataFrame:
    """O2: files that are not assigned to exactly one type, in path order."""
    return (
        filetype_report(classified)
        .filter(F.col("status") != "assigned")
        .orderBy("status", "path")
    )


_OBJECT_CHECKS = ("schema", "dtype", "objtype", "metadata", "ndim", "value", "name")


def needs_data_check(specs: Specs) -> DataFrame:
    """SPEC_TYPES with `skips` (its label's and its own) and `needs_data`."""
    none = F.array().cast("array<string>")
    skips = F.array_union(F.coalesce("skip", none), F.coalesce("global_skip", none))
    present = {
        check: F.max(F.col(check).isNotNull()).alias(check)
        for check in ("dtype", "objtype", "ndim", "value", "name")
    }
    keys = ["dataset", "delivery_id", "type"]
    objects = specs.objects.groupBy(*keys).agg(*present.values())
    schemas = specs.columns.groupBy(*keys).agg(F.lit(True).alias("schema"))
    metas = specs.meta.groupBy(*keys).agg(F.lit(True).alias("metadata"))
    joined = (
        specs.types.join(objects, keys, "left")
        .join(schemas, keys, "left")
        .join(metas, keys, "left")
        .join(specs.options.select(*DELIVERY, "global_skip"), DELIVERY, "left")
        .withColumn("skips", skips)
        .drop("global_skip")
    )

    def asked(check: str) -> Column:
        return ~F.array_contains("skips", check)

    object_checks = [
        F.coalesce(F.col(check), F.lit(False)) & asked(check) for check in _OBJECT_CHECKS
    ]
    wanted = reduce(
        or_, object_checks, asked("standard") | (F.col("hook").isNotNull() & asked("hook"))
    )
    supported = F.col("standard").isin(*DATA_STANDARDS) & asked("all")
    return joined.withColumn("needs_data", supported & wanted).drop(*_OBJECT_CHECKS)


def type_lookup(classified: DataFrame, specs: Specs) -> DataFrame:
    """Files with the options of their type in their own label, one row a file."""
    keys = [*label_keys(classified, specs), "type"]
    types = needs_data_check(specs).select(
        *keys, "standard", "ignore", "skips", "hook", "needs_data"
    )
    return classified.join(types, keys, "left").withColumn(
        "needs_data", F.coalesce("needs_data", F.lit(False))
    )


def apply_skips(failures: DataFrame, files: DataFrame) -> DataFrame:
    """Drop failures of checks skipped for the file's type (or globally)."""
    options = files.select("path", "skips").filter(F.size("skips") > 0)
    skipped = F.array_contains("skips", F.col("check")) | F.array_contains("skips", "all")
    return (
        failures.join(options, "path", "left")
        .filter(~F.coalesce(skipped, F.lit(False)))
        .drop("skips")
    )
