"""Conformance checks: actual columns, objects, nodes and metadata vs specs.

Every check returns FAILURES rows (path, object, check, key, message), empty
when all is well.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lading.functions import problems as p
from lading.functions.scalars import failure_text
from lading.materialise import cut
from lading.operators import classify as c
from lading.operators import hooks as h
from lading.operators import manifest
from lading.operators.align import align
from lading.operators.metadata import validate_metadata
from lading.operators.nodes import match_nodes
from lading.sources import probes
from lading.sources.catalog import Catalog
from lading.spec import DATA_STANDARDS, Specs, qualified_type

_FAILURE = ("path", "object", "check", "key", "message")


def _failures(
    rows: DataFrame, object_: Column, check: str, key: Column, messages: Column
) -> DataFrame:
    return rows.select(
        "path",
        object_.cast("string").alias("object"),
        F.lit(check).alias("check"),
        key.cast("string").alias("key"),
        F.explode(messages).alias("message"),
    )


def _failures_of(
    rows: DataFrame, object_: Column, checks: list[tuple[str, Column]]
) -> DataFrame:
    """Failures of several checks without keys, each a message or NULL, in one pass over the rows."""
    told = F.array(
        *[
            F.struct(F.lit(check).alias("check"), message.alias("message"))
            for check, message in checks
        ]
    )
    return (
        rows.select("path", object_.cast("string").alias("object"), F.explode(told).alias("told"))
        .select("path", "object", "told.check", F.lit("").alias("key"), "told.message")
        .filter(F.col("message").isNotNull())
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def validate_schema(columns: DataFrame, objects: DataFrame, specs: Specs) -> DataFrame:
    """V1: ordered, complete comparison of columns with their column specs.

    `columns` is COLUMNS with `type`; `objects` (path, type, obj_ix) are the
    tables to check.  Types without column specs are not checked.
    """
    slots = specs.column_specs().withColumnRenamed("col_ix", "slot").drop(
        "dataset", "delivery_id"
    )
    wanted = slots.select("type", "obj_ix").distinct()
    checked = columns.join(wanted, ["type", "obj_ix"], "left_semi")
    items = checked.select(
        "path", "type", "obj_ix", F.col("col_ix").alias("pos"), "name", "dtype", "ndim"
    )
    aligned, missing = align(items, slots, objects, specs.portable)
    compared = p.column_problems(
        F.col("name"), F.col("dtype"), F.col("ndim"), F.col("spec"), specs.portable
    )
    extra = F.array(F.concat(F.lit("extra field '"), F.col("name"), F.lit("'")))
    differences = F.when(F.col("spec").isNull(), extra).otherwise(compared)
    absent = F.when(
        F.col("spec.name_regex"),
        F.concat(F.lit("no fields matching /"), F.col("spec.name"), F.lit("/")),
    ).otherwise(F.concat(F.lit("field '"), F.col("spec.name"), F.lit("' missing")))
    return _failures(
        aligned, F.col("obj_ix"), "schema", F.col("pos"), differences
    ).unionByName(
        _failures(missing, F.col("obj_ix"), "schema", F.col("pos"), F.array(absent))
    )


def validate_parquet(
    files: DataFrame, specs: Specs, root: str, integrity: bool = True
) -> DataFrame:
    """V2: Parquet files (path, type, skips) against their one table spec."""
    footers = cut(probes.probe_footers(files, root))
    typed = files.select("path", "type")
    objects = typed.withColumn("obj_ix", F.lit(0))
    first = specs.with_objects(
        specs.objects.filter("obj_ix = 0"), specs.columns.filter("obj_ix = 0"),
        specs.known_regexes,
    )
    load = probes.load_errors(footers)
    readable = objects.join(load.select("path"), "path", "left_anti")
    schema = validate_schema(
        probes.columns_of(footers).join(typed, "path"), readable, first
    )
    meta = validate_metadata(
        probes.metadata_of(footers).join(typed, "path"), readable, specs, coerce=True
    )
    several = (
        specs.objects.groupBy("type")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
    )
    base = typed.join(several, "type").select(
        "path", F.lit("0").alias("object"), F.lit("base").alias("check"), F.lit("").alias("key"),
        F.concat(F.lit("Parquet types have at most one object (got "), F.col("n").cast("string"),
                 F.lit("); all but the first are ignored")).alias("message"),
    )
    checks = [schema, meta, base]
    if integrity:
        # content is read only where a schema is to be proven
        schemed = files.join(first.columns.select("type").distinct(), "type", "left_semi")
        kept = footers.join(
            schemed.filter(~F.array_contains("skips", "schema")).select("path"), "path", "left_semi"
        )
        checks.append(_error_rows(probes.scan_parquet_integrity(kept, root), "schema"))
    found = c.apply_skips(_union(checks), files).select(*_FAILURE)
    return found.unionByName(_error_rows(load, "load"))


def _error_rows(errors: DataFrame, check: str) -> DataFrame:
    return errors.select(
        "path", F.lit("0").alias("object"), F.lit(check).alias("check"),
        F.lit("base").alias("key"), "message",
    )


def validate_hdus(files: DataFrame, catalog: Catalog, specs: Specs) -> DataFrame:
    """V3: ordered objects of FITS files against ordered object specs."""
    typed = files.select("path", "type", "skips")
    objects = catalog.objects.join(typed, "path")
    slots = specs.object_specs().drop("dataset", "delivery_id").withColumns(
        {"slot": F.col("obj_ix"), "obj_ix": F.lit(0)}
    )
    items = objects.select(
        "path", "type", F.lit(0).alias("obj_ix"), F.col("obj_ix").alias("pos"),
        F.coalesce("name", F.lit("")).alias("name"), "objtype", "dtype", "ndim", "has_data", "skips",
    )
    everything = typed.withColumn("obj_ix", F.lit(0))
    aligned, missing = align(items, slots, everything, specs.portable, strict=True)
    spec = F.col("spec")
    placed = aligned.filter(spec.isNotNull()).withColumn("obj_ix", F.col("pos"))
    has_data = F.coalesce("has_data", F.lit(False))
    arrays = p.hdu_array_parts(
        F.col("objtype"), F.col("dtype"), F.col("ndim"), has_data, spec, F.col("skips")
    )
    checks = [
        ("name", p.object_name_problem(F.col("name"), spec, specs.portable)),
        ("objtype", p.hdu_type_problem(F.col("objtype"), spec)),
        *[("array_props", message) for message in arrays],
    ]
    told = [(check, F.when(spec.isNotNull(), message)) for check, message in checks]
    extra = F.when(spec.isNull(), "extra")
    found = [_failures_of(aligned, F.col("pos"), [*told, ("base", extra)])]
    found.append(
        _failures(
            missing.filter(~F.col("spec.optional")), F.col("pos"), "base", F.lit(""),
            F.array(F.lit("missing")),
        )
    )
    # schema and metadata are checked against the slot each HDU took
    taken = placed.select("path", F.col("pos").alias("hdu"), "type", F.col("slot"), "objtype")
    tables = taken.filter(F.lower("objtype") == "bintable")
    found.append(
        _at_hdu(
            validate_schema(
                _on_slot(catalog.columns, tables), _hdu_objects(tables), specs
            )
        )
    )
    cards = catalog.meta.withColumn("key", F.upper(F.trim("key")))
    found.append(
        _at_hdu(validate_metadata(_on_slot(cards, taken), _hdu_objects(taken), specs))
    )
    return c.apply_skips(_union(found), files).select(*_FAILURE)


_AT = "\n#"  # joins a path and the HDU it was found in


def _on_slot(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """Rows of an HDU, addressed as (path + HDU number, slot)."""
    hdu = taken.select("path", F.col("hdu").alias("obj_ix"), "type", "slot")
    return (
        rows.join(hdu, ["path", "obj_ix"])
        .withColumn("path", F.concat("path", F.lit(_AT), F.col("obj_ix").cast("string")))
        .withColumn("obj_ix", F.col("slot"))
        .drop("slot")
    )


def _hdu_objects(taken: DataFrame) -> DataFrame:
    return taken.select(
        F.concat("path", F.lit(_AT), F.col("hdu").cast("string")).alias("path"),
        "type",
        F.col("slot").alias("obj_ix"),
    )


def _at_hdu(failures: DataFrame) -> DataFrame:
    return failures.withColumns(
        {
            "object": F.substring_index("path", _AT, -1),
            "path": F.substring_index("path", _AT, 1),
        }
    ).select(*_FAILURE)


def validate_nodes(files: DataFrame, catalog: Catalog, specs: Specs) -> DataFrame:
    """V4: tree nodes of ASDF files against node specs; other nodes may exist."""
    typed = files.select("path", "type", "skips")
    nodes = catalog.nodes.join(typed, "path")
    matched = cut(match_nodes(nodes, specs))
    spec_rows = specs.object_specs().select(
        "type", "obj_ix",
        F.struct("name", "objtype", "dtype", "ndim", "repeated", "optional", "value",
                 "value_type", "value_regex", "java_value").alias("spec"),
    )
    compared = matched.join(spec_rows, ["type", "obj_ix"])
    spec = F.col("spec")
    place = F.concat(F.lit("root/"), F.array_join("node", "/"))
    # a structured node has columns in the catalogue and no scalar dtype
    is_table = F.col("dtype").isNull() & F.lower("objtype").rlike("table|dataframe|ndarray")
    one = lambda problem: F.filter(F.array(problem), lambda m: m.isNotNull())
    found = [
        _failures(compared, place, "objtype", F.lit(""), one(p.node_type_problem(F.col("objtype"), spec))),
        _failures(
            compared, place, "array_props", F.lit(""),
            p.node_array_problems(F.col("dtype"), F.col("ndim"), is_table, spec, F.col("skips")),
        ),
        _failures(
            compared, place, "value", F.lit(""),
            one(p.value_problem(F.col("value"), F.col("value_type"), spec, specs.portable)),
        ),
    ]
    counts = matched.groupBy("path", "type", "obj_ix").agg(F.count(F.lit(1)).alias("n"))
    found.append(
        counts.filter("n > 1")
        .join(spec_rows, ["type", "obj_ix"])
        .filter(~F.col("spec.repeated"))
        .select(
            "path", F.col("spec.name").alias("object"), F.lit("base").alias("check"),
            F.lit("").alias("key"), F.lit("too many matches").alias("message"),
        )
    )
    # required specs travel as one array per type; only absent ones become rows
    required = (
        specs.objects.filter(~F.col("optional"))
        .groupBy("type")
        .agg(F.collect_set("obj_ix").alias("__required"))
    )
    seen = counts.groupBy("path").agg(F.collect_set("obj_ix").alias("__seen"))
    absent = (
        typed.join(required, "type")
        .join(seen, "path", "left")
        .select(
            "path", "type",
            F.explode(F.array_except("__required", F.coalesce("__seen", F.array().cast("array<int>")))).alias("obj_ix"),
        )
    )
    found.append(
        absent.join(specs.objects.select("type", "obj_ix", "name"), ["type", "obj_ix"]).select(
            "path", F.col("name").alias("object"), F.lit("base").alias("check"),
            F.lit("").alias("key"), F.lit("missing").alias("message"),
        )
    )
    schema = _node_schemas(matched, catalog.columns, specs)
    return c.apply_skips(_union([*found, schema]), files).select(*_FAILURE)


def _node_schemas(matched: DataFrame, columns: DataFrame, specs: Specs) -> DataFrame:
    """Columns of matched table nodes against the schemas of their specs."""
    with_schema = specs.columns.select("type", "obj_ix").distinct()
    tables = matched.join(with_schema, ["type", "obj_ix"], "left_semi")
    taken = tables.select(
        "path", F.col("node_ix").alias("hdu"), "type", F.col("obj_ix").alias("slot")
    )
    return _at_hdu(validate_schema(_on_slot(columns, taken), _hdu_objects(taken), specs))


@dataclass(frozen=True)
class Validation:
    """Outcome of checking a whole delivery."""

    files: DataFrame  # path, type, verdict, note
    failures: DataFrame


def validate_all(
    files: DataFrame,
    specs: Specs,
    root: str,
    catalog: Catalog | None = None,
    index: DataFrame | None = None,
    hooks: Mapping[str, h.FileHook] | None = None,
    run_hooks: bool = True,
    match: str = "search",
) -> Validation:
    """V7: every file (or those of a manifest) against its type.

    A file without a type or with several fails; a type whose standard has no
    data checks passes by default; nothing is opened for either.
    """
    if index is not None:
        files = manifest.select_queued(files, index)
    keys = c.label_keys(files, specs)
    classified = c.type_lookup(c.classify(files, specs, match), specs)
    kept = cut(classified.filter(~F.coalesce("ignore", F.lit(False))))
    unusable = kept.filter(F.col("type").isNull()).select(
        "path", F.lit("").alias("object"), F.lit("filetype").alias("check"), F.lit("").alias("key"),
        F.when(F.size("types") == 0, "no filename patterns in label match")
        .otherwise(F.concat(F.lit("ambiguous filetype: matches "), F.array_join(F.array_sort("types"), ", ")))
        .alias("message"),
    )
    content = validate_content(kept, specs, root, catalog, hooks, run_hooks)
    failures = cut(unusable.unionByName(content))  # content is read once
    note = F.when(
        F.col("type").isNotNull() & ~F.col("standard").isin(*DATA_STANDARDS),
        F.concat(
            F.lit("pass by default ("), F.col("standard"),
            F.lit(" does not support data-level validation)"),
        ),
    )
    bad = failures.groupBy("path").agg(F.count(F.lit(1)).alias("n_failures"))
    verdicts = kept.join(bad, "path", "left").select(
        *keys,
        "path",
        "type",
        F.when(F.col("n_failures").isNull(), "ok").otherwise("failure").alias("verdict"),
        F.coalesce("n_failures", F.lit(0)).alias("n_failures"),
        note.alias("note"),
    )
    return Validation(verdicts, failures)


def validate_content(
    typed: DataFrame,
    specs: Specs,
    root: str,
    catalog: Catalog | None = None,
    hooks: Mapping[str, h.FileHook] | None = None,
    run_hooks: bool = True,
) -> DataFrame:
    """V2, V3, V4 and X1 for the files whose type asks for content checks."""
    if c.label_keys(typed, specs):  # types of equal names are told apart by their labels
        typed, specs = typed.withColumn("type", qualified_type()), specs.qualified()
    opened = typed.filter("needs_data").select("path", "type", "standard", "hook", "skips")

    def of(standard: str) -> DataFrame:
        return opened.filter(F.col("standard") == standard)

    found = [validate_parquet(of("parquet"), specs, root)]
    if catalog is not None:
        found.append(validate_hdus(of("fits"), catalog, specs))
        found.append(validate_nodes(of("asdf"), catalog, specs))
    failures = _union(found)
    if run_hooks:
        failures = h.merge_failures(failures, h.run_file_hooks(opened, root, hooks))
    return failures


def validate_file(files: DataFrame, path: str, specs: Specs, root: str, **options) -> Validation:
    """V6: one file; the filter is applied before anything is opened."""
    return validate_all(files.filter(F.col("path") == path), specs, root, **options)


def validate_all_summary(outcome: Validation) -> DataFrame:
    """Failed files with their number of failures and all failure texts, in order."""
    text = failure_text(F.col("object"), F.col("check"), F.col("key"), F.col("message"))
    found = outcome.failures.groupBy("path").agg(
        F.count(F.lit(1)).alias("n_failures"), F.sort_array(F.collect_set(text)).alias("findings")
    )
    return found.orderBy("path")


def count_outcomes(outcome: Validation) -> DataFrame:
    """One row, failed and all files."""
    return outcome.files.agg(
        F.count_if(F.col("verdict") == "failure").alias("n_failed"),
        F.count(F.lit(1)).alias("n_files"),
    )


def server_validate(
    index: DataFrame,
    listing: DataFrame,
    specs: Specs,
    root: str,
    catalog: Catalog | None = None,
    hooks: Mapping[str, h.FileHook] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """V8: (`path, status, message` per manifest row, FAILURES).

    Presence and checksum first; content only of files that pass and whose
    type needs it.  A crashed check is an `error`, any finding a `failure`.
    """
    if "checksum" not in index.columns:
        index = index.withColumn("checksum", F.lit(None).cast("string"))
    present = manifest.check_presence_checksum(index.drop("status", "message"), listing)
    present = cut(present)
    keys = c.label_keys(present, specs)
    typed = c.type_lookup(
        present.filter(F.col("status") == "ok").select(*keys, "path", "type"), specs
    )
    failures = cut(validate_content(typed, specs, root, catalog, hooks))
    crashed = F.col("check").startswith("hook:") & (F.col("key") == "error")
    text = failure_text(F.col("object"), F.col("check"), F.col("key"), F.col("message"))
    found = failures.groupBy("path").agg(
        F.bool_or(crashed).alias("__crashed"),
        F.array_join(F.sort_array(F.collect_set(text)), "\n").alias("__text"),
    )
    verdicts = present.join(found, "path", "left").select(
        *keys,
        "path",
        F.when(F.col("__crashed"), "error")
        .when(F.col("__text").isNotNull(), "failure")
        .otherwise(F.col("status"))
        .alias("status"),
        F.coalesce("message", "__text").alias("message"),
    )
    return verdicts, failures
