"""Infer specifications from the files of a delivery."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lading import schemas
from lading.functions.regex import escape_regex
from lading.materialise import cut
from lading.operators import classify as c
from lading.operators import infer
from lading.operators.nodes import data_nodes
from lading.sources import probes
from lading.sources.catalog import Catalog
from lading.spec import DATA_STANDARDS, Specs

DESCRIBED = ("parquet", "fits", "asdf")


@dataclass(frozen=True)
class Description:
    """Populated SPEC_OBJECTS and SPEC_COLUMNS, and why types were left out."""

    objects: DataFrame
    columns: DataFrame
    problems: DataFrame  # type, problem


def _good(frame: DataFrame, problems: DataFrame) -> DataFrame:
    return frame.join(problems.select("type").distinct(), "type", "left_anti")


def describe_tables(columns: DataFrame) -> Description:
    """Unify one-table files: COLUMNS with `type` become one table per type."""
    scope, file = ["type"], ["path"]
    grouped = infer.chunk_repeated(columns, scope, file, "col_ix")
    unified = infer.unify_columns(grouped, scope, file)
    problems = infer.chunk_problems(grouped, scope, file).unionByName(
        _failures(unified, "column")
    )
    types = columns.select("type").distinct()
    objects = types.select(
        "type", F.lit(0).alias("obj_ix"), F.lit("table").alias("name"),
        F.lit(None).cast("array<string>").alias("name_path"),
        F.lit(False).alias("name_regex"), F.lit("table").alias("objtype"),
        F.lit(None).cast("string").alias("dtype"), F.lit(None).cast("int").alias("ndim"),
        F.lit(False).alias("repeated"),
    )
    return Description(
        _good(objects, problems),
        _good(unified.withColumn("obj_ix", F.lit(0)), problems).selectExpr(*_COLUMN_FIELDS),
        problems,
    )


_COLUMN_FIELDS = (
    "type", "obj_ix", "group_id AS col_ix", "name", "name_regex",
    "dtype", "ndim", "repeated",
)
_OBJECT_FIELDS = (
    "type", "obj_ix", "name", "name_path", "name_regex", "objtype", "dtype", "ndim", "repeated",
)


def _failures(unified: DataFrame, what: str) -> DataFrame:
    """A problem for every group that can't be unified."""
    problem = F.concat(F.lit(f"{what} "), F.col("group_id").cast("string"), F.lit(": "), F.col("failure"))
    return unified.filter(F.col("failure").isNotNull()).select("type", problem.alias("problem"))


def describe_hdus(objects: DataFrame, columns: DataFrame) -> Description:
    """Unify files made of ordered objects: OBJECTS and COLUMNS with `type`.

    Objects are grouped first; then the schemas of all objects of a group are
    unified like the schemas of one-table files.
    """
    scope, file = ["type"], ["path"]
    has = columns.groupBy("path", "obj_ix").agg(F.lit(True).alias("has_schema"))
    described = objects.join(has, ["path", "obj_ix"], "left").withColumn(
        "has_schema", F.coalesce("has_schema", F.lit(False))
    )
    grouped = infer.chunk_repeated(described, scope, file, "obj_ix")
    unified = infer.unify_objects(grouped, scope, file)
    member = grouped.select("type", "path", "obj_ix", F.col("group_id").alias("__object"))
    in_group = columns.join(member, ["type", "path", "obj_ix"]).withColumn(
        "obj_ix_in_file", F.col("obj_ix")
    )
    schema_scope, schema_file = ["type", "__object"], ["path", "obj_ix_in_file"]
    schema_groups = infer.chunk_repeated(in_group, schema_scope, schema_file, "col_ix")
    schemas_ = infer.unify_columns(schema_groups, schema_scope, schema_file)
    problems = (
        infer.chunk_problems(grouped, scope, file)
        .unionByName(_failures(unified, "object"))
        .unionByName(infer.chunk_problems(schema_groups, schema_scope, schema_file).select("type", "problem"))
        .unionByName(_failures(schemas_, "column"))
    )
    spec_objects = unified.withColumns(
        {
            "obj_ix": F.col("group_id"),
            "name_path": F.lit(None).cast("array<string>"),
        }
    ).select(*_OBJECT_FIELDS)
    spec_columns = schemas_.withColumn("obj_ix", F.col("__object")).selectExpr(*_COLUMN_FIELDS)
    return Description(_good(spec_objects, problems), _good(spec_columns, problems), problems)


def describe_trees(nodes: DataFrame, columns: DataFrame) -> Description:
    """Unify tree files: data nodes and top-level keys (F21), grouped by path.

    `columns` belong to nodes through (path, obj_ix = node_ix).
    """
    scope, file = ["type"], ["path"]
    nodes = data_nodes(nodes).withColumnRenamed("node_ix", "obj_ix")
    has = columns.groupBy("path", "obj_ix").agg(F.lit(True).alias("has_schema"))
    described = nodes.join(has, ["path", "obj_ix"], "left").withColumn(
        "has_schema", F.coalesce("has_schema", F.lit(False))
    )
    grouped = infer.stem_sets(described, scope, file)
    unified = infer.unify_groups(
        grouped, scope, "group_key", file, ["objtype", "dtype", "ndim", "has_schema"]
    )
    spelled = grouped.groupBy("type", "group_key").agg(
        F.min("node").alias("node")
    )
    parts = F.transform(F.slice("node", 1, F.size("node") - 1), escape_regex)
    repeated = F.col("stem").isNotNull()
    path = F.when(
        repeated, F.array_append(parts, infer.generalise_repeated(F.col("stem")))
    ).otherwise(F.col("node"))
    # order of a type's objects: by group key, numbered over groups (label size)
    numbered = unified.select("type", "group_key").groupBy("type").agg(
        F.array_sort(F.collect_list("group_key")).alias("__keys")
    )
    positions = numbered.select("type", F.posexplode("__keys").alias("group_id", "group_key"))
    named = (
        unified.join(spelled, ["type", "group_key"])
        .join(positions, ["type", "group_key"])
        .withColumns(
            {
                "obj_ix": F.col("group_id"),
                "name_path": path,
                "name": F.array_join(path, "/"),
                "name_regex": repeated,
                "repeated": repeated,
                "ndim": F.col("ndim").cast("int"),
            }
        )
    )
    complex_ = named.withColumn(
        "failure",
        F.when(
            F.col("failure") == "incompatible group count",
            "variation in tree structure too complex to describe",
        ).otherwise(F.col("failure")),
    )
    member = grouped.join(positions, ["type", "group_key"]).select(
        "type", "path", "obj_ix", F.col("group_id").alias("__object")
    )
    in_group = columns.join(member, ["type", "path", "obj_ix"]).withColumn(
        "obj_ix_in_file", F.col("obj_ix")
    )
    schema_scope, schema_file = ["type", "__object"], ["path", "obj_ix_in_file"]
    schema_groups = infer.chunk_repeated(in_group, schema_scope, schema_file, "col_ix")
    schemas_ = infer.unify_columns(schema_groups, schema_scope, schema_file)
    problems = _failures(complex_, "object").unionByName(
        _failures(schemas_, "column")
    )
    spec_columns = schemas_.withColumn("obj_ix", F.col("__object")).selectExpr(*_COLUMN_FIELDS)
    return Description(
        _good(named.select(*_OBJECT_FIELDS), problems), _good(spec_columns, problems), problems
    )


def unify_by_standard(
    columns: DataFrame | None, catalog: Catalog | None, files: DataFrame
) -> list[Description]:
    """Descriptions per standard; `files` has path, type and standard."""

    def of(standard: str, frame: DataFrame) -> DataFrame:
        chosen = files.filter(F.col("standard") == standard).select("path", "type")
        return frame.join(chosen, "path")

    out = []
    if columns is not None:
        out.append(describe_tables(of("parquet", columns)))
    if catalog is not None:
        out.append(describe_hdus(of("fits", catalog.objects), of("fits", catalog.columns)))
        out.append(describe_trees(of("asdf", catalog.nodes), of("asdf", catalog.columns)))
    return out


def describe_types(
    files: DataFrame, specs: Specs, root: str, catalog: Catalog | None = None
) -> tuple[Specs, DataFrame]:
    """(specs with populated objects, problems by type).

    Files under `root` are classified, Parquet footers probed, FITS and ASDF
    objects taken from `catalog`.  A type with unreadable files, overlapping
    patterns or irreconcilable files is reported instead of populated.
    """
    classified = c.classify(files, specs)
    typed = classified.filter(F.col("type").isNotNull()).join(
        specs.types.select("type", "standard"), "type"
    )
    footers = cut(probes.probe_footers(typed.filter(F.col("standard") == "parquet"), root))
    descriptions = unify_by_standard(probes.columns_of(footers), catalog, typed)
    probed = probes.load_errors(footers).join(typed.select("path", "type"), "path")
    unreadable = probed.select(
        "type", F.concat(F.lit("unreadable file "), "path", F.lit(": "), "message").alias("problem")
    )
    skipped = (
        c.missing_types(classified, specs)
        .select("type", F.lit("no files").alias("problem"))
        .unionByName(
            specs.types.filter(~F.col("standard").isin(*DATA_STANDARDS)).select(
                "type",
                F.concat(F.col("standard"), F.lit(" does not support data-level validation")).alias("problem"),
            )
        )
    )
    problems = cut(reduce(DataFrame.unionByName, [d.problems for d in descriptions], unreadable))
    owner = specs.types.select("dataset", "delivery_id", "type")

    def finished(frames: list[DataFrame], layout: str, missing: dict) -> DataFrame:
        rows = _good(reduce(DataFrame.unionByName, frames), problems).join(owner, "type")
        names = [f.strip().split(" ")[0] for f in layout.split(",")]
        return rows.withColumns(
            {n: v for n, v in missing.items() if n not in rows.columns}
        ).select(*names)

    objects = finished(
        [d.objects for d in descriptions],
        schemas.SPEC_OBJECTS,
        {
            "optional": F.lit(False),
            "value": F.lit(None).cast("string"),
            "value_type": F.lit(None).cast("string"),
            "value_regex": F.lit(False),
        },
    )
    columns = finished([d.columns for d in descriptions], schemas.SPEC_COLUMNS, {})
    merged_objects = cut(infer.merge_specs(specs.objects, objects))
    merged_columns = cut(infer.merge_specs(specs.columns, columns))
    return specs.with_objects(merged_objects, merged_columns), problems.unionByName(skipped)
