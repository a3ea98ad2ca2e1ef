"""Tree documents as NODES rows, and matching of node specs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lading.functions.regex import java_pattern
from lading.spec import Specs

_STEP = 8  # levels that one round of the recursion takes apart
_TYPE_NAMES = {"BIGINT": "int", "DOUBLE": "float", "STRING": "str", "BOOLEAN": "bool"}


def flatten_paths(docs: DataFrame, document: str, keys: list[str]) -> DataFrame:
    """`node array<string>, value, value_type` for every leaf of a JSON column.

    A recursive query takes the containers apart, eight levels of all documents
    at a time, as deep as they go.  Documents without leaves have no row
    here; those that can't be read are `document_problems`.

    Spark ends recursions at a number of levels and rows; both limits are
    lifted for the session.
    """
    spark = docs.sparkSession
    for limit in ("Row", "Level"):
        spark.conf.set(f"spark.sql.cteRecursion{limit}Limit", "-1")
    names = [f"k{i}" for i in range(len(keys))]
    roots = docs.select(
        *[F.col(k).alias(n) for k, n in zip(keys, names)], F.try_parse_json(F.col(document)).alias("v")
    )
    columns = ", ".join([*names, "node", "v", "deeper"])
    kept = ", ".join(f"t.{n}" for n in names)
    levels = range(1, _STEP + 1)
    # a value without parts ends the path of its row; the last level's may have some
    parts = " ".join(
        f", LATERAL variant_explode{'' if i == 1 else '_outer'}({'t.v' if i == 1 else f'e{i - 1}.value'}) AS e{i}"
        for i in levels
    )
    steps = ", ".join(f"CASE WHEN e{i}.pos IS NOT NULL THEN coalesce(e{i}.key, CAST(e{i}.pos AS string)) END" for i in levels)
    value = "CASE " + " ".join(f"WHEN e{i}.pos IS NOT NULL THEN e{i}.value" for i in reversed(levels)) + " END"
    rows = spark.sql(
        f"""
        WITH RECURSIVE tree({columns}) AS (
          SELECT {kept}, CAST(array() AS array<string>), t.v, true FROM {{roots}} AS t
          UNION ALL
          SELECT {kept}, concat(t.node, array_compact(array({steps}))), {value}, e{_STEP}.pos IS NOT NULL
          FROM tree AS t{parts}
          WHERE t.deeper)
        SELECT * FROM tree WHERE size(node) > 0
        """,
        roots=roots,
    ).select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "node", "v")
    rows = rows.filter(~_is_container(F.col("v")))
    kind = F.schema_of_variant("v")
    text = F.when(kind == "STRING", F.try_variant_get("v", "$", "string")).otherwise(F.to_json("v"))
    value_type = F.when(kind.startswith("DECIMAL"), "float")
    for spark_type, name in _TYPE_NAMES.items():
        value_type = F.when(kind == spark_type, name).otherwise(value_type)
    return rows.select(
        *keys,
        "node",
        F.when(kind != "VOID", text).alias("value"),
        F.when(kind == "VOID", "null").otherwise(value_type).alias("value_type"),
    )


def document_problems(docs: DataFrame, document: str, keys: list[str]) -> DataFrame:
    """keys and `problem` of the documents that are no trees: missing, no JSON, or one bare value."""
    tree = F.try_parse_json(F.col(document))
    problem = (
        F.when(F.col(document).isNull(), "no document")
        .when(tree.isNull(), "not a JSON document")
        .when(~_is_container(tree), "a single value, not a tree")
    )
    return docs.select(*keys, problem.alias("problem")).filter(F.col("problem").isNotNull())


def _is_container(v: Column) -> Column:
    """One level of an object or array tells it; its parts aren't looked at."""
    kinds = ("map<string,variant>", "array<variant>")
    return F.coalesce(*[F.try_variant_get(v, "$", kind).isNotNull() | F.lit(None) for kind in kinds], F.lit(False))


# Table-like node types.
TABLE_TYPES = (
    "numpy.ndarray", "astropy.table.table.table", "pyarrow.lib.table", "pandas.dataframe",
)
BOOKKEEPING = ("asdf_library", "history")


def data_nodes(nodes: DataFrame) -> DataFrame:
    """array and table nodes, and all top-level keys except bookkeeping."""
    objtype = F.lower("objtype")
    is_data = objtype.isin(*TABLE_TYPES) | objtype.endswith("ndarraytype")
    top = (F.size("node") == 1) & ~F.element_at("node", 1).isin(*BOOKKEEPING)
    return nodes.filter(is_data | top)


def match_nodes(nodes: DataFrame, specs: Specs) -> DataFrame:
    """Nodes with the `obj_ix` of every spec that describes them.

    `nodes` has path, type and node.  Exact paths and bare names are
    equi-joins.  Regex specs are gathered per type (their number is that of
    the label) and tested inside the row, so only real matches are produced.
    """
    objects = specs.object_specs().filter(F.col("name").isNotNull())
    exact = objects.filter(~F.col("name_regex"))
    by_path = (
        exact.filter(F.col("name_path").isNotNull())
        .select("type", F.to_json("name_path").alias("__at"), "obj_ix")
    )
    by_name = (
        exact.filter(F.col("name_path").isNull())
        .select("type", F.col("name").alias("__last"), "obj_ix")
    )
    located = nodes.withColumns(
        {"__at": F.to_json("node"), "__last": F.element_at("node", -1)}
    )
    found = located.join(by_path, ["type", "__at"]).drop("__at", "__last")
    found = found.unionByName(
        located.join(by_name, ["type", "__last"]).drop("__at", "__last")
    )
    paths = _regex_paths(objects.filter("name_regex"))
    portable = ~F.exists("regexes", lambda p: p.isNull())
    regexes = (
        paths.filter(portable)
        .groupBy("type")
        .agg(F.collect_list(F.struct("obj_ix", "regexes", "bare")).alias("__regexes"))
    )

    def describes(spec: Column) -> Column:
        whole = (F.size(spec["regexes"]) == F.size("node")) & F.forall(
            F.zip_with(spec["regexes"], "node", lambda p, n: F.rlike(n, p)), lambda hit: hit
        )
        bare = F.rlike(F.element_at("node", -1), F.element_at(spec["regexes"], 1))
        return F.when(spec["bare"], bare).otherwise(whole)

    by_regex = (
        nodes.join(regexes, "type")
        .withColumn("__hit", F.explode(F.filter("__regexes", describes)))
        .withColumn("obj_ix", F.col("__hit.obj_ix"))
        .drop("__regexes", "__hit")
    )
    foreign = paths.filter(~portable).select("type", "obj_ix", "patterns", "bare")
    by_python = (
        nodes.join(foreign, "type")
        .filter(_python_path(F.col("node"), F.col("patterns"), F.col("bare")))
        .drop("patterns", "bare")
    )
    return found.unionByName(by_regex).unionByName(by_python)


def _python_path(node: Column, patterns: Column, bare: Column) -> Column:
    """Do the elements of a path match their patterns, or its last one that of a bare name?"""

    @F.pandas_udf("boolean")
    def test(nodes: pd.Series, wanted: pd.Series, single: pd.Series) -> pd.Series:
        known: dict[str, re.Pattern] = {}

        def compiled(pattern: str) -> re.Pattern:
            return known.get(pattern) or known.setdefault(pattern, re.compile(pattern))

        def holds(elements, patterns, alone) -> bool:
            if elements is None or not len(elements):
                return False
            if alone:
                return compiled(patterns[0]).search(elements[-1]) is not None
            return len(elements) == len(patterns) and all(
                e is not None and compiled(p).match(e) for e, p in zip(elements, patterns, strict=True)
            )

        return pd.Series([holds(*row) for row in zip(nodes, wanted, single, strict=True)], dtype="object")

    return test(node, patterns, bare)


def _regex_paths(objects: DataFrame) -> DataFrame:
    """Patterns of each path element, and their Java forms; a bare name is searched, not matched."""
    bare = F.col("name_path").isNull()
    elements = objects.withColumn("bare", bare).select(
        "type", "obj_ix", "bare",
        F.posexplode(F.when(bare, F.array("name")).otherwise(F.col("name_path"))).alias("k", "p"),
    )
    java = F.when(F.col("bare"), java_pattern(F.col("p"), "search")).otherwise(java_pattern(F.col("p"), "match"))
    return (
        elements.withColumn("java", java)
        .groupBy("type", "obj_ix", "bare")
        .agg(F.array_sort(F.collect_list(F.struct("k", "java", "p"))).alias("__ps"))
        .withColumns({
            "regexes": F.transform("__ps", lambda p: p["java"]),
            "patterns": F.transform("__ps", lambda p: p["p"]),
        })
    )
