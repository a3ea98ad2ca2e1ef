"""Lint rules over an archive of specs read from parts, customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from lading.operators import lint
from lading.queries.readings import table
from lading.spec import Specs


def archive(spark, folder) -> Specs:
    """Every part is a file type of its brand's delivery, with one object."""
    size, kind = F.col("p_size"), F.col("p_type")
    part = table(spark, folder, "part").withColumns(
        {
            "dataset": F.lit("parts"),
            "delivery_id": F.col("p_brand"),
            "type": F.col("p_partkey").cast("string"),
            "obj_ix": F.lit(0),
            "none": F.lit(None).cast("string"),
        }
    )
    key = ("dataset", "delivery_id", "type")
    standard = (
        F.when(kind == "ECONOMY", "asdf")
        .when(kind.isin("PROMO", "STANDARD"), "fits")
        .when(kind == "SMALL", "parquet")
        .when(kind == "LARGE", "unspecified")
        .otherwise("csv")
    )
    types = part.select(
        *key, standard.alias("standard"), (size > 45).alias("ignore"),
        F.when(size > 40, F.array(F.lit("schema"))).otherwise(F.array().cast("array<string>")).alias("skip"),
        F.col("none").alias("hook"), F.lit(0).alias("n_options"),
    )
    patterns = part.filter(size >= 3).select(
        *key, F.col("p_name").alias("pattern"), (size != 5).alias("include")
    )
    name = F.when(size != 7, F.col("p_name"))
    first = part.select(
        *key, "obj_ix", name.alias("name"),
        F.when(size.between(8, 10), F.array(name)).alias("name_path"),
        F.lit(False).alias("name_regex"),
        F.when(size < 10, F.lit(None)).when(size < 20, "numpy.ndarray").when(size < 30, "primary")
        .when(size < 40, "bintable").otherwise("not-a type").alias("objtype"),
        F.when(size.between(12, 15), "i4").when(size.between(25, 27), "f2")
        .when(size.between(35, 37), "q9").alias("dtype"),
        F.when(size.between(13, 16), 2).when(size.between(26, 33), 1).alias("ndim"),
        F.lit(False).alias("repeated"), F.lit(False).alias("optional"),
        F.when(F.col("p_retailprice") > 1080, "1").alias("value"),
        F.when(F.col("p_retailprice") > 1080, "int").alias("value_type"),
        F.lit(False).alias("value_regex"),
    )
    second = first.filter(F.col("objtype") == "bintable").withColumn("obj_ix", F.lit(1)).withColumns(
        {"dtype": F.lit(None).cast("string"), "ndim": F.lit(None).cast("int"),
         "value": F.lit(None).cast("string"), "value_type": F.lit(None).cast("string")}
    )
    columns = part.filter(size.between(14, 18) | size.between(28, 34)).select(
        *key, "obj_ix", F.lit(0).alias("col_ix"), F.col("p_name").alias("name"),
        F.lit(False).alias("name_regex"),
        F.when(size < 16, "f2").when(size < 29, "M8[s]").when(size < 31, "c8").otherwise("V0").alias("dtype"),
        F.lit(0).alias("ndim"), F.lit(False).alias("repeated"),
    )
    meta = part.filter(size.between(20, 39)).select(
        *key, "obj_ix", F.lit("KEY").alias("key"),
        F.when(size < 30, F.col("p_name")).alias("value"), F.when(size < 30, "str").alias("value_type"),
        F.lit(False).alias("value_regex"), F.col("none").alias("objtype"),
        F.when(size > 25, F.lit(0)).alias("index"),
    )
    meta = meta.unionByName(
        meta.filter(F.col("value").isNotNull() & F.col("index").isNotNull()).withColumn("index", F.lit(None).cast("int"))
    )
    domain = F.when(F.col("c_acctbal") < 0, "").when(F.col("c_nationkey") < 5, "@host").otherwise("@host.org")
    contacts = table(spark, folder, "customer").select(
        F.lit("parts").alias("dataset"), F.col("c_mktsegment").alias("delivery_id"),
        F.lit("provider").alias("grp"), F.col("c_custkey").cast("int").alias("ix"),
        F.concat("c_name", domain).alias("address"),
    )
    urgency = F.substring("o_orderpriority", 1, 1)
    props = table(spark, folder, "orders").select(
        F.lit("parts").alias("dataset"), F.col("o_orderstatus").alias("delivery_id"),
        F.concat(F.lit("/filetypes/c"), F.col("o_custkey").cast("string")).alias("lpath"),
        F.when(F.col("o_orderstatus") == "F", "column").otherwise("metadata").alias("element"),
        F.when(urgency == "1", "ndim").when(urgency == "2", "dtype").when(urgency == "3", "index")
        .when(urgency == "4", "value_regex").otherwise("name").alias("property"),
        F.when(F.col("o_totalprice") > 400_000, "many").otherwise(F.col("o_totalprice").cast("bigint").cast("string")).alias("value"),
        F.when(F.col("o_custkey") % 50 == 0, "map").when(F.col("o_custkey") % 50 == 1, "list").otherwise("scalar").alias("form"),
    )
    return Specs(types, patterns, first.unionByName(second), columns, meta, contacts, props, Specs.from_labels(spark, []).options)


def _rule(rule):
    def query(spark, folder):
        return rule(archive(spark, folder))

    return query


def lint_report(spark, folder):
    """All problems rolled up by label path."""
    return lint.sorted_spec_report(lint.lint_specs(archive(spark, folder)))


QUERIES = {
    "lint_objects": _rule(lint.object_rules),
    "lint_columns": _rule(lint.column_dtypes),
    "lint_metadata": _rule(lint.metadata_rules),
    "lint_types": _rule(lint.type_rules),
    "lint_contacts": _rule(lint.contact_rules),
    "lint_unknown": _rule(lint.unknown_properties),
    "lint_duplicates": _rule(lint.duplicate_properties),
    "lint_missing": _rule(lint.missing_properties),
    "lint_scalars": _rule(lint.scalar_errors),
    "lint_report": lint_report,
}

_ARCHIVE = """
part2 AS (
  SELECT 'parts' AS dataset, p_brand AS delivery_id, CAST(p_partkey AS VARCHAR) AS type, p_size AS size, p_name,
    CASE p_type WHEN 'ECONOMY' THEN 'asdf' WHEN 'PROMO' THEN 'fits' WHEN 'STANDARD' THEN 'fits'
      WHEN 'SMALL' THEN 'parquet' WHEN 'LARGE' THEN 'unspecified' ELSE 'csv' END AS std,
    p_retailprice > 1080 AS has_value
  FROM part),
objs AS (
  SELECT *, '/filetypes/' || type || '/objects/0' AS place,
    CASE WHEN size < 10 THEN NULL WHEN size < 20 THEN 'numpy.ndarray' WHEN size < 30 THEN 'primary'
      WHEN size < 40 THEN 'bintable' ELSE 'not-a type' END AS objtype,
    CASE WHEN size BETWEEN 12 AND 15 THEN 'i4' WHEN size BETWEEN 25 AND 27 THEN 'f2' WHEN size BETWEEN 35 AND 37 THEN 'q9' END AS dtype,
    CASE WHEN size BETWEEN 13 AND 16 THEN 2 WHEN size BETWEEN 26 AND 33 THEN 1 END AS ndim,
    size BETWEEN 14 AND 18 OR size BETWEEN 28 AND 34 AS has_schema, size BETWEEN 8 AND 10 AS is_list, size = 7 AS nameless
  FROM part2),
both_objs AS (
  SELECT std, dataset, delivery_id, place, objtype, dtype, ndim, has_schema, is_list, nameless, has_value FROM objs
  UNION ALL
  SELECT std, dataset, delivery_id, replace(place, '/objects/0', '/objects/1'), objtype, NULL, NULL, false, false, false, false
  FROM objs WHERE objtype = 'bintable')
"""
_ARRAYS = "can only be defined for array-like objects; not for '"
_IMAGES = "can only be specified for primary, image, and compimage HDUs"
_TABLES = (
    "dataframe, ndarray, table, astropy.table.table.table, numpy.ndarray, pandas.dataframe, pyarrow.lib.table"
)
_OBJECT_RULES = [
    ("has_schema AND (dtype IS NOT NULL OR ndim IS NOT NULL)", "/schema", "'may not be defined along with ndim and/or dtype'"),
    ("dtype = 'q9'", "/dtype", "'''q9'' is not a supported data type'"),
    ("std = 'fits' AND dtype = 'f2'", "/dtype", "'''f2'' is not a supported FITS array element type'"),
    ("std = 'asdf' AND nameless", "/name", "'ASDF data objects must have names'"),
    ("std = 'asdf' AND has_value AND (dtype IS NOT NULL OR ndim IS NOT NULL OR has_schema)", "/value", "'may not be defined along with ndim, dtype, or schema'"),
    ("std = 'asdf' AND objtype IS NULL", "/objtype", "'must be defined for ASDF files'"),
    ("std = 'asdf' AND objtype = 'not-a type'", "/objtype", "'''not-a type'' is not a valid Python type name'"),
    ("std = 'asdf' AND objtype <> 'numpy.ndarray' AND has_schema", "/schema", f"'can only be defined for ASDF objects of types {_TABLES}; not for ''' || objtype || ''''"),
    ("std = 'asdf' AND objtype <> 'numpy.ndarray' AND ndim IS NOT NULL", "/ndim", f"'{_ARRAYS}'' || objtype || ''''"),
    ("std = 'asdf' AND objtype <> 'numpy.ndarray' AND dtype IS NOT NULL", "/dtype", f"'{_ARRAYS}'' || objtype || ''''"),
    ("std = 'fits' AND is_list", "/name", "'for FITS files, must be a string, not a list'"),
    ("std IN ('fits', 'parquet') AND has_value", "/value", "'may only be defined for ASDF files'"),
    ("std = 'fits' AND objtype IS NULL", "/objtype", "'must be defined for FITS files'"),
    ("std = 'fits' AND objtype NOT IN ('primary', 'bintable')", "/objtype", "'''' || objtype || ''' is not a recognized HDU type for FITS files'"),
    ("std = 'fits' AND objtype <> 'bintable' AND has_schema", "/schema", "'can only be specified for bintable HDUs'"),
    ("std = 'fits' AND objtype <> 'primary' AND ndim IS NOT NULL", "/ndim", f"'{_IMAGES}'"),
    ("std = 'fits' AND objtype <> 'primary' AND dtype IS NOT NULL", "/dtype", f"'{_IMAGES}'"),
    ("std = 'parquet' AND objtype <> 'table'", "/objtype", "'must be ''table'' in Parquet files'"),
    ("std = 'parquet' AND is_list", "/name", "'for Parquet files, must be a string, not a list'"),
]
_TYPE_RULES = [
    ("size < 3", "/filename", "'should have at least one pattern'"),
    ("size = 5", "/filename", "'should have at least one inclusive pattern'"),
    ("size > 45", "/objects", "'should not be defined when ignore is true'"),
    ("size > 45 AND std <> 'unspecified'", "/standard", "'should not be set when ignore is true'"),
    ("size > 45", "/validation_options", "'should not be set when ignore is true'"),
    ("std = 'unspecified'", "/standard", "'must be defined if any objects are defined'"),
    ("std = 'csv'", "/standard", "'csv does not support data validation, but objects are defined'"),
    ("std = 'parquet' AND objtype = 'bintable'", "/objects", "'Parquet files may define only one object'"),
    ("std = 'fits' AND (objtype IS NULL OR objtype <> 'primary')", "/objects/0/objtype", "'first HDU in a FITS file must be a ''primary'' HDU'"),
]
_PROPS = """
props AS (
  SELECT 'parts' AS dataset, o_orderstatus AS delivery_id, '/filetypes/c' || o_custkey AS lpath,
    CASE o_orderstatus WHEN 'F' THEN 'column' ELSE 'metadata' END AS element,
    CASE o_orderpriority[1] WHEN '1' THEN 'ndim' WHEN '2' THEN 'dtype' WHEN '3' THEN 'index' WHEN '4' THEN 'value_regex' ELSE 'name' END AS prop,
    CASE WHEN o_totalprice > 400000 THEN 'many' ELSE CAST(CAST(trunc(o_totalprice) AS BIGINT) AS VARCHAR) END AS val,
    CASE o_custkey % 50 WHEN 0 THEN 'map' WHEN 1 THEN 'list' ELSE 'scalar' END AS form
  FROM orders)
"""


def _rules(rules, source, at):
    return "\nUNION ALL\n".join(
        f"SELECT dataset, delivery_id, {at} || '{place}' AS lpath, {text} AS problem FROM {source} WHERE {condition}"
        for condition, place, text in rules
    )


ORACLE = {
    "lint_objects": f"WITH {_ARCHIVE}\n{_rules(_OBJECT_RULES, 'both_objs', 'place')}",
    "lint_types": f"WITH {_ARCHIVE}\n" + _rules(_TYPE_RULES, "objs", "'/filetypes/' || type"),
    "lint_columns": f"""
WITH {_ARCHIVE},
cols AS (
  SELECT *, CASE WHEN size < 16 THEN 'f2' WHEN size < 29 THEN 'M8[s]' WHEN size < 31 THEN 'c8' ELSE 'V0' END AS code
  FROM objs WHERE has_schema)
SELECT dataset, delivery_id, place || '/schema/0/dtype' AS lpath, 'data type ''' || code || ''' is not supported'
  || CASE std WHEN 'fits' THEN ' in FITS tables' WHEN 'parquet' THEN ' in Parquet tables' ELSE '' END AS problem
FROM cols WHERE code = 'V0' OR (std = 'fits' AND code <> 'c8') OR (std = 'parquet' AND code <> 'f2')
""",
    "lint_metadata": f"""
WITH {_ARCHIVE},
meta AS (
  SELECT *, size < 30 AS constrained, CASE WHEN size > 25 THEN 0 END AS ix FROM objs WHERE size BETWEEN 20 AND 39),
all_meta AS (SELECT * FROM meta UNION ALL SELECT * REPLACE (NULL AS ix) FROM meta WHERE constrained AND ix IS NOT NULL)
SELECT dataset, delivery_id, place || '/metadata/KEY/index' AS lpath, 'is only permitted for FITS files' AS problem
FROM all_meta WHERE ix IS NOT NULL AND std <> 'fits'
UNION ALL
SELECT dataset, delivery_id, place || '/metadata/KEY', 'per-object metadata constraints are not supported for ASDF'
FROM all_meta WHERE std = 'asdf' AND constrained
UNION ALL
SELECT dataset, delivery_id, place || '/metadata/KEY', 'metadata key with no index and also with indices'
FROM meta WHERE constrained AND ix IS NOT NULL
""",
    "lint_contacts": """
SELECT 'parts' AS dataset, c_mktsegment AS delivery_id, '/contacts/provider/' || c_custkey AS lpath,
  CASE WHEN c_acctbal < 0 THEN '''' || c_name || ''' has no @domain component'
    ELSE '''' || c_name || '@host'' doesn''t end with a fully qualified domain name' END AS problem
FROM customer WHERE c_acctbal < 0 OR c_nationkey < 5
""",
    "lint_unknown": f"""
WITH {_PROPS}
SELECT DISTINCT dataset, delivery_id, lpath || '/' || prop AS lpath, 'not a valid property for ' || element AS problem
FROM props WHERE (element = 'column' AND prop IN ('index', 'value_regex')) OR (element = 'metadata' AND prop IN ('ndim', 'dtype', 'name'))
""",
    "lint_duplicates": f"""
WITH {_PROPS}
SELECT dataset, delivery_id, lpath || '/' || prop AS lpath, 'property appears twice or more in this element' AS problem
FROM props GROUP BY dataset, delivery_id, lpath, prop HAVING count(*) > 1
""",
    "lint_missing": f"""
WITH {_PROPS},
elements AS (SELECT DISTINCT dataset, delivery_id, lpath FROM props WHERE element = 'column')
SELECT e.dataset, e.delivery_id, e.lpath || '/' || r.prop AS lpath, 'must always be defined' AS problem
FROM elements e, (VALUES ('name'), ('dtype')) r(prop)
WHERE NOT EXISTS (SELECT 1 FROM props p WHERE p.delivery_id = e.delivery_id AND p.lpath = e.lpath AND p.prop = r.prop)
""",
    "lint_scalars": f"""
WITH {_PROPS}
SELECT dataset, delivery_id, lpath || '/' || prop AS lpath,
  'bad value; ''' || val || ''' could not be parsed as '
    || CASE prop WHEN 'value_regex' THEN 'a boolean value' ELSE 'an integer' END AS problem
FROM props
WHERE form = 'scalar' AND ((element = 'column' AND prop = 'ndim' AND val = 'many') OR (element = 'metadata' AND prop = 'index' AND val = 'many')
  OR (element = 'metadata' AND prop = 'value_regex' AND val NOT IN ('0', '1')))
UNION ALL
SELECT dataset, delivery_id, lpath || '/' || prop, 'bad value; expected a scalar, got a ' || form
FROM props
WHERE form <> 'scalar' AND prop IN ('ndim', 'dtype', 'name', 'index', 'value_regex')
  AND NOT (element = 'column' AND prop IN ('index', 'value_regex')) AND NOT (element = 'metadata' AND prop IN ('ndim', 'dtype', 'name'))
""",
}
ORACLE["lint_report"] = (
    "WITH all_problems AS ("
    + "\nUNION ALL\n".join(f"SELECT * FROM ({sql})" for sql in ORACLE.values())
    + """)
SELECT dataset, delivery_id, lpath, count(*) AS n_problems,
  string_agg(problem, '; ' ORDER BY problem) AS problems
FROM all_problems GROUP BY dataset, delivery_id, lpath
"""
)
