"""File classification: URLs of `pages` as paths, parts as file names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lading.functions.names import infer_standard, order_patterns
from lading.operators import classify as c
from lading.operators import manifest
from lading.queries.readings import table
from lading.spec import Specs

URL_LABEL = {
    "dataset": "web",
    "delivery_id": 1,
    "filetypes": {
        "html": {"filename": [r"\.html$"], "standard": "html"},
        "lang_de": {"filename": [r"/de/\d+", "(?!)utm_"]},
        "lang_en": {"filename": [r"/en/\d+", "(?!)utm_"]},
        "lang_es": {"filename": [r"/es/\d+", "(?!)utm_"]},
        "lang_fr": {"filename": [r"/fr/\d+", "(?!)utm_", r"(?!)#top\Z"]},
        "video": {"filename": r"(?i)\.MP4$", "standard": "mp4"},
    },
    "time": {"delivery_start_date": "2026-01-01"},
    "delivery_meta": {"schema_version": "0.1.0"},
}
NAME_LABEL = {
    "dataset": "web",
    "delivery_id": 2,
    "filetypes": {
        "fits": {"filename": r".*\.fits", "standard": "fits"},
        "numbered": {"filename": [r"\d+", r"(?!)\d+\?", r"(?!)\d{1,2}$"]},
        "query": {"filename": [r"\d+\?", r"(?!).*utm_"]},
        "tagged": {"filename": [r"\d+\?utm_", r"\d+#"]},
    },
}


def _urls(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select(F.col("url").alias("path"))


def _classified(spark: SparkSession, folder: str) -> tuple[DataFrame, Specs]:
    specs = Specs.from_labels(spark, [URL_LABEL])
    return c.classify(_urls(spark, folder), specs), specs


def classify_pages(spark, folder):
    return c.filetype_report(_classified(spark, folder)[0])


def classify_by_delivery(spark, folder):
    """J1 with patterns in tables: two labels, each page in the delivery of its scheme."""
    specs = Specs.from_labels(spark, [URL_LABEL, NAME_LABEL])
    secure = F.col("path").startswith("https")
    files = _urls(spark, folder).withColumns(
        {"dataset": F.lit("web"), "delivery_id": F.when(secure, "1").otherwise("2")}
    )
    matched = c.match_types_by_delivery(files, specs.patterns)
    return matched.select(
        "path", "delivery_id", F.array_join("types", ";").alias("filetypes")
    )


def unassigned_pages(spark, folder):
    return c.unassigned_files(_classified(spark, folder)[0]).select("path")


def ambiguous_pages(spark, folder):
    found = c.ambiguous_files(_classified(spark, folder)[0])
    return found.select("path", F.size("types").cast("bigint").alias("n_types"))


def missing_types(spark, folder):
    classified, specs = _classified(spark, folder)
    return c.missing_types(classified, specs)


def covered_pages(spark, folder):
    specs = Specs.from_labels(spark, [URL_LABEL])
    return c.covered_only(_urls(spark, folder), specs)


def problem_report(spark, folder):
    return c.sorted_problem_report(_classified(spark, folder)[0])


def _manifest(spark: SparkSession, folder: str):
    specs = Specs.from_labels(spark, [NAME_LABEL])
    index = _urls(spark, folder).withColumn(
        "will_transfer", ~F.col("path").contains("#top")
    )
    return manifest.check_manifest(index, specs)


def manifest_index(spark, folder):
    index, _ = _manifest(spark, folder)
    return index.select(
        "path", "filename", "type", "status", F.col("n_fail").cast("bigint").alias("n_fail")
    )


def manifest_problems(spark, folder):
    return _manifest(spark, folder)[1]


def standards_by_suffix(spark, folder):
    """Part names with a suffix by size."""
    size = F.col("p_size")
    suffix = (
        F.when(size < 10, ".FITS.gz")
        .when(size < 20, ".v2.pqt")
        .when(size < 30, ".asdf")
        .when(size < 40, ".Txt")
        .otherwise("")
    )
    files = table(spark, folder, "part").withColumn("path", F.concat("p_name", suffix))
    return files.groupBy(infer_standard(F.col("path")).alias("standard")).agg(
        F.count(F.lit(1)).alias("n_files")
    )


def needs_data_check(spark, folder):
    """Every brand is a file type, its parts the objects."""
    part = table(spark, folder, "part")
    types = part.groupBy(F.col("p_brand").alias("type")).agg(
        F.min("p_size").alias("least"), F.max("p_size").alias("most")
    )
    key = {"dataset": F.lit("parts"), "delivery_id": F.lit("1")}
    types = types.withColumns(
        {
            **key,
            "standard": F.when(F.col("least") > 1, "fits").otherwise("text"),
            "skip": F.when(F.col("most") < 50, F.array(F.lit("all"))).otherwise(
                F.array(F.lit("standard"), F.lit("name"), F.lit("objtype"))
            ),
            "hook": F.lit(None).cast("string"),
        }
    )
    objects = part.withColumns(
        {
            **key,
            "type": F.col("p_brand"),
            "name": F.col("p_name"),
            "objtype": F.lit("image"),
            "ndim": F.when(F.col("p_retailprice") > 1050, F.lit(2)),
            "dtype": F.lit(None).cast("string"),
            "value": F.lit(None).cast("string"),
        }
    )
    empty = Specs.from_labels(spark, [])
    specs = Specs(
        types=types, patterns=empty.patterns, objects=objects, columns=empty.columns,
        meta=empty.meta, contacts=empty.contacts, props=empty.props, options=empty.options,
    )
    return c.needs_data_check(specs).select("type", "standard", "needs_data")


SKIP_LABEL = {
    "dataset": "web",
    "delivery_id": 3,
    "filetypes": {
        "feeds": {"filename": r"utm_source=", "ignore": True},
        "secure": {"filename": ["^https", r"(?!)utm_"], "standard": "parquet"},
        "plain": {"filename": ["^http:", r"(?!)utm_", r"(?!)/$"], "standard": "html"},
    },
}


def files_to_check(spark, folder):
    """Pages without ignored ones, with their type's options."""
    specs = Specs.from_labels(spark, [SKIP_LABEL])
    classified = c.exempt_label_file(c.classify(_urls(spark, folder), specs))
    kept = c.type_lookup(c.drop_ignored(classified, specs), specs)
    return kept.select("path", "type", "standard", "needs_data")


TWO_LABELS = [
    {
        "dataset": "web", "delivery_id": 4,
        "filetypes": {
            "feeds": {"filename": "utm_source=", "ignore": True},
            "pages": {"filename": [r"/(en|de)/\d+(?!.*utm_)"], "standard": "parquet"},
            "doubled": {"filename": r"://(\w)\w*\.(?:\w+\.)*\w+/.*(?(1)html|never)$", "standard": "html"},
        },
    },
    {
        "dataset": "web", "delivery_id": 5,
        "filetypes": {
            "feeds": {"filename": "utm_source=", "standard": "fits", "validation_options": {"skip": ["objtype"]}},
            "pages": {"filename": [r"/(en|fr)/\d+", "(?!)utm_source="], "standard": "asdf"},
            "nothing": {"filename": r"\.never$"},
        },
        "delivery_meta": {"global_validation_options": {"skip": ["all"]}},
    },
]


def _two_labels(spark: SparkSession, folder: str) -> tuple[DataFrame, Specs]:
    """Each page in the delivery of its scheme; labels share type names with other options."""
    specs = Specs.from_labels(spark, TWO_LABELS)
    secure = F.col("path").startswith("https")
    files = _urls(spark, folder).withColumns(
        {"dataset": F.lit("web"), "delivery_id": F.when(secure, "4").otherwise("5")}
    )
    return files, specs


def files_of_two_labels(spark, folder):
    """One row a file, with the options of its own label's type."""
    files, specs = _two_labels(spark, folder)
    kept = c.type_lookup(c.drop_ignored(c.classify(files, specs), specs), specs)
    return kept.select(
        "path", "delivery_id", F.array_join("types", ";").alias("filetypes"), "type", "standard",
        F.array_join("skips", ",").alias("skips"), "needs_data",
    )


def problems_of_two_labels(spark, folder):
    """V9: manifest checks of both labels in one job."""
    files, specs = _two_labels(spark, folder)
    index = files.withColumn("will_transfer", F.lit(True))
    return manifest.check_manifest(index, specs, "search")[1]


def ordered_patterns(spark, folder):
    """O1: three patterns per page, inclusions first."""
    host = F.regexp_extract("url", "https?://([^/]+)", 1)
    rest = F.regexp_extract("url", "https?://[^/]+(.*)$", 1)
    patterns = F.array(
        *[
            F.struct(text.alias("pattern"), F.lit(include).alias("include"))
            for text, include in ((host, False), (rest, True), (F.lit("/en/m"), True))
        ]
    )
    ordered = F.transform(order_patterns(patterns), lambda p: p["pattern"])
    return table(spark, folder, "pages").select(
        "page_id", F.array_join(ordered, " ").alias("patterns")
    )


QUERIES = {
    "files_of_two_labels": files_of_two_labels,
    "problems_of_two_labels": problems_of_two_labels,
    "files_to_check": files_to_check,
    "ordered_patterns": ordered_patterns,
    "classify_pages": classify_pages,
    "classify_by_delivery": classify_by_delivery,
    "unassigned_pages": unassigned_pages,
    "ambiguous_pages": ambiguous_pages,
    "missing_types": missing_types,
    "covered_pages": covered_pages,
    "problem_report": problem_report,
    "manifest_index": manifest_index,
    "manifest_problems": manifest_problems,
    "standards_by_suffix": standards_by_suffix,
    "needs_data_check": needs_data_check,
}

_HITS = """
hits AS (
  SELECT url AS path,
    CASE WHEN regexp_matches(url, '\\.html$') THEN 'html' END AS t1,
    CASE WHEN regexp_matches(url, '/de/\\d+') AND NOT regexp_matches(url, 'utm_') THEN 'lang_de' END AS t2,
    CASE WHEN regexp_matches(url, '/en/\\d+') AND NOT regexp_matches(url, 'utm_') THEN 'lang_en' END AS t3,
    CASE WHEN regexp_matches(url, '/es/\\d+') AND NOT regexp_matches(url, 'utm_') THEN 'lang_es' END AS t4,
    CASE WHEN regexp_matches(url, '/fr/\\d+') AND NOT regexp_matches(url, 'utm_')
      AND NOT regexp_matches(url, '#top$') THEN 'lang_fr' END AS t5,
    CASE WHEN regexp_matches(url, '(?i)\\.mp4$') THEN 'video' END AS t6
  FROM pages),
report AS (
  SELECT path, concat_ws(';', t1, t2, t3, t4, t5, t6) AS filetypes,
    (t1 IS NOT NULL)::INT + (t2 IS NOT NULL)::INT + (t3 IS NOT NULL)::INT
    + (t4 IS NOT NULL)::INT + (t5 IS NOT NULL)::INT + (t6 IS NOT NULL)::INT AS n
  FROM hits)
"""
_STATUS = "CASE n WHEN 0 THEN 'unassigned' WHEN 1 THEN 'assigned' ELSE 'ambiguous' END"
_NAMED = """
named AS (
  SELECT url AS path, list_extract(string_split(url, '/'), -1) AS filename, NOT contains(url, '#top') AS will_transfer
  FROM pages),
typed AS (
  SELECT *,
    CASE WHEN regexp_matches(filename, '^(?:.*\\.fits)') THEN 'fits' END AS t0,
    CASE WHEN regexp_matches(filename, '^\\d+') AND NOT regexp_matches(filename, '^\\d+\\?')
      AND NOT regexp_matches(filename, '^\\d{1,2}$') THEN 'numbered' END AS t1,
    CASE WHEN regexp_matches(filename, '^\\d+\\?') AND NOT regexp_matches(filename, '^.*utm_') THEN 'query' END AS t2,
    CASE WHEN regexp_matches(filename, '^(?:\\d+\\?utm_|\\d+#)') THEN 'tagged' END AS t3
  FROM named),
counted AS (
  SELECT *, (t0 IS NOT NULL)::INT + (t1 IS NOT NULL)::INT + (t2 IS NOT NULL)::INT + (t3 IS NOT NULL)::INT AS n
  FROM typed)
"""

_TWO = """
found AS (
  SELECT url AS path, '4' AS delivery_id,
    CASE WHEN regexp_matches(url, '://\\w+\\.(?:\\w+\\.)*\\w+/.*html$') THEN 'doubled' END AS t1,
    CASE WHEN contains(url, 'utm_source=') THEN 'feeds' END AS t2,
    CASE WHEN regexp_matches(url, '/(en|de)/\\d+') AND NOT regexp_matches(url, '/(?:en|de)/\\d+.*utm_') THEN 'pages' END AS t3
  FROM pages WHERE url LIKE 'https%'
  UNION ALL
  SELECT url, '5', NULL, CASE WHEN contains(url, 'utm_source=') THEN 'feeds' END,
    CASE WHEN regexp_matches(url, '/(en|fr)/\\d+') AND NOT contains(url, 'utm_source=') THEN 'pages' END
  FROM pages WHERE url NOT LIKE 'https%'),
typed AS (
  SELECT path, delivery_id, concat_ws(';', t1, t2, t3) AS filetypes, t1, t2, t3,
    (t1 IS NOT NULL)::INT + (t2 IS NOT NULL)::INT + (t3 IS NOT NULL)::INT AS n
  FROM found),
named AS (SELECT *, CASE WHEN n = 1 THEN coalesce(t1, t2, t3) END AS type FROM typed),
options AS (
  SELECT * FROM (VALUES ('4', 'feeds', 'unspecified', '', false), ('4', 'pages', 'parquet', '', true),
    ('4', 'doubled', 'html', '', false), ('5', 'feeds', 'fits', 'objtype,all', false),
    ('5', 'pages', 'asdf', 'all', false)) AS o(delivery_id, type, standard, skips, needs_data))
"""

ORACLE = {
    "files_of_two_labels": f"""
WITH {_TWO}
SELECT path, delivery_id, filetypes, type, standard, skips, coalesce(needs_data, false) AS needs_data
FROM named LEFT JOIN options USING (delivery_id, type)
WHERE NOT coalesce(delivery_id = '4' AND type = 'feeds', false)
""",
    "problems_of_two_labels": f"""
WITH {_TWO}
SELECT 'web' AS dataset, delivery_id, CASE n WHEN 0 THEN 'no filetype' ELSE 'ambiguous filetype' END AS problem, path AS subject
FROM named WHERE n <> 1
UNION ALL
SELECT 'web', d, 'filetype without files', t
FROM (VALUES ('4', 'feeds'), ('4', 'pages'), ('4', 'doubled'), ('5', 'feeds'), ('5', 'pages'), ('5', 'nothing')) AS x(d, t)
WHERE NOT EXISTS (SELECT 1 FROM named WHERE delivery_id = d AND t IN (t1, t2, t3))
""",
    "files_to_check": """
WITH typed AS (
  SELECT url AS path, CASE WHEN url LIKE 'https%' THEN 'secure' WHEN url NOT LIKE '%/' THEN 'plain' END AS type
  FROM pages WHERE NOT contains(url, 'utm_source='))
SELECT path, type, CASE type WHEN 'secure' THEN 'parquet' WHEN 'plain' THEN 'html' END AS standard,
  coalesce(type = 'secure', false) AS needs_data
FROM typed
""",
    "ordered_patterns": """
WITH parts AS (SELECT page_id, regexp_extract(url, 'https?://([^/]+)', 1) AS host,
  regexp_extract(url, 'https?://[^/]+(.*)$', 1) AS rest FROM pages)
SELECT page_id, least(rest, '/en/m') || ' ' || greatest(rest, '/en/m') || ' ' || host AS patterns FROM parts
""",
    "classify_pages": f"WITH {_HITS} SELECT path, filetypes, {_STATUS} AS status FROM report",
    "classify_by_delivery": f"""
WITH {_HITS},
paged AS (
  SELECT url AS path,
    CASE WHEN regexp_matches(url, '.*\\.fits') THEN 'fits' END AS t0,
    CASE WHEN regexp_matches(url, '\\d+') AND NOT regexp_matches(url, '\\d+\\?')
      AND NOT regexp_matches(url, '\\d{{1,2}}$') THEN 'numbered' END AS t1,
    CASE WHEN regexp_matches(url, '\\d+\\?') AND NOT regexp_matches(url, '.*utm_') THEN 'query' END AS t2,
    CASE WHEN regexp_matches(url, '\\d+\\?utm_|\\d+#') THEN 'tagged' END AS t3
  FROM pages)
SELECT path, '1' AS delivery_id, filetypes FROM report WHERE path LIKE 'https%'
UNION ALL
SELECT path, '2', concat_ws(';', t0, t1, t2, t3) FROM paged WHERE path NOT LIKE 'https%'
""",
    "unassigned_pages": f"WITH {_HITS} SELECT path FROM report WHERE n = 0",
    "ambiguous_pages": f"WITH {_HITS} SELECT path, CAST(n AS BIGINT) AS n_types FROM report WHERE n > 1",
    "missing_types": f"""
WITH {_HITS}
SELECT 'web' AS dataset, '1' AS delivery_id, t.type
FROM (VALUES ('html'), ('lang_de'), ('lang_en'), ('lang_es'), ('lang_fr'), ('video')) t(type)
WHERE NOT EXISTS (SELECT 1 FROM hits WHERE t.type IN (t1, t2, t3, t4, t5, t6))
""",
    "covered_pages": f"WITH {_HITS} SELECT path FROM report WHERE n > 0",
    "problem_report": f"""
WITH {_HITS} SELECT path, filetypes, {_STATUS} AS status FROM report WHERE n <> 1
""",
    "manifest_index": f"""
WITH {_NAMED}
SELECT path, filename, CASE WHEN n = 1 THEN coalesce(t0, t1, t2, t3) END AS type,
  CASE WHEN will_transfer THEN 'waiting' ELSE 'done' END AS status, CAST(0 AS BIGINT) AS n_fail
FROM counted
""",
    "manifest_problems": f"""
WITH {_NAMED}
SELECT 'ambiguous filetype' AS problem, path AS subject FROM counted WHERE n > 1
UNION ALL SELECT 'no filetype', path FROM counted WHERE n = 0
UNION ALL
SELECT 'filetype without files', t.type
FROM (VALUES ('fits'), ('numbered'), ('query'), ('tagged')) t(type)
WHERE NOT EXISTS (SELECT 1 FROM counted WHERE t.type IN (t0, t1, t2, t3))
""",
    "standards_by_suffix": """
SELECT CASE WHEN p_size < 10 THEN 'fits' WHEN p_size < 20 THEN 'parquet'
  WHEN p_size < 30 THEN 'asdf' WHEN p_size < 40 THEN 'txt' ELSE 'unknown' END AS standard,
  count(*) AS n_files
FROM part GROUP BY 1
""",
    "needs_data_check": """
SELECT p_brand AS type, CASE WHEN min(p_size) > 1 THEN 'fits' ELSE 'text' END AS standard,
  min(p_size) > 1 AND max(p_size) >= 50 AND bool_or(p_retailprice > 1050) AS needs_data
FROM part GROUP BY p_brand
""",
}
