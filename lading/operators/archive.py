"""File classification for many labels at once: an inverted index of pattern factors.

Most patterns hold a literal that every match must contain.  A piece of GRAM
characters of it, that which the fewest patterns of its label share, is the
pattern's entry in the index; a file looks up the pieces of its own name and is
tested only against the patterns found that way, and against the few that have
no entry.  So the work for a file doesn't grow with the size of its label, and
no file x pattern pairs are made.

Patterns that Java can't express are tested by Python, in Arrow batches.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lading.functions.names import basename
from lading.functions.regex import java_pattern, literal_runs, regex_test_by_row

DELIVERY = ["dataset", "delivery_id"]
GRAM = 3  # characters of an index entry

# How a file-name pattern is applied: (tested text, regex mode).
ANCHORING = {
    "search": (lambda path: path, "search"),  # listing, describing, local checks
    "basename": (basename, "match"),  # manifest checks
    "full": (lambda path: path, "fullmatch"),  # as documented
}


def grams(text: Column) -> Column:
    """The distinct pieces of GRAM characters of a text."""
    places = F.sequence(F.lit(1), F.length(text) - GRAM + 1)
    pieces = F.transform(places, lambda i: F.substring(text, i, GRAM))
    return F.when(F.length(text) >= GRAM, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


@F.pandas_udf(ArrayType(StringType()))
def _pattern_grams(patterns: pd.Series) -> pd.Series:
    """Pieces that every match of a pattern must contain."""
    return patterns.map(
        lambda p: sorted({run[i : i + GRAM] for run in literal_runs(p) for i in range(len(run) - GRAM + 1)})
    )


def index_patterns(patterns: DataFrame, mode: str = "search") -> DataFrame:
    """SPEC_PATTERNS with `java` (NULL: only Python has it) and `gram`, the index entry (NULL: none).

    A table of label size; of a pattern's pieces that which the fewest
    patterns of the label hold is taken, the first in order of those.
    """
    rows = patterns.distinct().withColumns(
        {"java": java_pattern(F.col("pattern"), mode), "__grams": _pattern_grams("pattern")}
    )
    single = rows.select(*DELIVERY, "pattern", F.explode("__grams").alias("gram")).distinct()
    shared = single.groupBy(*DELIVERY, "gram").agg(F.count("*").alias("__n"))
    rarest = (
        single.join(shared, [*DELIVERY, "gram"])
        .groupBy(*DELIVERY, "pattern")
        .agg(F.min(F.struct("__n", "gram")).alias("__best"))
        .select(*DELIVERY, "pattern", F.col("__best.gram").alias("gram"))
    )
    return rows.drop("__grams").join(rarest, [*DELIVERY, "pattern"], "left")


def _matching(candidates: DataFrame, mode: str) -> DataFrame:
    """Candidates (with __text, pattern, java) whose pattern matches."""
    portable = candidates.filter(F.col("java").isNotNull()).filter(F.rlike("__text", F.col("java")))
    foreign = candidates.filter(F.col("java").isNull())
    return portable.unionByName(foreign.filter(regex_test_by_row(F.col("__text"), F.col("pattern"), mode)))


def match_types_by_delivery(files: DataFrame, patterns: DataFrame, match: str = "search") -> DataFrame:
    """J1 for files and SPEC_PATTERNS of many deliveries: files with `types`.

    A type covers a file if one of its include patterns matches and none of
    its exclude patterns does; only types of the file's own delivery count.
    Files without path or delivery have no types.
    """
    subject, mode = ANCHORING[match]
    indexed = index_patterns(patterns, mode)
    includes, excludes = indexed.filter("include"), indexed.filter("not include")
    named = files.select(*DELIVERY, "path").distinct().withColumn("__text", subject(F.col("path")))
    looked_up = named.withColumn("gram", F.explode(grams(F.col("__text"))))
    wanted = [*DELIVERY, "path", "__text", "type", "pattern", "java"]
    candidates = reduce(
        DataFrame.unionByName,
        [
            looked_up.join(includes.filter("gram is not null"), [*DELIVERY, "gram"]).select(wanted),
            named.join(includes.filter("gram is null"), DELIVERY).select(wanted),
        ],
    )
    held = _matching(candidates, mode).select(*DELIVERY, "path", "__text", "type").distinct()
    against = excludes.select(*DELIVERY, "type", "pattern", "java")
    barred = _matching(held.join(against, [*DELIVERY, "type"]), mode)
    covering = held.join(barred.select(*DELIVERY, "path", "type").distinct(), [*DELIVERY, "path", "type"], "left_anti")
    types = covering.groupBy(*DELIVERY, "path").agg(F.sort_array(F.collect_set("type")).alias("types"))
    matched = files.drop("types").join(types, [*DELIVERY, "path"], "left")
    return matched.withColumn("types", F.coalesce("types", F.array().cast("array<string>"))).select(
        *[c for c in files.columns if c != "types"], "types"
    )
