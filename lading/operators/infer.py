"""Infer one specification from many file descriptions.

`items` are ordered descriptions (columns of a schema, HDUs of a file): a
scope (what is unified), a file, a position, a name and properties.  All
steps are aggregates over (scope, ...) keys that combine before shuffling;
the order-dependent step (stem runs) is a bucketed scan within each file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lading.functions.names import generalise_repeated, stem_of
from lading.functions.regex import escape_regex
from lading.materialise import stored
from lading.operators import scans


def name_counts(
    items: DataFrame, scope: Sequence[str], file: Sequence[str], name: str = "name"
) -> DataFrame:
    """A5: per name, the files that have it and the files of its scope."""
    in_file = items.groupBy(*scope, name, *file).agg(F.lit(1).alias("__one"))
    named = in_file.groupBy(*scope, name).agg(F.count(F.lit(1)).alias("n_with"))
    return named.join(file_counts(items, scope, file), list(scope))


def file_counts(
    items: DataFrame, scope: Sequence[str], file: Sequence[str]
) -> DataFrame:
    """Files per scope and the fewest and most items of a file."""
    per_file = items.groupBy(*scope, *file).agg(F.count(F.lit(1)).alias("__n"))
    return per_file.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.min("__n").alias("fewest"),
        F.max("__n").alias("most"),
    )


def shared_names(
    items: DataFrame, scope: Sequence[str], file: Sequence[str], name: str = "name"
) -> DataFrame:
    """A5: every name with `shared`: is it in every file of its scope?"""
    return name_counts(items, scope, file, name).withColumn(
        "shared", F.col("n_with") == F.col("n_files")
    )


def name_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Names in both."""
    return a.select("name").intersect(b.select("name"))


def name_symdiff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Names in exactly one."""
    left, right = a.select("name"), b.select("name")
    return left.exceptAll(right).unionByName(right.exceptAll(left)).distinct()


def structure_variants(
    items: DataFrame, scope: Sequence[str], file: Sequence[str], name: str = "name"
) -> DataFrame:
    """Number of distinct item counts and of distinct name sets per scope.

    A file's set of names is reduced to two order-independent sums of hashes
    over its distinct names, so no set is ever gathered.  Items are sorted by
    file and name, so that a task keeps no table of them; sorts spill.
    """
    in_order = Window.partitionBy(*scope, *file).orderBy(name)
    # is it the first item of its name?
    fresh = F.coalesce(
        ~F.lag(F.struct(name)).over(in_order).eqNullSafe(F.struct(name)), F.lit(True)
    )
    wide = "decimal(38,0)"
    first = items.select(*scope, *file, name, fresh.alias("__fresh"))
    prints = first.groupBy(*scope, *file).agg(
        F.count(F.lit(1)).alias("__size"),
        F.count_if("__fresh").alias("__names"),
        F.sum(F.when(F.col("__fresh"), F.xxhash64(name).cast(wide))).alias("__h1"),
        F.sum(F.when(F.col("__fresh"), F.xxhash64(F.lit(1), F.col(name)).cast(wide))).alias("__h2"),
    )
    variants = prints.groupBy(*scope, "__size", "__names", "__h1", "__h2").agg(F.lit(1).alias("__one"))
    for column in scope:
        variants = variants.filter(F.col(column).isNotNull())
    return variants.groupBy(*scope).agg(
        F.count_distinct("__size").alias("n_sizes"),
        F.count_distinct("__names", "__h1", "__h2").alias("n_sets"),
    )


def recognised_stems(
    items: DataFrame, scope: Sequence[str], file: Sequence[str]
) -> DataFrame:
    """Stems of names missing from some file, where files differ in length."""
    loose = name_counts(items, scope, file).filter(
        (F.col("n_with") < F.col("n_files")) & (F.col("fewest") != F.col("most"))
    )
    return (
        loose.withColumn("stem", stem_of(F.col("name")))
        .filter(F.col("stem").isNotNull())
        .groupBy(*scope, "stem")
        .agg(F.lit(True).alias("__known"))
    )


def stem_runs(
    items: DataFrame,
    scope: Sequence[str],
    file: Sequence[str],
    position: str,
    stem: Column,
    width: int = 4096,
) -> DataFrame:
    """`group_id` along each file: consecutive equal stems share one.

    Rows with a NULL stem start a group of their own.
    """
    numbered = scans.change_runs(
        items.withColumn("stem", stem),
        [*scope, *file],
        [F.col(position)],
        scans.position_bucket(F.col(position), width),
        F.col("stem"),
        lambda before, here: ~F.coalesce(before == here, F.lit(False)),
        "__runs",
    )
    return numbered.withColumn("group_id", (F.col("__runs") - 1).cast("int")).drop("__runs")


def chunk_repeated(
    items: DataFrame, scope: Sequence[str], file: Sequence[str], position: str
) -> DataFrame:
    """W1 with its gate: only recognised stems (see `recognised_stems`) group.

    The result is materialised: unification reads it several times.
    """
    items = stored(items)
    known = stored(recognised_stems(items, scope, file))
    stemmed = items.withColumn("__stem", stem_of(F.col("name")))
    joined = stemmed.join(
        known.withColumnRenamed("stem", "__stem"), [*scope, "__stem"], "left"
    )
    grouped = stem_runs(
        joined, scope, file, position, F.when(F.col("__known"), F.col("__stem"))
    )
    return stored(grouped.drop("__stem", "__known"))


def chunk_problems(
    grouped: DataFrame, scope: Sequence[str], file: Sequence[str]
) -> DataFrame:
    """Stems that repeat apart within a file or sit elsewhere in other files."""
    spots = (
        grouped.filter(F.col("stem").isNotNull())
        .groupBy(*scope, "stem", *file)
        .agg(F.min("group_id").alias("__from"), F.max("group_id").alias("__to"))
        .groupBy(*scope, "stem")
        .agg(
            F.bool_or(F.col("__from") != F.col("__to")).alias("__apart"),
            F.min("__from").alias("__low"),
            F.max("__from").alias("__high"),
        )
    )
    problem = F.when(F.col("__apart"), "repeated group").when(
        F.col("__low") != F.col("__high"), "inconsistent position"
    )
    return spots.withColumn(
        "problem", F.concat(problem, F.lit(": "), F.col("stem"))
    ).filter(F.col("problem").isNotNull()).select(*scope, "problem")


def stem_sets(nodes: DataFrame, scope: Sequence[str], file: Sequence[str]) -> DataFrame:
    """Groups of tree nodes; the stem is taken on the last path element.

    `nodes` has `node array<string>`.  Adds `name` (joined path), `parent`,
    `stem` (NULL unless recognised) and `group_key`.
    """
    last = F.element_at("node", -1)
    parent = F.slice("node", 1, F.size("node") - 1)
    named = stored(
        nodes.withColumns(
            {
                "name": F.to_json("node"),
                "parent": F.to_json(parent),
                "__stem": stem_of(last),
            }
        )
    )
    loose = name_counts(named, scope, file).filter(F.col("n_with") < F.col("n_files"))
    known = stored(
        named.join(stored(loose.select(*scope, "name")), [*scope, "name"], "left_semi")
        .filter(F.col("__stem").isNotNull())
        .groupBy(*scope, "parent", "__stem")
        .agg(F.lit(True).alias("__known"))
    )
    joined = named.join(known, [*scope, "parent", "__stem"], "left")
    stem = F.when(F.col("__known"), F.col("__stem"))
    keyed = joined.withColumn("stem", stem).withColumn(
        "group_key",
        F.when(
            F.col("stem").isNotNull(), F.concat(F.col("parent"), F.lit("+"), F.col("stem"))
        ).otherwise(F.col("name")),
    )
    return keyed.drop("__stem", "__known")


def generalise_names(
    items: DataFrame, keys: Sequence[str], name: str = "name"
) -> DataFrame:
    """One name or regex per group of names.

    Characters that differ become ``.``; positions beyond the shortest name
    become ``.?``.  All names count at once, so their order does not matter.
    Copies of a name collapse before its characters are spread out.
    """
    distinct = items.groupBy(*keys, name).agg(F.lit(1).alias("__one"))
    lengths = distinct.groupBy(*keys).agg(
        F.min(F.length(name)).alias("__shortest"),
        F.count(F.lit(1)).alias("n_names"),
        F.min(name).alias("__any"),
    )
    letters = distinct.select(*keys, F.posexplode(F.split(name, "")).alias("pos", "__ch"))
    agreed = letters.filter(F.col("__ch") != "").groupBy(*keys, "pos").agg(
        F.min("__ch").alias("__low"), F.max("__ch").alias("__high")
    )
    joined = agreed.join(lengths.select(*keys, "__shortest"), list(keys))
    piece = (
        F.when(F.col("pos") >= F.col("__shortest"), ".?")
        .when(F.col("__low") == F.col("__high"), escape_regex(F.col("__low")))
        .otherwise(".")
    )
    patterns = (
        joined.withColumn("__piece", piece)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("pos", "__piece"))).alias("__pieces"))
    )
    one = F.col("n_names") == 1
    return lengths.join(patterns, list(keys), "left").select(
        *keys,
        F.when(one, F.col("__any"))
        .otherwise(F.array_join(F.transform("__pieces", lambda p: p["__piece"]), ""))
        .alias("name"),
        (~one).alias("name_regex"),
    )


def unify_groups(
    grouped: DataFrame,
    scope: Sequence[str],
    group: str,
    file: Sequence[str],
    properties: Sequence[str],
) -> DataFrame:
    """One row per group; its properties must agree over all items.

    `failure` holds the first disagreement (NULL when unified).
    """
    keys = [*scope, group]
    # least and greatest text of the distinct values, so that equal rows are counted, not sorted
    values = (
        grouped.groupBy(*keys, *[F.col(p).cast("string").alias(f"__is_{p}") for p in properties])
        .agg(F.count(F.lit(1)).alias("__n"))
        .groupBy(*[F.col(k).alias(f"__at_{k}") for k in keys])
        .agg(
            *[
                agg(f"__is_{p}").alias(f"__{tag}_{p}")
                for p in properties
                for tag, agg in (("lo", F.min), ("hi", F.max))
            ],
            *[
                F.sum(F.when(F.col(f"__is_{p}").isNotNull(), F.col("__n")).otherwise(0)).alias(f"__set_{p}")
                for p in properties
            ],
            F.sum("__n").alias("__n"),
        )
    )
    in_file = grouped.groupBy(*keys, "stem", *file).agg(F.lit(1).alias("__one"))
    stems = (
        in_file.groupBy(*keys, "stem")
        .agg(F.count(F.lit(1)).alias("n_with"))
        .groupBy(*keys)
        .agg(
            F.sum("n_with").alias("n_with"),
            F.max("stem").alias("stem"),
            (F.count_if(F.col("stem").isNull()) > 0).alias("__plain"),
        )
    )
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__at_{k}"))
    unified = stems.join(values, same).drop(*[f"__at_{k}" for k in keys])
    files = file_counts(grouped, scope, file).select(*scope, "n_files")

    def text(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit("none"))

    failure = F.when(F.col("n_with") != F.col("n_files"), F.lit("incompatible group count"))
    failure = failure.when(
        F.col("stem").isNotNull() & F.col("__plain"), F.lit("mismatched repeated stem")
    )
    for p in properties:
        some_null = F.col(f"__set_{p}") < F.col("__n")
        failure = failure.when(
            (F.col(f"__lo_{p}") != F.col(f"__hi_{p}"))
            | (some_null & (F.col(f"__set_{p}") > 0)),
            F.concat(
                F.lit(f"mismatched {p}: "),
                F.when(some_null, "none").otherwise(text(f"__lo_{p}")),
                F.lit(" vs. "),
                text(f"__hi_{p}"),
            ),
        )
    return unified.join(files, list(scope)).select(
        *scope,
        group,
        "stem",
        *[F.col(f"__lo_{p}").alias(p) for p in properties],
        failure.alias("failure"),
    )


def unify_columns(
    grouped: DataFrame, scope: Sequence[str], file: Sequence[str]
) -> DataFrame:
    """Unified columns with name, regex flag and repetition."""
    unified = unify_groups(grouped, scope, "group_id", file, ["dtype", "ndim"])
    return _with_names(unified, grouped, [*scope, "group_id"]).withColumn(
        "ndim", F.col("ndim").cast("int")
    )


def unify_objects(
    grouped: DataFrame, scope: Sequence[str], file: Sequence[str]
) -> DataFrame:
    """A10: unified objects; `has_schema` must agree like any other property."""
    unified = unify_groups(
        grouped, scope, "group_id", file, ["objtype", "dtype", "ndim", "has_schema"]
    )
    return _with_names(unified, grouped, [*scope, "group_id"]).withColumns(
        {
            "ndim": F.col("ndim").cast("int"),
            "has_schema": F.col("has_schema").cast("boolean"),
        }
    )


def _with_names(unified: DataFrame, grouped: DataFrame, keys: Sequence[str]) -> DataFrame:
    plain = generalise_names(grouped.filter(F.col("stem").isNull()), keys)
    repeated = F.col("stem").isNotNull()
    return unified.join(plain, list(keys), "left").withColumns(
        {
            "name": F.when(repeated, generalise_repeated(F.col("stem"))).otherwise(
                F.col("name")
            ),
            "name_regex": repeated | F.coalesce("name_regex", F.lit(False)),
            "repeated": repeated,
        }
    )


def drop_temporaries(described: DataFrame) -> DataFrame:
    """Without the working columns of inference."""
    return described.drop("group_id", "group_key", "stem", "parent", "has_schema")


def merge_specs(current: DataFrame, populated: DataFrame) -> DataFrame:
    """Rows of populated types replace the current ones."""
    keys = ["dataset", "delivery_id", "type"]
    kept = current.join(populated.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(populated.select(*current.columns))


def diff_specs(submitted: DataFrame, accepted: DataFrame) -> DataFrame:
    """Rows of only one of two spec tables, tagged with their side."""
    return (
        submitted.exceptAll(accepted)
        .withColumn("side", F.lit("submitted"))
        .unionByName(accepted.exceptAll(submitted).withColumn("side", F.lit("accepted")))
    )
