"""Key/value metadata against constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lading.functions.problems import meta_problem
from lading.functions.scalars import coerce_meta
from lading.operators import scans
from lading.spec import Specs

OBJECT = ("path", "type", "obj_ix")
_SPEC_FIELDS = ("value", "value_type", "value_regex", "java_value")


def card_index(kv: DataFrame, keys: tuple[str, ...] = ("path", "obj_ix", "key")) -> DataFrame:
    """`ix`, counting from 0, of each occurrence of a keyword."""
    counted = scans.running(
        kv, keys, [F.col("pos")], scans.position_bucket(F.col("pos")), {"__n": ("sum", F.lit(1))}
    )
    return counted.withColumn("ix", (F.col("__n") - 1).cast("int")).drop("__n")


def _missing_keys(objects: DataFrame, present: DataFrame, wanted: DataFrame) -> DataFrame:
    """Keys of the spec an object lacks.

    The spec keys of a type travel as one array; only absent keys become rows.
    """
    keys = wanted.groupBy("type", "obj_ix").agg(F.collect_set("key").alias("__wanted"))
    have = present.groupBy(*OBJECT).agg(F.collect_set("key").alias("__have"))
    lacking = F.array_except(
        "__wanted", F.coalesce("__have", F.array().cast("array<string>"))
    )
    return (
        objects.select(*OBJECT)
        .join(keys, ["type", "obj_ix"])
        .join(have, list(OBJECT), "left")
        .select(*OBJECT, F.explode(lacking).alias("key"))
        .withColumn("message", F.lit("required metadata key missing"))
    )


def validate_metadata(
    kv: DataFrame, objects: DataFrame, specs: Specs, coerce: bool = False
) -> DataFrame:
    """FAILURES of key/values; `coerce` reads text values as typed.

    `kv` has path, type, obj_ix, pos, key, value and value_type.  A keyword
    whose spec has no index may occur once; one with indices must occur often
    enough, and each index is compared with its own occurrence.
    """
    wanted = specs.meta_specs()
    keys = wanted.groupBy("type", "obj_ix", "key").agg(
        (F.max(F.coalesce("index", F.lit(-1))) + 1).alias("__n_specs"),
    )
    relevant = kv.join(keys.drop("__n_specs"), ["type", "obj_ix", "key"], "left_semi")
    counts = relevant.groupBy(*OBJECT, "key").agg(F.count(F.lit(1)).alias("__n_cards"))
    counted = counts.join(keys, ["type", "obj_ix", "key"])
    n_cards, n_specs = F.col("__n_cards"), F.col("__n_specs")
    miscounted = counted.filter(
        ((n_specs == 0) & (n_cards > 1)) | ((n_specs > 0) & (n_cards < n_specs))
    )
    count_failures = miscounted.select(
        *OBJECT,
        "key",
        F.concat(
            F.lit("metadata key appears "), n_cards.cast("string"),
            F.lit(" times in header; label expects "),
            F.greatest(n_specs, F.lit(1)).cast("string"),
        ).alias("message"),
    )

    indexed = card_index(relevant)
    spec = wanted.select(
        "type", "obj_ix", "key", F.coalesce("index", F.lit(0)).alias("ix"),
        F.struct(*_SPEC_FIELDS).alias("spec"),
    )
    compared = indexed.join(spec, ["type", "obj_ix", "key", "ix"]).join(
        miscounted.select(*OBJECT, "key"), [*OBJECT, "key"], "left_anti"
    )
    if coerce:
        read = coerce_meta(F.col("value"), F.col("spec.value_type"))
        unread = F.when(
            F.col("spec.value").isNotNull() & ~F.col("spec.value_regex"), read["problem"]
        )
        compared = compared.withColumns(
            {
                "__unread": unread,
                "value": F.when(F.col("spec.value_regex"), F.col("value")).otherwise(read["value"]),
                "value_type": F.when(F.col("spec.value_regex"), "str").otherwise(
                    F.col("spec.value_type")
                ),
            }
        )
        problem = F.coalesce(
            F.col("__unread"),
            meta_problem(F.col("value"), F.col("value_type"), F.col("spec"), specs.portable),
        )
    else:
        problem = meta_problem(
            F.col("value"), F.col("value_type"), F.col("spec"), specs.portable
        )
    value_failures = compared.select(*OBJECT, "key", problem.alias("message")).filter(
        F.col("message").isNotNull()
    )
    found = (
        _missing_keys(objects, counts, wanted)
        .unionByName(count_failures)
        .unionByName(value_failures)
    )
    return found.select(
        "path",
        F.col("obj_ix").cast("string").alias("object"),
        F.lit("metadata").alias("check"),
        "key",
        "message",
    )


def ambiguous_metadata(meta: DataFrame) -> DataFrame:
    """V5: spec keys given twice, or both with and without an index."""
    keys = ["dataset", "delivery_id", "type", "obj_ix", "key"]
    per_index = meta.groupBy(*keys, "index").agg(F.count(F.lit(1)).alias("n"))
    facts = per_index.groupBy(*keys).agg(
        F.max("n").alias("most"),
        F.bool_or(F.col("index").isNull()).alias("plain"),
        F.bool_or(F.col("index").isNotNull()).alias("indexed"),
    )
    problem = F.when(
        F.col("plain") & F.col("indexed"), "metadata key with no index and also with indices"
    ).when(F.col("most") > 1, "metadata key twice")
    return facts.withColumn("problem", problem).filter("problem is not null").select(
        *keys, "problem"
    )
