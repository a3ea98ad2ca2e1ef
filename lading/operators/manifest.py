"""Manifest (file index) operators: joins of paths with listings and specs.

All inputs here hold one row per path, except reports, which are first
reduced to one row per path; no join therefore sees a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lading.functions.names import basename
from lading.operators import classify as c
from lading.spec import Specs


def select_queued(index: DataFrame, keys: DataFrame) -> DataFrame:
    """Manifest rows whose path is among `keys`."""
    return index.join(keys.select("path").distinct(), "path", "left_semi")


def unexpected_files(transfers: DataFrame, index: DataFrame) -> DataFrame:
    """Transferred refs outside the manifest, with their number of reports."""
    per_ref = transfers.groupBy("ref").agg(F.count(F.lit(1)).alias("n_reports"))
    return per_ref.join(index.select(F.col("path").alias("ref")), "ref", "left_anti")


def missing_targets(index: DataFrame, listing: DataFrame) -> DataFrame:
    """Manifest paths that do not exist."""
    return index.join(listing.select("path"), "path", "left_anti")


def check_presence_checksum(index: DataFrame, listing: DataFrame) -> DataFrame:
    """`path, status, message`; a NULL or blank expected checksum is not checked."""
    expected = F.nullif(F.col("checksum"), F.lit(""))
    found = listing.select(
        "path", F.col("checksum").alias("__found"), F.lit(True).alias("__present")
    )
    message = F.when(F.col("__present").isNull(), "file not found").when(
        expected.isNotNull() & ~expected.eqNullSafe(F.col("__found")),
        F.concat(
            F.lit("incorrect crc32 checksum: expected "),
            expected,
            F.lit(", got "),
            F.coalesce("__found", F.lit("none")),
        ),
    )
    return (
        index.join(found, "path", "left")
        .withColumn("message", message)
        .withColumn("status", F.when(F.col("message").isNull(), "ok").otherwise("failure"))
        .drop("__found", "__present")
    )


def resume_plan(index: DataFrame, verdicts: DataFrame, listing: DataFrame) -> DataFrame:
    """What to do with each manifest row when a delivery is taken up again.

    `verdicts` is `last_verdict(events)`.  A file last found ok and present is
    valid; all others are sent (again).  Refs outside the manifest drop out.
    """
    last = verdicts.select(F.col("ref").alias("path"), F.col("status").alias("__last"))
    present = listing.select("path", F.lit(True).alias("__present"))
    ok, there = F.col("__last") == "ok", F.col("__present").isNotNull()
    reason = (
        F.when(F.col("__last").isNull(), "new")
        .when(ok & there, "valid")
        .when(ok, "missing")
        .otherwise("invalid")
    )
    return (
        index.join(last, "path", "left")
        .join(present, "path", "left")
        .withColumn("reason", reason)
        .withColumn("will_transfer", F.col("reason") != "valid")
        .drop("__last", "__present")
    )


def nothing_to_do(plan: DataFrame) -> DataFrame:
    """One row; is every file already valid?"""
    return plan.agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(F.col("reason") == "valid").alias("n_valid"),
        F.count_if(F.col("reason") == "invalid").alias("n_invalid"),
        F.count_if(F.col("reason") == "missing").alias("n_missing"),
        F.bool_and(F.col("reason") == "valid").alias("all_valid"),
    )


def next_files(states: DataFrame, n: int, position: str = "pos") -> DataFrame:
    """O3: the first `n` files that may be transferred, in manifest order."""
    return states.filter(can_transfer()).orderBy(position).limit(n)


def can_transfer() -> Column:
    """Ready, or failed with retries left."""
    return (F.col("state") == "ready") | (
        (F.col("state") == "failed") & (F.col("retries") < F.col("max_retries"))
    )


def no_retry() -> Column:
    """Failed for good."""
    return (F.col("state") == "failed") & (F.col("retries") >= F.col("max_retries"))


def is_complete() -> Column:
    """Nothing left to do."""
    return F.col("state").isin("valid", "invalid") | no_retry()


def queue_conflicts(
    requested: DataFrame, index: DataFrame, queued: DataFrame
) -> DataFrame:
    """`path, problem` for keys that may not be queued.

    Duplicates, keys outside the manifest, keys already queued and keys whose
    manifest status is not `waiting`.
    """
    keys = requested.groupBy("path").agg(F.count(F.lit(1)).alias("__n"))
    known = index.select("path", F.col("status").alias("__status"))
    busy = queued.select("path", F.lit(True).alias("__queued")).distinct()
    joined = keys.join(known, "path", "left").join(busy, "path", "left")
    problems = F.array(
        F.when(F.col("__n") > 1, F.lit("duplicate")),
        F.when(F.col("__status").isNull(), F.lit("not indexed")),
        F.when(F.col("__status") != "waiting", F.lit("already validated")),
        F.when(F.col("__queued").isNotNull(), F.lit("already queued")),
    )
    return joined.select(
        "path", F.explode(F.filter(problems, lambda p: p.isNotNull())).alias("problem")
    )


def check_index_header(columns: list[str]) -> list[str]:
    """S3: what is wrong with the header of a manifest CSV."""
    problems = []
    if not columns or columns[0] != "path":
        problems.append("first column must be 'path'")
    if "will_transfer" not in columns:
        problems.append("a 'will_transfer' column is required")
    if len(columns) > 3:
        problems.append("at most three columns are allowed")
    if len(columns) == 3 and "checksum" not in columns:
        problems.append("the third column, if any, must be 'checksum'")
    return problems


def check_manifest(
    index: DataFrame, specs: Specs, match: str = "basename"
) -> tuple[DataFrame, DataFrame]:
    """V9: (prepared index, problems) of a whole manifest.

    The index gets `filename`, `type`, `status` and `n_fail`; problems are
    `problem, subject` rows, empty when the manifest can be accepted.  With
    several labels, index and problems have `dataset` and `delivery_id` too.
    """
    classified = c.classify(index.withColumn("filename", basename(F.col("path"))), specs, match)
    keys = c.label_keys(classified, specs)

    def told(rows: DataFrame, problem: str, subject: str) -> DataFrame:
        return rows.select(*keys, F.lit(problem).alias("problem"), F.col(subject).alias("subject"))

    def unless(rows: DataFrame, flag: str) -> DataFrame:
        allowing = specs.options.filter(F.col(flag))
        if keys:
            return rows.join(allowing.select(keys), keys, "left_anti")
        return rows if allowing.isEmpty() else rows.limit(0)  # one row, held by the driver

    unassigned = unless(c.unassigned_files(classified), "no_assigned_filetype_ok")
    missing = unless(c.missing_types(classified, specs), "missing_filetypes_ok")
    problems = (
        told(c.ambiguous_files(classified), "ambiguous filetype", "path")
        .unionByName(told(unassigned, "no filetype", "path"))
        .unionByName(told(missing, "filetype without files", "type"))
    )
    prepared = c.init_status(classified).drop("types", "assignment")
    return prepared, problems
