"""User-defined checks that run after the standard ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from importlib import import_module
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lading import schemas
from lading.sources.files import spread
from lading.sources.probes import _open

_FIELDS = ["path", "object", "check", "key", "message"]

# A hook gets an open file and its type's options and returns {key: message}.
FileHook = Callable[[Any, Mapping], Mapping]
# A set hook gets all files of the type at once and returns FAILURES.
SetHook = Callable[[DataFrame], DataFrame]


def load_hook(name: str) -> FileHook:
    """`check_file` of a module; a missing module or function is an error."""
    checker = getattr(import_module(name), "check_file", None)
    if not callable(checker):
        raise TypeError(f"{name!r} must define a callable check_file(data, spec)")
    return checker


def run_file_hooks(
    files: DataFrame, root: str, hooks: Mapping[str, FileHook] | None = None
) -> DataFrame:
    """FAILURES with check ``hook:<name>`` for files whose type has a hook.

    `files` has path, type, standard, hook and skips (see `type_lookup`).
    Hooks are taken from `hooks` or imported by module name on executors.
    """
    known = dict(hooks or {})
    chosen = files.filter(
        F.col("hook").isNotNull()
        & ~F.array_contains("skips", "hook")
        & ~F.array_contains("skips", "all")
    ).select("path", "type", "standard", "hook")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, type_, standard, hook in batch.itertuples(index=False):
                try:
                    checker = known.get(hook) or load_hook(hook)
                    spec = {"type": type_, "standard": standard, "hook": hook}
                    if standard == "parquet":
                        with _open(root, path) as data:
                            found = dict(checker(data, spec) or {})
                    else:
                        found = dict(checker(f"{root}/{path}", spec) or {})
                except Exception as problem:
                    found = {"error": f"{type(problem).__name__}: {problem}"}
                rows = [(path, "", f"hook:{hook}", str(k), str(v)) for k, v in found.items()]
                if rows:
                    yield pd.DataFrame(rows, columns=_FIELDS, dtype=object)

    return spread(chosen, "path").mapInPandas(run, schemas.FAILURES)


def run_set_hooks(files: DataFrame, hooks: Mapping[str, SetHook]) -> DataFrame | None:
    """X1 for hooks that are Spark jobs themselves: one call per hook name."""
    out = None
    for name, hook in hooks.items():
        found = hook(files.filter(F.col("hook") == name)).withColumn(
            "check", F.lit(f"hook:{name}")
        )
        out = found if out is None else out.unionByName(found)
    return out


def merge_failures(standard: DataFrame, hooked: DataFrame) -> DataFrame:
    """U4: standard and hook failures; hook rows may only use ``hook:`` checks."""
    collision = F.raise_error(F.concat(F.lit("failure namespace collision: "), F.col("check")))
    own = F.coalesce(F.col("check").startswith("hook:"), F.lit(False))
    # a filter, as a column nobody reads would be pruned with its check
    guarded = hooked.filter(F.when(own, True).otherwise(collision.cast("boolean")))
    return standard.unionByName(guarded.select(*standard.columns))
