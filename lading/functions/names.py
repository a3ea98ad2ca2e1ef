"""Paths, names and file standards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lading.functions.regex import escape_regex

EXCLUDE_MARK = "(?!)"
STEM_PATTERN = r"(?s)^(.*?)([_\d]*\d)$"  # recognised suffix of repeated names
STEM_SUFFIX = r"((?:_|\d)*\d+)"


def basename(path: Column) -> Column:
    """Last path component."""
    return F.element_at(F.split(path, "/"), -1)


def resolve_path(root: str, key: Column) -> Column:
    """Absolute path of a key below `root`."""
    return F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace(key, r"^/+", ""))


def relative_path(root: str, path: Column) -> Column:
    """Path below `root`, whatever URI scheme prefix the reader put in front."""
    bare = "/" + root.split(":", 1)[-1].strip("/") + "/"
    at = F.instr(path, bare)
    return F.when(at > 0, F.substring(path, at + len(bare), 1 << 30)).otherwise(path)


def split_exclusion(pattern: Column) -> Column:
    """struct(pattern, include); a leading ``(?!)`` marks an exclusion."""
    marked = pattern.startswith(EXCLUDE_MARK)
    rest = F.substring(pattern, len(EXCLUDE_MARK) + 1, 1 << 30)
    return F.struct(
        F.when(marked, rest).otherwise(pattern).alias("pattern"),
        (~marked).alias("include"),
    )


def order_patterns(patterns: Column) -> Column:
    """O1: array<struct(pattern, include)> with inclusions first, then by text."""
    keyed = F.transform(
        patterns,
        lambda p: F.struct(
            (~p["include"]).alias("exclude"),
            p["pattern"].alias("pattern"),
            p["include"].alias("include"),
        ),
    )
    return F.transform(
        F.array_sort(keyed),
        lambda p: F.struct(p["pattern"].alias("pattern"), p["include"].alias("include")),
    )


def infer_standard(path: Column) -> Column:
    """File standard from the suffixes of the base name.

    Any of the suffixes decides (so ``x.fits.gz`` is fits); otherwise the last
    suffix names the standard and a name without suffix is ``unknown``.
    """
    name = F.lower(basename(path))
    # leading dots belong to the stem of a hidden file, not to a suffix
    parts = F.split(F.regexp_replace(name, r"^\.+", ""), r"\.")
    suffixes = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))

    def has(*wanted: str) -> Column:
        return F.arrays_overlap(suffixes, F.array(*[F.lit(w) for w in wanted]))

    return (
        F.when(F.size(suffixes) < 1, F.lit("unknown"))
        .when(has("fit", "fits"), F.lit("fits"))
        .when(has("pqt", "parquet"), F.lit("parquet"))
        .when(has("asdf"), F.lit("asdf"))
        .otherwise(F.element_at(parts, -1))
    )


def split_stem(name: Column) -> Column:
    """struct(stem, suffix); NULL when the name has no numeric suffix."""
    stem = F.regexp_extract(name, STEM_PATTERN, 1)
    suffix = F.regexp_extract(name, STEM_PATTERN, 2)
    return F.when(
        suffix != "", F.struct(stem.alias("stem"), suffix.alias("suffix"))
    )


def stem_of(name: Column) -> Column:
    """Stem of a name with a numeric suffix, NULL for other names."""
    return F.when(
        name.rlike(r"\d$"), F.regexp_extract(name, STEM_PATTERN, 1)
    )


def generalise_repeated(stem: Column) -> Column:
    """Regex for every name made of `stem` and a numeric suffix."""
    return F.concat(escape_regex(stem), F.lit(STEM_SUFFIX))
