"""Specifications (labels) as tables.

A label is a small document; it is the one thing read on the driver.  `Specs`
holds it as SPEC_* tables, keyed by (dataset, delivery_id), and keeps the
file-name patterns at hand so that classification needs no join.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from lading import schemas
from lading.functions.names import EXCLUDE_MARK
from lading.functions.regex import anchored_java, java_pattern, regex_portable

DATA_STANDARDS = ("asdf", "fits", "parquet")  # standards with data-level checks

TABLES = {
    "types": schemas.SPEC_TYPES,
    "patterns": schemas.SPEC_PATTERNS,
    "objects": schemas.SPEC_OBJECTS,
    "columns": schemas.SPEC_COLUMNS,
    "meta": schemas.SPEC_META,
    "contacts": schemas.SPEC_CONTACTS,
    "props": schemas.SPEC_PROPS,
    "options": schemas.SPEC_OPTIONS,
}


@dataclass(frozen=True)
class Specs:
    """SPEC_* tables of one or many labels."""

    types: DataFrame
    patterns: DataFrame
    objects: DataFrame
    columns: DataFrame
    meta: DataFrame
    contacts: DataFrame
    props: DataFrame
    options: DataFrame
    single: bool = True  # of one label: its types are known by their names alone
    portable: bool = True  # every name/value regex runs in the JVM
    known_patterns: dict[str, list[tuple[str, bool]]] | None = field(default=None)
    known_regexes: frozenset[str] | None = None  # every name and value regex

    @classmethod
    def from_labels(cls, spark: SparkSession, labels: Iterable[Mapping]) -> Specs:
        rows: dict[str, list[tuple]] = {name: [] for name in TABLES}
        labels = list(labels)
        for label in labels:
            _label_rows(label, rows)
        frames = {name: local_table(spark, rows[name], TABLES[name]) for name in TABLES}
        known: dict[str, list[tuple[str, bool]]] = {row[2]: [] for row in rows["types"]}
        for *_, type_, pattern, include in rows["patterns"]:
            known[type_].append((pattern, include))
        return cls(
            **frames,
            single=len({row[:2] for row in rows["options"]}) < 2,
            portable=all(regex_portable(p) is not None for p in _regexes(rows)),
            known_patterns=known,
            known_regexes=frozenset(_regexes(rows)),
        )

    @cached_property
    def patterns_by_type(self) -> dict[str, list[tuple[str, bool]]]:
        """type -> [(pattern, include)]: inclusions first, then by text (O1)."""
        known = self.known_patterns
        if known is None:
            known = {r.type: [] for r in self.types.select("type").collect()}
            for r in self.patterns.select("type", "pattern", "include").collect():
                known.setdefault(r.type, []).append((r.pattern, r.include))
        return {
            type_: sorted(patterns, key=lambda p: (not p[1], p[0]))
            for type_, patterns in sorted(known.items())
        }

    def qualified(self) -> Specs:
        """The same with type names that no other label has: see `qualified_type`."""
        named = {
            name: frame.withColumn("type", qualified_type())
            for name in ("types", "patterns", "objects", "columns", "meta")
            for frame in (getattr(self, name),)
        }
        return replace(self, **named, known_patterns=None)

    def column_specs(self) -> DataFrame:
        """Column specs with the JVM form of their name pattern."""
        return self.columns.withColumn("java_name", self._java("name_regex", "name", "fullmatch"))

    def object_specs(self) -> DataFrame:
        return self.objects.withColumns(
            {
                "java_name": self._java("name_regex", "name", "fullmatch"),
                "java_value": self._java("value_regex", "value", "match"),
            }
        )

    def meta_specs(self) -> DataFrame:
        return self.meta.withColumn("java_value", self._java("value_regex", "value", "match"))

    def _java(self, flag: str, text: str, mode: str) -> Column:
        """Translated on the driver when the patterns are known there."""
        pattern = F.when(F.col(flag), F.col(text))
        if self.known_regexes is None:
            return java_pattern(pattern, mode)
        pairs = {p: anchored_java(p, mode) for p in sorted(self.known_regexes)}
        known = [F.lit(t) for kv in pairs.items() if kv[1] is not None for t in kv]
        if not known:
            return F.lit(None).cast("string")
        return F.when(F.col(flag), F.create_map(*known)[F.col(text)])

    def with_objects(
        self, objects: DataFrame, columns: DataFrame, regexes: frozenset[str] | None = None
    ) -> Specs:
        known = None
        if regexes is not None and self.known_regexes is not None:
            known = regexes | self.known_regexes  # values and metadata keep theirs
        return replace(self, objects=objects, columns=columns, known_regexes=known)


def qualified_type() -> Column:
    """A type's name with those of its label; NULL without a type."""
    return F.when(F.col("type").isNotNull(), F.to_json(F.array("dataset", "delivery_id", "type")))


def local_table(spark: SparkSession, rows: list[tuple], layout: str) -> DataFrame:
    """Rows held by the driver as a relation whose size the planner knows.

    An Arrow table becomes a LocalRelation, so joins with it are broadcast
    exactly when it is below spark.sql.autoBroadcastJoinThreshold.
    """
    schema = StructType.fromDDL(layout)
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    table = pa.Table.from_arrays(
        [pa.array(c, type=to_arrow_type(f.dataType)) for c, f in zip(columns, schema)],
        names=schema.names,
    )
    return spark.createDataFrame(table, schema)


def _regexes(rows: dict[str, list[tuple]]) -> list[str]:
    patterns = [r[5] for r in rows["columns"] if r[6]]
    for r in rows["objects"]:
        if r[6]:
            patterns += r[5] or [r[4]]
        if r[14]:
            patterns.append(r[12])
    patterns += [r[5] for r in rows["meta"] if r[7]]
    return [p for p in patterns if p]


def _scalar(owner: Mapping) -> tuple[str | None, str | None]:
    """(text, type) of a label value; an explicit null differs from no value."""
    if "value" not in owner:
        return None, None
    value = owner["value"]
    if value is None:
        return None, "null"
    if isinstance(value, bool):
        return str(value).lower(), "bool"
    if isinstance(value, (int, float)):
        return repr(value), type(value).__name__
    if isinstance(value, (list, dict)):
        return json.dumps(value), type(value).__name__
    return str(value), "str"


def split_marker(pattern: str | Mapping) -> tuple[str, bool]:
    """P4 for a label entry: text (maybe with the marker) or {pattern, include}."""
    if isinstance(pattern, Mapping):
        return pattern["pattern"], pattern.get("include", True)
    return pattern.removeprefix(EXCLUDE_MARK), not pattern.startswith(EXCLUDE_MARK)


def _label_rows(label: Mapping, rows: dict[str, list[tuple]]) -> None:
    key = (str(label["dataset"]), str(label["delivery_id"]))
    whole = label.get("delivery_meta", {}).get("global_validation_options", {})
    flags = ("missing_filetypes_ok", "no_assigned_filetype_ok")
    rows["options"].append((*key, list(whole.get("skip", ())), *(bool(whole.get(f)) for f in flags)))
    for group, addresses in label.get("contacts", {}).items():
        rows["contacts"] += [(*key, group, i, a) for i, a in enumerate(addresses)]
    for type_, ft in label.get("filetypes", {}).items():
        options = ft.get("validation_options", {})
        rows["types"].append(
            (
                *key,
                type_,
                ft.get("standard", "unspecified").lower(),
                ft.get("ignore", False),
                list(options.get("skip", ())),
                options.get("object_check_hook"),
                len(options),
            )
        )
        patterns = ft.get("filename", [])
        for entry in [patterns] if isinstance(patterns, str) else patterns:
            pattern, include = split_marker(entry)
            re.compile(pattern)  # a bad pattern fails here, not on executors
            rows["patterns"].append((*key, type_, pattern, include))
        for ix, obj in enumerate(ft.get("objects", ())):
            _object_rows((*key, type_, ix), obj, ft.get("standard", ""), rows)
    for row in _property_rows(label):
        rows["props"].append((*key, *row))


def _object_rows(
    key: tuple, obj: Mapping, standard: str, rows: dict[str, list[tuple]]
) -> None:
    name = obj.get("name")
    path = [str(n) for n in name] if isinstance(name, list) else None
    repeated = obj.get("repeated", False)
    value, value_type = _scalar(obj)
    objtype = obj.get("objtype")
    if objtype is None and standard.lower() == "parquet":
        objtype = "table"
    rows["objects"].append(
        (
            *key,
            "/".join(path) if path else (None if name is None else str(name)),
            path,
            obj.get("name_regex", False) or repeated,
            objtype.lower() if objtype else None,
            obj.get("dtype"),
            obj.get("ndim"),
            repeated,
            obj.get("optional", False),
            value,
            value_type,
            obj.get("value_regex", False),
        )
    )
    for ix, column in enumerate(obj.get("schema", ())):
        column_repeats = column.get("repeated", False)
        rows["columns"].append(
            (
                *key,
                ix,
                column.get("name"),
                column.get("name_regex", False) or column_repeats,  # L3
                column.get("dtype"),
                column.get("ndim", 0),
                column_repeats,
            )
        )
    for meta_key, meta in obj.get("metadata", {}).items():
        value, value_type = _scalar(meta)
        rows["meta"].append(
            (
                *key,
                # header keywords ignore case, so variants address one keyword
                meta_key.strip().upper() if standard.lower() == "fits" else meta_key,
                value,
                value_type,
                meta.get("value_regex", False),
                meta.get("objtype"),
                meta.get("index"),
            )
        )


# Elements of a label and where their children live (fixed values).
_CHILDREN = {
    "label": {"time": "time", "contacts": "contacts", "delivery_meta": "delivery_meta"},
    "delivery_meta": {"global_validation_options": "global_options"},
    "filetype": {"validation_options": "options"},
}
_COLLECTIONS = {
    "label": {"filetypes": "filetype"},
    "filetype": {"objects": "object"},
    "object": {"schema": "column", "metadata": "metadata"},
}


def _property_rows(element: Mapping, kind: str = "label", lpath: str = ""):
    """(lpath, element, property, scalar text, form) of every property of a label."""
    for name, value in element.items():
        scalar = isinstance(value, (str, int, float, bool))
        text = str(value).lower() if isinstance(value, bool) else str(value)
        form = "scalar" if scalar else "null" if value is None else "map" if isinstance(value, Mapping) else "list"
        yield lpath or "/", kind, name, text if scalar else None, form
        here = f"{lpath}/{name}"
        if name in _CHILDREN.get(kind, {}) and isinstance(value, Mapping):
            yield from _property_rows(value, _CHILDREN[kind][name], here)
        elif name in _COLLECTIONS.get(kind, {}):
            child = _COLLECTIONS[kind][name]
            items = value.items() if isinstance(value, Mapping) else () if scalar else enumerate(value or ())
            for key, item in items:
                if not isinstance(item, Mapping):
                    continue  # its form is told at the property itself
                yield from _property_rows(item, child, f"{here}/{key}")


def load_specs(spark: SparkSession, source: Mapping | str | list) -> Specs:
    """Specs from a label (dict), several labels, or a folder of tables."""
    if isinstance(source, Mapping):
        return Specs.from_labels(spark, [source])
    if isinstance(source, list):
        return Specs.from_labels(spark, source)
    if source.endswith(".json"):
        text = spark.read.text(source, wholetext=True).first()[0]
        document = json.loads(text)
        return load_specs(spark, document)
    tables = {
        name: spark.read.schema(layout).json(f"{source}/{name}")
        for name, layout in TABLES.items()
    }
    flags = spark.read.schema("single boolean, portable boolean").json(f"{source}/flags").first()
    return Specs(**tables, single=flags.single, portable=flags.portable)


def write_specs(specs: Specs, path: str) -> None:
    """Write (populated) specs as a folder of JSON tables."""
    for name in TABLES:
        getattr(specs, name).write.mode("overwrite").json(f"{path}/{name}")
    flags = specs.types.sparkSession.createDataFrame([(specs.single, specs.portable)], "single boolean, portable boolean")
    flags.write.mode("overwrite").json(f"{path}/flags")
