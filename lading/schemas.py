"""Fixed table layouts shared by all operators."""

from __future__ import annotations

FILES = "path string, length bigint, mtime timestamp"
COLUMNS = "path string, obj_ix int, col_ix int, name string, dtype string, ndim int"
OBJECTS = (
    "path string, obj_ix int, name string, objtype string, dtype string, "
    "ndim int, has_data boolean"
)
META_KV = (
    "path string, obj_ix int, pos int, key string, value string, value_type string"
)
# node_ix numbers the nodes of a file; COLUMNS of a table node carry it as obj_ix.
NODES = (
    "path string, node_ix int, node array<string>, objtype string, dtype string, ndim int, "
    "value string, value_type string"
)
PROBE_ERRORS = "path string, stage string, message string"
FAILURES = "path string, object string, check string, key string, message string"

# Column layout of the event log (fixed values).
EVENT_FIELDS = ("time", "category", "ref", "status", "message", "agent_id")
EVENT_REQUIRED = ("time", "category", "ref", "status", "agent_id")
EVENTS = ", ".join(f"{name} string" for name in EVENT_FIELDS)

SPEC_TYPES = (
    "dataset string, delivery_id string, type string, standard string, "
    "ignore boolean, skip array<string>, hook string, n_options int"
)
SPEC_PATTERNS = (
    "dataset string, delivery_id string, type string, pattern string, include boolean"
)
SPEC_OBJECTS = (
    "dataset string, delivery_id string, type string, obj_ix int, name string, "
    "name_path array<string>, name_regex boolean, objtype string, dtype string, "
    "ndim int, repeated boolean, optional boolean, value string, "
    "value_type string, value_regex boolean"
)
SPEC_COLUMNS = (
    "dataset string, delivery_id string, type string, obj_ix int, col_ix int, "
    "name string, name_regex boolean, dtype string, ndim int, repeated boolean"
)
SPEC_META = (
    "dataset string, delivery_id string, type string, obj_ix int, key string, "
    "value string, value_type string, value_regex boolean, objtype string, index int"
)
SPEC_CONTACTS = (
    "dataset string, delivery_id string, grp string, ix int, address string"
)
# One row per label: what it says for all its types.
SPEC_OPTIONS = (
    "dataset string, delivery_id string, global_skip array<string>, "
    "missing_filetypes_ok boolean, no_assigned_filetype_ok boolean"
)
# One row per property written in a label; `element` is the element's class,
# `form` that of the value: scalar, null, list or map.
SPEC_PROPS = (
    "dataset string, delivery_id string, lpath string, element string, "
    "property string, value string, form string"
)
