"""Named queries over the star-schema test tables, each with its oracle.

The tables are read as manifests, logs, schemas and key/values; see
`readings`.  Each module has QUERIES (name -> function of session and table
folder) and ORACLE (name -> SQL giving the same rows).
"""

from lading.queries import (
    checks,
    classification,
    eventlog,
    inference,
    linting,
    manifests,
    scalars,
    streams,
)

_MODULES = (
    classification, manifests, eventlog, inference, scalars, checks, linting, streams,
)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
