"""lading: delivery-conformance operators for PySpark.

A delivery is a set of tables (files, columns, objects, key/values, events);
every operator takes DataFrames or Columns and returns DataFrames or Columns.
"""

from lading.spec import Specs, load_specs, write_specs

__all__ = ["Specs", "load_specs", "write_specs"]
