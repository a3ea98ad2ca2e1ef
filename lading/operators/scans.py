"""Ordered running aggregates that survive hot keys.

``sum() over (partition by key order by t)`` sends all rows of a key to one
task.  Here each key's rows are first cut into buckets by a function of the
order (an hour of the log, 4096 positions of a schema, ...):

1. partial totals per (key, bucket), combined before the shuffle;
2. a running total over the few buckets of each key;
3. a window inside each (key, bucket), to which 2 is added.

The rows are shuffled once, by (key, bucket), so a key that owns a third of
the log is spread over as many tasks as it has buckets.  Running aggregates
and runs take steps 1 and 2 only for the keys that lie in several buckets,
and store what those carry on, whose size then decides how it is joined.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lading.materialise import stored

_BUCKET = "__bucket"
_FIRST = -(1 << 62)  # bucket of rows whose order value is unknown

# kind -> (partial total, combine totals, add carried total to a local one)
_KINDS = {
    "sum": (F.sum, F.sum, lambda c, v: F.coalesce(c, F.lit(0)) + F.coalesce(v, F.lit(0))),
    "max": (F.max, F.max, lambda c, v: F.greatest(c, v)),
    "min": (F.min, F.min, lambda c, v: F.least(c, v)),
}


def time_bucket(ts: Column, seconds: int = 3600) -> Column:
    """Bucket of a timestamp; choose `seconds` so a bucket fits one task."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(seconds * 1_000_000))


def position_bucket(position: Column, width: int = 4096) -> Column:
    """Bucket of a dense ordinal."""
    return F.floor(position / F.lit(width)).cast("bigint")


def _with_bucket(df: DataFrame, bucket: Column) -> DataFrame:
    return df.withColumn(_BUCKET, F.coalesce(bucket.cast("bigint"), F.lit(_FIRST)))


def _carry(totals: DataFrame, keys: Sequence[str], columns: Mapping[str, Column]):
    renamed = [F.col(k).alias(f"__carry_{k}") for k in keys]
    return totals.select(*renamed, F.col(_BUCKET).alias("__carry_bucket"), *[
        c.alias(name) for name, c in columns.items()
    ])


def _spread(rows: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """Rows of the keys that lie in several buckets; None if there are none."""
    low, high = rows.agg(F.min(_BUCKET), F.max(_BUCKET)).first()
    if low == high:
        return None
    if not keys:
        return rows
    several = (
        rows.groupBy(*[F.col(k).alias(f"__several_{k}") for k in keys])
        .agg((F.min(_BUCKET) < F.max(_BUCKET)).alias("__several"))
        .filter("__several")
        .drop("__several")
    )
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"__several_{key}"))
    return rows.join(stored(several), condition, "left_semi")


def _kept(carry: DataFrame, spread: DataFrame | None) -> DataFrame:
    """What is carried on, stored; no rows if no key lies in several buckets."""
    if spread is None:
        return carry.filter(F.lit(False))
    return stored(carry)


def _join_carry(rows: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    condition = F.col(_BUCKET) == F.col("__carry_bucket")
    for key in reversed(keys):
        condition = F.col(key).eqNullSafe(F.col(f"__carry_{key}")) & condition
    return rows.join(carry, condition, "left").drop(
        "__carry_bucket", *[f"__carry_{k}" for k in keys]
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    measures: Mapping[str, tuple[str, Column]],
) -> DataFrame:
    """Add inclusive running ``sum``/``max``/``min`` columns.

    `measures` maps a new column to (kind, value); `bucket` must not decrease
    along `order`.
    """
    rows = _with_bucket(df, bucket).withColumns(
        {f"__in_{name}": value for name, (_, value) in measures.items()}
    )
    earlier = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(
        Window.unboundedPreceding, -1
    )
    spread = _spread(rows, keys)
    totals = (rows if spread is None else spread).groupBy(*keys, _BUCKET).agg(
        *[
            _KINDS[kind][0](f"__in_{name}").alias(f"__total_{name}")
            for name, (kind, _) in measures.items()
        ]
    )
    carry = _carry(
        totals,
        keys,
        {
            f"__carry_of_{name}": _KINDS[kind][1](f"__total_{name}").over(earlier)
            for name, (kind, _) in measures.items()
        },
    )
    carry = _kept(carry, spread)
    so_far = Window.partitionBy(*keys, _BUCKET).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = rows.withColumns(
        {
            f"__in_{name}": _KINDS[kind][0](f"__in_{name}").over(so_far)
            for name, (kind, _) in measures.items()
        }
    )
    joined = _join_carry(local, carry, keys)
    out = joined.withColumns(
        {
            name: _KINDS[kind][2](F.col(f"__carry_of_{name}"), F.col(f"__in_{name}"))
            for name, (kind, _) in measures.items()
        }
    )
    return out.drop(
        _BUCKET,
        *[f"__in_{name}" for name in measures],
        *[f"__carry_of_{name}" for name in measures],
    )


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    value: Column,
    name: str,
    forward: bool = False,
) -> DataFrame:
    """Add the previous (or next) row's `value` under `name` (lag/lead by one)."""
    sortable = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    rows = _with_bucket(df, bucket).withColumn("__value", value)
    edge = F.min_by if forward else F.max_by
    totals = rows.groupBy(*keys, _BUCKET).agg(
        edge(F.struct("__value"), sortable).alias("__edge")
    )
    by_bucket = Window.partitionBy(*keys).orderBy(_BUCKET)
    shift = F.lead if forward else F.lag
    carry = _carry(totals, keys, {"__beyond": shift("__edge").over(by_bucket)})
    inside = Window.partitionBy(*keys, _BUCKET).orderBy(*order)
    local = rows.withColumn("__near", shift(F.struct("__value")).over(inside))
    joined = _join_carry(local, carry, keys)
    return joined.withColumn(
        name, F.coalesce(F.col("__near"), F.col("__beyond"))["__value"]
    ).drop(_BUCKET, "__value", "__near", "__beyond")


def change_runs(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    value: Column,
    changed: Callable[[Column, Column], Column],
    name: str,
) -> DataFrame:
    """Number the runs of each key from 1 under `name`.

    A row opens a run when it is the first of its key or when
    `changed(value before, value)` holds.  A bucket is summed up by its first
    and last value and the runs opened inside it.
    """
    rows = _with_bucket(df, bucket).withColumn("__value", F.struct(value.alias("v")))
    inside = Window.partitionBy(*keys, _BUCKET).orderBy(*order)
    def opens(before: Column, here: Column) -> Column:
        fresh = F.coalesce(changed(before["v"], here["v"]), F.lit(False))
        return F.when(fresh, 1).otherwise(0)

    def marked(some: DataFrame) -> DataFrame:
        return some.withColumn("__near", F.lag("__value").over(inside)).withColumn(
            "__opened",
            F.when(F.col("__near").isNotNull(), opens(F.col("__near"), F.col("__value"))),
        )

    sortable = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    spread = _spread(rows, keys)
    totals = marked(rows if spread is None else spread).groupBy(*keys, _BUCKET).agg(
        F.min_by("__value", sortable).alias("__first"),
        F.max_by("__value", sortable).alias("__last"),
        F.coalesce(F.sum("__opened"), F.lit(0)).alias("__inner"),
    )
    by_bucket = Window.partitionBy(*keys).orderBy(_BUCKET)
    entered = totals.withColumn("__before", F.lag("__last").over(by_bucket)).withColumn(
        "__entry",
        F.when(F.col("__before").isNull(), 1).otherwise(
            opens(F.col("__before"), F.col("__first"))
        ),
    )
    earlier = by_bucket.rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.sum(F.col("__entry") + F.col("__inner")).over(earlier), F.lit(0))
    carry = _kept(_carry(entered, keys, {"__base": gone + F.col("__entry")}), spread)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = marked(rows).withColumn("__so_far", F.sum(F.coalesce("__opened", F.lit(0))).over(so_far))
    return (
        _join_carry(local, carry, keys)
        .withColumn(name, F.coalesce("__base", F.lit(1)) + F.col("__so_far"))
        .drop(_BUCKET, "__value", "__near", "__opened", "__so_far", "__base")
    )
