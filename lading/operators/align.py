"""Line up actual ordered items (columns, HDUs) with the slots of a spec."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lading.materialise import stored

OBJECT = ("path", "type", "obj_ix")


WIDTH = 2048  # items of one object walked in one go


def spec_runs(
    items: DataFrame,
    slots: DataFrame,
    portable: bool = True,
    strict: bool = False,
    width: int = WIDTH,
) -> DataFrame:
    """Add `slot`, the spec slot each item consumes.

    `items` has path, type, obj_ix, pos (from 0, without gaps) and name;
    `slots` has type, obj_ix, slot, name, java_name and repeated.  Without
    repeated slots an item's slot is its position.  A repeated slot takes the
    item it meets and all that follow as long as their names match it;
    `strict` also wants the first to.

    The walk is greedy, hence sequential, but its state is just a slot number.
    So an object's items are cut into runs of `width`; each full run is
    reduced to a small table from the state before it to the state after it,
    these tables are chained per object, and every run is then walked on its
    own from its known start.  Only objects of several runs have tables.  The
    items of a run stream past in order; none are gathered.
    """
    items = stored(items)
    repeats = (
        slots.groupBy("type", "obj_ix")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.when(
                        F.col("repeated"),
                        F.struct("slot", F.col("name").alias("pattern"), "java_name"),
                    )
                )
            ).alias("__repeated"),
            F.count(F.lit(1)).cast("int").alias("__n_slots"),
        )
        .filter(F.size("__repeated") > 0)
    )
    repeats = stored(repeats)
    keyed = items.join(repeats, ["type", "obj_ix"], "left")
    plain = keyed.filter(F.col("__repeated").isNull()).withColumn("slot", F.col("pos"))
    run = F.floor(F.col("pos") / F.lit(width)).cast("int")
    fields = [c for c in items.columns if c not in OBJECT and c != "pos"]
    walkable = keyed.filter(F.col("__repeated").isNotNull()).withColumn("__run", run)
    longer = stored(walkable.filter(run > 0).select(*OBJECT).distinct())
    if longer.isEmpty():
        started = walkable.withColumn("__start", F.lit(_BEGIN))
    else:
        long_runs = _runs(walkable.join(longer, list(OBJECT), "left_semi"), portable)
        starts = stored(_run_starts(long_runs, strict, width))
        started = walkable.join(starts, [*OBJECT, "__run"], "left")
    run_key = [*OBJECT, "__run"]
    ordered = (
        started.withColumn("__hits", _hits(F.col("name"), F.col("__repeated"), portable))
        .select(*items.columns, "__run", "__hits", F.coalesce("__start", F.lit(_BEGIN)).alias("__start"))
        .repartition(*run_key)
        .sortWithinPartitions(*run_key, "pos", "__hits", *fields)
    )
    walked = ordered.mapInArrow(
        _walker(run_key, strict), StructType([*ordered.schema.fields, StructField("slot", IntegerType())])
    )
    return plain.drop("__repeated", "__n_slots").unionByName(
        walked.select(*items.columns, "slot")
    )


def _runs(walkable: DataFrame, portable: bool) -> DataFrame:
    """`__items` of each run in order: position and repeated slots hit."""
    hits = _hits(F.col("name"), F.col("__repeated"), portable)
    return (
        walkable.withColumn("__hits", hits)
        .groupBy(*OBJECT, "__run", "__n_slots")
        .agg(
            F.sort_array(F.collect_list(F.struct("pos", "__hits"))).alias("__items")
        )
    )


# State of a walk: twice the slot, plus one if the last item matched it.
_BEGIN = -1


def _step(code: Column, hits: Column, strict: bool) -> Column:
    slot = F.shiftright(code, 1)
    hit = F.array_contains(hits, slot)
    stays = (hit & (code.bitwiseAND(1) == 1)) if strict else hit
    after = F.when(stays, slot).otherwise(slot + 1)
    return after * 2 + F.when(F.array_contains(hits, after), 1).otherwise(0)


def _walker(run_key: list[str], strict: bool):
    """`slot` of rows that come run by run, each run in order; the same steps as `_step`."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, slot, inside = None, 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            hits = batch.column("__hits")
            ends, found = hits.offsets.to_numpy(), hits.values.to_numpy()
            opens = np.zeros(batch.num_rows, bool)
            for k in run_key:
                key, none = batch.column(k), batch.column(k).is_null().to_numpy(zero_copy_only=False)
                other = pc.not_equal(key[1:], key[:-1]).fill_null(False)
                opens[1:] |= other.to_numpy(zero_copy_only=False) | (none[1:] != none[:-1])
            opens[0] = [batch.column(k)[0].as_py() for k in run_key] != last
            last = [batch.column(k)[-1].as_py() for k in run_key]
            slots = []
            rows = zip(opens.tolist(), batch.column("__start").to_numpy().tolist(), ends[:-1].tolist(), ends[1:].tolist())
            found = found.tolist()
            for fresh, start, low, high in rows:
                if fresh:
                    slot, inside = start >> 1, bool(start & 1)
                hit = found[low:high]
                if not (slot in hit and (inside or not strict)):
                    slot += 1
                inside = slot in hit
                slots.append(slot)
            columns = [*batch.columns, pa.array(slots, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "slot"])

    return walk


def _run_starts(runs: DataFrame, strict: bool, width: int) -> DataFrame:
    """`__start`, the state before each run but the first of an object.

    Beyond the last slot a state only counts on, so the table of a run needs
    entries up to there.
    """
    full = runs.filter(F.size("__items") == width)
    ends = F.transform(
        F.sequence(F.lit(-2), 2 * F.col("__n_slots") + 1),
        lambda code: F.aggregate(
            "__items", code, lambda state, item: _step(state, item["__hits"], strict)
        ),
    )
    chained = full.select(*OBJECT, "__run", ends.alias("__ends")).groupBy(*OBJECT).agg(
        F.array_sort(F.collect_list(F.struct("__run", "__ends"))).alias("__tables")
    )

    def chain(state: Column, table: Column) -> Column:
        known = F.get(table["__ends"], state["code"] + 2)
        code = F.coalesce(known, state["code"] + F.lit(2 * width))
        return F.struct(code.alias("code"), F.array_append(state["starts"], code).alias("starts"))

    starts = F.aggregate(
        "__tables",
        F.struct(F.lit(_BEGIN).alias("code"), F.array().cast("array<int>").alias("starts")),
        chain,
        lambda state: state["starts"],
    )
    return chained.select(*OBJECT, F.posexplode(starts).alias("__run", "__start")).withColumn(
        "__run", F.col("__run") + 1
    )


def _hits(name: Column, repeated: Column, portable: bool) -> Column:
    """Repeated slots whose name pattern the name matches."""
    if portable:
        found = F.filter(repeated, lambda r: F.rlike(name, r["java_name"]))
        return F.transform(found, lambda r: r["slot"])
    return _python_hits(
        name,
        F.transform(repeated, lambda r: r["pattern"]),
        F.transform(repeated, lambda r: r["slot"]),
    )


def _python_hits(name: Column, patterns: Column, slots: Column) -> Column:
    @F.pandas_udf("array<int>")
    def hits(names: pd.Series, regexes: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series(
            [
                [int(i) for i, rx in zip(ix, rxs) if re.fullmatch(rx, n)]
                for n, rxs, ix in zip(names, regexes, ids)
            ]
        )

    return hits(name, patterns, slots)


def align(
    items: DataFrame,
    slots: DataFrame,
    objects: DataFrame,
    portable: bool = True,
    strict: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(items with their spec struct, slots nothing was found for).

    Extra items have a NULL `spec`.  `objects` (path, type, obj_ix) are all
    objects to check, including those without any item.  Missing slots come
    with `pos`, numbered on from the last item.
    """
    placed = stored(spec_runs(items, slots, portable, strict))
    spec = slots.select("type", "obj_ix", "slot", F.struct(slots.columns).alias("spec"))
    aligned = placed.join(spec, ["type", "obj_ix", "slot"], "left")
    reached = placed.groupBy(*OBJECT).agg(
        F.max("slot").alias("__last"), F.count(F.lit(1)).cast("int").alias("__n")
    )
    wanted = slots.groupBy("type", "obj_ix").agg(
        F.max("slot").cast("int").alias("__final")
    )
    ends = (
        objects.select(*OBJECT)
        .join(reached, list(OBJECT), "left")
        .join(wanted, ["type", "obj_ix"])
        .withColumns(
            {
                "__last": F.coalesce("__last", F.lit(-1)).cast("int"),
                "__n": F.coalesce("__n", F.lit(0)),
            }
        )
        .filter(F.col("__last") < F.col("__final"))
    )
    missing = (
        ends.withColumn("slot", F.explode(F.sequence(F.col("__last") + 1, F.col("__final"))))
        .withColumn("pos", F.col("__n") + F.col("slot") - F.col("__last") - 1)
        .drop("__last", "__n", "__final")
        .join(spec, ["type", "obj_ix", "slot"])
    )
    return aligned, missing
