"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits.  Bit i is given a nonzero vector m(i) of RADIUS + 1
bits, and table v (a nonzero vector too) keeps the bits with odd <m(i), v>.
RADIUS differing bits give RADIUS equations <m(i), v> = 0 in RADIUS + 1
unknowns, which have a nonzero solution: in that table the two fingerprints
agree on every kept bit.  So 2^(RADIUS + 1) - 1 tables find every pair within
the radius, and each pair found is checked by its differing bits.

Equal fingerprints are one node.  A bucket of more than CROWD different
fingerprints isn't paired: its members are linked through points of the cube
at most RADIUS / 2 bits away, which two fingerprints share exactly if they are
within the radius; that costs a fixed number of rows a fingerprint.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lading.llm.components import components
from lading.materialise import cut

BITS, RADIUS, SEED = 64, 4, 42
CROWD = 256  # different fingerprints in a bucket from which shared points are cheaper than pairs
BLOCK = 1 << 16  # shingle hashes unpacked at once


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each run of `words` words; of all words if there are fewer; none if there are none."""
    found = text.lower().split()  # bytes: A-Z only, and white space is 0x20 and 0x09-0x0D
    if not found:
        return np.zeros(0, np.uint64)
    whole = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    last = ends[words - 1 :] if len(found) >= words else ends[-1:]
    first = (ends - sizes)[: len(last)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(whole[a:b], SEED) for a, b in zip(first.tolist(), last.tolist(), strict=True)),
        np.uint64,
        len(last),
    )


def majority(hashes: np.ndarray) -> int:
    """Bit set if it is set in over half of the hashes; as a signed 64-bit number."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = np.ascontiguousarray(hashes[at : at + BLOCK]).astype("<u8").view(np.uint8)
        counts += np.unpackbits(part.reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: Column, words: int = 4) -> Column:
    """64-bit SimHash of a text's shingles, repeats included; null and wordless texts give 0."""

    @pandas_udf("bigint")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([majority(shingle_hashes(t, words)) for t in texts], dtype="int64")

    return simhash(F.coalesce(text, F.lit("")).cast("binary"))


def masks(radius: int = RADIUS) -> list[int]:
    """The bits each table keeps, as signed 64-bit numbers."""
    top = 1 << (radius + 1)
    vectors = [1 + i % (top - 1) for i in range(BITS)]
    kept = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, top)]
    return [k - (1 << BITS) if k >> (BITS - 1) else k for k in kept]


def _flips(most: int) -> Column:
    """Every 64-bit number of at most `most` set bits, as one constant array."""
    numbers = [sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(BITS), k)]
    signed = (n - (1 << BITS) if n >> (BITS - 1) else n for n in numbers)
    return F.split(F.lit(",".join(map(str, signed))), ",").cast("array<bigint>")


def _crowd_links(crowd: DataFrame, radius: int) -> DataFrame:
    """Links among the fingerprints of crowded buckets, through shared points of the cube."""
    point = F.explode(F.transform(_flips(radius // 2), lambda flip: F.col("fp").bitwiseXOR(flip)))
    points = crowd.select("id", point.alias("point"))
    centres = points.groupBy("point").agg(F.min("id").alias("a"), F.count("*").alias("n"))
    centres = centres.filter("n > 1").select("point", "a")
    return points.join(centres, "point").filter("id <> a").select("a", F.col("id").alias("b")).distinct()


def links(nodes: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """(a, b) of nodes (id, fp), one node a fingerprint, that connect all within the radius.

    The radius must be even.  Every pair within it is either returned or
    joined through a chain of such pairs.
    """
    keys = [
        F.xxhash64(F.lit(v), F.col("fp").bitwiseAND(F.lit(mask))) for v, mask in enumerate(masks(radius))
    ]
    rows = nodes.select("id", "fp", F.explode(F.array(*keys)).alias("key"))
    sizes = rows.groupBy("key").count().filter("count > 1")
    shared = cut(rows.join(sizes, "key"))
    small = shared.filter(F.col("count") <= crowd)
    left = small.select("key", F.col("id").alias("a"), F.col("fp").alias("x"))
    right = small.select("key", F.col("id").alias("b"), F.col("fp").alias("y"))
    near = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= radius
    pairs = left.join(right, (left.key == right.key) & (F.col("a") < F.col("b")) & near)
    crowded = shared.filter(F.col("count") > crowd).select("id", "fp").distinct()
    return pairs.select("a", "b").unionByName(_crowd_links(crowded, radius)).distinct()


def simhash_groups(docs: DataFrame, words: int = 4, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row of docs.

    The component is the smallest doc_id reachable over links of at most
    `radius` bits.  Repeated rows come back as often as they came; rows that
    share a doc_id are one document.  A null text is empty, and texts without
    words link through fingerprint zero.  A row without doc_id links nothing
    and takes the component of its fingerprint, if that has one.  No other
    column of docs is read.
    """
    prints = cut(docs.select("doc_id", fingerprint(F.col("text"), words).alias("fp")))
    by_print = prints.groupBy("fp").agg(F.min("doc_id").alias("id"))
    nodes = cut(by_print.filter("id is not null"))
    same = prints.filter("doc_id is not null").groupBy("doc_id").agg(F.min("fp"), F.max("fp"))
    same = same.toDF("doc_id", "low", "high").filter("low <> high")  # documents of several texts
    of_id = prints.join(same.select("doc_id"), "doc_id", "left_semi").join(nodes, "fp")
    edges = links(nodes, radius).unionByName(of_id.select(F.col("doc_id").alias("a"), F.col("id").alias("b")))
    of_node = components(edges, "a", "b")
    named = by_print.join(of_node, "id", "left").select(
        "fp", F.coalesce("component", "id").alias("component_id")
    )
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, words: int = 4, radius: int = RADIUS) -> DataFrame:
    """docs without near-duplicates: of each group the document of the smallest id stays.

    Rows that share a doc_id are one document, of which one row stays (if
    their other columns differ, any one of them); rows without doc_id all stay.
    """
    groups = simhash_groups(docs, words, radius)
    go = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    once = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    return once.join(go, "doc_id", "left_anti").unionByName(docs.filter("doc_id is null")).select(docs.columns)
