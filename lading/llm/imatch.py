"""I-Match fingerprints over several randomised lexicons.

Terms whose document frequency lies in a band make the lexicon.  Each of
SUBSETS random parts of it, from large to small, gives one hash of a text: of
the sorted distinct terms that the text has in that part.  Equal texts have
equal hashes; a changed text keeps those of the parts it isn't changed in.

The lexicon has at most (mean distinct terms of a text) / LEAST_SHARE terms,
whatever the number of texts, as each stands in that share of them.  It goes
into the plan as constant arrays, two hash tables in which each term has one
place, so looking a term up is two array accesses, without join or shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lading.llm.common import ascii_lower, whole_text

LEAST_SHARE, MOST_SHARE = 0.001, 0.2  # of the texts that hold a term of the lexicon; two texts at least
#: For each subset, the hexadecimal digits below which a term's hash must lie: a half, an eighth, ...
EDGES = ["80"] * 2 + ["20"] * 4 + ["08"] * 8 + ["02"] * 10
NONE = "--------"
BUCKET = 1000  # documents of a bucket when their neighbours are sought
FAN, LEVELS = 64, 3
BROADCAST_ROWS = 1_000_000  # of 24 bytes


def terms(text: Column) -> Column:
    """Distinct terms: runs of letters and digits, A-Z lower-cased."""
    return F.array_distinct(F.filter(F.split(ascii_lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def lexicon(docs: DataFrame) -> DataFrame:
    """(term, n) of the terms in the band, over all texts of docs."""
    total = docs.count()
    found = docs.select(F.explode(terms(whole_text())).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return found.filter((F.col("n") >= max(2, LEAST_SHARE * total)) & (F.col("n") <= MOST_SHARE * total))


def _tables(rows: list[tuple[int, int]]) -> tuple[list[list[int]], int]:
    """Two hash tables (keys, masks, keys, masks) in which each key has one of two places."""
    power = max(4, len(rows).bit_length())
    while True:
        size = 1 << power
        keys, masks = ([[0] * size, [0] * size] for _ in range(2))
        for key, mask in rows:
            side = 0
            for _ in range(500):
                at = ((key >> (20 * side)) & (size - 1)) if power <= 20 else ((key >> (30 * side)) & (size - 1))
                key, keys[side][at] = keys[side][at], key
                mask, masks[side][at] = masks[side][at], mask
                if not mask:
                    break
                side = 1 - side
            else:
                break
        else:
            return [keys[0], masks[0], keys[1], masks[1]], power
        power += 1


def _constant(numbers: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def fingerprinter(words: DataFrame):
    """Function from a text column to its fingerprint column, for a lexicon of (term, n)."""
    mask = sum((F.when(F.substring(F.md5(F.concat(F.lit(f"{k}:"), "term")), 1, 2) < e, 1 << k).otherwise(0) for k, e in enumerate(EDGES)), F.lit(0))
    # terms of no subset go here, as Spark would move a filter on m, with its hashes, before the counting
    rows = words.select(F.xxhash64("term").alias("h"), mask.alias("m")).collect()
    tables, power = _tables([(r["h"], r["m"]) for r in rows if r["m"]])
    key1, mask1, key2, mask2 = map(_constant, tables)
    second = 20 if power <= 20 else 30

    def place(h: Column, by: int) -> Column:
        return (F.shiftright(h, by).bitwiseAND(F.lit((1 << power) - 1)) + 1).cast("int")

    def mask_of(h: Column) -> Column:
        one, two = place(h, 0), place(h, second)
        return F.when(F.element_at(key1, one) == h, F.element_at(mask1, one)).when(
            F.element_at(key2, two) == h, F.element_at(mask2, two)
        ).otherwise(0)

    def subset_hash(kept: Column, k: int) -> Column:
        own = F.filter(kept, lambda x: x["m"].bitwiseAND(F.lit(1 << k)) != 0)
        text = F.concat_ws(" ", F.transform(own, lambda x: x["t"]))
        return F.when(text == "", NONE).otherwise(F.substring(F.md5(text), 1, 8))

    def fingerprint(text: Column) -> Column:
        known = F.transform(terms(text), lambda t: F.struct(t.alias("t"), mask_of(F.xxhash64(t)).alias("m")))
        kept = F.array_sort(F.filter(known, lambda x: x["m"] != 0))
        # bound once to a lambda's variable, as an expression used 24 times would be computed 24 times
        return F.transform(F.array(kept), lambda s: F.concat_ws(".", *(subset_hash(s, k) for k in range(len(EDGES)))))[0]

    return fingerprint


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets in which either text has terms; 1 if neither has any."""
    pairs = F.filter(
        F.zip_with(F.split(a, r"\."), F.split(b, r"\."), lambda x, y: F.struct(x.alias("x"), y.alias("y"))),
        lambda p: (p["x"] != NONE) | (p["y"] != NONE),
    )
    equal = F.filter(pairs, lambda p: p["x"] == p["y"])
    return F.when(a == b, 1.0).otherwise(F.coalesce(F.try_divide(F.size(equal), F.size(pairs)), F.lit(1.0)))


def into_buckets(docs: DataFrame, count: int) -> DataFrame:
    """docs with `bucket`, numbers that rise with doc_id, some BUCKET rows each however the ids are spread.

    Quantiles of the ids cut all rows into up to FAN ranges, then each range
    again, LEVELS times at most; the edges are FAN numbers a range.
    """
    docs = docs.withColumn("bucket", F.lit(0).cast("bigint"))
    wanted = -(-count // BUCKET)
    for _ in range(LEVELS):
        parts = min(FAN, wanted)
        if parts < 2:
            break
        shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
        edges = docs.groupBy("bucket").agg(F.percentile_approx("doc_id", shares, 1000).alias("edges"))
        at = F.size(F.filter("edges", lambda e: e <= F.col("doc_id")))
        docs = docs.join(F.broadcast(edges), "bucket").withColumn("bucket", F.col("bucket") * FAN + at).drop("edges")
        wanted = -(-wanted // parts)
    return docs


def with_next(docs: DataFrame, fingerprint) -> DataFrame:
    """Rows of docs (doc_id, text) with fingerprint, next_text and next_fingerprint.

    Next is the document of the next smaller doc_id, after the smallest the
    largest.  Texts are shuffled once, into buckets of neighbouring ids; each
    bucket also gets the first document of the next one.
    """
    count = docs.count()
    docs = into_buckets(docs, count)
    heads = docs.groupBy("bucket").agg(F.max("doc_id").alias("doc_id"))
    above = Window.orderBy("bucket")  # one small row a bucket
    top = heads.agg(F.min("bucket")).first()[0]
    heads = heads.select("doc_id", F.coalesce(F.lead("bucket").over(above), F.lit(top)).alias("bucket"))
    heads = F.broadcast(heads) if count / BUCKET < BROADCAST_ROWS else heads
    borrowed = docs.drop("bucket").join(heads, "doc_id").withColumn("own", F.lit(False))
    both = docs.withColumn("own", F.lit(True)).unionByName(borrowed).withColumn("fingerprint", fingerprint(F.col("text")))
    order = Window.partitionBy("bucket").orderBy(F.desc("own"), F.desc("doc_id"), "text")
    found = both.withColumns({f"next_{c}": F.lead(c).over(order) for c in ("text", "fingerprint")})
    return found.filter("own").drop("own", "bucket")


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs with `fingerprint`, from a lexicon of all its texts.

    Null texts are empty; texts without a term of the lexicon have none in any
    subset and are alike.  Repeated rows get equal fingerprints and count in
    the document frequencies as often as they stand there.
    """
    return docs.withColumn("fingerprint", fingerprinter(lexicon(docs))(whole_text()))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of texts, of their edited form (last third from the next document), and likenesses.

    Rows without doc_id are left out, as they have no next document.
    """
    docs = docs.filter("doc_id is not null").select("doc_id", whole_text().alias("text"))
    fingerprint = fingerprinter(lexicon(docs))
    paired = with_next(docs, fingerprint)
    size = F.length("text")
    third = F.floor(size / 3).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), size - third), F.col("next_text").substr(F.lit(1), third))
    done = paired.withColumn("edited", edited).withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return done.select(
        "doc_id", size.cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
