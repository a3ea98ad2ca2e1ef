"""Ranked lexical search of a query set over all documents, by dense blocked matrix products.

The queries' terms make a compact vocabulary.  One pass reduces each document
to its number of terms and the vocabulary terms it holds; from that come N, L
and the document frequencies.  In a second pass each task fills tiles, some
vocabulary terms times some documents, with the documents' impacts, and
multiplies tiles of the queries' term counts with them in float64.  Every
entry is an integer, and a vocabulary tile is closed before any query's sum
could reach 2^53, so sums are exact in whatever order BLAS adds; tiles are
added up as 64-bit integers.

Each task keeps the best rows of its tiles for each query under the total
order (score descending, doc_id ascending), so equal scores lose nobody, and
two window steps merge the tasks' lists.

Queries are taken in blocks of about BLOCK (query, term) pairs, with one pass
over the documents for each, so what a task is sent stays bounded however many
queries there are.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructType
from pyspark.sql.window import Window

from lading.llm.common import whole_text
from lading.materialise import cut

BLOCK = 1 << 17  # (query, term) pairs of a block of queries
TILE_QUERIES, TILE_TERMS, TILE_DOCS = 256, 512, 512
EXACT = 1 << 53
SATURATED = 1_000_000  # what (10^9 tf) div (1000 tf + 8 m) stays below
GROUPS = 64  # first step of the merge: lists of so many groups of tasks
_TERM_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and all other non-ASCII characters of a UTF-8 text, A-Z lower-cased."""
    return text.translate(_TERM_BYTES).split()


def _query_terms(queries: DataFrame, id_column: str) -> DataFrame:
    """(id, term, times) of each query; rows of one id and text count once."""
    schema = StructType().add("id", queries.schema[id_column].dataType).add("term", BinaryType()).add("times", LongType())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = Counter(terms_of(text))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(found), arrow[0].type), list(found), pa.array(found.values(), pa.int64())],
                        schema=arrow,
                    )

    texts = queries.select(F.col(id_column).alias("id"), whole_text().alias("text")).distinct()
    return texts.select("id", F.col("text").cast("binary")).mapInArrow(counted, schema).groupBy("id", "term").agg(
        F.sum("times").alias("times")
    )


class _Block:
    """A block of queries: ids, vocabulary and the pairs' positions in them."""

    def __init__(self, rows: list):
        self.ids = list(dict.fromkeys(r["id"] for r in rows))
        self.vocabulary = sorted({bytes(r["term"]) for r in rows})
        place = {t: i for i, t in enumerate(self.vocabulary)}
        number = {k: i for i, k in enumerate(self.ids)}
        self.query = np.array([number[r["id"]] for r in rows], np.int64)
        self.term = np.array([place[bytes(r["term"])] for r in rows], np.int64)
        self.times = np.array([r["times"] for r in rows], np.int64)


def _reduced(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document: its number of terms, and places and counts of vocabulary terms as bytes."""
    schema = StructType().add("doc_id", LongType()).add("n", LongType()).add("terms", BinaryType()).add("tfs", BinaryType())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        place = {t: i for i, t in enumerate(vocabulary)}
        for batch in batches:
            sizes, terms, tfs = [], [], []
            for text in batch.column(1):
                words = terms_of(text.as_buffer().to_pybytes())
                found = Counter(map(place.get, words))
                found.pop(None, None)
                sizes.append(len(words))
                terms.append(np.fromiter(found.keys(), "<i4", len(found)).tobytes())
                tfs.append(np.fromiter(found.values(), "<i8", len(found)).tobytes())
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    rows = docs.select(F.col("doc_id").cast("bigint"), whole_text().cast("binary").alias("text"))
    return rows.mapInArrow(counted, schema)


def _frequencies(reduced: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each vocabulary term."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            held = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4")
            total += np.bincount(held, minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["term", "df"])

    partial = reduced.select("terms").mapInArrow(counted, StructType().add("term", IntegerType()).add("df", LongType()))
    out = np.zeros(size, np.int64)
    for row in partial.groupBy("term").agg(F.sum("df").alias("df")).collect():  # one row a vocabulary term
        out[row["term"]] = row["df"]
    return out


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def tiles(query: np.ndarray, term: np.ndarray, times: np.ndarray, weight: np.ndarray) -> list[tuple]:
    """(queries, terms, counts) tiles whose sums stay below 2^53 for any document.

    `queries` are at most TILE_QUERIES numbers, `terms` at most TILE_TERMS
    places, `counts` the sparse (row, column, count) of the matrix between.  A
    count too large for one tile is spread over several.
    """
    out = []
    for low in range(0, int(query.max()) + 1 if len(query) else 0, TILE_QUERIES):
        mine = (query >= low) & (query < low + TILE_QUERIES) & (weight[term] > 0)
        order = np.flatnonzero(mine)[np.argsort(term[mine], kind="stable")]
        load = np.zeros(TILE_QUERIES, np.int64)
        terms, counts = [], []

        def close():
            if counts:
                out.append((low, np.array(terms), np.array(counts, np.int64)))
            load[:] = 0
            return [], []

        for i in order.tolist():
            row, place, left = int(query[i]) - low, int(term[i]), int(times[i])
            most = SATURATED * int(weight[place])
            while left:
                room = (EXACT - 1 - int(load[row])) // most
                if not room or (terms and terms[-1] != place and len(terms) == TILE_TERMS):
                    terms, counts = close()
                    continue
                if not terms or terms[-1] != place:
                    terms.append(place)
                taken = min(left, room)
                counts.append((row, len(terms) - 1, taken))
                load[row] += taken * most
                left -= taken
        close()
    return out


class _Best:
    """The best `k` (score, doc_id) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = np.zeros((queries, k), np.int64)  # 0: nobody yet
        self.docs = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, low: int, scores: np.ndarray, docs: np.ndarray) -> None:
        """Scores (queries, documents) of a tile whose first query is `low`."""
        worst = self.scores[low : low + len(scores), -1]
        for row in np.flatnonzero((scores.max(1) > 0) & (scores.max(1) >= worst)).tolist():
            at = np.flatnonzero((scores[row] >= worst[row]) & (scores[row] > 0))
            own = np.concatenate([self.scores[low + row], scores[row, at]])
            ids = np.concatenate([self.docs[low + row], docs[at]])
            order = np.lexsort((ids, -own))[: self.k]
            self.scores[low + row], self.docs[low + row] = own[order], ids[order]


def _scored(block: _Block, weight: np.ndarray, n_docs: int, n_terms: int, k: int, schema: StructType):
    """mapInArrow function from reduced documents to the task's best rows."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut_up = tiles(block.query, block.term, block.times, weight)
        best = _Best(len(block.ids), k)
        column = np.full(len(block.vocabulary), -1)
        for batch in batches:
            for at in range(0, batch.num_rows, TILE_DOCS):
                ids, sizes, terms, tfs = (batch.column(i).slice(at, TILE_DOCS) for i in range(4))
                ids = np.array(ids.to_pylist(), np.int64)
                terms = [np.frombuffer(t, "<i4") for t in terms.to_pylist()]
                doc = np.repeat(np.arange(len(ids)), [len(t) for t in terms])
                term = np.concatenate(terms)
                tf = np.frombuffer(b"".join(tfs.to_pylist()), "<i8")
                m = np.array([25 + 75 * n * n_docs // n_terms for n in sizes.to_pylist()], np.int64)
                impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
                low, total = 0, None
                for first, places, counts in cut_up:
                    if total is not None and first != low:
                        best.add(low, total, ids)
                        total = None
                    low = first
                    column[places] = np.arange(len(places))
                    own = column[term]
                    held = own >= 0
                    tile = np.zeros((len(places), len(ids)))
                    tile[own[held], doc[held]] = impact[held]
                    column[places] = -1
                    matrix = np.zeros((min(TILE_QUERIES, len(block.ids) - first), len(places)))
                    matrix[counts[:, 0], counts[:, 1]] = counts[:, 2]
                    part = (matrix @ tile).astype(np.int64)
                    total = part if total is None else total + part
                if total is not None:
                    best.add(low, total, ids)
        query, rank = np.nonzero(best.scores)
        part = TaskContext.get().partitionId()
        arrow = to_arrow_schema(schema)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([block.ids[i] for i in query], arrow[0].type),
                pa.array(best.docs[query, rank]),
                pa.array(best.scores[query, rank]),
                pa.array(np.full(len(query), part % GROUPS, np.int32)),
            ],
            schema=arrow,
        )

    return searched


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "item_id", block: int = BLOCK) -> DataFrame:
    """id_column, rank (from 1), doc_id and score of the `k` best documents of each query.

    Documents are rows of docs (doc_id, text): a repeated row is a document of
    its own, a null text has no terms, a row without doc_id counts in all
    statistics but can't be named and isn't returned.  Rows of queries that share
    id and text are one query, several texts of an id are taken together, rows
    without id are the query of null id.  A query without matching document
    has no row; empty tables give no rows.  Other columns are not read.
    """
    key = queries.schema[id_column].dataType
    schema = StructType().add(id_column, key).add("doc_id", LongType()).add("score", LongType()).add("__group", IntegerType())
    pairs = cut(_query_terms(queries, id_column))
    blocks = -(-pairs.count() // block)
    found = []
    for number in range(blocks):
        rows = pairs.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number).collect()  # about `block` pairs
        if not rows:
            continue
        these = _Block(rows)
        reduced = cut(_reduced(docs, these.vocabulary))
        n_docs, n_terms = reduced.filter("n > 0").agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            break
        weight = weights(_frequencies(reduced, len(these.vocabulary)), n_docs)
        named = reduced.filter("doc_id is not null and length(terms) > 0")
        found.append(named.mapInArrow(_scored(these, weight, n_docs, n_terms, k, schema), schema))
    if not found:
        return docs.sparkSession.createDataFrame([], schema).select(id_column, F.lit(0).alias("rank"), "doc_id", "score")
    lists = reduce(DataFrame.unionAll, found)
    for keys in ([id_column, "__group"], [id_column]):
        window = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("doc_id"))
        lists = lists.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)
    return lists.select(id_column, "rank", "doc_id", "score")
