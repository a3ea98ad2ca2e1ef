"""Benchmark decontamination by spaced-seed hashing.

A text is a sequence of word hashes.  A seed is two runs of RUN words, a fixed
gap apart, whose words are ignored.  Every stretch that counts as an overlap
has two such runs at one of GAPS (of an item of fewer than LEAST_WORDS words, one run
at least), whichever of its words are replaced.  Hashes of the benchmark's seeds are
joined with those of the texts; each hit fixes an alignment of an item with a
text, and the aligned words around it are compared: of the stretches in which
SHARE of the words are equal, the one of most equal words counts as an overlap
if it has LEAST_WORDS of them, or nearly all of a shorter item.

Most seeds of most texts are in no item, so a bitmap of the benchmark's
hashes, of bounded size however many items there are, thins the texts' seeds
before the join.  It only saves work: what it lets through is joined exactly.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from pyspark.sql.types import IntegerType, StructType

from lading.llm.common import whole_text
from lading.materialise import cut

RUN = 3
#: Words between the runs.  The test of the seeds goes through all stretches of up to 29 words; a longer one has a half that counts too.
GAPS = (0, 1, 5, 8, 10)
SPAN = 2 * RUN + max(GAPS)
LEAST_WORDS = 12  # equal words of an overlap; of an item shorter than 15 words, 0.8 of its words
SHARE = 0.8
LOSS = round(SHARE / (1 - SHARE))  # equal words that make up for a different one
LEAST_ITEM = 6  # words; a stretch of a shorter item needn't have a run, so such an item is compared whole
CONTEXT = 64  # words kept before and after a hit; items' stretches beyond it are found by further hits
BITMAP = 16, 27  # least and most bits of the bitmap, as powers of two; in between 64 and more a hash
PROBES = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
SALTS = 16
WORD = re.compile(r"[^\W_]+")
MEMO, MEMO_SIZE = 1 << 17, 32  # words remembered, and their greatest length: some 20 MB


class Memo(dict):
    """32-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = zlib.crc32(word.encode())
        if len(word) <= MEMO_SIZE:
            self[word] = h
        return h


def word_hashes(text: str, memo: Memo) -> np.ndarray:
    """32-bit hash of each lower-cased word."""
    words = WORD.findall(text.lower())
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


#: Odd factors, for both runs of each gap and for each word of a run or of a short item.
_ODD = np.random.default_rng(5).integers(0, 1 << 63, 2 * len(GAPS) + LEAST_ITEM - 1, dtype=np.uint64) * 2 + 1
RUN_FACTORS, WORD_FACTORS = _ODD[: 2 * len(GAPS)].reshape(-1, 2), _ODD[2 * len(GAPS) :]


def _mixed(h: np.ndarray) -> np.ndarray:
    return h ^ (h >> np.uint64(32))


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words from each place."""
    count = max(0, len(words) - size + 1)
    run = np.full(count, size, np.uint64)
    for i, factor in enumerate(WORD_FACTORS[:size]):
        run += words[i : i + count] * factor
    return _mixed(run)


def seeds(words: np.ndarray, sizes: tuple[int, ...] = (0,)) -> list[np.ndarray]:
    """For each size the hashes of so many words from each place; for size 0, and each gap, those of two runs.

    As signed 64-bit numbers.
    """
    out = []
    for size in sizes:
        run = run_hashes(words, size or RUN)
        if size:
            out.append(run.view(np.int64))
            continue
        for gap, (one, two) in zip(GAPS, RUN_FACTORS, strict=True):
            second = run[RUN + gap :]
            out.append(_mixed(run[: len(second)] * one + second * two).view(np.int64))
    return out


def _slot(h: np.ndarray, probe: int, power: int) -> np.ndarray:
    """Place of each hash among 2^power bits."""
    return (h.view(np.uint64) * np.uint64(probe)) >> np.uint64(64 - power)


def seed_size(n_words: int) -> int:
    """What an item's seeds are: two runs (0), one run, or, of a short item, all its words."""
    return 0 if n_words >= LEAST_WORDS else RUN if n_words >= LEAST_ITEM else n_words


def benchmark_seeds(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(item_id, at, seed, size) for each seed of each item."""
    memo = Memo()
    for frame in frames:
        rows = []
        for item, text in zip(frame["item_id"], frame["text"], strict=True):
            words = word_hashes(text, memo)
            size = seed_size(len(words))
            for h in seeds(words, (size,)) if len(words) else ():
                rows += zip([item] * len(h), range(len(h)), h.tolist(), [size] * len(h), strict=True)
        yield pd.DataFrame(rows, columns=["item_id", "at", "seed", "size"])


def _bitmap(windows: DataFrame) -> tuple[bytes, int]:
    """The bits of all seeds and their number as a power of two; at most 2^21 small rows reach the driver."""
    seeds = windows.select("seed").distinct()
    power = min(BITMAP[1], max(BITMAP[0], (64 * seeds.count()).bit_length()))

    @pandas_udf("array<bigint>")
    def slots(found: pd.Series) -> pd.Series:
        h = found.to_numpy(np.int64)
        return pd.Series(list(np.stack([_slot(h, p, power) for p in PROBES], 1).astype(np.int64)))

    bit = F.bit_or(F.expr("shiftleft(1L, CAST(slot % 64 AS INT))"))
    bits = seeds.select(F.explode(slots("seed")).alias("slot"))
    words = np.zeros((1 << power) // 64, "<i8")
    for row in bits.groupBy(F.shiftright("slot", 6).alias("at")).agg(bit.alias("bits")).collect():
        words[row["at"]] = row["bits"]
    return words.tobytes(), power


def _regions(bitmap, sizes: tuple[int, ...]):
    """Stretches of texts around seeds that the bitmap lets through, with their hits; `sizes` are those of the seeds."""

    def regions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, power = bitmap.value
        known = np.frombuffer(bits, np.uint8)
        memo = Memo()
        for frame in frames:
            rows = []
            for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
                words = word_hashes(text, memo)
                at, hit = [], []
                for h in seeds(words, sizes):
                    found = np.arange(len(h))
                    for probe in PROBES:
                        slot = _slot(h[found], probe, power)
                        found = found[known[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1 > 0]
                    at.append(found)
                    hit.append(h[found])
                at, hit = np.concatenate(at), np.concatenate(hit)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, hit = at[order], hit[order]
                breaks = np.flatnonzero(np.diff(at) > 2 * CONTEXT) + 1
                for a, h in zip(np.split(at, breaks), np.split(hit, breaks), strict=True):
                    start = max(0, int(a[0]) - CONTEXT)
                    piece = words[start : int(a[-1]) + SPAN + CONTEXT]
                    rows.append((doc, start, piece.astype(np.int64), a, h))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "words", "at", "seeds"])

    return regions


def stretch(text: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """Aligned stretch of most equal words, SHARE of all or more, of an item whose word j stands at text word j + shift.

    (first item word, length, equal words); it begins and ends with an equal word.
    """
    low, high = max(0, -shift), min(len(item), len(text) - shift)
    if low >= high:
        return 0, 0, 0
    same = item[low:high] == text[low + shift : high + shift]
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -LOSS))])
    ahead = np.maximum.accumulate(total[::-1])  # greatest total from each place on, last place first
    end = len(total) - 1 - np.searchsorted(ahead, total)  # the last one to which each place loses nothing
    equal = np.concatenate([[0], np.cumsum(same)])
    begin = int((equal[end] - equal).argmax())
    places = np.flatnonzero(same)[equal[begin] : equal[end[begin]]]
    if not len(places):
        return 0, 0, 0
    return low + int(places[0]), int(places[-1] - places[0]) + 1, len(places)


def least_equal(n_words: int) -> int:
    """Equal words that make an overlap with an item of so many words."""
    share = n_words if n_words < LEAST_ITEM else -(-LOSS * n_words // (LOSS + 1))
    return min(LEAST_WORDS, max(1, share))


VERDICT = StructType()
for _name in ("item_at", "n_words", "n_equal", "wanted"):
    VERDICT.add(_name, IntegerType())


@pandas_udf(VERDICT)
def _verify(words: pd.Series, item: pd.Series, shift: pd.Series) -> pd.DataFrame:
    memo = Memo()
    out = []
    for text, other, s in zip(words, item, shift, strict=True):
        other = word_hashes(other, memo).astype(np.int64)
        wanted = least_equal(len(other))
        out.append((*stretch(np.asarray(text), other, int(s)), wanted))
    return pd.DataFrame(out, columns=["item_at", "n_words", "n_equal", "wanted"])


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and benchmark item that overlap.

    doc_id, item_id, doc_word and item_word (where the longest overlap starts,
    words from 0), n_words (its length) and n_equal (its equal words).  Whole
    texts are searched.  Null texts are empty and overlap nothing; an item of
    fewer than LEAST_ITEM words overlaps where all its words stand in a row, so
    one of a single word wherever that stands.  Repeated documents and items count once; rows without doc_id or item_id are left out; only
    doc_id, item_id and text are read.
    """
    docs = docs.filter("doc_id is not null").select("doc_id", whole_text().alias("text"))
    items = benchmark.filter("item_id is not null").select(
        F.col("item_id").cast("string").alias("item_id"), whole_text().alias("text")
    )
    windows = cut(items.mapInPandas(benchmark_seeds, "item_id string, at int, seed bigint, size int").distinct())
    sizes = tuple(sorted(r["size"] for r in windows.select("size").distinct().collect()))  # at most LEAST_ITEM numbers
    sizes = sizes or (0,)  # no items: nothing passes the empty bitmap
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(windows))  # 16 MB at most
    layout = "doc_id bigint, start int, words array<bigint>, at array<int>, seeds array<bigint>"
    found = docs.mapInPandas(_regions(bitmap, sizes), layout)
    regions = cut(found.withColumn("region", F.monotonically_increasing_id()))
    hits = regions.select("region", "doc_id", "start", F.explode(F.arrays_zip("at", "seeds")).alias("h"))
    hits = hits.select("region", F.col("h.at").alias("here"), F.col("h.seeds").alias("seed"), "start")
    # a passage that very many texts hold is one seed: its rows are spread over SALTS keys
    hits = hits.withColumn("salt", F.pmod(F.xxhash64("region"), F.lit(SALTS)).cast("int"))
    spread = windows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lined = hits.join(spread.select("item_id", "at", "seed", "salt"), ["seed", "salt"])
    lined = lined.select("region", "item_id", (F.col("here") - F.col("start") - F.col("at")).alias("shift"))
    both = lined.distinct().join(regions.select("region", "doc_id", "start", "words"), "region")
    both = both.join(items.select("item_id", F.col("text").alias("item")).distinct(), "item_id")
    checked = both.withColumn("v", _verify("words", "item", "shift")).select(
        "doc_id", "item_id", "v.*", (F.col("start") + F.col("shift") + F.col("v.item_at")).alias("doc_word")
    )
    passed = checked.filter("n_equal >= wanted")
    best = F.max(F.struct("n_equal", -F.col("doc_word"), -F.col("item_at"), "n_words", "doc_word", "item_at"))
    return passed.groupBy("doc_id", "item_id").agg(best.alias("b")).select(
        "doc_id", "item_id", "b.doc_word", F.col("b.item_at").alias("item_word"), "b.n_words", "b.n_equal"
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that overlap a benchmark item; rows without doc_id stay."""
    leaked = overlaps(docs, benchmark).select("doc_id").distinct()
    return docs.join(leaked, "doc_id", "left_anti").select(docs.columns)
