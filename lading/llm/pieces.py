"""SentencePiece encoding by forward filtering and backward sampling, and decoding.

The vocabulary is a given public model's; nothing is trained.  All ways to cut
a text into pieces form a lattice; a way's weight is the product of its
pieces' weights.  Forward filtering sums the weights of all ways to each place,
backward sampling draws a way from the end to the start with the right
probabilities.  The random numbers are a hash of seed, row key and place, so a
row's segmentation doesn't depend on partitions, batches or retries.

Pieces never hold a space mark after another character, nor a line break, so
the lattice falls apart at such places: it is filtered once for each distinct
unit of a batch, and sampled for each of its occurrences, all with numpy.

Spaces become marks, one mark is put before the text, and characters without a
piece, the mark itself among them, are spelled in UTF-8 byte pieces; so
decoding gives back every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructType

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK, LITERAL = 0x2581, 0x110000  # the space mark; a mark that the text itself holds
BASE = 0x9E3779B97F4A7C15  # odd: has an inverse modulo 2^64
PART = 300_000  # characters handled at once
STORE = 2_500_000  # arcs of the lattices a task remembers, about, nine bytes each and their names
LONG = 64  # characters from which a unit is searched for places that no piece crosses
STEEP = 1.0  # power of the weights: higher keeps closer to the likeliest way


def _mix(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of BASE and of its inverse, for hashes of substrings from running sums."""

    def __init__(self, n: int):
        self.up, self.down = (np.full(n + 1, x, np.uint64) for x in (BASE, pow(BASE, -1, 1 << 64)))
        for powers in (self.up, self.down):
            powers[0] = 1
            np.cumprod(powers, dtype=np.uint64, out=powers)

    def sums(self, chars: np.ndarray) -> np.ndarray:
        own = _mix(chars.astype(np.uint64) + np.uint64(1)) * self.up[: len(chars)]
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(own, dtype=np.uint64)])

    def hashes(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (sums[stop] - sums[start]) * self.down[start]


class Vocabulary:
    """Pieces of a model as arrays: hashes of the pieces, their weights, bytes for decoding."""

    def __init__(self, model: bytes, steep: float = STEEP):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.byte = np.full(256, -1, np.int32)
        self.bytes: list[bytes] = [b""] * size
        for i in range(size):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:5], 16)
                self.byte[value] = i
                self.bytes[i] = bytes([value])
        if (self.byte < 0).any():
            raise ValueError("the model has no byte pieces, so decoding could lose characters")
        pieces = [sp.id_to_piece(i) for i in plain]
        for i, piece in zip(plain, pieces, strict=True):
            self.bytes[i] = piece.replace("▁", " ").encode()
            if "\n" in piece or "▁" in piece.lstrip("▁"):
                raise ValueError(f"piece {piece!r} crosses a word's start; its lattice doesn't fall apart there")
        scores = np.array([sp.get_score(i) for i in plain])
        # merge ranks (whole numbers from 0 down) get Zipf weights; log-probabilities are taken as they are
        ranked = (scores == np.round(scores)).all() and scores.min() < -1000
        logs = steep * (-np.log1p(-scores) if ranked else scores)
        self.longest = max(map(len, pieces))
        self.powers = Powers(self.longest)
        hashes = []
        for piece in pieces:
            chars = np.frombuffer(piece.encode("utf-32-le"), np.uint32)
            hashes.append(self.powers.sums(chars)[-1])
        order = np.argsort(np.array(hashes, np.uint64))
        self.hashes = np.array(hashes, np.uint64)[order]
        self.ids = np.array(plain, np.int32)[order]
        self.weights = np.exp(logs)[order]
        self.rare = float(np.exp(logs.min() - 10 * steep))  # a character spelled in bytes
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.sizes = np.array([len(b) for b in self.bytes])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Places of hashes among the pieces, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        some = np.flatnonzero(self.maybe[(hashes >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[some]), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes[some]
        out[some[hit]] = at[hit]
        return out


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ..., for each span one after another."""
    before = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(starts - before, sizes)


def filter_forward(vocabulary: Vocabulary, chars: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """The pieces that may come last, for each character of the units.

    Number of pieces that end at each character; then for all of those, in
    order of their lengths, the running probability, the id (-1 spells one
    character in bytes) and the length.
    """
    longest, n = vocabulary.longest, len(chars)
    powers = Powers(n)
    sums = powers.sums(chars)
    first = np.cumsum(sizes) - sizes
    before = np.arange(n) - np.repeat(first, sizes)  # characters of the unit before each
    weight = np.zeros((n, longest), np.float32)
    chance = np.full((n, longest), 2, np.float32)
    ids = np.full((n, longest), -1, np.int32)
    for length in range(1, min(longest, int(sizes.max())) + 1):
        end = np.flatnonzero(before >= length - 1)
        at = vocabulary.look_up(powers.hashes(sums, end - length + 1, end + 1))
        hit = at >= 0
        weight[end[hit], length - 1] = vocabulary.weights[at[hit]]
        ids[end[hit], length - 1] = vocabulary.ids[at[hit]]
    bare = ids[:, 0] < 0
    weight[bare, 0] = vocabulary.rare
    order = np.argsort(-sizes, kind="stable")
    base = (first + np.arange(len(sizes)) + longest)[order]  # node before each unit's first character
    total = np.zeros(n + len(sizes) + longest)
    total[base] = 1.0
    back = np.arange(1, longest + 1)
    ordered = -sizes[order]
    for p in range(1, int(sizes.max()) + 1):
        live = np.searchsorted(ordered, -p, side="right")  # units of at least p characters
        node, end = base[:live] + p, first[order[:live]] + p - 1
        most = min(p, longest)
        running = np.cumsum(weight[end, :most] * total[node[:, None] - back[:most]], 1)
        chance[end, :most] = running / running[:, -1:]
        total[node] = running[:, -1]
        if p % longest == 0:  # only ratios count: keep them in range however long the unit is
            window = node[:, None] - np.arange(longest)
            total[window] /= total[node][:, None]
    held = ids >= 0
    held[:, 0] = True
    return held.sum(1), chance[held], ids[held], np.nonzero(held)[1].astype(np.uint8) + np.uint8(1)


def _units(chars: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of units: texts, line breaks and what follows them, marks after other characters."""
    new = np.zeros(len(chars), bool)
    new[first] = True
    mark, line = chars == MARK, chars == 10
    new[1:] |= (mark[1:] & ~mark[:-1]) | line[1:] | line[:-1]
    return np.flatnonzero(new)


def _cut_long(vocabulary: Vocabulary, chars: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Starts of units, with those of more than LONG characters cut wherever no piece crosses.

    Texts without spaces, such as Chinese, fall apart into short units; the
    ways through a lattice are independent on both sides of such a place.
    """
    long = np.flatnonzero(size > LONG)
    if not len(long):
        return start
    at = _spans(start[long], size[long])
    own = chars[at]
    sums = (powers := Powers(len(own))).sums(own)
    before = np.arange(len(own)) - np.repeat(np.cumsum(size[long]) - size[long], size[long])
    crossed = np.zeros(len(own) + 1, np.int64)
    for length in range(2, vocabulary.longest + 1):
        end = np.flatnonzero(before >= length - 1)
        end = end[vocabulary.look_up(powers.hashes(sums, end - length + 1, end + 1)) >= 0]
        np.add.at(crossed, end - length + 2, 1)  # the places before a piece's second to last characters
        np.add.at(crossed, end + 1, -1)
    free = np.cumsum(crossed)[:-1] == 0
    return np.union1d(start, at[free])


class Store:
    """Lattices of units met before, so that each distinct unit is filtered once.

    It grows with what it holds; with more than STORE arcs it starts anew
    before the next call.
    """

    def __init__(self, vocabulary: Vocabulary):
        self._clear()

    def _clear(self):
        self.arcs = [np.empty(1 << 14, kind) for kind in (np.float32, np.int32, np.uint8)]
        self.first = np.empty(1 << 12, np.int32)  # each character's first arc
        self.used = self.characters = 0
        self.known: dict[int, int] = {}

    @staticmethod
    def _put(old: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
        if used + len(more) > len(old):
            new = np.empty(max(used + len(more), len(old) * 3 // 2), old.dtype)
            new[:used] = old[:used]
            old = new
        old[used : used + len(more)] = more
        return old

    def places(self, vocabulary: Vocabulary, names: np.ndarray, chars: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Number of the first character of each distinct unit, after filtering the new ones."""
        if self.used > STORE:
            self._clear()
        names = names.tolist()
        place = np.array([self.known.get(n, -1) for n in names], np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            own = size[new]
            place[new] = self.characters + np.cumsum(own) - own
            count, *arcs = filter_forward(vocabulary, chars[_spans(start[new], own)], own)
            self.first = self._put(self.first, self.characters, self.used + np.cumsum(count) - count)
            self.arcs = [self._put(old, self.used, more) for old, more in zip(self.arcs, arcs, strict=True)]
            self.characters += len(count)
            self.used += len(arcs[0])
            self.known.update(zip([names[i] for i in new.tolist()], place[new].tolist(), strict=True))
        return place

    def draw(self, character: np.ndarray, chance: np.ndarray) -> np.ndarray:
        """The arc into each character that a number from 0 to 1 chooses."""
        running = self.arcs[0]
        arc = self.first[character]
        left = np.flatnonzero(running[arc] <= chance)
        while len(left):  # the last arc's running probability is 1
            arc[left] += 1
            left = left[running[arc[left]] <= chance[left]]
        return arc


def sample(vocabulary: Vocabulary, store: Store, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts one after another, and how many each text has; keys are 64-bit row hashes."""
    raw = np.frombuffer("".join("￼" + t for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    of_text = np.array([len(t) + 1 for t in texts])
    first = np.cumsum(of_text) - of_text
    raw[raw == MARK] = LITERAL
    raw[raw == 32] = MARK
    raw[first] = MARK
    start = _units(raw, first)
    start = _cut_long(vocabulary, raw, start, np.diff(np.append(start, len(raw))))
    size = np.diff(np.append(start, len(raw)))
    powers = Powers(len(raw))
    sums = powers.sums(raw)
    name = powers.hashes(sums, start, start + size) + _mix(size.astype(np.uint64))
    name, one, which = np.unique(name, return_index=True, return_inverse=True)
    base = store.places(vocabulary, name, raw, start[one], size[one])[which]
    _, ids, lengths = store.arcs
    row = np.searchsorted(first, start, side="right") - 1
    order = np.arange(len(start)) - np.searchsorted(start, first)[row]  # of the unit in its text
    seed = _mix(keys.astype(np.uint64)[row] + _mix(order.astype(np.uint64) + np.uint64(1)))
    live, left = np.arange(len(start)), size.copy()
    steps, counts = [], np.zeros(len(start), np.int64)
    step = 0
    while len(live):
        node = base[live] + left[live] - 1
        drawn = (_mix(seed[live] + np.uint64(step)) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
        arc = store.draw(node, drawn)
        piece = ids[arc]
        spelled = piece < 0
        piece[spelled] = -1 - raw[start[live[spelled]] + left[live[spelled]] - 1].astype(np.int32)
        steps.append((live, piece))
        counts[live] += 1
        left[live] -= lengths[arc]
        live = live[left[live] > 0]
        step += 1
    offset = np.cumsum(counts)
    out = np.empty(counts.sum(), np.int32)
    for s, (units, piece) in enumerate(steps):
        out[offset[units] - 1 - s] = piece  # drawn from the end
    per_text = np.bincount(row, counts, len(texts)).astype(np.int64)
    return _spell(vocabulary, out, per_text)


def _spell(vocabulary: Vocabulary, out: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters without a piece (-1 - code point) replaced by their byte pieces."""
    at = np.flatnonzero(out < 0)
    if not len(at):
        return out, per_text
    points, which = np.unique(-1 - out[at].astype(np.int64), return_inverse=True)
    spelled = [vocabulary.byte[list(("▁" if p == LITERAL else chr(p)).encode())] for p in points]
    sizes = np.ones(len(out), np.int64)
    sizes[at] = np.array([len(s) for s in spelled])[which]
    row = np.repeat(np.arange(len(per_text)), per_text)
    start = np.cumsum(sizes) - sizes
    whole = np.repeat(out, sizes)
    table = np.full((len(spelled), 4), -1, np.int32)
    for i, s in enumerate(spelled):
        table[i, : len(s)] = s
    for j in range(4):
        has = sizes[at] > j
        whole[start[at[has]] + j] = table[which[has], j]
    return whole, np.bincount(row, sizes, len(per_text)).astype(np.int64)


def join(vocabulary: Vocabulary, ids: np.ndarray) -> bytes:
    """Text of a sequence of pieces, without the mark put before it."""
    table = vocabulary.bytes
    return b"".join([table[i] for i in ids.tolist()])[1:]


def round_trip(vocabulary: Vocabulary, texts: list[str], ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether each text comes back from its pieces; all are decoded at once, one by one only if they differ."""
    sizes = vocabulary.sizes[ids]
    decoded = vocabulary.flat[_spans(vocabulary.starts[ids], sizes)]
    wanted = [b" " + t.encode() for t in texts]
    ends = np.cumsum(np.append(0, sizes))[np.cumsum(counts)]
    if np.array_equal(ends, np.cumsum([len(w) for w in wanted])) and decoded.tobytes() == b"".join(wanted):
        return np.ones(len(texts), bool)
    return np.array([decoded[e - n : e].tobytes() == w for e, n, w in zip(ends, np.diff(np.append(0, ends)), wanted, strict=True)])


def _parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about PART characters."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > PART:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


#: A worker process's vocabulary and known lattices; they only save time, results don't depend on them.
_READY: dict[tuple[float, bytes], tuple[Vocabulary, Store]] = {}


def _encoder(model, steep: float):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (steep, model.value) not in _READY:
            _READY.clear()
            vocabulary = Vocabulary(model.value, steep)
            _READY[steep, model.value] = vocabulary, Store(vocabulary)
        vocabulary, store = _READY[steep, model.value]
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("__text"))
            null = column.is_null().to_numpy(zero_copy_only=False)
            texts = [t or "" for t in column.to_pylist()]
            keys = batch.column(batch.schema.get_field_index("__key")).to_numpy(zero_copy_only=False)
            keys = keys.astype(np.int64).view(np.uint64)
            rest = [i for i, n in enumerate(batch.schema.names) if n not in ("__text", "__key")]
            for a, b in _parts(texts):
                ids, counts = sample(vocabulary, store, texts[a:b], keys[a:b])
                ends = np.cumsum(counts)
                good = round_trip(vocabulary, texts[a:b], ids, counts)
                empty = null[a:b]
                counts = np.where(empty, 0, counts)
                keep = np.repeat(~empty, np.diff(np.append(0, ends)))
                offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[keep]), mask=pa.array(empty))
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*(own.column(i) for i in rest), lists, pa.array(good)],
                    names=[*(batch.schema.names[i] for i in rest), "ids", "lossless"],
                )

    return encode


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, key: str = "doc_id", seed: int = 0, steep: float = STEEP) -> DataFrame:
    """docs with `ids` (sampled piece ids) and `lossless` (they decode to the text).

    A null text has null ids; an empty one is the single space mark.  Rows are
    seeded by `key` (null keys alike), so repeated rows get equal ids.  Columns
    already called ids or lossless are replaced.
    """
    docs = docs.drop("ids", "lossless")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a vocabulary file, some 0.5 MB
    layout = StructType([*docs.schema.fields]).add("ids", ArrayType(IntegerType())).add("lossless", BooleanType())
    seeded = docs.withColumns({"__text": F.col("text"), "__key": F.xxhash64(F.lit(seed), F.col(key).cast("string"))})
    return seeded.mapInArrow(_encoder(shared, steep), layout)


def decode(ids: Column, model: bytes) -> Column:
    """Texts of piece ids; null for null."""

    @F.pandas_udf("string")
    def text(lists):
        vocabulary = Vocabulary(model)
        return lists.map(lambda x: None if x is None else join(vocabulary, np.asarray(x)).decode())

    return text(ids)
