"""Secrets in texts: base rules, and a linear-chain conditional random field that finds more.

A text is a sequence of tokens, tagged as beginning a secret (B), inside one
(I) or outside (O).  A tagging's score is the sum of the tokens' scores and of
the transitions between neighbouring tags.  A token's score adds up weights of its
shape, of the words around it (three before, one after) and of the file: its
length, its shares of digits and of code symbols.

The field is trained with numpy on the driver, on windows of a bounded sample
of texts; the values that the base rules find there are its labels, so it
learns how secrets look and where they stand, and finds such as no rule
describes.  Decoding is exact: a token whose score for O leads by more than any
two transitions can make good is outside in the best tagging whatever its
neighbours are; the runs between such tokens go through Viterbi.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType

from lading.llm.common import whole_text

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "crf")

TOKEN = re.compile(r"[\w+/~-]+(?:\.[\w+/~-]+)*|\S")
B, I, O = range(3)  # noqa: E741
SHAPES = 9  # features of a token's own shape
AROUND = (-3, -2, -1, 1)  # neighbours whose words count
SLOTS = 1 << 12  # hashed values of a kind of feature
ROWS = SLOTS * (SHAPES + len(AROUND)) + 64  # weights: shapes, neighbours, file
FILE = 3

SAMPLE = 10_000  # texts whose windows are learned from, about: the bound of what is fitted on
WINDOW = 32  # tokens of a training window
WINDOWS = 4  # of each sampled text at most
EPOCHS, BATCH, RATE, DECAY = 12, 256, 0.05, 1e-4
PIECE = 1 << 18  # characters of a text decoded at once
OVERLAP = 1024  # characters of context before and after a piece
BLOCK = 1 << 17  # tokens decoded at once
MEMO = 1 << 18  # tokens remembered by a task, of MEMO_SIZE characters at most
MEMO_SIZE = 40

_CLASSES = bytes(
    ord("0") if 48 <= c <= 57 else ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 else ord("x") if c > 127 else ord(".")
    for c in range(256)
)
_REPEATS = re.compile(rb"(.)\1+")
_HEXES = b"0123456789abcdefABCDEF"
_VOWELS = b"aeiouAEIOU"
_DIGITS, _SYMBOLS = b"0123456789", b"=:;{}[]()<>\"'`$_"


def base_matches(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, start and end of the value) of the base rules, sorted."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end(), *m.span(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end(), *m.span()) for m in HEX.finditer(text)]
    return sorted(found)


def _by_classes(classes: bytes) -> tuple[int, ...]:
    """Rows of the features that a token's characters' classes give, and its size in steps."""
    n = len(classes)
    size = n if n < 8 else min(63, 4 + n.bit_length() * 2 + (n >> (n.bit_length() - 2) & 1))
    runs = _REPEATS.sub(rb"\1", classes)
    small = min(size, 12)
    values = (
        size,
        (bytes(sorted(set(classes))), small),
        (min(len(runs), 12), small),
        (runs[:6], n > 11),
        (8 * classes.count(b"0") // n, small),
    )
    return size, *(k * SLOTS + zlib.crc32(repr(v).encode()) % SLOTS for k, v in enumerate(values))


def features(token: str, known: dict[bytes, tuple]) -> tuple[int, ...]:
    """Rows of a token's own features; the last less (SHAPES - 1) * SLOTS is its word to its neighbours.

    `known` remembers what classes of characters give.  A token of more than
    16 bytes is not a word but its opening.
    """
    raw = token.encode("utf-8", "replace")
    classes = raw.translate(_CLASSES)
    own = known.get(classes)
    if own is None:
        own = _by_classes(classes)
        if len(classes) <= MEMO_SIZE:
            known[classes] = own
    size, *rows = own
    different = set(raw)
    hexes = not raw.translate(None, _HEXES)
    vowels = len(raw) - len(raw.translate(None, _VOWELS))
    text = raw.lower() if len(raw) <= 16 else b"\0" + classes[:4] + raw[:3]
    return (
        *rows,
        5 * SLOTS + 8 * len(different) // len(raw) * 64 + size,
        6 * SLOTS + hexes * 64 + size,
        7 * SLOTS + 4 * vowels // len(raw) * 64 + size,
        8 * SLOTS + zlib.crc32(text) % SLOTS,
    )


def around(words: np.ndarray) -> np.ndarray:
    """(tokens, neighbours) rows of the words around each token; those beyond the ends are word 0."""
    padded = np.concatenate([np.zeros(3, np.int64), words, np.zeros(1, np.int64)])
    n = len(words)
    return np.stack([(SHAPES + k) * SLOTS + padded[3 + o : 3 + o + n] for k, o in enumerate(AROUND)], 1)


def file_rows(text: str) -> list[int]:
    """Rows of the features of the whole text."""
    raw = text.encode("utf-8", "replace")
    n = max(1, len(raw))
    digits, symbols = (n - len(raw.translate(None, own)) if raw else 0 for own in (_DIGITS, _SYMBOLS))
    shares = (min(15, len(raw).bit_length()), min(15, 200 * digits // n), min(15, 200 * symbols // n))
    return [SLOTS * (SHAPES + len(AROUND)) + 16 * k + s for k, s in enumerate(shares)]


def silver(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Tags that the values of the base rules give the tokens."""
    tags = np.full(len(spans), O, np.int8)
    values = sorted({(m[3], m[4]) for m in base_matches(text)})
    starts = np.array([s for s, _ in spans])
    for low, high in values:
        inside = np.flatnonzero((starts >= low) & (starts < high))
        tags[inside] = I
        tags[inside[:1]] = B
    return tags


def training_windows(text: str, seed: int) -> list[np.ndarray]:
    """Windows of a text, each (WINDOW, features + tag): those around secrets, around odd tokens, and one anywhere."""
    found = list(TOKEN.finditer(text))
    if not found:
        return []
    tags = silver(text, [m.span() for m in found])
    odd = [i for i, m in enumerate(found) if len(m[0]) > 15 or (any(map(str.isdigit, m[0])) and len(m[0]) > 3)]
    rng = np.random.default_rng(seed)
    begins = np.flatnonzero(tags == B)
    places = [int(i) for i in rng.permutation(begins)[: WINDOWS - 2]]
    places += [odd[i] for i in rng.permutation(len(odd))[:1]] + [int(rng.integers(len(found)))]
    known: dict[bytes, tuple] = {}
    out = []
    for place in places:
        low = max(0, min(place - int(rng.integers(4, WINDOW - 4)), len(found) - WINDOW))
        high = min(low + WINDOW, len(found))
        rows = np.full((WINDOW, SHAPES + len(AROUND) + FILE + 1), -1, np.int32)
        start = max(0, low - 3)
        own = np.array([features(m[0], known) for m in found[start : high + 1]])
        near = around(own[:, -1] - (SHAPES - 1) * SLOTS)[low - start :][: high - low]
        rows[: high - low, :SHAPES] = own[low - start :][: high - low]
        rows[: high - low, SHAPES : SHAPES + len(AROUND)] = near
        rows[: high - low, SHAPES + len(AROUND) : -1] = file_rows(text)
        rows[: high - low, -1] = tags[low:high]
        out.append(rows)
    return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def loss_and_grad(weight: np.ndarray, move: np.ndarray, rows: np.ndarray):
    """Mean negative log-likelihood of windows (n, WINDOW, features + tag), and its gradients.

    A window stands between tokens outside; places behind a short one's end are -1.
    """
    n, length = rows.shape[:2]
    features, tags = rows[:, :, :-1], rows[:, :, -1]
    real = tags >= 0
    emission = np.where(real[:, :, None], weight[features].sum(2), 0.0)
    ahead = np.empty((n, length, 3))
    ahead[:, 0] = emission[:, 0] + move[O]
    for t in range(1, length):
        step = _logsum(ahead[:, t - 1, :, None] + move, 1) + emission[:, t]
        ahead[:, t] = np.where(real[:, t, None], step, ahead[:, t - 1])
    total = _logsum(ahead[:, -1] + move[:, O], 1)
    back = np.empty((n, length, 3))
    back[:, -1] = move[:, O]
    pair = np.zeros((3, 3))
    for t in range(length - 2, -1, -1):
        far = emission[:, t + 1] + back[:, t + 1]
        step = _logsum(move + far[:, None, :], 2)
        live = real[:, t + 1, None]
        back[:, t] = np.where(live, step, back[:, t + 1])
        joint = np.exp(ahead[:, t, :, None] + move + far[:, None, :] - total[:, None, None])
        pair += (joint * live[:, :, None]).sum(0)
    share = np.exp(ahead + back - total[:, None, None]) * real[:, :, None]
    sizes = real.sum(1)
    final = share[np.arange(n), sizes - 1]
    pair[O] += share[:, 0].sum(0)
    pair[:, O] += final.sum(0)
    told = np.where(real, tags, 0)
    score = np.take_along_axis(emission, told[:, :, None], 2)[:, :, 0].sum()
    both = real[:, 1:]
    seen = np.zeros((3, 3))
    np.add.at(seen, (told[:, :-1][both], told[:, 1:][both]), 1)
    np.add.at(seen, (O, told[:, 0]), 1)
    np.add.at(seen, (told[np.arange(n), sizes - 1], O), 1)
    score += (seen * move).sum()
    off = share.copy()
    np.put_along_axis(off, told[:, :, None], np.take_along_axis(off, told[:, :, None], 2) - real[:, :, None], 2)
    flat = features[real].reshape(-1)
    spread = np.repeat(off[real], features.shape[2], 0)
    grad = np.stack([np.bincount(flat, c, len(weight)) for c in spread.T], 1)
    return (total.sum() - score) / n, grad / n, (pair - seen) / n


def fit(windows: np.ndarray, seed: int = 13) -> dict | None:
    """Weights and transitions, by Adam; None if no window holds a secret."""
    if not len(windows) or not (windows[:, :, -1] == B).any():
        return None
    rng = np.random.default_rng(seed)
    now = [np.zeros((ROWS, 3)), np.zeros((3, 3))]
    first, second = ([np.zeros_like(a) for a in now] for _ in range(2))
    t = 0
    epochs = max(EPOCHS, min(200, 400 * BATCH // len(windows)))
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(len(windows)), max(1, len(windows) // BATCH)):
            t += 1
            rate = RATE * (1 - 0.8 * epoch / epochs)
            for k, g in enumerate(loss_and_grad(*now, windows[part])[1:]):
                g = g + DECAY * now[k]
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                now[k] -= rate * first[k] / (1 - 0.9**t) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return {"weight": now[0].astype(np.float32), "move": now[1]}


@pandas_udf(ArrayType(BinaryType()))
def _windows(texts: pd.Series, seeds: pd.Series) -> pd.Series:
    return pd.Series([[w.tobytes() for w in training_windows(t, s)] for t, s in zip(texts, seeds, strict=True)])


def train(docs: DataFrame, sample: int = SAMPLE) -> dict | None:
    """Fit on windows of about `sample` texts, chosen by a hash of their content; None without a secret among them."""
    count = docs.count()
    if not count:
        return None
    edge = int(min(1.0, sample / count) * 1_000_000)
    chosen = F.pmod(F.xxhash64(F.lit("secrets"), "text"), F.lit(1_000_000)) < edge
    texts = docs.select(whole_text().alias("text")).filter(chosen).distinct()  # copies are one text
    cut = texts.select(F.explode(_windows("text", F.pmod(F.xxhash64("text"), F.lit(1 << 31)))).alias("w"))
    rows = sorted(bytes(r["w"]) for r in cut.collect())
    return fit(np.frombuffer(b"".join(rows), np.int32).reshape(len(rows), WINDOW, -1))


def viterbi(emission: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best tags of a run of tokens that stands between tokens outside."""
    n = len(emission)
    came = np.empty((n, 3), np.int8)
    best = emission[0] + move[O]
    for t in range(1, n):
        options = best[:, None] + move
        came[t] = options.argmax(0)
        best = options.max(0) + emission[t]
    tags = np.empty(n, np.int8)
    tags[-1] = (best + move[:, O]).argmax()
    for t in range(n - 1, 0, -1):
        tags[t - 1] = came[t, tags[t]]
    return tags


def decode(emission: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best tags of tokens; the first and the last are outside."""
    tags = np.full(len(emission), O, np.int8)
    margin = 2 * (move.max() - move.min())
    open_ = emission[:, O] - emission[:, :O].max(1) <= margin
    open_[[0, -1]] = False
    edges = np.flatnonzero(np.diff(open_.astype(np.int8)))
    for low, high in zip((edges[::2] + 1).tolist(), (edges[1::2] + 1).tolist(), strict=True):
        tags[low:high] = viterbi(emission[low:high], move)
    return tags


class Tagger:
    """Tags texts with a trained field, remembering the scores of frequent tokens."""

    def __init__(self, model: dict):
        self.weight, self.move = model["weight"], model["move"]
        self.edge = self.weight[(SHAPES + np.arange(len(AROUND))) * SLOTS]
        self._clear()

    def _clear(self):
        self.memo: dict[str, int] = {}
        self.known: dict[bytes, tuple] = {}
        self.table = np.zeros((1, 1 + len(AROUND), 3), np.float32)  # scores of a token itself, and to its neighbours
        self.table[0, 1:] = self.edge

    def _learn(self, rows: list[tuple[int, ...]]) -> None:
        """Scores of new tokens behind the table."""
        rows = np.array(rows)
        own = np.empty((len(rows), 1 + len(AROUND), 3), np.float32)
        own[:, 0] = self.weight[rows].sum(1)
        for k in range(len(AROUND)):
            own[:, 1 + k] = self.weight[rows[:, -1] + (k + 1) * SLOTS]
        self.table = np.concatenate([self.table, own])

    def _number(self, token: str, new: list) -> int:
        number = len(self.table) + len(new)
        new.append(features(token, self.known))
        if len(token) <= MEMO_SIZE:
            self.memo[token] = number
        return number

    def tag(self, texts: list[tuple[str, list[int]]]) -> list[np.ndarray]:
        """Tags of the tokens of several pieces, each with the file rows of its text."""
        if len(self.table) > MEMO:
            self._clear()
        get, gap = self.memo.get, [0] * 3
        ids, sizes, files, new = gap[:], [], [], []
        for text, rows in texts:
            own = [get(t) or self._number(t, new) for t in TOKEN.findall(text)]
            ids += own
            ids += gap
            sizes.append(len(own))
            files.append(self.weight[rows].sum(0))
        if new:
            self._learn(new)
        ids = np.array(ids)
        emission = self.table[ids, 0].astype(np.float64)
        for k, o in enumerate(AROUND, 1):  # the gaps' row 0 is the word beyond the ends
            emission += self.table[np.roll(ids, -o), k]
        starts = 3 + np.concatenate([[0], np.cumsum(np.array(sizes) + 3)[:-1]]).astype(np.int64)
        emission[3:] += np.repeat(files, np.array(sizes) + 3, 0)
        emission[ids == 0] = (-1e9, -1e9, 0)  # gaps are outside
        tags = decode(emission, self.move)
        return [tags[a : a + n] for a, n in zip(starts, sizes, strict=True)]


def pieces_of(text: str) -> Iterator[tuple[int, int, int, int]]:
    """(start, end) of the pieces of a text, cut at white space, and (from, to) with their context."""
    start = 0
    while start < len(text):
        end = _space(text, start + PIECE)
        yield start, end, _space(text, start - OVERLAP) if start > OVERLAP else 0, _space(text, end + OVERLAP)
        start = end


def _space(text: str, at: int) -> int:
    """The first place from `at` on before a white-space character, or the end."""
    found = re.compile(r"\s").search(text, at) if at < len(text) else None
    return found.start() if found else len(text)


def _spans(text: str, tags: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of the tagged secrets of a piece."""
    if not len(tags) or (tags == O).all():
        return []
    out: list[list[int]] = []
    inside = False
    for m, tag in zip(TOKEN.finditer(text), tags.tolist(), strict=True):
        if tag == B or (tag == I and not inside):
            out.append([m.start(), m.end()])
        elif tag == I:
            out[-1][1] = m.end()
        inside = tag != O
    return [(a, b) for a, b in out]


def _added(tagger: Tagger, batch: list[str]) -> list[list[tuple[int, int]]]:
    """Spans that the field finds in each text."""
    out: list[list[tuple[int, int]]] = [[] for _ in batch]
    waiting, size = [], 0

    def flush():
        parts = [(batch[n][low:high], rows) for n, _, _, low, high, rows in waiting]
        for (n, start, end, low, _, _), (part, _), tags in zip(waiting, parts, tagger.tag(parts), strict=True):
            out[n] += [(low + a, low + b) for a, b in _spans(part, tags) if start <= low + a < end]

    for n, text in enumerate(batch):
        rows = file_rows(text)
        for start, end, low, high in pieces_of(text):
            waiting.append((n, start, end, low, high, rows))
            size += high - low
            if size > 4 * BLOCK:
                flush()
                waiting, size = [], 0
    if waiting:
        flush()
    return out


def finder(model: dict | None):
    """Pandas UDF from a text to its secrets: (kind, start, end), by start and kind."""

    @pandas_udf("array<struct<kind: string, start: bigint, end: bigint>>")
    def secrets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = Tagger(model) if model else None
        for batch in batches:
            texts = batch.tolist()
            added = _added(tagger, texts) if tagger else [[] for _ in texts]
            out = []
            for text, more in zip(texts, added, strict=True):
                base = base_matches(text)
                found = [(m[0], m[1], m[2]) for m in base]
                found += [(a, 3, b) for a, b in more if not any(m[0] < b and a < m[2] for m in base)]
                out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(found)])
            yield pd.Series(out)

    return secrets


def find(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs with `secrets`, an array of (kind, start, end) in code points, end exclusive.

    Kinds `assign`, `access` and `hex` are the base rules' matches; `crf` are
    the field's spans that overlap none of them.  Without a model (no secret
    to learn from) only the base rules speak.  A null or empty text has none;
    repeated rows get equal answers; a column already called secrets is
    replaced.  Very long texts are tagged in pieces cut at white space, with
    OVERLAP characters of context around each.
    """
    return docs.withColumn("secrets", finder(model)(whole_text()))


def _of(secrets: str, kinds: tuple[str, ...]) -> Column:
    return F.filter(secrets, lambda s: s["kind"].isin(*kinds))


def number(secrets: str, kind: str) -> Column:
    return F.size(_of(secrets, (kind,))).cast("bigint")


def as_text(secrets: str, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of an array's secrets of some kinds, comma-joined."""
    told = F.transform(_of(secrets, kinds), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return F.array_join(told, ",")
