"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct lower-cased words and their openings of three,
four and five characters, each hashed.  The score is

    sigmoid(w0 + sum w_i + 1/2 (|sum v_i|^2 - sum |v_i|^2)),

so that pairs of terms count beyond their own weights.  Weights are learned
with numpy on the driver from a bounded, balanced sample, for two kinds of
terms: those whose own share of texts differs between the labels by LEAST_Z
standard errors, and those of a pair that tells the labels apart although its
terms may not: where the one stands, the other's share differs between the
labels otherwise than where it doesn't.  So a word that is neutral by itself,
as the name of a group, has its factors.  Other terms have none.  Scoring goes
through all of every text, in Arrow batches.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType

from lading.llm.common import agreed_labels, balanced_sample, fold

PER_CLASS = 5000  # sampled training rows of each label; the bound of what is fitted on
SLOTS = 1 << 22  # hashed terms
BLOCK = 1 << 18  # slots weighed at once, to spare the driver's memory
LEAST_Z = 3.0
PAIR_TERMS = 2048  # most frequent terms whose pairs are compared
PAIR_SHARES = 0.005, 0.9  # of the sampled texts that hold such a term
PAIR_Z, PAIR_LEAST = 6.0, 0.8  # how sure and how large the difference of a pair must be
RANK, EPOCHS, BATCH, RATE = 4, 12, 64, 0.1
BEGIN = 0.02  # size of the first, random factors; with 0 the machine stays linear
FAINT = 0.01  # squared length of factors that can be left out
LASSO = 0.0002  # shrinks single weights to zero; factors are kept whatever the single weight
WORD = re.compile(r"[^\W_]+")
MEMO, MEMO_SIZE = 1 << 17, 32  # words whose terms a task remembers, and their greatest length: some 30 MB


def terms_of(word: str) -> list[int]:
    """Hashed terms of a word: itself and its openings."""
    parts = {word} | {f"{word[:n]}*" for n in (3, 4, 5) if len(word) > n}
    return [zlib.crc32(p.encode()) % SLOTS for p in parts]


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


@pandas_udf(BinaryType())
def _terms(texts: pd.Series) -> pd.Series:
    """Distinct terms of each text as the bytes of 32-bit numbers."""
    found = (np.unique([t for w in words_of(x) for t in terms_of(w)]).astype("<i4") for x in texts)
    return pd.Series([f.tobytes() for f in found])


def _by_row(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Column sums of `values` within each of n rows."""
    return np.stack([np.bincount(rows, c, n) for c in values.T], 1)


def margins(w0, w, v, flat, sizes):
    """Log-odds of several texts, whose terms lie one after another in `flat`."""
    rows, n = np.repeat(np.arange(len(sizes)), sizes), len(sizes)
    own = v[flat]
    total = _by_row(rows, own, n)
    square = np.bincount(rows, (own**2).sum(1), n)
    return w0 + np.bincount(rows, w[flat], n) + 0.5 * ((total**2).sum(1) - square), total, rows


def telling(texts: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Terms whose share of texts differs between the labels beyond chance."""
    seen = [np.zeros(SLOTS, np.int32) for _ in range(2)]
    for t, label in zip(texts, y, strict=True):
        seen[label][t] += 1  # a text's terms are distinct
    sizes = np.bincount(y, minlength=2)
    found = []
    for at in range(0, SLOTS, BLOCK):
        no, yes = (s[at : at + BLOCK] for s in seen)
        both = (no + yes) / sizes.sum()
        error = np.sqrt(both * (1 - both) * (1 / sizes[0] + 1 / sizes[1])) + 1e-12
        found.append(at + np.flatnonzero(np.abs(yes / sizes[1] - no / sizes[0]) >= LEAST_Z * error))
    return np.concatenate(found)


def paired(texts: list[np.ndarray], y: np.ndarray, block: int = 256) -> np.ndarray:
    """Terms of the pairs that interact: the share of texts with the second differs between the labels
    by another amount where the first stands than where it doesn't, by PAIR_Z standard errors and PAIR_LEAST."""
    seen = np.zeros(SLOTS, np.int32)
    for t in texts:
        seen[t] += 1
    low, high = (share * len(texts) for share in PAIR_SHARES)
    ids = np.flatnonzero((seen >= max(low, 5)) & (seen <= high))
    ids = np.sort(ids[np.argsort(-seen[ids], kind="stable")[:PAIR_TERMS]])
    if not len(ids):
        return ids
    both = np.zeros((2, len(ids), len(ids)), np.float32)
    for label in (0, 1):
        own = [t for t, x in zip(texts, y, strict=True) if x == label]
        for at in range(0, len(own), 1000):
            part = np.zeros((len(own[at : at + 1000]), len(ids)), np.float32)
            for row, t in zip(part, own[at : at + 1000], strict=True):
                row[np.searchsorted(ids, t[np.isin(t, ids)])] = 1
            both[label] += part.T @ part
    sizes = np.bincount(y, minlength=2)
    alone = np.diagonal(both, axis1=1, axis2=2)  # texts with each term, by label
    found = np.zeros(len(ids), bool)
    for at in range(0, len(ids), block):
        moved, error = 0.0, 0.0
        for label, sign in ((1, 1), (0, -1)):
            for held, way in ((True, 1), (False, -1)):
                first = alone[label][at : at + block, None]
                joint = both[label][at : at + block]
                n = first if held else sizes[label] - first
                share = ((joint if held else alone[label] - joint) + 0.5) / (n + 1)
                moved = moved + sign * way * share
                error = error + share * (1 - share) / (n + 1)
        hit = np.abs(moved) >= np.maximum(PAIR_LEAST, PAIR_Z * np.sqrt(error))
        hit[np.arange(len(hit)), at + np.arange(len(hit))] = False
        found[at : at + block] |= hit.any(1)
        found |= hit.any(0)
    return ids[found]


def fit(texts: list[np.ndarray], y: np.ndarray, prior: float, seed: int = 7) -> dict:
    """Weights and factors of the telling terms; adaptive gradient steps with soft thresholds.

    prior: share of label 1 among all training rows, which the balanced sample hides.
    """
    if not len(texts) or len(np.unique(y)) < 2:  # nothing to tell apart: the one label seen, or 0
        base = 8.0 if len(y) and y[0] == 1 else -8.0
        return {"ids": np.zeros(0, int), "w0": base, "w": np.zeros(0), "v": np.zeros((0, RANK))}
    ids = np.union1d(telling(texts, y), paired(texts, y))
    own = [np.searchsorted(ids, t[np.isin(t, ids)]) for t in texts]
    rng = np.random.default_rng(seed)
    w0, w, v = 0.0, np.zeros(len(ids)), rng.normal(0, BEGIN, (len(ids), RANK))
    g0, gw, gv = 1e-6, np.full(len(ids), 1e-6), np.full(v.shape, 1e-6)
    share = y.mean()
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    weight = np.sqrt(weight / weight.mean())  # halfway between the balanced and the true prior
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(len(own)), max(1, len(own) // BATCH)):
            part = [own[i] for i in at]
            sizes = np.array([len(p) for p in part])
            flat = np.concatenate(part).astype(np.int64)
            m, total, rows = margins(w0, w, v, flat, sizes)
            err = (1 / (1 + np.exp(-np.clip(m, -30, 30))) - y[at]) * weight[at] / len(at)
            d0 = err.sum()
            g0 += d0**2
            w0 -= RATE * d0 / np.sqrt(g0)
            live, back = np.unique(flat, return_inverse=True)
            dw = np.bincount(back, err[rows], len(live))
            dv = _by_row(back, err[rows, None] * (total[rows] - v[flat]), len(live))
            gw[live] += dw**2
            gv[live] += dv**2
            step = RATE / np.sqrt(gw[live])
            moved = w[live] - step * dw
            w[live] = np.sign(moved) * np.maximum(np.abs(moved) - step * LASSO, 0)
            v[live] -= 0.2 * RATE / np.sqrt(gv[live]) * (dv + LASSO * v[live])
    used = (w != 0) | ((v**2).sum(1) > FAINT)
    return {"ids": ids[used], "w0": float(w0), "w": w[used], "v": v[used]}


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict:
    """Fit on at most about per_class documents of each label, outside the held-out fold 0."""
    agreed = agreed_labels(labels, "toxic").filter(fold("doc_id", 5) != 0)
    sizes = {r["y"]: r["count"] for r in agreed.groupBy("y").count().collect()}
    sample = balanced_sample(agreed, "y", "doc_id", per_class)
    known = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # 2 per_class rows of 12 bytes
    rows = known.select("doc_id", "y", _terms("text").alias("terms")).toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    prior = sizes.get(1, 0) / max(1, sum(sizes.values()))
    return fit([np.frombuffer(t, "<i4") for t in rows["terms"]], rows["y"].to_numpy(), prior)


def scorer(model: dict):
    """Pandas UDF text -> probability."""

    @pandas_udf("double")
    def toxicity(texts: pd.Series) -> pd.Series:
        at = {int(t): i for i, t in enumerate(model["ids"])}
        memo: dict[str, list[int]] = {}
        sizes, flat = [], []
        for text in texts:
            found: set[int] = set()
            for word in words_of(text):
                own = memo.get(word)
                if own is None:
                    own = [at[t] for t in terms_of(word) if t in at]
                    if len(memo) >= MEMO:
                        memo.clear()
                    if len(word) <= MEMO_SIZE:
                        memo[word] = own
                found.update(own)
            sizes.append(len(found))
            flat.extend(sorted(found))
        flat, sizes = np.array(flat, np.int64), np.array(sizes, np.int64)
        m, _, _ = margins(model["w0"], model["w"], model["v"], flat, sizes)
        return pd.Series(1 / (1 + np.exp(-np.clip(m, -30, 30))))

    return toxicity


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs with `score` (0 to 1) and `predicted` (1 from 0.5).

    A null or empty text has no terms and gets the model's intercept.  Repeated
    rows get equal scores; other columns are kept, except that columns already
    called score or predicted are replaced.
    """
    scored = docs.withColumn("score", scorer(model)(F.col("text")))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
