"""Quality by a byte-level convolutional network.

Filters of four and six bytes run over overlapping chunks of CHUNK bytes that
cover the whole text; their largest responses are averaged over the chunks and
combined into one probability.  The network (`bytenet`) is trained with numpy
on the driver, from a bounded, balanced sample of labelled texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType

from lading.llm import bytenet
from lading.llm.common import agreed_labels, balanced_sample, fold

PER_CLASS = 3000  # sampled training rows of each label; the bound of what is fitted on
CHUNK, STEP = 256, 240  # bytes; chunks overlap by sixteen
TRAIN_CHUNKS = 4  # of each training text, evenly over it
FILTERS = {4: 16, 6: 16}


@pandas_udf(BinaryType())
def _chunks(texts: pd.Series) -> pd.Series:
    whole = (bytenet.windows_of(t or b"", CHUNK, STEP) for t in texts)
    return pd.Series([bytenet.spread(w, TRAIN_CHUNKS).tobytes() for w in whole])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict | None:
    """Fit on at most about per_class documents of each label outside fold 0; None without two labels."""
    agreed = agreed_labels(labels, "quality").filter(fold("doc_id", 5) != 0)
    sample = balanced_sample(agreed, "y", "doc_id", per_class)
    known = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # 2 per_class rows of 12 bytes
    chunks = _chunks(F.col("text").cast("binary")).alias("chunks")
    rows = known.select("doc_id", "y", chunks).toPandas().sort_values("doc_id", kind="stable")
    y = rows["y"].to_numpy(np.int64)
    if len(np.unique(y)) < 2:
        return None
    windows = np.frombuffer(b"".join(rows["chunks"]), np.uint8).reshape(len(y), TRAIN_CHUNKS, CHUNK)
    epochs = max(5, min(60, 30_000 // len(y)))
    return bytenet.fit(windows, y, FILTERS, 2, epochs=epochs)


def scorer(net: dict | None):
    """Pandas UDF from a text's bytes to the probability of label 1."""

    @pandas_udf("double")
    def quality(texts: pd.Series) -> pd.Series:
        if net is None:
            return pd.Series(np.full(len(texts), 0.5))
        chunks = bytenet.responses(bytenet.tables(net), [t or b"" for t in texts], CHUNK, STEP)
        means = np.array([c.mean(0) for c in chunks])
        return pd.Series(bytenet.softmax(means @ net["head"] + net["bias"])[:, 1].astype(float) if len(means) else means)

    return quality


def score(docs: DataFrame, net: dict | None) -> DataFrame:
    """docs with `score` (0 to 1) and `predicted` (1 from 0.3).

    A null or empty text is one chunk of padding.  Without a network (fewer
    than two labels to learn from) every score is 0.5.  Repeated rows get equal
    scores; columns already called score or predicted are replaced.
    """
    scored = docs.withColumn("score", scorer(net)(F.col("text").cast("binary")))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
