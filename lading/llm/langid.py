"""Language of a text by a byte convolutional network.

Filters of two, four and six bytes, max pooling and a softmax over fixed,
overlapping windows of WINDOW bytes, which are scored in batches and cover the whole text;
the windows' log-probabilities are averaged by the bytes they hold.  Trained
with numpy on the driver, from a bounded sample of each language.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType

from lading.llm import bytenet
from lading.llm.common import balanced_sample, fold

PER_LANGUAGE = 1500  # sampled training rows of each language; the bound of what is fitted on
WINDOW = 128
STEP = 123  # windows overlap by the widest filter less one byte, so no place is left out
TRAIN_WINDOWS = 3  # of each training text, evenly over it
FILTERS = {2: 8, 4: 16, 6: 12}
UNKNOWN = "und"


@pandas_udf(BinaryType())
def _windows(texts: pd.Series) -> pd.Series:
    whole = (bytenet.windows_of(t or b"", WINDOW, STEP) for t in texts)
    return pd.Series([bytenet.spread(w, TRAIN_WINDOWS).tobytes() for w in whole])


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], dict | None]:
    """Languages and network, from rows outside fold 2 of 4 with text, letters and a language."""
    known = docs.select("doc_id", "text", "lang").filter(
        (fold("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    )
    sample = balanced_sample(known, "lang", "doc_id", per_language)
    windows = _windows(F.col("text").cast("binary")).alias("windows")
    rows = sample.select("doc_id", "lang", windows).toPandas().sort_values(["doc_id", "lang"], kind="stable")
    langs = sorted(rows["lang"].unique())
    if len(langs) < 2:
        return langs, None
    y = rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64).repeat(TRAIN_WINDOWS)
    x = np.frombuffer(b"".join(rows["windows"]), np.uint8).reshape(len(y), 1, WINDOW)
    epochs = max(3, min(40, 40_000 // len(y)))
    return langs, bytenet.fit(x, y, FILTERS, len(langs), epochs=epochs)


def scorer(langs: list[str], net: dict | None):
    """Pandas UDF from a text's bytes to language and score."""

    @pandas_udf("lang string, score double")
    def language(texts: pd.Series) -> pd.DataFrame:
        if net is None:
            return pd.DataFrame({"lang": [langs[0] if langs else UNKNOWN] * len(texts), "score": 1.0 if langs else 0.0})
        out = []
        raw = [t or b"" for t in texts]
        for text, found in zip(raw, bytenet.responses(bytenet.tables(net), raw, WINDOW, STEP), strict=True):
            logs = np.log(bytenet.softmax(found @ net["head"] + net["bias"]) + 1e-9)
            held = np.full(len(logs), WINDOW)
            held[-1] = max(1, len(text) - STEP * (len(logs) - 1))
            p = bytenet.softmax((logs * held[:, None]).sum(0) / held.sum())
            best = int(p.argmax())
            out.append((langs[best], float(p[best])))
        return pd.DataFrame(out, columns=["lang", "score"])

    return language


def predict(docs: DataFrame, langs: list[str], net: dict | None) -> DataFrame:
    """docs with `lang_pred` and `score` (0 to 1).

    Null texts and texts without a letter are `und` with score 0; so is every
    text if no language was learned.  If one was, each text with a letter gets
    it with score 1.  Of languages of equal probability the first in order is
    taken.  Repeated rows get equal answers; columns already called
    lang_pred or score are replaced.
    """
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    found = docs.withColumn("__found", scorer(langs, net)(F.col("text").cast("binary")))
    return found.withColumns(
        {
            "lang_pred": F.when(lettered, F.col("__found.lang")).otherwise(UNKNOWN),
            "score": F.when(lettered, F.col("__found.score")).otherwise(0.0),
        }
    ).drop("__found")
