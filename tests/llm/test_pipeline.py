"""The pipeline's decisions on a small corpus, each stage on what its predecessor kept."""

import numpy as np

import corpus_pipeline
from test_operators import LAYOUT, plain_print, prose


def closely(text, n):
    """The text with its n-th word changed, if its fingerprint stays within four bits."""
    words = text.split()
    other = " ".join([*words[: n % len(words)], "changed", *words[n % len(words) + 1 :]])
    return other if 0 < (plain_print(text) ^ plain_print(other)).bit_count() <= 4 else None


def test_stages_take_effect(spark, tmp_path):
    rng = np.random.default_rng(2)
    item = prose(999, 30)
    docs = [(i, prose(i, int(rng.integers(60, 90))) + (" idiot scum moron" if i % 4 == 0 else ""), "en", "s", 0) for i in range(200)]
    near = next(t for n in range(3, 90) if (t := closely(docs[2][1], n)))
    docs += [(300, docs[1][1], "en", "s", 0), (301, near, "en", "s", 0), (302, prose(302, 50) + " " + item, "en", "s", 0)]
    docs += [(303, prose(303, 70) + " write to joe@example.com", "en", "s", 0), (304, None, None, None, None)]
    spark.createDataFrame(docs, LAYOUT).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(i % 4 == 0)) for i in range(200)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("b", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {i for i in range(200) if i % 4} | {303, 304}
    assert all(r["lossless"] for r in out.values())
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == [c.split()[0] for c in LAYOUT.split(", ")]
    text = step.filter("doc_id = 303").first()["text"]
    assert "joe@" not in text and text.startswith(prose(303, 70)) and text.endswith(".com")
