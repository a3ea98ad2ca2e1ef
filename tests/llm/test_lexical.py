import math
import re
from collections import Counter

import numpy as np
import pytest

from lading.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k=10):
    found = [(i, Counter(plain_terms(t))) for i, t in docs]
    found = [(i, c, c.total()) for i, c in found if c]
    n_docs, n_terms = len(found), sum(n for _, _, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for t, x in df.items()}
    asked = {}
    for item, text in set(items):
        asked.setdefault(item, Counter()).update(plain_terms(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for doc, tfs, n in found:
            m = 25 + 75 * n * n_docs // n_terms
            score = sum(
                times * weight[t] * (10**9 * tfs[t] // (1000 * tfs[t] + 8 * m)) for t, times in terms.items() if t in tfs
            )
            if score > 0 and doc is not None:
                scored.append((-score, doc))
        out += [(item, rank, doc, -score) for rank, (score, doc) in enumerate(sorted(scored)[:k], 1)]
    return out


def both(spark, docs, items, **options):
    frame = spark.createDataFrame([(i, t, 5, 6) for i, t in docs], "doc_id bigint, text string, score int, rank int")
    asked = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id bigint, text string, doc_id int")
    got = sorted(map(tuple, lexical.search(frame.repartition(5), asked, **options).collect()), key=repr)
    return got, sorted(plain_search(docs, items), key=repr)


@pytest.mark.parametrize("block", [1 << 17, 40])
def test_search_as_a_plain_one(spark, block):
    rng = np.random.default_rng(4)
    words = ["ärger", "Zebra", "x1", "the", "of", "日本", "GmbH", *(f"w{i}" for i in range(60))]
    docs = [(i, " ,".join(rng.choice(words, rng.integers(0, 90)))) for i in range(300)]
    docs += [(400 + i, docs[3][1]) for i in range(40)]  # ties beyond the tenth rank
    docs += [docs[5], docs[5], (500, None), (501, ""), (502, "!? --"), (None, docs[3][1]), (503, "zebra " * 5000)]
    items = [(i, ";".join(rng.choice(words, 12))) for i in range(30)]
    items += [(0, "another text of item w1"), items[4], (90, None), (91, "nowhere"), (None, "zebra X1"), (92, docs[3][1])]
    got, wanted = both(spark, docs, items, block=block)
    assert got == wanted
    assert len({r[:2] for r in got}) == len(got)


def test_no_documents_or_queries(spark):
    assert both(spark, [], [(1, "a b")])[0] == []
    assert both(spark, [(1, "a b")], [])[0] == []
    assert both(spark, [(1, None), (2, "--")], [(1, "a")])[0] == []


def test_a_tile_never_reaches_the_bound_of_exact_sums():
    rng = np.random.default_rng(9)
    n = 900
    query, term = rng.integers(0, 600, n), rng.integers(0, 700, n)
    pairs = np.unique(np.stack([query, term], 1), axis=0)
    times = rng.choice([1, 3, 10**6, 10**9], len(pairs))
    weight = rng.integers(0, 40_000, 700)
    found = Counter()
    for low, places, counts in lexical.tiles(pairs[:, 0], pairs[:, 1], times, weight):
        assert len(places) <= lexical.TILE_TERMS and len(set(places)) == len(places)
        load = Counter()
        for row, column, count in counts.tolist():
            assert row < lexical.TILE_QUERIES
            load[row] += count * int(weight[places[column]]) * lexical.SATURATED
            found[low + row, int(places[column])] += count
        assert max(load.values()) < 2**53
    assert found == {(q, t): c for (q, t), c in zip(pairs.tolist(), times.tolist(), strict=True) if weight[t]}
