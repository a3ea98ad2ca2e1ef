import itertools
import re
import string

import numpy as np
import pytest

from lading.llm import secrets

A = '(password|passwd|secret|token|api_?key)["\']?\\x20*[:=]\\x20*["\']?([A-Za-z0-9+/_.=-]+)'


def plain_base(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(A, text, re.A | re.I) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def key(rng, alphabet, n):
    return "".join(rng.choice(list(alphabet), n))


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "Straße", "hesh", "and,", "on.", "für", "anderson", "42", "(see", "1999)"], n))


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(2)
    texts = []
    for i in range(1500):
        secret = [
            f'token = "{key(rng, "0123456789abcdef", 40)}"',
            f"password={key(rng, string.ascii_letters + string.digits, 18)}",
            f"api_key: {key(rng, string.ascii_letters + string.digits, 32)}",
            f"mail me at {key(rng, string.ascii_lowercase, 8)}@example.com",
            f"call +49 30 {key(rng, string.digits, 7)}",
            f"see http://example.com/{key(rng, string.ascii_lowercase, 20)}",
        ][i % 6]
        texts.append(f"{prose(rng, 30)} {secret} {prose(rng, 30)}")
    return texts


def trained(texts, seed=0):
    return secrets.fit(np.array([w for i, t in enumerate(texts) for w in secrets.training_windows(t, seed + i)]))


@pytest.fixture(scope="module")
def model(corpus):
    return trained(corpus)


def test_base_rules():
    rng = np.random.default_rng(8)
    parts = ["token", "Api_Key", "APIKEY", "passWD", "ſecret=abcdefg", "=", ":", " ", '"', "'", "abcdef", "AKIA", "0123456789abcdef",
             "XYZ0123456789ABCDEFG", "ñ", "K", ".", "-", "\n", "AKIAAKIA"]
    texts = ["", *("".join(rng.choice(parts, rng.integers(1, 14))) for _ in range(4000))]
    for text in texts:
        assert [(a, k, b) for a, k, b, _, _ in secrets.base_matches(text)] == plain_base(text), text


def test_gradients(corpus):
    rows = np.array([w for i, t in enumerate(corpus[:12]) for w in secrets.training_windows(t, i)])
    short = np.full((1, *rows.shape[1:]), -1)
    short[0, :3] = rows[0, 5:8]
    rows = np.concatenate([rows, short])
    rng = np.random.default_rng(0)
    weight, move = rng.normal(0, 0.3, (secrets.ROWS, 3)), rng.normal(0, 0.3, (3, 3))
    _, by_weight, by_move = secrets.loss_and_grad(weight, move, rows)

    def nudged(array, at, own):
        around = []
        for step in (1e-5, -1e-5):
            other = array.copy()
            other[at] += step
            around.append(secrets.loss_and_grad(*own(other), rows)[0])
        return (around[0] - around[1]) / 2e-5

    for at in itertools.product(range(3), range(3)):
        assert nudged(move, at, lambda m: (weight, m)) == pytest.approx(by_move[at], abs=1e-6)
    for row in rng.choice(np.unique(rows[:, :, :-1][rows[:, :, -1] >= 0]), 12):
        assert nudged(weight, (row, 1), lambda w: (w, move)) == pytest.approx(by_weight[row, 1], abs=1e-6)


def test_likelihoods_sum_to_one():
    """Over all taggings of a window of five tokens."""
    rng = np.random.default_rng(1)
    weight, move = rng.normal(0, 1, (secrets.ROWS, 3)), rng.normal(0, 1, (3, 3))
    rows = np.full((3**5, secrets.WINDOW, secrets.SHAPES + len(secrets.AROUND) + secrets.FILE + 1), -1)
    rows[:, :5, :-1] = rng.integers(0, secrets.ROWS, (5, rows.shape[2] - 1))
    rows[:, :5, -1] = list(itertools.product(range(3), repeat=5))
    each = [secrets.loss_and_grad(weight, move, r[None])[0] for r in rows]
    assert np.exp(-np.array(each)).sum() == pytest.approx(1)


@pytest.mark.parametrize("scale", [0.2, 1, 4])
def test_decoding_finds_the_best_tagging(scale):
    rng = np.random.default_rng(int(scale * 10))
    for _ in range(60):
        move = rng.normal(0, 1, (3, 3))
        emission = rng.normal(0, scale * 3, (8, 3))
        emission[[0, -1]] = (-1e9, -1e9, 0)
        best = max(
            ((secrets.O, *t, secrets.O) for t in itertools.product(range(3), repeat=6)),
            key=lambda t: emission[range(8), t].sum() + move[t[:-1], t[1:]].sum(),
        )
        assert secrets.decode(emission, move).tolist() == list(best)


def test_the_field_finds_secrets_that_no_rule_describes(model):
    rng = np.random.default_rng(77)
    alnum = string.ascii_letters + string.digits
    found = clean = 0
    for _ in range(200):
        secret = key(rng, alnum, int(rng.integers(18, 40)))
        text = f"{prose(rng, 20)} {rng.choice(['auth', 'credential', 'key'])} = \"{secret}\" {prose(rng, 20)}"
        assert plain_base(text) == []
        ((*spans,),) = secrets._added(secrets.Tagger(model), [text])
        found += any(text[a:b] == secret for a, b in spans)
        plain = f"{prose(rng, 40)} mail {key(rng, string.ascii_lowercase, 9)}@example.org or +49 30 {key(rng, string.digits, 7)}"
        clean += not secrets._added(secrets.Tagger(model), [plain])[0]
    assert found >= 180 and clean >= 195


def test_long_texts_are_tagged_as_short_ones(model, monkeypatch):
    rng = np.random.default_rng(3)
    parts = [f'{prose(rng, 40)} auth = "{key(rng, string.ascii_letters + string.digits, 24)}"' for _ in range(60)]
    whole = " ".join(parts)
    spans = secrets._added(secrets.Tagger(model), [whole])
    monkeypatch.setattr(secrets, "PIECE", 500)
    monkeypatch.setattr(secrets, "MEMO", 50)
    assert secrets._added(secrets.Tagger(model), [whole]) == spans and len(spans[0]) >= 50
    assert secrets._added(secrets.Tagger(model), ["", "a" * 5000, " "]) == [[], [], []]


def test_find(spark, model, corpus):
    rows = [(i, t, 0) for i, t in enumerate(corpus[:40])] + [(1, corpus[1], 0), (90, None, 0), (91, "", 0), (None, 'token="abcdefgh"', 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, secrets int")
    for own in (model, None):
        out = secrets.find(docs, own).collect()
        assert len(out) == len(rows)
        for row in out:
            base = [(s["start"], secrets.KINDS.index(s["kind"]), s["end"]) for s in row["secrets"] if s["kind"] != "crf"]
            assert base == plain_base(row["text"] or "")
            starts = [s["start"] for s in row["secrets"]]
            assert starts == sorted(starts)
            assert own or len(row["secrets"]) == len(base)
    shown = secrets.find(docs, None).select(secrets.as_text("secrets").alias("t"), secrets.number("secrets", "assign").alias("n"))
    assert ("assign:0:15", 1) in [tuple(r) for r in shown.collect()]


def test_train(spark, corpus):
    docs = spark.createDataFrame([(t,) for t in corpus[:300]], "text string")
    first = secrets.train(docs.union(docs))
    again = secrets.train(docs.repartition(7))
    assert np.allclose(first["weight"], again["weight"])
    assert secrets.train(docs.limit(0)) is None
    assert secrets.train(spark.createDataFrame([("no secrets",), (None,)], "text string")) is None
