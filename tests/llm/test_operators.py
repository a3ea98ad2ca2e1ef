"""Each operator against a plain version on small tables, with nulls, empty and long texts, ties and repeats."""

import itertools
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lading.llm import bytenet, components, decontaminate, imatch, langid, licenses, pieces, pii, quality, simhash, toxicity, warc

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
LAYOUT = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed: int, n: int) -> str:
    return " ".join(np.random.default_rng(seed).choice(WORDS, n).tolist())


ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (4, "Ünï ▁ 日本 😀\x00", "de", "s", 9),
    (5, prose(5, 40), "en", "s", 1), (5, prose(5, 40), "en", "s", 1), (6, prose(5, 40), "en", "t", 1),
    (7, prose(7, 9000), "en", "s", 1), (None, "no id here", None, None, None), (8, "x" * 30000, "en", "s", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, i, "own") for i, r in enumerate(ODD)], LAYOUT + ", score int, fingerprint string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], LAYOUT)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(8, 40)]
    edges = spark.createDataFrame([*chain, *star, (50, 50), (None, 3), (7, 8)], "a bigint, b bigint")
    found = dict(components.components(edges, "a", "b").collect())
    assert found == {i: 100 for i in range(100, 161)} | {i: 7 for i in range(7, 40)}
    assert components.components(edges.limit(0), "a", "b").count() == 0


def plain_print(text, k=4):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def test_every_pair_within_the_radius_shares_a_table():
    kept = [m & (2**64 - 1) for m in simhash.masks()]
    rng = np.random.default_rng(1)
    flips = itertools.chain(itertools.combinations(range(64), 2), (rng.choice(64, 4, False).tolist() for _ in range(3000)))
    for places in flips:
        flip = sum(1 << int(i) for i in places)
        assert any(flip & m == 0 for m in kept)


@pytest.mark.parametrize("crowd", [2, 256])
def test_links_connect_what_is_near(spark, crowd):
    rng = np.random.default_rng(3)
    prints = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 20)]
    for p in prints[:6]:
        for _ in range(6):
            p ^= sum(1 << int(i) for i in rng.choice(63, rng.integers(1, 6), False))
            prints.append(p)
    nodes = list(enumerate(dict.fromkeys(prints)))
    found = simhash.links(spark.createDataFrame(nodes, "id bigint, fp bigint"), crowd=crowd)
    got = dict(components.components(found, "a", "b").collect())
    parent = {i: i for i, _ in nodes}
    for _ in nodes:
        for (i, x), (j, y) in itertools.combinations(nodes, 2):
            if ((x ^ y) & (2**64 - 1)).bit_count() <= 4:
                parent[i] = parent[j] = min(parent[i], parent[j])
    assert {i: got.get(i, i) for i, _ in nodes} == parent


def test_simhash_groups(spark, odd, none):
    out = simhash.simhash_groups(odd).collect()
    assert len(out) == len(ODD)
    wanted = sorted((r[0] or 0, f"{plain_print(r[1]):016x}") for r in ODD if r[0] != 7)
    assert sorted((r[0] or 0, r[1]) for r in out if r[0] != 7) == wanted
    of = {r["doc_id"]: r["component_id"] for r in out}
    assert of[1] == of[2] == of[3] == 1 and of[5] == of[6] == 5 and of[7] == 7 and of[None] is None
    assert simhash.simhash_groups(none).count() == 0


def test_keep_one_of_each_group(spark, odd, none):
    texts = [prose(s, 120) for s in range(30)]
    texts += [" ".join([*t.split()[:i], "changed", *t.split()[i + 1 :]]) for i, t in enumerate(texts[:20])] + texts[25:]
    prints = [plain_print(t) for t in texts]
    parent = list(range(len(texts)))
    for _ in texts:
        for i, j in itertools.combinations(range(len(texts)), 2):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[i] = parent[j] = min(parent[i], parent[j])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = {r[0] for r in simhash.keep_one(docs).select("doc_id").collect()}
    assert kept == set(parent) and len(kept) <= 45
    left = simhash.keep_one(odd).select("doc_id").collect()
    assert sorted(r[0] or 0 for r in left) == [0, 1, 4, 5, 7, 8]
    assert simhash.keep_one(none).columns == none.columns


def test_overlaps_tolerate_replaced_words(spark, odd, none):
    items = [(f"i{n}", prose(100 + n, 15 + 3 * n)) for n in range(8)] + [(None, prose(1, 30)), ("null", None)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs, wanted = [], set()
    for n in range(8):
        words = items[n][1].split()
        docs.append((n, prose(n, 200) + " " + " ".join(words) + " " + prose(n + 50, 10)))
        wanted.add((n, f"i{n}"))
        if len(words) >= 30:
            words[5] = words[20] = "other"
            docs.append((n + 20, " ".join(words).upper()))
            wanted.add((n + 20, f"i{n}"))
    docs += [(n + 40, prose(n + 900, 300)) for n in range(5)] + [(60, items[7][1]), (60, items[7][1])]
    wanted.add((60, "i7"))
    found = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id bigint, text string"), bench)
    got = {(r["doc_id"], r["item_id"]): r for r in found.collect()}
    assert set(got) == wanted and found.count() == len(wanted)
    assert got[27, "i7"]["n_words"] - got[27, "i7"]["n_equal"] == 2
    assert decontaminate.overlaps(odd, bench.limit(0)).count() == 0
    cleaned = decontaminate.clean(odd, bench)
    assert cleaned.columns == odd.columns and cleaned.count() == len(ODD)
    assert decontaminate.clean(none, bench).count() == 0


def test_stretch_of_most_equal_words():
    rng = np.random.default_rng(4)
    for n in [*range(1, 40)] * 8:
        item = np.arange(n)
        text = np.where(rng.random(n) < rng.choice([0.1, 0.25, 0.5]), -1, item)
        same = (item == text).tolist()
        spans = [same[a:b] for a, b in itertools.combinations(range(n + 1), 2)]
        most = max((sum(x) for x in spans if 5 * sum(x) >= 4 * len(x)), default=0)
        at, length, equal = decontaminate.stretch(np.concatenate([[-2, -2], text]), item, 2)
        assert equal == most == sum(same[at : at + length]) and 5 * equal >= 4 * length


def test_more_overlap_is_not_less_detected(spark):
    words = [f"w{i}" for i in range(60)]
    runs = words[:12] + ["x"] * 5 + words[17:29] + ["y"] * 5 + words[34:46] + ["z"] * 14
    docs = spark.createDataFrame([(1, " ".join(runs)), (2, " ".join(words[:12] + ["x"] * 48))], "doc_id bigint, text string")
    bench = spark.createDataFrame([("b", " ".join(words)), ("c", " ".join(words[:46]))], "item_id string, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(docs, bench).collect()}
    assert found == {(1, "b"), (1, "c"), (2, "b"), (2, "c")}


def test_every_stretch_that_counts_has_a_seed():
    def has(kept, gaps):
        run = kept & (kept >> 1) & (kept >> 2)
        return any(run & (run >> (3 + g)) for g in gaps) if gaps else run

    for n in range(decontaminate.LEAST_ITEM, 30):
        # as a whole item of n words, and as a stretch of n words of an item of 15 words or more
        wanted = min(12, -(-4 * n // 5))
        for replaced in range(min(n - wanted, n // 5) + 1):
            for places in itertools.combinations(range(n), replaced):
                kept = (1 << n) - 1 - sum(1 << i for i in places)
                assert has(kept, decontaminate.GAPS if n >= 12 else ())
    for n, wanted in ((12, 10), (13, 11)):  # items whose stretches may be shorter than they are
        for size in range(wanted, n + 1):
            for places in itertools.combinations(range(size), size - wanted):
                assert 5 * wanted < 4 * size or has((1 << size) - 1 - sum(1 << i for i in places), decontaminate.GAPS)


def test_few_words_replaced_in_short_items_are_found(spark):
    docs, bench, wanted = [], [], set()
    for n, replaced in ((15, (2, 3)), (15, (3, 7, 11)), (15, (0, 5, 14)), (20, (4, 7, 12, 15)), (14, (4, 9)), (12, (0,)), (12, (3, 6)), (11, (3, 6)), (6, (3,))):
        i = len(docs)
        words = [f"w{i}x{j}" for j in range(n)]
        bench.append((f"b{i}", " ".join(words)))
        for j in replaced:
            words[j] = "other"
        docs.append((i, f"before it {' '.join(words)} after it"))
        wanted.add((i, f"b{i}"))
    found = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id string, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == wanted


def test_short_items_are_compared_whole(spark):
    docs = [(1, "so Alpha, beta it is"), (2, "beta alpha"), (3, "gamma delta epsilon zeta eta"), (4, "gamma delta epsilon zeta"), (5, "solo")]
    bench = [("two", "alpha beta"), ("five", "Gamma delta epsilon zeta eta."), ("one", "SOLO"), ("none", "-- !")]
    found = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id string, text string"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, "two", 1, 0, 2, 2), (3, "five", 0, 0, 5, 5), (5, "one", 0, 0, 1, 1)]


def test_overlaps_as_a_search_of_all_alignments(spark):
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(3000)]
    items = [rng.choice(words, rng.integers(1, 60)).tolist() for _ in range(40)]
    docs = []
    for _ in range(150):
        text = rng.choice(words, rng.integers(0, 60)).tolist()
        for _ in range(rng.integers(0, 3)):
            item = items[rng.integers(len(items))]
            a, b = sorted(rng.integers(0, len(item) + 1, 2))
            part = [w if rng.random() > 0.12 else "other" for w in item[a:b]]
            text += part + rng.choice(words, rng.integers(0, 9)).tolist()
        docs.append(text)
    memo = decontaminate.Memo()
    hashed = [[decontaminate.word_hashes(" ".join(t), memo).astype(np.int64) for t in part] for part in (docs, items)]
    wanted = {}
    for (d, text), (i, item) in itertools.product(enumerate(hashed[0]), enumerate(hashed[1])):
        found = [decontaminate.stretch(text, item, s)[2] for s in range(-len(item) + 1, len(text))]
        if max(found, default=0) >= decontaminate.least_equal(len(item)):
            wanted[d, f"i{i}"] = max(found)
    got = decontaminate.overlaps(
        spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(docs)], "doc_id bigint, text string"),
        spark.createDataFrame([(f"i{i}", " ".join(t)) for i, t in enumerate(items)], "item_id string, text string"),
    )
    assert {(r["doc_id"], r["item_id"]): r["n_equal"] for r in got.collect()} == wanted and len(wanted) > 30


def test_permutation_is_one_to_one_and_moves_all():
    key = b"k" * 32
    for size in (2, 7, 100, 1000):
        moved = [pii.shifted(i, size, key, b"s") for i in range(size)]
        assert sorted(moved) == list(range(size)) and all(i != m for i, m in enumerate(moved))
    assert pii.shifted(0, 1, key, b"s") == 0


def test_surrogates_keep_type_format_gender_and_identity(spark, odd, none):
    text = (
        "Write Bob.3@mail7.example.com or bob.3@MAIL7.example.com, call +1 (017) 555-7713 or +1 017-555-7713, from 97.51.17.173, "
        'card 4111 1111 1111 1111, token = "5d190bd7c06284de91015a36974748794293dd8a". Anna Weber met Mr. Weber; Иван Петров.'
    )
    masker = pii.Masker("key")
    masked, seen = masker.mask(text)
    by = {a: b for _, a, b in seen}
    assert [k for k, _, _ in seen] == ["email", "email", "phone", "phone", "ipv4", "card", "secret", "person", "person", "person"]
    assert by["Bob.3@mail7.example.com"] == by["bob.3@MAIL7.example.com"] and "Bob" not in masked
    digits = lambda s: "".join(c for c in s if c.isdigit())
    assert digits(by["+1 (017) 555-7713"]) == digits(by["+1 017-555-7713"]) and by["+1 (017) 555-7713"][:4] == "+1 ("
    card = digits(by["4111 1111 1111 1111"])
    assert pii.luhn(card[:-1]) % 10 == int(card[-1]) and by["4111 1111 1111 1111"].count(" ") == 3
    given, surname = by["Anna Weber"].split()
    assert given in pii.GIVEN["latin", "f"] and surname == by["Weber"] and by["Иван Петров"].split()[0] in pii.GIVEN["cyrillic", "m"]
    assert all(a.lower() != b.lower() for a, b in by.items())
    docs = spark.createDataFrame([(i, f"mail u{i}@example.org now") for i in range(300)], "doc_id bigint, text string")
    out = pii.mask(docs, "key").collect()
    assert len({r["text"] for r in out}) == 300 and all(r["n_replaced"] == 1 and r["kinds"] == "email" for r in out)
    plain = pii.mask(odd, "key")
    assert rows(plain.select("doc_id", "text")) == rows(odd.select("doc_id", "text"))
    assert pii.mask(none, "key").count() == 0
    clash = spark.createDataFrame([("email", "a", "x"), ("email", "b", "x")], "kind string, entity string, surrogate string")
    assert rows(pii.collisions(clash)) == [("email", "x")]


def test_secrets_and_addresses_are_replaced_whole():
    masker = pii.Masker("key")
    letters = np.random.default_rng(6).choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789"), 4000).tolist()
    values = ["".join(letters[:300]), "".join(letters), "eyJhbGciOi.eyJzdWIiOiIx.SflKxwRJSM", "abc~DEF+/12345==", "".join(letters[:299]) + "Q"]
    for value in values:
        masked, seen = masker.mask(f"token = {value}. Next")
        assert seen[0][:2] == ("secret", value) and masked == f"token = {seen[0][2]}. Next"
        assert sum(a == b for a, b in zip(value, seen[0][2], strict=True) if a.isalnum()) < 0.3 * len(value)
    others = [masker.mask(f"token = {v}")[1][0][2] for v in values]
    assert len(set(others)) == len(values) and all(len(a) == len(b) for a, b in zip(values, others, strict=True))
    local = "user" * 30
    masked, seen = masker.mask(f"write to {local}@{'label' * 20}.{'a.' * 12}example.com now")
    assert "user" not in masked and "label" not in masked and "example" not in masked and seen[0][1].startswith(local)
    long = pii.same_shape("ab" * 400, masker.key, "x")
    assert long[:256] != long[256:512] and pii.same_shape("ab" * 399 + "ac", masker.key, "x")[:512] == long[:512]


@pytest.mark.parametrize("entity", ["李小龙@例子公司.com", "محمد@مثال.com", "उपयोगकर्ता@डाटामेल.com", "żółć@łąka.com", "+٩٦٦ ٥٥٥ ١٢٣ ٤٥٦٧", "соловьёв@почта.com"])
def test_every_script_has_surrogates(entity):
    masked, seen = pii.Masker("key").mask(f"call {entity} now")
    assert [a for _, a, _ in seen] == [entity] and len(masked) == len(entity) + 9
    import unicodedata

    replaced = 0
    for a, b in zip(entity.split(".com")[0], seen[0][2].split(".com")[0], strict=True):
        assert unicodedata.category(a) == unicodedata.category(b)
        replaced += a != b
    assert replaced >= 3


def test_what_cannot_be_replaced_is_not_counted(spark):
    out = pii.mask(spark.createDataFrame([(1, "see +@-._ and token = ------------")], "doc_id bigint, text string"), "key").first()
    assert out["n_replaced"] == 0 and out["kinds"] == "" and out["text"] == "see +@-._ and token = ------------"
    key = b"k" * 32
    for symbols in ("ąćęł", "0٣", "中"):
        turned = {pii.same_shape(a, key, "x") for a in symbols for _ in range(2)}
        assert len(turned) == len(symbols) and not turned & set(symbols[-1:])


def test_pieces_come_back_and_dont_depend_on_batches(spark, odd, none):
    model = pieces.read_model()
    out = pieces.encode(odd, model).select("doc_id", "text", "ids", "lossless", pieces.decode(F.col("ids"), model).alias("back"))
    found = out.collect()
    assert all(r["back"] == r["text"] for r in found) and all(r["lossless"] for r in found)
    assert [r["ids"] for r in found if r["text"] is None] == [None]
    again = pieces.encode(odd.repartition(5), model).select("doc_id", "text", "ids")
    assert rows(again) == rows(out.select("doc_id", "text", "ids"))
    other = pieces.encode(odd.filter("doc_id = 7"), model, seed=1).first()["ids"]
    assert other != [r["ids"] for r in found if r["doc_id"] == 7][0]
    assert pieces.encode(none, model).count() == 0


def test_pieces_are_drawn_with_their_weights():
    v = pieces.Vocabulary(pieces.read_model())

    def ways(s):
        if not s:
            yield (), 1.0
        for n in range(1, len(s) + 1):
            chars = np.array([ord(c) for c in s[:n]], np.uint32)
            at = int(v.look_up(v.powers.sums(chars)[-1:])[0])
            if at >= 0:
                yield from (((int(v.ids[at]), *rest), v.weights[at] * w) for rest, w in ways(s[n:]))

    exact = dict(ways("▁thing"))
    n = 20_000
    ids, counts = pieces.sample(v, pieces.Store(v), ["thing"] * n, np.arange(n).astype(np.uint64))
    drawn = {}
    for e, c in zip(np.cumsum(counts), counts, strict=True):
        way = tuple(ids[e - c : e].tolist())
        drawn[way] = drawn.get(way, 0) + 1
    total = sum(exact.values())
    assert set(drawn) <= set(exact)
    for way, w in exact.items():
        p = w / total
        assert abs(drawn.get(way, 0) / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-3


def test_long_units_are_cut_where_no_piece_crosses():
    v = pieces.Vocabulary(pieces.read_model())
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("日本語の文章ですabcing"), 200)), "x" * 500, "https://example.org/" + "ab/" * 60]
    known = {b.decode("utf-8", "ignore") for b in v.bytes}
    for text in texts:
        chars = np.array([ord(c) for c in text])
        got = pieces._cut_long(v, chars, np.zeros(1, np.int64), np.array([len(text)]))
        free = [i for i in range(1, len(text)) if not any(
            text[a:b] in known for a in range(max(0, i - v.longest), i) for b in range(i + 1, min(len(text), a + v.longest) + 1))]
        assert got.tolist() == [0, *free]
    store = pieces.Store(v)
    ids, counts = pieces.sample(v, store, ["長い文章" * 50_000], np.array([1], np.uint64))
    assert pieces.round_trip(v, ["長い文章" * 50_000], ids, counts).all()


def test_store_is_bounded_and_changes_nothing(monkeypatch):
    v = pieces.Vocabulary(pieces.read_model())
    texts = [prose(s, 50) + f" n{s}" for s in range(60)]
    keys = np.arange(60).astype(np.uint64)
    store = pieces.Store(v)
    ids, counts = pieces.sample(v, store, texts, keys)
    monkeypatch.setattr(pieces, "STORE", 300)
    small = pieces.Store(v)
    for k in range(60):
        own, n = pieces.sample(v, small, texts[k : k + 1], keys[k : k + 1])
        assert own.tolist() == ids[counts[:k].sum() : counts[: k + 1].sum()].tolist()
    assert small.used < store.used


def test_buckets_hold_neighbours_however_ids_are_spread(spark):
    ids = [*range(30_000), 10**15, -(10**12), *range(10**9, 10**9 + 5000)]
    docs = spark.createDataFrame([(i,) for i in ids], "doc_id bigint")
    found = imatch.into_buckets(docs, len(ids)).collect()
    assert len(found) == len(ids)
    sizes = {}
    for r in found:
        sizes.setdefault(r["bucket"], []).append(r["doc_id"])
    assert max(map(len, sizes.values())) < 4 * imatch.BUCKET and len(sizes) > len(ids) / imatch.BUCKET / 3
    spans = sorted((min(x), max(x), b) for b, x in sizes.items())
    assert all(a[1] < b[0] and a[2] < b[2] for a, b in itertools.pairwise(spans))


def test_imatch_equal_texts_and_neighbours(spark, odd, none):
    docs = spark.createDataFrame([(3 * i, prose(i % 37, 40 + i)) for i in range(60)] + [(1, None), (2, "")], "doc_id bigint, text string")
    out = {r["doc_id"]: r for r in imatch.edited_likeness(docs).collect()}
    assert len(out) == 62 and out[1]["fingerprint"] == out[2]["fingerprint"] and out[2]["near_next"] == 1.0
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    order = sorted(texts, reverse=True)
    import hashlib

    for a, b in zip(order, order[1:] + order[:1], strict=True):
        n = len(texts[a])
        edited = texts[a][: n - n // 3] + texts[b][: n // 3]
        assert out[a]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and out[a]["n_chars"] == n
    assert imatch.fingerprints(odd).count() == len(ODD)
    assert imatch.edited_likeness(odd).count() == len(ODD) - 1
    assert imatch.edited_likeness(none).count() == 0


def plain_base(text):
    import re

    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    phrases = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    hits = [(i, k) for i in range(len(words)) for k, p in phrases.items() if words[i : i + len(p)] == p]
    return len(words), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({k for _, k in hits}))


def test_licenses(spark, odd, none):
    texts = [
        "Released under the MIT License.", "x Licensed under the Apache License, Version 2.0.\nMIT\nlicense GNU General Public License, version 3.",
        "Licensed under CC BY-NC 4.0.", "cc-by-nc-sa 3.0 and SPDX-License-Identifier: MPL-2.0", "the GNU Lesser General Public License v2.1",
        "All rights reserved. " * 3, "licence of no kind", "MIT License " * 400, None, "",
    ]
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id bigint, text string, labels int")
    out = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    for i, t in enumerate(texts):
        r = out[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_base(t)
        assert 0 <= r["score"] <= 1
    assert [out[i]["labels"] for i in (0, 1, 2, 3, 4, 5, 6, 8)] == [
        "mit", "apache,apache-2.0,gpl,gpl-3.0,mit", "cc-by-nc-4.0", "cc-by-nc-sa-3.0,mpl-2.0", "gpl,lgpl-2.1", "proprietary", "", "",
    ]
    assert out[7]["n_detections"] == 400
    assert licenses.scan(odd).count() == len(ODD) and licenses.scan(none).count() == 0
    assert len(licenses.rules()) > 200


def ways(parsed):
    """Every string a rule's pattern matches, with one word for any word."""
    out = [""]
    for op, av in parsed:
        match str(op):
            case "LITERAL":
                more = [chr(av)]
            case "IN":
                more = [chr(x) for o, x in av if str(o) == "LITERAL"] or ["x"]
            case "BRANCH":
                more = [w for b in av[1] for w in ways(b)]
            case "SUBPATTERN":
                more = ways(av[3])
            case "MAX_REPEAT":
                more = ([""] if av[0] == 0 else []) + ways(av[2])
            case "ASSERT" | "ASSERT_NOT":
                more = [""]
        out = [a + b for a in out for b in more]
    return out


def test_no_match_of_a_rule_is_kept_from_it():
    import re
    import re._parser

    for keyword, pattern, label, _ in licenses.rules():
        matches = [w for w in ways(re._parser.parse(pattern)) if re.search(pattern, w + " ")]
        assert matches, pattern
        for w in matches:
            assert keyword in w and re.search(licenses.GATE, w.upper()) and re.search(licenses.GATE, w.replace(" ", "-")), (label, w)


def test_licenses_without_the_word_license(spark):
    texts = ["Released under the GNU GPL v3", "GNU GPL.", "the GNU Lesser GPL, version 2.1", "CC Attribution 4.0", "CC-Attribution-ShareAlike",
             "Distributed under the CC0"]
    out = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert [r["labels"] for r in out.orderBy("doc_id").collect()] == ["gpl-3.0", "gpl", "lgpl-2.1", "cc-by-4.0", "cc-by-sa", "cc0"]


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a", "same"), (2, "http://b\r\nX: y", "same"), (3, None, None), (4, "u", ""), (5, "u", "ä" * 3_000_000), (5, "u", "z"), (None, "u", "same")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(3)
    written = warc.write_monolithic(warc.with_revisits(df), f"file://{tmp_path}/w")
    ready = warc.normalise_all(written)
    got = {(r["page_id"], r["payload_bytes"]): (r["record_type"], r["refers_to"], r["payload_digest"]) for r in warc.read_all(ready).collect()}
    d = lambda t: warc.digest((t or "").encode())
    assert got == {
        (1, 4): ("revisit", 2, d("same")), (2, 4): ("response", None, d("same")), (None, 4): ("response", None, d("same")),
        (3, 0): ("revisit", 4, d("")), (4, 0): ("response", None, d("")), (5, 6_000_000): ("response", None, d("ä" * 3_000_000)), (5, 1): ("response", None, d("z")),
    }
    assert warc.with_revisits(df, least=1).filter("refers_to IS NOT NULL").count() == 1
    empty = warc.write_monolithic(warc.with_revisits(df.limit(0)), f"{tmp_path}/e")
    assert warc.read_all(warc.normalise_all(empty)).count() == 0


def labelled(spark, n=240):
    docs = [(i, prose(i, 60) + (" you idiot scum" if i % 3 == 0 else ""), "en" if i % 2 else "ja", "s", 0) for i in range(n)]
    docs = [(i, t if i % 2 else "日本語の文章です " + t[:10] + "。これは別の言葉", lang, s, c) for i, t, lang, s, c in docs]
    docs = [(i, t + (" idiot scum" if i % 3 == 0 else ""), lang, s, c) for i, t, lang, s, c in docs]
    labels = [(i, int(i % 2), int(i % 3 == 0)) for i in range(n)] + [(0, None, 0), (None, 1, 1)]
    return spark.createDataFrame(docs, LAYOUT), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark, odd, none):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    held = [r for r in toxicity.score(docs, model).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert held and all(r["predicted"] == int(r["doc_id"] % 3 == 0) for r in held)
    out = toxicity.score(odd, model).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0


def test_pairs_count_without_their_terms_counting(monkeypatch):
    """Label 1 if exactly one of two words stands in a text: a linear model is no better than chance."""
    rng = np.random.default_rng(0)
    pairs, texts = rng.random((3000, 2)) < 0.5, []
    for a, b in pairs:
        found = {f"w{x}" for x in rng.integers(0, 300, 40)} | ({"mira"} if a else set()) | ({"tolo"} if b else set())
        texts.append(np.unique([t for w in found for t in toxicity.terms_of(w)]).astype("<i4"))
    y = (pairs[:, 0] != pairs[:, 1]).astype(int)
    right = []
    for begin in (toxicity.BEGIN, 0):
        monkeypatch.setattr(toxicity, "BEGIN", begin)
        model = toxicity.fit(texts[:2400], y[:2400], 0.5)
        at = {int(i): k for k, i in enumerate(model["ids"])}
        own = [np.array([at[i] for i in t.tolist() if i in at], np.int64) for t in texts[2400:]]
        flat, sizes = np.concatenate(own), np.array([len(o) for o in own])
        margins, _, _ = toxicity.margins(model["w0"], model["w"], model["v"], flat, sizes)
        right.append(((margins > 0) == y[2400:]).mean())
    assert right[0] > 0.95 and right[1] < 0.6


def test_margins_are_the_double_sum():
    rng = np.random.default_rng(2)
    w0, w, v = 0.3, rng.normal(0, 1, 20), rng.normal(0, 1, (20, 4))
    texts = [np.sort(rng.choice(20, n, False)) for n in (0, 1, 2, 7, 20)]
    got, _, _ = toxicity.margins(w0, w, v, np.concatenate(texts).astype(np.int64), np.array([len(t) for t in texts]))
    wanted = [w0 + w[t].sum() + sum(v[i] @ v[j] for i, j in itertools.combinations(t, 2)) for t in texts]
    assert np.allclose(got, wanted)


def test_quality_on_held_out_rows(spark, odd, none):
    docs, labels = labelled(spark)
    net = quality.train(docs, labels)
    held = [r for r in quality.score(docs, net).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert held and sum(r["predicted"] == r["doc_id"] % 2 for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in quality.score(odd, net).collect())
    assert quality.train(none, labels) is None and quality.score(none, None).count() == 0


def test_language_on_held_out_rows(spark, odd, none):
    docs, _ = labelled(spark)
    langs, net = langid.train(docs)
    found = langid.predict(docs, langs, net).collect()
    held = [r for r in found if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert held and all(r["lang_pred"] == r["lang"] for r in held)
    out = {r["doc_id"]: r["lang_pred"] for r in langid.predict(odd, langs, net).collect()}
    assert out[1] == out[2] == out[3] == "und" and out[7] == "en"
    assert langid.train(none) == ([], None) and langid.predict(odd, [], None).filter("lang_pred <> 'und'").count() == 0


def test_windows_and_tables_agree_with_the_network():
    assert bytenet.windows_of(b"", 8, 6).tolist() == [[0] * 8]
    whole = bytenet.windows_of(bytes(range(1, 20)), 8, 6)
    assert whole.shape == (3, 8) and whole[-1].tolist() == [13, 14, 15, 16, 17, 18, 19, 0]
    net = bytenet.begin({2: 3, 4: 5, 6: 2}, 2, 1)
    windows = np.random.default_rng(0).integers(0, 256, (50, 32)).astype(np.uint8)
    slow, _ = bytenet._forward(net, windows)
    assert np.allclose(slow, bytenet.pooled(bytenet.tables(net), windows), atol=1e-4)


def test_every_offset_is_looked_at(spark):
    """Scores as of plain sums over all places; a byte put before a text moves them little."""
    rng = np.random.default_rng(3)
    net = bytenet.begin(quality.FILTERS, 2, 1)
    texts = [rng.integers(97, 123, n).astype(np.uint8).tobytes() for n in (0, 1, 5, 255, 256, 257, 3000)]

    def plain(text):
        chunks = bytenet.windows_of(text, quality.CHUNK, quality.STEP)
        rows = []
        for chunk in chunks:
            e = net["emb"][chunk]
            best = []
            for width in sorted(quality.FILTERS):
                z = [e[i : i + width].reshape(-1) @ net[f"w{width}"] + net[f"b{width}"] for i in range(len(chunk) - width + 1)]
                best.append(np.maximum(np.max(z, 0), 0))
            rows.append(np.concatenate(best))
        return bytenet.softmax(np.mean(rows, 0) @ net["head"] + net["bias"])[1]

    def scores(those):
        df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(those)], "doc_id bigint, text string")
        return [r["score"] for r in quality.score(df, net).orderBy("doc_id").collect()]

    got = scores(texts)
    assert np.allclose(got, [plain(t) for t in texts], atol=1e-4)
    moved = scores([b" " + t for t in texts])
    assert abs(moved[-1] - got[-1]) < 0.02
    single = b"z" * 127
    odd_place, even_place = (single[:n] + b"qj" + single[n + 2 :] for n in (51, 52))
    assert np.allclose(*scores([odd_place, even_place]), atol=1e-6)  # the same pair at an odd and an even offset


def test_windows_vote_by_their_bytes(spark):
    net = bytenet.begin(langid.FILTERS, 3, 4)
    text = bytes(np.random.default_rng(1).integers(97, 123, 400).astype(np.uint8))
    windows = bytenet.windows_of(text, langid.WINDOW, langid.STEP)
    assert len(windows) == 4 and b"".join(w.tobytes()[: langid.STEP] for w in windows[:-1]) + windows[-1].tobytes().rstrip(b"\0") == text
    pooled, _ = bytenet._forward(net, windows)
    logs = np.log(bytenet.softmax(pooled @ net["head"] + net["bias"]))
    held = np.array([128, 128, 128, 400 - 3 * langid.STEP])
    p = bytenet.softmax((logs * held[:, None]).sum(0) / held.sum())
    row = langid.predict(spark.createDataFrame([(1, text.decode())], "doc_id bigint, text string"), ["a", "b", "c"], net).first()
    assert row["lang_pred"] == "abc"[p.argmax()] and row["score"] == pytest.approx(p.max(), abs=1e-4)
