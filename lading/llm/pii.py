"""Surrogates for personal data: keyed, of the same type, script, gender and format.

Every entity is a row of symbols, each from a small alphabet (digits, or the
vowels or consonants of a script and case; of scripts without an alphabet here,
the letters, marks or digits of its kind around it in Unicode).  The symbols are the digits of one
mixed-radix number, and a keyed permutation of all numbers of that shape gives
the surrogate: same length, same classes, same separators.  Equal entities get
equal surrogates in every document (coreference) and different ones different
surrogates (distinctness), with nothing to look up.  Given names come from a
list for each script and gender, permuted within the list.  A permutation
P^-1(P(x) + 1) has no fixed point, so nothing stands for itself; what has no
symbol to replace (an address of signs only) is left and not counted.  Long
entities are permuted in blocks of BLOCK symbols, each under a key that depends
on all before it.

`collisions` checks distinctness over all documents; `mask` refuses a key
that has any.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from lading.llm.common import whole_text

#: Given names by script and gender, and titles by gender.
GIVEN = {
    ("latin", "f"): "Anna Maria Laura Julia Sarah Emma Elena Claire Sophie Nina Alice Marta".split(),
    ("latin", "m"): "Peter Thomas Martin David Daniel Lucas Paul Simon Robert Victor Hugo Oscar".split(),
    ("cyrillic", "f"): "Анна Мария Ольга Елена Ирина Наталья Светлана Татьяна".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Дмитрий Алексей Николай Виктор Олег".split(),
    ("greek", "f"): "Μαρία Ελένη Σοφία Άννα Ιωάννα Δήμητρα".split(),
    ("greek", "m"): "Γιώργος Νίκος Δημήτρης Γιάννης Κώστας Πέτρος".split(),
}
TITLES = r"Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame"
ALPHABETS = [
    "0123456789", "aeiou", "AEIOU", "bcdfghjklmnpqrstvwxyz", "BCDFGHJKLMNPQRSTVWXYZ",
    "аеёиоуыэюя", "АЕЁИОУЫЭЮЯ", "бвгджзйклмнпрстфхцчшщ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ",
    "αεηιουω", "ΑΕΗΙΟΥΩ", "βγδζθκλμνξπρστφχψ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
    "ьъ", "ЬЪ", "άέήίόύώ", "ΆΈΉΊΌΎΏ",
    "àáâãäåæèéêëìíîïòóôõöøùúûüýÿ", "ÀÁÂÃÄÅÆÈÉÊËÌÍÎÏÒÓÔÕÖØÙÚÛÜÝ", "çñßðþ", "ÇÑÐÞ",
]
_FIXED = {c: (a, i) for a in ALPHABETS for i, c in enumerate(a)}


class Classes(dict):
    """(alphabet, place in it) of each symbol; None of signs.

    A letter, mark or digit of none of ALPHABETS has those of its category
    among the 128 code points of its block that casing leaves alike.
    """

    def __missing__(self, symbol: str) -> tuple[str, int] | None:
        kind = unicodedata.category(symbol)
        alphabet = ""
        if symbol > "\x7f" and kind[0] in "LMN":
            start = ord(symbol) - unicodedata.decimal(symbol) if kind == "Nd" else ord(symbol) & ~127
            same = (chr(c) for c in range(start, start + (10 if kind == "Nd" else 128)))
            cased = symbol == symbol.lower()
            alphabet = "".join(c for c in same if c not in _FIXED and unicodedata.category(c) == kind and (c == c.lower()) == cased)
        self[symbol] = (alphabet, alphabet.index(symbol)) if len(alphabet) > 1 else None
        return self[symbol]


CLASS = Classes(_FIXED)
HEX = {c: ("0123456789abcdef", i) for i, c in enumerate("0123456789abcdef")}
ROUNDS = 8
BLOCK = 256  # symbols permuted as one number

_NAMES = {n: (s, g) for (s, g), names in GIVEN.items() for n in names}
_SURNAME = r"[A-ZÀ-ÞА-ЯЁΑ-Ω][a-zß-ÿа-яёα-ώ]+"
PERSON = re.compile(
    rf"\b(?:(?:{TITLES})\.? (?P<titled>{_SURNAME}(?: {_SURNAME})?)|(?P<full>(?:{'|'.join(_NAMES)}) {_SURNAME}))\b"
)
PERSON_HINT = re.compile(rf"\b(?:{TITLES})\b|{'|'.join(_NAMES)}")
_VALUE = r"[A-Za-z0-9_+/\-.=~]"
SECRET = re.compile(
    r"\b(?:token|passw(?:or)?d|pwd|secret|api[_-]?key)\b[\"']?\s{0,3}[:=]\s{0,3}[\"']?"
    rf"(?P<v>(?=[_+/\-.=~]*[A-Za-z0-9]){_VALUE}{{7,}}[A-Za-z0-9_+/\-=~])",
    re.I,
)
SECRET_HINT = re.compile(r"token|passw|pwd|secret|api[_-]?key", re.I)
#: Combining marks, which stand in words of many scripts but aren't in \w.
_MARKS = "".join(c for c in map(chr, range(0x300, 0x10000)) if unicodedata.category(c)[0] == "M")
NOT_LOCAL = re.compile(rf"[^\w.+\-{_MARKS}]")
DOMAIN = re.compile(rf"[\w\-{_MARKS}]+(?:\.[\w\-{_MARKS}]+)+")
COUNTRY = re.compile(r"\+(\d{1,3})(?=[ .\-(])")
DIGIT = re.compile(r"\d")
NUMERIC = (
    ("ipv4", re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)")),
    ("phone", re.compile(r"(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){1,4}(?!\d)")),
    ("phone", re.compile(r"(?<![\w(])(?:\(\d{3}\) ?|\d{3}[.\-])\d{3}[.\-]\d{4}(?!\d)")),
    ("ssn", re.compile(r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])")),
    ("card", re.compile(r"(?<![\w\-])\d(?:[ \-]?\d){12,18}(?![\w\-])")),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")),
)


def _half(key: bytes, shape: bytes, turn: int, half: int, bits: int) -> int:
    block = hashlib.blake2b(half.to_bytes((bits + 7) // 8, "big") + shape, key=key, salt=bytes([turn]), digest_size=64)
    return int.from_bytes(block.digest() * (bits // 512 + 1), "big") & ((1 << bits) - 1)


def _permuted(x: int, size: int, key: bytes, shape: bytes, back: bool) -> int:
    """Keyed permutation of range(size): a balanced Feistel network, walked until it is in range."""
    bits = max(1, ((size - 1).bit_length() + 1) // 2)
    low = (1 << bits) - 1
    while True:
        left, right = x >> bits, x & low
        for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ _half(key, shape, turn, left, bits), left
            else:
                left, right = right, left ^ _half(key, shape, turn, right, bits)
        x = (left << bits) | right
        if x < size:
            return x


def shifted(x: int, size: int, key: bytes, shape: bytes) -> int:
    """Another number below `size` (if there is one); different numbers give different ones."""
    y = (_permuted(x, size, key, shape, False) + 1) % size
    return _permuted(y, size, key, shape, True)


def same_shape(text: str, key: bytes, kind: str, classes: dict = CLASS) -> str:
    """Each symbol replaced by one of its alphabet; symbols of no alphabet stay."""
    found = [(i, *own) for i, c in enumerate(text) if (own := classes[c])]
    out = list(text)
    for at in range(0, max(1, len(found)), BLOCK):
        places = found[at : at + BLOCK]
        number, size = 0, 1
        for _, alphabet, digit in places:
            number, size = number * len(alphabet) + digit, size * len(alphabet)
        shape = (kind + "|" + "".join(a[0] for _, a, _ in places)).encode()
        if at:
            shape += b"|" + "".join(text[i] for i, _, _ in found[:at]).encode()
        number = shifted(number, size, key, hashlib.blake2b(shape, digest_size=16).digest())
        for i, alphabet, _ in reversed(places):
            number, digit = divmod(number, len(alphabet))
            out[i] = alphabet[digit]
    return "".join(out)


def _refill(text: str, digits: str) -> str:
    """Text with its digits replaced in order."""
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in text)


def luhn(digits: str) -> int:
    """Check digit for the digits before it."""
    turned = [int(c) for c in reversed(digits)]
    return -sum(2 * d - 9 * (d > 4) for d in turned[0::2]) - sum(turned[1::2])


def _card(text: str, key: bytes) -> str:
    digits = "".join(c for c in text if c.isdigit())
    body = same_shape(digits[:-1], key, "card")
    off = int(digits[-1]) - luhn(digits[:-1])  # a valid number stays valid, an invalid one invalid
    zero = ord(digits[-1]) - int(digits[-1])  # of the digits' script
    return _refill(text, body + chr(zero + (luhn(body) + off) % 10))


def _phone(text: str, key: bytes) -> str:
    digits = "".join(c for c in text if c.isdigit())
    country = COUNTRY.match(text)
    keep = country[1] if country else ""
    return _refill(text, keep + same_shape(digits[len(keep) :], key, "phone" + keep))


def _ip(text: str, key: bytes) -> str:
    number = int.from_bytes(bytes(map(int, text.split("."))), "big")
    return ".".join(map(str, shifted(number, 1 << 32, key, b"ip").to_bytes(4, "big")))


def _iban(text: str, key: bytes) -> str:
    plain = text.replace(" ", "")
    body = same_shape(plain[4:], key, "iban" + plain[:2])
    value = lambda s: int("".join(str(int(c, 36)) for c in s))
    valid = value(plain[4:] + plain[:4]) % 97 == 1
    check = f"{98 - value(body + plain[:2] + '00') % 97:02d}" if valid else plain[2:4]
    left = iter(plain[:2] + check + body)
    return "".join(c if c == " " else next(left) for c in text)


def _email(text: str, key: bytes) -> str:
    """Local part and each label before the last are replaced; case doesn't tell addresses apart."""
    local, domain = text.split("@", 1)
    labels = domain.split(".")
    turned = [same_shape(x.lower(), key, "label") for x in labels[:-1]]
    return same_shape(local.lower(), key, "local") + "@" + ".".join([*turned, labels[-1]])


def _secret(text: str, key: bytes) -> str:
    return same_shape(text, key, "secret", HEX if len(text) >= 16 and all(c in HEX for c in text) else CLASS)


def _person(text: str, key: bytes) -> str:
    """Given names go to names of their script and gender, surnames to their own shape; part by part."""
    out = []
    for word in text.split(" "):
        if word in _NAMES:
            names = GIVEN[_NAMES[word]]
            out.append(names[shifted(names.index(word), len(names), key, "/".join(_NAMES[word]).encode())])
        else:
            out.append(same_shape(word, key, "surname"))
    return " ".join(out)


SURROGATE = {
    "email": _email, "ipv4": _ip, "phone": _phone, "card": _card, "iban": _iban, "secret": _secret,
    "person": _person, "ssn": lambda text, key: same_shape(text, key, "ssn"),
}


def _local_start(text: str, low: int, at: int) -> int:
    """Where the local part that ends before `at` starts, however long it is."""
    while at > low and not NOT_LOCAL.match(text, at - 1):
        at -= 1
    return at


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities, in order and without overlap; the earlier, then longer one wins."""
    found = []
    at, last = text.find("@"), 0
    while at >= 0:
        left, right = _local_start(text, last, at), DOMAIN.match(text, at + 1)
        if left < at and right:
            found.append((left, right.end(), "email"))
        at, last = text.find("@", at + 1), at + 1
    if DIGIT.search(text):
        for kind, pattern in NUMERIC:
            for m in pattern.finditer(text):
                if kind != "ipv4" or all(int(x) < 256 and str(int(x)) == x for x in m[0].split(".")):
                    found.append((m.start(), m.end(), kind))
    if SECRET_HINT.search(text):
        found += [(m.start("v"), m.end("v"), "secret") for m in SECRET.finditer(text)]
    if PERSON_HINT.search(text):
        for m in PERSON.finditer(text):
            found.append((*m.span("titled" if m["titled"] else "full"), "person"))
    out, end = [], -1
    for start, stop, kind in sorted(found, key=lambda f: (f[0], -f[1])):
        if start >= end:
            out.append((start, stop, kind))
            end = stop
    return out


def normal(kind: str, text: str) -> str:
    """What makes two mentions the same entity: digits of a number, an address without its case."""
    if kind in ("phone", "card", "ssn"):
        country = COUNTRY.match(text)
        return (country[0] if country else "") + "".join(c for c in text[country.end() if country else 0 :] if c.isdigit())
    return text.lower() if kind == "email" else text.replace(" ", "") if kind == "iban" else text


class Masker:
    """Finds and replaces with one key; remembers what it has replaced, up to a bound."""

    def __init__(self, key: str, most: int = 200_000):
        self.key, self.most, self.memo = hashlib.blake2b(key.encode(), digest_size=32).digest(), most, {}

    def surrogate(self, kind: str, text: str) -> str:
        if (kind, text) not in self.memo:
            if len(self.memo) >= self.most:
                self.memo.clear()
            self.memo[kind, text] = SURROGATE[kind](text, self.key)
        return self.memo[kind, text]

    def mask(self, text: str) -> tuple[str, list[tuple[str, str, str]]]:
        """Text with surrogates, and (kind, entity, surrogate) of each mention."""
        parts, seen, end = [], [], 0
        for start, stop, kind in find(text):
            own = text[start:stop]
            other = self.surrogate(kind, own)
            if normal(kind, other) == normal(kind, own):
                continue  # nothing in it to replace
            parts += [text[end:start], other]
            seen.append((kind, own, other))
            end = stop
        return "".join([*parts, text[end:]]), seen


def _pairs(key: str):
    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        masker = Masker(key)
        for frame in frames:
            rows = {(k, normal(k, a), normal(k, b)) for t in frame["text"] for k, a, b in masker.mask(t)[1]}
            yield pd.DataFrame(sorted(rows), columns=["kind", "entity", "surrogate"])

    return pairs


def entities(docs: DataFrame, key: str) -> DataFrame:
    """Distinct (kind, entity, surrogate) over all texts, in normal form."""
    texts = docs.select(whole_text().alias("text"))
    return texts.mapInPandas(_pairs(key), "kind string, entity string, surrogate string").distinct()


def collisions(found: DataFrame) -> DataFrame:
    """(kind, surrogate) that stand for several entities, and (kind, entity) that have several surrogates."""
    twice = found.groupBy("kind", "surrogate").agg(F.count("*").alias("n")).filter("n > 1").select("kind", "surrogate")
    split = found.groupBy("kind", "entity").agg(F.count("*").alias("n")).filter("n > 1").select("kind", "entity")
    return twice.unionByName(split.toDF("kind", "surrogate"))


def masked(text: Column, key: str) -> Column:
    """Struct of the masked text, the number of replaced mentions and their kinds."""

    @F.pandas_udf(StructType().add("text", StringType()).add("n_replaced", IntegerType()).add("kinds", StringType()))
    def mask_all(texts: pd.Series) -> pd.DataFrame:
        masker = Masker(key)
        rows = []
        for t in texts:
            out, seen = masker.mask(t)
            rows.append((out, len(seen), ",".join(sorted({k for k, _, _ in seen}))))
        return pd.DataFrame(rows, columns=["text", "n_replaced", "kinds"])

    return mask_all(F.coalesce(text, F.lit("")))


def mask(docs: DataFrame, key: str) -> DataFrame:
    """docs with text replaced by its masked form, and n_replaced and kinds added.

    A null text stays null (0 replaced, no kinds).  Repeated rows are masked
    alike; other columns are kept, but columns already called n_replaced or
    kinds are replaced.  Raises ValueError if the key makes two entities of all
    the documents collide, which by construction it can't.
    """
    wrong = collisions(entities(docs, key)).take(1)
    if wrong:
        raise ValueError(f"surrogates collide under this key: {wrong[0]}")
    done = docs.withColumn("__m", masked(F.col("text"), key))
    return done.withColumns(
        {
            "text": F.when(F.col("text").isNotNull(), F.col("__m.text")),
            "n_replaced": F.col("__m.n_replaced"),
            "kinds": F.col("__m.kinds"),
        }
    ).drop("__m")
