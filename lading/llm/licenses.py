"""License scan by ordered signature rules.

A text's words, joined by single spaces, are searched by some hundred regular
expressions.  A rule runs only where its keyword stands, and none where no
keyword can stand.  Of overlapping detections one that contains another wins,
and of others that overlap, or are equal, the rule of smaller priority number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lading.llm.common import ascii_lower, whole_text

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # between words of a text without A-Z
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # a word of any text
#: Some part of every match of a rule or base phrase, as it may stand in a text.
GATE = r"(?i)licen|spdx|commons|domain|reserved|copyleft|gpl|cc[^a-z]*(by|zero|0|attribution)"

#: Names in words, as regular expressions: family, name, versions, words of the identifier.
FAMILIES = [
    ("gpl", r"gnu (?:general public licen[sc]e|gpl)", ["1.0", "2.0", "3.0"]),
    ("lgpl", r"gnu (?:lesser|library) (?:general public licen[sc]e|gpl)", ["2.0", "2.1", "3.0"]),
    ("agpl", r"(?:gnu )?affero general public licen[sc]e", ["1.0", "3.0"]),
    ("gfdl", r"gnu free documentation licen[sc]e", ["1.1", "1.2", "1.3"]),
    ("apache", r"apache (?:software )?licen[sc]e", ["1.0", "1.1", "2.0"]),
    ("mpl", r"mozilla public licen[sc]e", ["1.0", "1.1", "2.0"]),
    ("epl", r"eclipse public licen[sc]e", ["1.0", "2.0"]),
    ("eupl", r"european union public licen[sc]e", ["1.0", "1.1", "1.2"]),
    ("cddl", r"common development and distribution licen[sc]e", ["1.0", "1.1"]),
    ("cpl", r"common public licen[sc]e", ["1.0"]),
    ("artistic", r"artistic licen[sc]e", ["1.0", "2.0"]),
    ("afl", r"academic free licen[sc]e", ["1.1", "1.2", "2.0", "2.1", "3.0"]),
    ("osl", r"open software licen[sc]e", ["1.0", "1.1", "2.0", "2.1", "3.0"]),
    ("bsl", r"boost software licen[sc]e", ["1.0"]),
    ("ofl", r"sil open font licen[sc]e", ["1.0", "1.1"]),
    ("odbl", r"open (?:data commons open )?database licen[sc]e", ["1.0"]),
    ("odc-by", r"open data commons attribution licen[sc]e", ["1.0"]),
    ("cecill", r"cecill(?: free software)? licen[sc]e", ["1.0", "1.1", "2.0", "2.1"]),
    ("psf", r"python software foundation licen[sc]e", ["2.0"]),
    ("php", r"php licen[sc]e", ["3.0", "3.01"]),
    ("zpl", r"zope public licen[sc]e", ["1.1", "2.0", "2.1"]),
    ("lppl", r"latex project public licen[sc]e", ["1.0", "1.1", "1.2", "1.3"]),
    ("rpl", r"reciprocal public licen[sc]e", ["1.1", "1.5"]),
    ("ms-pl", r"microsoft public licen[sc]e", []),
    ("ms-rl", r"microsoft reciprocal licen[sc]e", []),
    ("mit", r"mit (?:x11 )?licen[sc]e", []),
    ("isc", r"isc licen[sc]e", []),
    ("zlib", r"zlib (?:libpng )?licen[sc]e", []),
    ("wtfpl", r"do what the \w+ you want to public licen[sc]e", []),
    ("unlicense", r"(?:the )?unlicense", []),
    ("bsd-2-clause", r"(?:2|two) clause bsd licen[sc]e|simplified bsd licen[sc]e|freebsd licen[sc]e", []),
    ("bsd-3-clause", r"(?:3|three) clause bsd licen[sc]e|(?:new|modified|revised) bsd licen[sc]e", []),
    ("bsd-4-clause", r"(?:4|four) clause bsd licen[sc]e|original bsd licen[sc]e", []),
    ("bsd", r"bsd licen[sc]e", []),
    ("openssl", r"openssl licen[sc]e", []),
    ("ncsa", r"university of illinois ncsa open source licen[sc]e", []),
    ("postgresql", r"postgresql licen[sc]e", []),
    ("ruby", r"ruby licen[sc]e", []),
    ("vim", r"vim licen[sc]e", []),
    ("x11", r"x11 licen[sc]e", []),
    ("curl", r"curl licen[sc]e", []),
    ("ijg", r"independent jpeg group licen[sc]e", []),
    ("proprietary", r"all rights reserved", []),
    ("public-domain", r"(?:in|into|to) the public domain", []),
    ("cc0", r"(?:cc0|cc zero|creative commons zero)", ["1.0"]),
]
#: Parts of the names of the Creative Commons licenses.
COMMONS = {"by": "attribution", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?", "sa": "share ?alike"}
COMMONS_KINDS = ["by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"]
COMMONS_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]
#: Weight of a detection by its rule's priority: identifier, version named, grant, name, base phrase.
WEIGHTS = [1.0, 0.95, 0.85, 0.7, 0.6]


def _version(version: str) -> str:
    """A version in words: 2.0 also as 2, and with v or version before it."""
    return r"(?: or)?(?: version| v(?=\d))? ?v?" + version.replace(".0", r"(?: 0)?").replace(".", " ")


def _keyword(family: str) -> str:
    """A part of every match of the family's name, in all its ways of writing."""
    fixed = {"gpl": "gnu", "lgpl": "gnu", "proprietary": "reserved", "public-domain": "domain", "cc0": "c", "unlicense": "unlicense"}
    return fixed.get(family, "licen")


def rules() -> list[tuple[str, str, str, int]]:
    """(keyword, regular expression, label, priority), in order."""
    out = []
    names = [(f, n, v, _keyword(f)) for f, n, v in FAMILIES]
    for kind in COMMONS_KINDS:
        parts = kind.split("-")
        short, long = " ".join(parts), " ".join(COMMONS[p] for p in parts)
        name = rf"(?:creative commons |cc )(?:{short}|{long})(?! (?:nc|nd|sa|non|no|share))"
        names.append((f"cc-{kind}", name, COMMONS_VERSIONS, "c"))
    for family, name, versions, keyword in names:
        name = f"(?:{name})"
        words = family.replace("-", " ")
        for version in versions:
            named = f"{family}-{version}"
            out.append(("spdx", f" spdx licen[sc]e identifier {words} {version.replace('.', ' ')}(?= )", named, 0))
            out.append((keyword, f" {name}(?: international| unported)?{_version(version)}(?= )", named, 1))
            out.append(("licen", f" licensed under (?:the )?{words} ?v?{version.replace('.', ' ')}(?= )", named, 2))
        if not versions:
            out.append(("spdx", f" spdx licen[sc]e identifier {words}(?= )", family, 0))
            out.append((keyword, f" (?:licensed|released|distributed) under (?:the )?{name}(?= )", family, 2))
        out.append((keyword, f" {name}(?= )", family, 3))
    return out


def _rules() -> Column:
    """The rules as one constant array."""
    ddl = "array<struct<keyword:string,pattern:string,label:string,priority:int>>"
    import json

    fields = ("keyword", "pattern", "label", "priority")
    return F.from_json(F.lit(json.dumps([dict(zip(fields, r, strict=True)) for r in rules()])), ddl)


def _base(words: Column) -> Column:
    """(at, label) of each base phrase, all of which end in `license`."""

    def phrase(word: Column, i: Column) -> Column:
        before, two = F.get(words, i - 1), F.get(words, i - 2)
        return (
            F.when(word != "license", None)
            .when(before.isin("mit", "apache"), F.struct((i - 1).cast("bigint").alias("at"), before.alias("label")))
            .when((before == "public") & (two == "general"), F.struct((i - 2).cast("bigint").alias("at"), F.lit("gpl").alias("label")))
        )

    return F.filter(F.transform(words, phrase), lambda x: x.isNotNull())


def _hits(text: Column, rule: Column) -> Column:
    """Detections of one rule: its matches, each placed after what stands before it."""
    found = F.regexp_extract_all(text, rule["pattern"], F.lit(0))
    between = F.split(text, rule["pattern"], -1)
    none = F.array().cast("array<struct<start:int,less:int,priority:int,label:string>>")

    def add(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        one = F.struct(start.alias("start"), (-end).alias("less"), rule["priority"].alias("priority"), rule["label"].alias("label"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    pairs = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda acc: acc["out"])


def _resolved(detections: Column) -> Column:
    """Labels and weights of the detections that no other suppresses, in one pass in order of their starts."""
    item = "struct<start:int,less:int,priority:int,label:string>"
    first = F.struct(
        F.lit(None).cast(item).alias("last"), F.array().cast("array<string>").alias("labels"), F.lit(9).alias("best"), F.lit(0).alias("n")
    )

    def put(acc: Column) -> Column:
        last = acc["last"]
        return F.when(last.isNull(), acc).otherwise(
            F.struct(
                last.alias("last"),
                F.array_union(acc["labels"], F.array(last["label"])).alias("labels"),
                F.least(acc["best"], last["priority"]).alias("best"),
                (acc["n"] + 1).alias("n"),
            )
        )

    def step(acc: Column, d: Column) -> Column:
        last = acc["last"]
        apart = last.isNull() | (d["start"] >= -last["less"])
        inside = -d["less"] <= -last["less"]
        better = ~inside & (d["priority"] < last["priority"])
        done = put(acc)
        fresh = F.struct(d.alias("last"), done["labels"].alias("labels"), done["best"].alias("best"), done["n"].alias("n"))
        taken = F.struct(d.alias("last"), acc["labels"].alias("labels"), acc["best"].alias("best"), acc["n"].alias("n"))
        return F.when(apart, fresh).when(better, taken).otherwise(acc)

    return F.aggregate(F.array_sort(detections), first, step, put)


def scan(docs: DataFrame) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, n_detections and score.

    A null or wordless text has no words, no labels (empty texts) and score 0.
    Repeated rows get equal answers; columns of these names are replaced, and
    only text is read.
    """
    text = whole_text()
    words = F.filter(F.split(ascii_lower(text), BREAK), lambda w: w != "")

    def answer(words: Column) -> Column:
        joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))

        def method(joined: Column) -> Column:
            chosen = F.filter(_rules(), lambda r: F.contains(joined, r["keyword"]))
            return _resolved(F.flatten(F.transform(chosen, lambda r: _hits(joined, r))))

        found = F.transform(F.array(joined), method)[0]
        return F.struct(_base(words).alias("base"), found.alias("own"))

    # arrays of one element bind a value to a lambda's variable, so that it is computed once
    gated = F.when(text.rlike(GATE), F.transform(F.array(words), answer)[0])
    out = docs.withColumn("__n", F.regexp_count(text, F.lit(WORD))).withColumn("__f", gated)
    base, own = F.col("__f.base"), F.col("__f.own")
    at = F.coalesce(base["at"], F.array().cast("array<bigint>"))
    named = F.array_sort(F.array_distinct(F.coalesce(base["label"], F.array().cast("array<string>"))))
    labels = F.array_sort(F.array_union(named, F.coalesce(own["labels"], F.array().cast("array<string>"))))
    best = F.least(F.coalesce(own["best"], F.lit(9)), F.when(F.size(at) > 0, 4).otherwise(9))
    weight = F.coalesce(F.get(F.array(*map(F.lit, WEIGHTS)), best), F.lit(0.0))
    return out.withColumns(
        {
            "n_words": F.col("__n").cast("bigint"),
            "n_base": F.size(at).cast("bigint"),
            "first_word": F.array_min(at),
            "last_word": F.array_max(at),
            "base_labels": F.array_join(named, ","),
            "labels": F.array_join(labels, ","),
            "n_detections": F.coalesce(own["n"], F.lit(0)),
            "score": weight,
        }
    ).drop("__n", "__f")
