"""Python-dialect regular expressions on Spark columns.

Labels are written with Python's ``re`` syntax while ``rlike`` runs Java's.  A
pattern inside the subset on which both agree after a small rewrite stays in
the JVM; any other pattern is tested by an Arrow-batched pandas UDF.
"""

from __future__ import annotations

import re
from re import _parser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\."
    r"|\(\?P<[^>]*>|\(\?P=[^)]*\)|\(\?[a-zA-Z-]+[:)]|\(\?<?."
    r"|\[\^?\]?|\{\d*(?:,\d*)?\}|.",
    re.S,
)
_WORD = r"\p{L}\p{N}_"
_SPACE = r"\t-\r\x1c-\x20\x85\p{Z}"
_OUTSIDE = {
    r"\d": r"\p{Nd}",
    r"\D": r"\P{Nd}",
    r"\w": f"[{_WORD}]",
    r"\W": f"[^{_WORD}]",
    r"\s": f"[{_SPACE}]",
    r"\S": f"[^{_SPACE}]",
    r"\b": f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))",
    r"\B": f"(?:(?<=[{_WORD}])(?=[{_WORD}])|(?<![{_WORD}])(?![{_WORD}]))",
    r"\Z": r"\z",
    r"\v": r"\x0B",
    "{": r"\{",
    "}": r"\}",
}
_INSIDE = {
    r"\d": r"\p{Nd}",
    r"\D": r"\P{Nd}",
    r"\w": _WORD,
    r"\s": _SPACE,
    r"\b": r"\x08",
    r"\v": r"\x0B",
    "[": r"\[",
    "[^": r"\[\^",
    "&": r"\&",
}
_KEPT_GROUPS = ("(?:", "(?=", "(?!", "(?<=", "(?<!", "(?>")

ANCHORS = {"search": "{}", "match": r"\A(?:{})", "fullmatch": r"\A(?:{})\z"}


def regex_portable(pattern: str) -> str | None:
    """the Java form of a Python pattern, or None if there is none.

    Raises ``re.error`` for a pattern Python itself rejects.
    """
    re.compile(pattern)
    out, in_class = [], False
    for token in _TOKEN.findall(pattern):
        if in_class:
            if token in (r"\W", r"\S") or re.fullmatch(r"\\[0-9NU]", token):
                return None
            if token == "[]" or token == "[^]":
                out.append(re.sub(r"[\[^]", r"\\\g<0>", token[:-1]) + "]")
                in_class = False
            else:
                out.append(_INSIDE.get(token, token))
                in_class = token != "]"
        elif token.startswith("["):
            out.append(token[:-1] + r"\]" if token.endswith("]") else token)
            in_class = True
        elif token.startswith("(?P<"):
            if not token[4:-1].isalnum() or not token.isascii():
                return None
            out.append("(?<" + token[4:])
        elif token.startswith("(?P="):
            out.append(rf"\k<{token[4:-1]}>")
        elif re.fullmatch(r"\(\?[a-zA-Z-]+[:)]", token):
            if not set(token[2:-1]) <= set("is"):
                return None
            out.append(token.replace("i", "iu"))
        elif token.startswith("(?"):
            if token not in _KEPT_GROUPS:
                return None
            out.append(token)
        elif re.fullmatch(r"\\[0NU]", token):
            return None
        elif re.fullmatch(r"\{,\d+\}", token):
            out.append("{0" + token[1:])
        elif token in ("{}", "{,}"):
            out.append(r"\{" + token[1:-1] + r"\}")
        elif re.search(r"\\[1-9]$", out[-1] if out else "") and token.isdigit():
            return None
        else:
            out.append(_OUTSIDE.get(token, token))
    # (?d): only \n ends a line, as in Python.
    return "(?d)" + "".join(out)


def literal_runs(pattern: str) -> list[str]:
    """Texts that every match of a Python pattern contains, as far as its structure shows.

    Alternatives, classes and optional parts interrupt a text; parts that
    occur at least once have texts of their own.  None if letter case is ignored.
    """
    tree = _parser.parse(pattern)
    runs = [""]

    def walk(items) -> None:
        for op, value in items:
            name = str(op)
            if name == "LITERAL":
                runs[-1] += chr(value)
            elif name == "SUBPATTERN":
                if value[1] & re.IGNORECASE:
                    runs.append("")
                else:
                    walk(value[3])
            elif name == "ATOMIC_GROUP":
                walk(value)
            elif name in ("AT", "ASSERT", "ASSERT_NOT"):
                continue  # of no width
            else:
                runs.append("")
                if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
                    walk(value[2])
                    runs.append("")

    if not tree.state.flags & re.IGNORECASE:
        walk(tree)
    return [run for run in runs if run]


def _python_test(pattern: str, mode: str):
    @F.pandas_udf("boolean")
    def test(subject: pd.Series) -> pd.Series:
        probe = getattr(re.compile(pattern), mode)
        return subject.map(lambda s: None if s is None else probe(s) is not None)

    return test


def regex_test(subject: Column, pattern: str, mode: str = "search") -> Column:
    """Does `subject` match a pattern known when the plan is built?"""
    java = regex_portable(pattern)
    if java is None:
        return _python_test(pattern, mode)(subject)
    flags, body = java[:4], java[4:]
    if re.match(r"\(\?[ius]+\)", body):  # global flags stay in front
        cut = body.index(")") + 1
        flags, body = flags + body[:cut], body[cut:]
    return subject.rlike(flags + ANCHORS[mode].format(body))


def anchored_java(pattern: str | None, mode: str) -> str | None:
    """Java pattern with the anchoring of `mode` folded in, None if not portable."""
    java = None if pattern is None else regex_portable(pattern)
    if java is None:
        return None
    flags, body = java[:4], java[4:]
    if re.match(r"\(\?[ius]+\)", body):
        cut = body.index(")") + 1
        flags, body = flags + body[:cut], body[cut:]
    return flags + ANCHORS[mode].format(body)


def java_pattern(pattern: Column, mode: str) -> Column:
    """Translate a (small) column of Python patterns; used on spec tables only."""

    @F.pandas_udf("string")
    def translate(patterns: pd.Series) -> pd.Series:
        return patterns.map(lambda p: anchored_java(p, mode))

    return translate(pattern)


def regex_test_by_row(subject: Column, pattern: Column, mode: str) -> Column:
    """Test each row's subject with that row's own Python pattern."""

    @F.pandas_udf("boolean")
    def test(subjects: pd.Series, patterns: pd.Series) -> pd.Series:
        compiled = {p: re.compile(p) for p in patterns.dropna().unique()}
        return pd.Series(
            [
                None
                if s is None or p is None
                else getattr(compiled[p], mode)(s) is not None
                for s, p in zip(subjects, patterns)
            ],
            dtype="object",
        )

    return test(subject, pattern)


def escape_regex(text: Column) -> Column:
    """Quote regex metacharacters of a literal so it matches itself."""
    return F.regexp_replace(text, r"([\\.^$|?*+()\[\]{}])", r"\\$1")
