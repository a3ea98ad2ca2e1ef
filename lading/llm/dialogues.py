"""Repair of conversations: the cheapest edits that give each a proper order of roles.

A conversation is well formed if it is empty or an optional system message
followed by pairs of user and assistant.  Rows are kept (0), given another role
(2), deleted (3; blank rows and repeated ones must be) or followed by empty
inserted lines (2 each); a truncated row that stays adds 1.  Of all cheapest
lists of edits, the one whose initials (D, I, K, R) come first in ASCII wins.

The cost of what follows is worked out backwards for the four states of that
grammar.  The arcs that lie on a cheapest way are then ranked by the audit of
their first letter, of the first two, four, eight ... letters: an arc's rank for
twice the letters is that of the pair (own rank, rank of the arc where its
pointer leads), and the pointer then leads twice as far.  The arcs of one point
differ in their letter, so a least arc's successor is never in doubt.  Final
ranks choose each point's arc, and the doubled pointers spell out the path.

Rows are shuffled once, by conversation.  A conversation's rows stream through
its task in order, because the SHA-256 of the repaired text is one chain; all
that is held of a long one is a byte a row, the size of its audit.  Repeated
rows are found before, by an aggregation of digests over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructType

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
NEVER = 1 << 40
START, SYSTEM, USER, ASSISTANT = range(4)  # states; the codes of rows use the same numbers for their roles, 0 for any other
NEXT = (USER, USER, ASSISTANT, USER)  # state after a line that is inserted or given another role
NAMES = {USER: "user", ASSISTANT: "assistant"}
AFTER = np.full((4, 4), -1)  # state after a row of some role is kept
AFTER[START, SYSTEM] = SYSTEM
AFTER[[START, SYSTEM, ASSISTANT], USER] = USER
AFTER[USER, ASSISTANT] = ASSISTANT
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
TRUNCATED, FAULTY, BLANK = 4, 8, 16  # added to a row's code
LETTERS = np.frombuffer(b"\0DIKR", np.uint8)
PIECE = 2048  # rows solved at once
HELD = 8 << 20  # characters of text held until their conversations are solved
PROPER = {"su", "ua", "au"}
COLUMNS = ["conv_id", "kind", "turn", "role", "text", "code", "copies", "first"]

REPORT = StructType()
for _name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"):
    REPORT = REPORT.add(_name, LongType())
REPORT = REPORT.add("audit", StringType()).add("repaired_sha256", StringType())


def _settle(base: list[int]) -> list[int]:
    """Cheapest costs of the states at one place, inserted lines included."""
    user = min(base[USER], INSERT + base[ASSISTANT])
    return [
        min(base[START], INSERT + user),
        min(base[SYSTEM], INSERT + user),
        user,
        min(base[ASSISTANT], INSERT + base[USER]),
    ]


END = _settle([0, NEVER, NEVER, 0])


def costs(codes: bytes, end: list[int] = END) -> np.ndarray:
    """(rows + 1, 4): cost of the cheapest edits from each place and state on; `end` holds behind the last row."""
    out = np.empty((len(codes) + 1, 4), np.int64)
    out[-1] = now = end
    for i in range(len(codes) - 1, -1, -1):
        code = codes[i]
        base = [DELETE + c for c in now]
        if not code & FAULTY:
            more = 1 if code & TRUNCATED else 0
            for q in range(4):
                base[q] = min(base[q], REROLE + more + now[NEXT[q]])
                kept = int(AFTER[q, code & 3])
                if kept >= 0:
                    base[q] = min(base[q], KEEP + more + now[kept])
        out[i] = now = _settle(base)
    return out


def _arcs(codes: np.ndarray, cost: np.ndarray, last: np.ndarray, final: bool):
    """Arcs (from, letter, to) of all cheapest ways; point 4 * place + state.

    One row of `codes` and `cost` a place; `last` marks the places behind a conversation's rows.
    """
    places = np.arange(len(cost))
    ahead = np.minimum(places + 1, len(cost) - 1)
    open_ = ~last
    free = open_ & ((codes & FAULTY) == 0)
    more = ((codes & TRUNCATED) > 0).astype(np.int64)
    found = []
    for q in range(4):
        own, kept = cost[:, q], AFTER[q, codes & 3]
        deleted = open_ & (own == DELETE + cost[ahead, q])
        inserted = (open_ | final) & (own == INSERT + cost[:, NEXT[q]])
        keeps = free & (kept >= 0) & (own == KEEP + more + cost[ahead, kept])
        reroles = free & (own == REROLE + more + cost[ahead, NEXT[q]])
        stops = last & ((own == 0) if final else True)
        for letter, holds, to in (
            (0, stops, 4 * places + q),
            (1, deleted, 4 * ahead + q),
            (2, inserted, 4 * places + NEXT[q]),
            (3, keeps, 4 * ahead + kept),
            (4, reroles, 4 * ahead + NEXT[q]),
        ):
            at = np.flatnonzero(holds)
            found.append((4 * at + q, np.full(len(at), letter), to[at]))
    return (np.concatenate(part) for part in zip(*found, strict=True))


def _least_of(points: np.ndarray, rank: np.ndarray, n: int) -> np.ndarray:
    """For each of n points its arc of the least rank (-1: none)."""
    order = np.lexsort((rank, points))
    first = np.unique(points[order], return_index=True)
    out = np.full(n, -1)
    out[first[0]] = order[first[1]]
    return out


def least_paths(codes, cost, last, starts, final=True) -> list[tuple[bytes, int]]:
    """Audit and point reached of the least cheapest way from each starting point, by prefix doubling."""
    points, letter, to = _arcs(codes, cost, last, final)
    n = 4 * len(cost)
    rank = letter
    pointer = _least_of(points, rank, n)[to]
    stop = letter == 0
    pointer[stop] = np.flatnonzero(stop)  # the end follows itself
    doubled = []
    while True:
        doubled.append(pointer)
        pairs = rank * (int(rank.max()) + 1) + rank[pointer]
        rank = np.unique(pairs, return_inverse=True)[1]
        if stop[pointer].all():
            break
        pointer = pointer[pointer]
    path = _least_of(points, rank, n)[starts][:, None]
    for leap in doubled:
        path = np.concatenate([path, leap[path]], 1)
    spelt = LETTERS[letter[path]]
    sizes = (spelt != 0).sum(1)
    return [(s[:k].tobytes(), int(points[p[-1]])) for s, k, p in zip(spelt, sizes, path, strict=True)]


def _solve_short(rows: list[bytes]) -> list[tuple[int, str]]:
    """Cost and audit of several conversations at once."""
    cost = [costs(c) for c in rows]
    sizes = np.array([len(c) for c in cost])
    ends = np.cumsum(sizes)
    codes = np.frombuffer(b"\0".join(rows) + b"\0", np.uint8).astype(np.int64)
    last = np.zeros(len(codes), bool)
    last[ends - 1] = True
    audits = least_paths(codes, np.concatenate(cost), last, 4 * (ends - sizes) + START)
    return [(int(c[0, START]), a.decode()) for c, (a, _) in zip(cost, audits, strict=True)]


def _solve_long(rows: bytes) -> tuple[int, str]:
    """The same for one conversation, piece by piece: costs backwards, then the path forwards."""
    pieces = [rows[at : at + PIECE] for at in range(0, len(rows), PIECE)]
    behind = [END]
    for piece in reversed(pieces):
        behind.append(costs(piece, behind[-1])[0].tolist())
    behind.reverse()
    state, out = START, []
    for number, piece in enumerate(pieces, 1):
        codes = np.frombuffer(piece + b"\0", np.uint8).astype(np.int64)
        last = np.arange(len(codes)) == len(piece)
        final = number == len(pieces)
        cost = costs(piece, behind[number])
        ((audit, point),) = least_paths(codes, cost, last, np.array([state]), final)
        out.append(audit)
        state = point % 4
    return behind[0][START], b"".join(out).decode()


def solve(conversations: list[bytes]) -> list[tuple[int, str]]:
    """(cost, audit) of each conversation's row codes."""
    out: list = [(0, "")] * len(conversations)
    by_size = sorted((len(c).bit_length(), i) for i, c in enumerate(conversations) if c)
    for _, group in groupby(by_size, key=lambda x: x[0]):
        at = [i for _, i in group]
        if len(conversations[at[0]]) > PIECE // 2:
            for i in at:
                out[i] = _solve_long(conversations[i])
            continue
        step = max(1, 2 * PIECE // (1 << len(conversations[at[0]]).bit_length()))
        for k in range(0, len(at), step):
            part = at[k : k + step]
            for i, found in zip(part, _solve_short([conversations[i] for i in part]), strict=True):
                out[i] = found
    return out


class _Conversation:
    """One conversation on its way through a task."""

    def __init__(self, key):
        self.key, self.codes, self.texts = key, bytearray(), []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.before = None
        self.audit = None

    def row(self, turn, role, code, copies, first):
        """A run of equal rows; all but the first of its kind are duplicates."""
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in PROPER
        self.illegal += (copies - 1) * (initial + initial not in PROPER)
        self.before = initial
        code |= INITIALS.get(initial, 0)
        if code & BLANK:
            self.blank += copies
            self.codes.extend(bytes([FAULTY]) * copies)
            return
        if first:
            self.truncated += bool(code & TRUNCATED)
            self.codes.append(code)
        self.duplicate += copies - bool(first)
        self.codes.extend(bytes([FAULTY]) * (copies - bool(first)))

    def solved(self, cost, audit):
        self.cost, self.audit = cost, audit
        self.codes = bytearray()
        self.at = self.lines = 0
        self.state, self.hash = START, hashlib.sha256()

    def _line(self, role, text, edit):
        self.hash.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1
        return {"conv_id": self.key, "line_no": self.lines, "role": role, "text": text, "edit": edit, "report": None}

    def _new(self, text, edit):
        self.state = NEXT[self.state]
        return self._line(NAMES[self.state], text, edit)

    def _inserted(self):
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._new("", "I")

    def text(self, role, text):
        """The lines that come of the next row."""
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = int(AFTER[self.state, INITIALS[role[:1]]])
            yield self._line(role, text, edit)
        elif edit == "R":
            yield self._new(text, edit)

    def end(self):
        yield from self._inserted()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        report = {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated}
        report |= {"illegal": self.illegal, "cost": self.cost, "audit": self.audit}
        report["repaired_sha256"] = self.hash.hexdigest()
        empty = dict.fromkeys(("line_no", "role", "text", "edit"))
        yield {"conv_id": self.key} | empty | {"report": report}


def _lines(rows: Iterator[tuple]) -> Iterator[dict]:
    """Repaired lines and reports of a task's sorted rows."""
    waiting: list[_Conversation] = []
    held = 0

    def flush(last_is_whole: bool):
        """Solve what waits; the last conversation's texts may still be coming."""
        for talk, found in zip(waiting, solve([bytes(t.codes) for t in waiting]), strict=True):
            talk.solved(*found)
            for role, text in talk.texts:
                yield from talk.text(role, text)
            talk.texts = []
            if talk is not waiting[-1] or last_is_whole:
                yield from talk.end()

    now = None
    for key, kind, turn, role, text, code, copies, first in rows:
        if now is None or key != now.key:
            if now is not None and now.audit is not None:
                yield from now.end()
            elif held > HELD or sum(len(t.codes) for t in waiting) > PIECE:
                yield from flush(True)
                waiting, held = [], 0
            now = _Conversation(key)
            waiting.append(now)
        if kind == 0:
            if copies:
                now.row(turn, role, code, copies, first)
        elif now.audit is not None:
            yield from now.text(role, text)
        else:
            now.texts.append((role, text))
            held += len(text) + 64
            if held > HELD:  # all rows of this one are known, its texts needn't be
                yield from flush(False)
                waiting, held = [], 0
    if now is not None and now.audit is not None:
        yield from now.end()
    elif waiting:
        yield from flush(True)


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and `dropped` of the damaged rows, for tests of the repair.

    A hash of `conv_id:turn` chooses the fault; nulls in role, text and that key are one space.
    """
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        (F.crc32(key) % 20).alias("fault"),
    )
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    dropped = (F.col("fault") == 0).alias("dropped")
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), dropped, copies.alias("copy"))
    return rows.drop("copy")


def sorted_rows(turns: DataFrame, dropped: Column | None = None) -> DataFrame:
    """COLUMNS of the rows that a task goes through: of each conversation its runs of equal rows without text, then all texts."""
    rows = turns.select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        (F.lit(False) if dropped is None else F.coalesce(dropped, F.lit(False))).alias("dropped"),
    )
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    code = F.when(blank, BLANK).when(~ended, TRUNCATED).otherwise(0)
    order = [F.substring("text", 1, 32).alias("head"), F.unhex(F.sha2("text", 256)).alias("digest")]
    there = rows.filter(~F.col("dropped")).select("conv_id", "turn", "role", *order, code.alias("code"), "text")
    runs = there.groupBy("conv_id", "turn", "role", "head", "digest", "code").agg(F.count("*").alias("copies"))
    seen = runs.groupBy("conv_id", "role", "digest").agg(
        F.min("turn").alias("low"), F.max(F.col("turn").isNull()).alias("none"), F.count("*").alias("n")
    )
    again = seen.filter("n > 1").alias("s")
    same = " and ".join(f"s.{c} <=> r.{c}" for c in ("conv_id", "role", "digest"))
    marked = runs.alias("r").join(again, F.expr(same), "left")
    first = F.expr("s.n is null or (r.turn is null) or (not s.none and r.turn = s.low)").alias("first")
    marked = marked.select("r.*", first)
    names = rows.filter("dropped").select("conv_id").distinct()
    kinds = (
        marked.withColumn("kind", F.lit(0))
        .unionByName(there.select("*", F.lit(1).alias("kind")).drop("code"), allowMissingColumns=True)
        .unionByName(names.select("conv_id", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("copies")), allowMissingColumns=True)
    )
    return (
        kinds.repartition("conv_id")
        .sortWithinPartitions(
            F.asc_nulls_first("conv_id"), "kind", F.asc_nulls_first("turn"), F.asc_nulls_first("role"), "head", "digest"
        )
        .select(COLUMNS)
    )


def repair(turns: DataFrame, dropped: Column | None = None) -> DataFrame:
    """conv_id, line_no, role, text, edit and report of the repaired conversations of turns (conv_id, turn, role, text).

    A repaired line has its number from 1 and edit K (kept), R (other role) or
    I (inserted, empty text); each conversation ends with a row that has only
    conv_id and `report`: gaps between the turns, the rows' first faults
    (blank, duplicate, truncated), illegal neighbours, cost, audit, SHA-256 of
    the lines `role:text`.

    Rows go by turn, nulls first; equal turns by role, the first characters
    and the digest of the text.  Null role and text are one space; rows without
    conv_id are one conversation; repeated rows are duplicates; an empty table
    gives an empty one.  Rows for which `dropped` holds only name their
    conversation, so one that has no other gets an empty audit.  Other columns
    are not read.
    """
    key_type = turns.schema["conv_id"].dataType
    schema = (
        StructType().add("conv_id", key_type).add("line_no", LongType()).add("role", StringType())
        .add("text", StringType()).add("edit", StringType()).add("report", REPORT)
    )
    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in COLUMNS), strict=True))
        out, size = [], 0
        for line in _lines(rows):
            out.append(line)
            size += len(line["text"] or "") + 100
            if size > 1 << 20:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return sorted_rows(turns, dropped).mapInArrow(streamed, schema)


def reports(repaired: DataFrame) -> DataFrame:
    """One row a conversation: conv_id and the report's fields."""
    return repaired.filter("report is not null").select("conv_id", "report.*")
