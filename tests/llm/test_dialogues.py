import hashlib
import heapq
import random
import re
import zlib

import pytest

from lading.llm import dialogues

STEPS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
NEW = {"": "u", "s": "u", "u": "a", "a": "u"}


def plain_edits(rows):
    """Cheapest, then least audit of (initial, truncated, faulty) rows, by a search over whole audits."""
    queue, done = [(0, "", 0, "")], set()
    while queue:
        cost, audit, i, q = heapq.heappop(queue)
        if i == len(rows) and q in ("", "a"):
            return cost, audit
        if (i, q) in done:
            continue
        done.add((i, q))
        heapq.heappush(queue, (cost + 2, audit + "I", i, NEW[q]))
        if i < len(rows):
            initial, truncated, faulty = rows[i]
            heapq.heappush(queue, (cost + 3, audit + "D", i + 1, q))
            if not faulty:
                heapq.heappush(queue, (cost + 2 + truncated, audit + "R", i + 1, NEW[q]))
                if (q, initial) in STEPS:
                    heapq.heappush(queue, (cost + truncated, audit + "K", i + 1, STEPS[q, initial]))


def plain_damage(rows):
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * ((fault != 0) + (fault == 3))


def plain_report(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:32], hashlib.sha256(r[3].encode()).digest()))
    blank = duplicate = truncated = 0
    seen, coded = set(), []
    for _, _, role, text in rows:
        inked = text.strip(" \t\n\v\f\r")
        kind = (
            "b" if not inked else "d" if (role, text) in seen else "t" if inked[-1] not in ".!?" else ""
        )
        seen.add((role, text))
        blank, duplicate, truncated = blank + (kind == "b"), duplicate + (kind == "d"), truncated + (kind == "t")
        coded.append((role[:1], kind == "t", kind in ("b", "d")))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit = plain_edits(coded)
    lines, q, left = [], "", iter(rows)
    for edit in audit:
        row = None if edit == "I" else next(left)
        if edit == "D":
            continue
        q = row[2][:1] if edit == "K" else NEW[q]
        role = row[2] if edit == "K" else {"u": "user", "a": "assistant"}[q]
        lines.append(f"{role}:{row[3] if row else ''}")
    assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in lines))
    return gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def conversation(rng, conv, size):
    said = ["Yes.", "No!", "and so", "", " \n", "Why?  ", "Wieso ñ", "x" * 3000 + ".", "Yes."]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, ""]
    turns = [None, *range(size)]
    return [(conv, rng.choice(turns), rng.choice(roles), rng.choice([*said, None])) for _ in range(size)]


@pytest.mark.parametrize("piece", [4, 16, 2048])
def test_least_cheapest_edits(monkeypatch, piece):
    monkeypatch.setattr(dialogues, "PIECE", piece)
    rng = random.Random(piece)
    talks = [[(rng.choice("suaua "), rng.random() < 0.3, rng.random() < 0.2) for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 30]))]
             for _ in range(600)]
    coded = [bytes(dialogues.INITIALS.get(i, 0) + 4 * t + 8 * f for i, t, f in talk) for talk in talks]
    assert dialogues.solve(coded) == [plain_edits(t) for t in talks]


@pytest.mark.parametrize(("held", "piece"), [(8 << 20, 2048), (200, 8)])
def test_reports_as_a_plain_repair(spark, monkeypatch, held, piece):
    monkeypatch.setattr(dialogues, "HELD", held)
    monkeypatch.setattr(dialogues, "PIECE", piece)
    rng = random.Random(5)
    rows = [r for c in [*range(60), None] for r in conversation(rng, c, rng.choice([1, 2, 4, 7, 12]))]
    rows += conversation(rng, 99, 600)  # one conversation of a third of all rows
    rows += rows[:20]
    turns = spark.createDataFrame([(*r, 7) for r in rows], "conv_id bigint, turn bigint, role string, text string, report int")
    # not through workers: the bounds above hold in this process only
    out = list(dialogues._lines(_sorted_rows(turns)))
    got = {r["conv_id"]: tuple(r["report"].values()) for r in out if r["report"]}
    damaged = list(plain_damage(rows))
    assert got.keys() == {r[0] for r in rows}
    for conv, report in got.items():
        assert report == plain_report([r for r in damaged if r[0] == conv]), conv
    lines = [r for r in out if r["conv_id"] == 99 and r["line_no"]]
    assert [r["line_no"] for r in lines] == list(range(1, len(lines) + 1))
    text = "\n".join(f"{r['role']}:{r['text']}" for r in lines)
    assert hashlib.sha256(text.encode()).hexdigest() == got[99][-1]
    spread = dialogues.reports(dialogues.repair(dialogues.damage(turns), dialogues.F.col("dropped"))).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in spread} == got


def _sorted_rows(turns):
    """What the tasks are given, a stable sort by conversation; collect() keeps the order within."""
    rows = dialogues.sorted_rows(dialogues.damage(turns), dialogues.F.col("dropped"))
    return iter(sorted(map(tuple, rows.collect()), key=lambda r: (r[0] is not None, r[0] or 0)))


def test_conversations_without_rows(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert dialogues.repair(none).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(gone, 0, "user", "Hi.")], none.schema)
    (row,) = dialogues.reports(dialogues.repair(dialogues.damage(one), dialogues.F.col("dropped"))).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
