"""Conversation repair against a plain recursion that keeps whole audits and texts."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from corridor.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, cost string, at int, path string, _kind int"
WANTED, AFTER, NAME = {0: "u", 1: "u", 2: "a", 3: "u"}, {0: 2, 1: 2, 2: 3, 3: 2}, {"u": "user", "a": "assistant"}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, "p", 2) for r in rows], SCHEMA)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def solve(rows):
    """(blank, duplicate, truncated, illegal, cost, audit, repaired) of one conversation's (turn, role, text) rows."""
    mark = lambda r, t: hashlib.md5(f"{len(r)}:{r}{t}".encode()).digest()
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), mark(r[1], r[2])))
    seen, kinds = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        kinds.append("blank" if not bare.strip(" \t\n\x0b\x0c\r") else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(at, state, inserts):
        options = [(0, "", ())] if at == len(rows) and state in (0, 3) else []
        if inserts:
            cost, audit, lines = best(at, AFTER[state], inserts - 1)
            options.append((cost + 3, "I" + audit, (NAME[WANTED[state]] + ":",) + lines))
        if at < len(rows):
            _, role, text = rows[at]
            cost, audit, lines = best(at + 1, state, 3)
            options.append((cost + 4, "D" + audit, lines))
            if kinds[at] in ("", "truncated"):
                extra = 3 if kinds[at] else 0
                for to in {AFTER[state]} if role[:1] == WANTED[state] else {1} if role[:1] == "s" and state == 0 else ():
                    cost, audit, lines = best(at + 1, to, 3)
                    options.append((cost + extra, "K" + audit, (f"{role}:{text}",) + lines))
                cost, audit, lines = best(at + 1, AFTER[state], 3)
                options.append((cost + 3 + extra, "R" + audit, (f"{NAME[WANTED[state]]}:{text}",) + lines))
        return min(options, default=(10**9, "", ()))

    cost, audit, lines = best(0, 0, 3)
    pairs = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    counts = [kinds.count(k) for k in ("blank", "duplicate", "truncated")]
    return (*counts, pairs, cost, audit, "\n".join(lines))


def expected(rows, ids):
    out = set()
    for conv in ids:
        mine = [r[1:] for r in rows if r[0] == conv]
        blank, duplicate, truncated, illegal, cost, audit, text = solve(mine)
        turns = {r[0] for r in mine if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.add((conv, gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return out


def many(seed, conversations):
    draw = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "umpire", "User", "", None]
    texts = ["Yes.", "No", "", " \t", "Why? ", "same text.", "ünï 😀!", None]
    rows = []
    for conv in range(conversations):
        for at in range(draw.randrange(0, 9)):
            turn = draw.choice([at, at, at, at + 40, None, at // 2])
            rows.append((draw.choice([conv, conv, conv, None]) if conv < 3 else conv, turn, draw.choices(roles, [9, 9, 4, 1, 1, 1, 1, 1])[0], draw.choice(texts)))
    return rows + [(-7, 3, "user", "Hello.")] * 3


def results(found):
    return {tuple(r) for r in found.collect()}


def test_report_equals_recursion(spark):
    rows = many(1, 250)
    ids = {r[0] for r in rows}
    table = frame(spark, rows)
    found = repair.report(repair.damage(table), table)
    assert results(found) == expected(damaged(rows), ids)


def test_undamaged_rows_and_missing_ones(spark):
    rows = many(2, 120)
    table = frame(spark, rows)
    ids = spark.createDataFrame([(r[0],) for r in rows] + [(10**6,)], "conv_id long")
    assert results(repair.report(table, ids)) == expected([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows], {r[0] for r in rows} | {10**6})


def test_one_long_conversation_in_pieces(spark):
    rows = [(5, t, ("user", "assistant")[t % 2], f"turn {t}" + "." * (t % 11 > 0)) for t in range(30_000)]
    rows += [(5, 10**9 + t, "user", "again and again.") for t in range(6_000)] + [(i, 0, "user", "Hi.") for i in range(10, 40)]
    table = frame(spark, rows)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = {r.conv_id: r for r in repair.report(table, table).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    long = found[5]
    assert long.truncated == 2728 and long.duplicate == 5_999 and long.illegal == 6_000 - 1
    assert long.cost == 3 * 2728 + 4 * 5_999 + 3 and len(found) == 31
    lines = [f"{r}:{x}" for _, _, r, x in rows[:30_000]] + ["user:again and again.", "assistant:"]
    assert long.repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_repaired_rows(spark):
    rows = frame(spark, [(1, 0, "assistant", "Hi."), (1, 1, "user", "Cut"), (2, 0, "user", "")])
    turns = repair.repaired(rows, repair.plan(rows)).orderBy("conv", "position").collect()
    assert [tuple(r) for r in turns] == [("=1", 0, "user", ""), ("=1", 1, "assistant", "Hi.")]  # to finish "Cut" costs more than to delete it


def test_suffixes_are_computed_once():
    automaton = repair.Automaton()
    paths = sorted(["suaua", "uaua", "xua", "ua", "Saua", "uaUa"], key=lambda p: p[::-1])
    answers = {}
    for path in paths:
        automaton.turn_to(path[::-1].encode())
        answers[path] = automaton.answer()
    suffixes = {p[i:] for p in paths for i in range(len(p) + 1)}
    assert automaton.computed == len(suffixes)
    assert answers["suaua"] == (0, "KKKKK") and answers["xua"] == (4, "DKK") and answers["uaUa"] == (3, "KKKK")


def test_empty(spark):
    table = frame(spark, [])
    assert repair.report(repair.damage(table), table).collect() == []


@pytest.mark.parametrize("turns", [[None, None], [-(2**63), 2**63 - 1]])
def test_turn_bounds(spark, turns):
    table = frame(spark, [(1, t, "user", "x.") for t in turns])
    assert repair.report(table, table).first().gaps == (0 if turns[0] is None else 2**63 - 1)
