"""Conversation repair against plain dynamic programming and against all edits of short conversations."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from labelaudit.llm import op11_repair

SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?")
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        some = lambda v: " " if v is None else str(v)
        fault = zlib.crc32(f"{some(conv)}:{some(turn)}".encode()) % 20
        role, text = some(role), some(text)
        if fault == 0:
            continue
        role = "user" if fault == 4 else role
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, role, text)] * (2 if fault == 3 else 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        found = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain(rows, faults):
    """Least (cost, edits) by plain recursion from the end, one entry a state."""
    best = {"": (0, ""), "s": (10, "II"), "u": (5, "I"), "a": (0, "")}
    for (_, _, role, _), fault in zip(reversed(rows), reversed(faults), strict=True):
        extra = 5 if fault == "truncated" else 0
        step = {}
        for state in best:
            ways = [(best[state][0] + 2, "D" + best[state][1])]
            if fault not in ("blank", "duplicate"):
                n = NEXT[state]
                ways.append((best[n][0] + 1 + extra, "R" + best[n][1]))
                if role[:1] == n or (role[:1] == "s" and state == ""):
                    ways.append((best[role[:1]][0] + extra, "K" + best[role[:1]][1]))
            step[state] = min(ways)
        once = {s: min(step[s], (step[NEXT[s]][0] + 5, "I" + step[NEXT[s]][1])) for s in step}
        best = {s: min(once[s], (once[NEXT[s]][0] + 5, "I" + once[NEXT[s]][1])) for s in step}
    return best[""]


def expected(rows):
    out = []
    ids = {r[0] for r in rows}
    after = damage(rows)
    for conv in ids:
        mine = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        faults = faults_of(mine)
        cost, audit = plain(mine, faults)
        lines, state, left = [], "", iter(mine)
        for edit in audit:
            row = next(left) if edit != "I" else None
            if edit == "D":
                continue
            state = row[2][:1] if edit == "K" else NEXT[state]
            role = row[2] if edit == "K" else {"u": "user", "a": "assistant"}[state]
            lines.append(f"{role}:{'' if edit == 'I' else row[3]}")
        turns = {r[1] for r in mine} - {None}
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def odd_conversations():
    rnd = random.Random(5)
    roles = ["user", "assistant", "system", "tool", "", None, "umpire", "User"]
    texts = ["Hello there.", "Why?", "no end", "", " \t\n", None, "So it is!  ", "日本語。", "ends in a blank line.\n\n", "x" * 70_000]
    rows = []
    for conv in [*range(150), None, 10**15]:
        for _ in range(rnd.choice([1, 1, 2, 3, 5, 8, 13])):
            turn = rnd.choice([None, *range(9)])
            rows.append((conv, turn, rnd.choices(roles, [6, 6, 2, 1, 1, 1, 1, 1])[0], rnd.choice(texts[: 9 + (rnd.random() < 0.05)])))
    return [*rows, *rows[:25]]


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_equals_plain_recursion(spark):
    rows = odd_conversations()
    got = found(op11_repair.repaired_conversations(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    assert got == expected(rows)


@pytest.mark.parametrize("most", [0, 3])
def test_ranges_of_rows_give_the_same(spark, most):
    rows = odd_conversations()
    rnd = random.Random(6)
    rows += [(7000, rnd.choice([None, *range(700)]), rnd.choice(["user", "assistant", "system"]), rnd.choice(["a.", "b?", f"c{rnd.random()}!", "open"])) for _ in range(2500)]
    got = found(op11_repair.repaired_conversations(spark.createDataFrame(rows, SCHEMA).repartition(5), long_rows=most))
    assert got == expected(rows)


def test_all_edits_of_short_conversations():
    """Every sequence of edits of up to three rows and three inserts, told apart by grammar and cost alone."""

    def every(rows, faults):
        def results(edits, at=0, roles="", cost=0):
            if not edits:
                if at == len(rows) and GRAMMAR.fullmatch(roles):
                    yield cost
                return
            edit, rest = edits[0], edits[1:]
            if edit == "I":
                for r in "ua":
                    yield from results(rest, at, roles + r, cost + 5)
            elif at < len(rows):
                extra = 5 if faults[at] == "truncated" else 0
                if edit == "D":
                    yield from results(rest, at + 1, roles, cost + 2)
                elif faults[at] not in ("blank", "duplicate"):
                    for r in [rows[at][2][:1]] if edit == "K" else "ua":
                        yield from results(rest, at + 1, roles + r, cost + extra + (edit == "R"))

        best = []
        for inserts in range(4):
            for edits in product("DIKR", repeat=len(rows) + inserts):
                if edits.count("I") == inserts:
                    best += [(c, "".join(edits)) for c in results(edits)]
        return min(best)

    for n in range(4):
        for roles in product(["user", "assistant", "system", "tool"], repeat=n):
            for texts in product(["x.", "x", ""], repeat=n):
                rows = [(0, k, r, t and t + "!" * k * (t != "x") + str(k) * (t == "x")) for k, (r, t) in enumerate(zip(roles, texts, strict=True))]
                faults = faults_of(rows)
                if n == 3 and hash((roles, texts)) % 12:
                    continue
                codes = bytes(op11_repair.row_code(r[2][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(rows, faults, strict=True))
                cost, edits, tail = op11_repair.cheapest(codes)
                assert (cost, "".join(edits) + tail) == every(rows, faults) == plain(rows, faults)


def test_nothing_left_and_empty_tables(spark):
    assert op11_repair.repaired_conversations(spark.createDataFrame([], SCHEMA)).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    for most in (0, 100):
        got = found(op11_repair.repaired_conversations(spark.createDataFrame([(gone, 0, "user", "x.")], SCHEMA), long_rows=most))
        assert got == [(gone, 0, 0, 0, 0, 0, 0, "", empty)]


def test_clashing_columns(spark):
    rows = odd_conversations()[:60]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as gone", "2 as part", "3 as place", "4 as fault", "5 as large_id", "6 as n", "7 as `a.b`")
    assert found(op11_repair.repaired_conversations(docs)) == expected(rows)
