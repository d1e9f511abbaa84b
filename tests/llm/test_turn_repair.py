import hashlib
import itertools
import random
import re
import zlib

import pytest

from siftlake.llm import turn_repair as T

SCHEMA = "conv_id bigint, turn bigint, role string, text string, fault string, seen int, way int"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        way = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        text, role = {1: "", 2: re.sub("[.!?]", "", show(text))}.get(way, show(text)), "user" if way == 4 else show(role)
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(way, 1)
    return out


def repairs(turns, most_inserts):
    """(cost, audit, lines) of all edits with at most so many inserts, by enumeration."""
    ways = []
    for role, text, fault in turns:
        extra = 5 if fault == "truncated" else 0
        own = [("D", 2, None)]
        if fault not in ("blank", "duplicate"):
            own += [("K", extra, (role, text)), ("R", 1 + extra, ("user", text)), ("R", 1 + extra, ("assistant", text))]
        ways.append(own)
    adds = [tuple(("I", 5, (r, "")) for r in rs) for n in range(most_inserts + 1) for rs in itertools.product(("user", "assistant"), repeat=n)]
    for chosen in itertools.product(*ways):
        for spots in itertools.product(adds, repeat=len(turns) + 1):
            if sum(map(len, spots)) <= most_inserts:
                steps = [*spots[0], *(x for step, add in zip(chosen, spots[1:], strict=True) for x in (step, *add))]
                lines = [line for _, _, line in steps if line]
                if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in lines)) and all(r for r, _ in lines):
                    yield sum(c for _, c, _ in steps), "".join(e for e, _, _ in steps), lines


def brute(rows, most_inserts=2):
    out, all_ids = [], {r[0] for r in rows}
    for conv in all_ids:
        turns = sorted((r[1:] for r in damage(rows) if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, marked = set(), []
        for _, role, text in turns:
            inner = text.strip(SPACE)
            fault = "blank" if not inner else "duplicate" if (role, text) in seen else "truncated" if inner[-1] not in ".!?" else None
            seen.add((role, text))
            marked.append((role, text, fault))
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit, lines = min(repairs(marked, most_inserts), key=lambda x: x[:2])
        count = lambda kind: sum(f == kind for _, _, f in marked)
        out.append((conv, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()))
    return sorted(out, key=str)


def repaired(spark, rows):
    df = spark.createDataFrame([(*r, "f", 1, 2) for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in T.repair(T.damaged(df)).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_same_repairs_as_all_edits(spark, seed):
    pick, rows = random.Random(seed), []
    for conv in range(60):
        for turn in range(pick.randint(1, 4)):
            rows.append((conv, pick.choice([turn, turn, 2 * turn, None]), pick.choice(["user", "assistant", "user", "assistant", "system", "tool", "u", "", None]), pick.choice(["Yes.", "No!", "Why?", "cut off", "cut off ", " \n", None, "", "Yes.", "é. \t"])))
    assert repaired(spark, rows) == brute(rows)


def test_no_rows_left_and_null_conversations(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hello."), (None, 5, "user", "A."), (None, 9, "assistant", "B."), (None, None, "assistant", "C.")]
    got = repaired(spark, rows)
    assert got == brute(rows)
    assert (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got
    assert repaired(spark, []) == []


def test_long_conversations_take_one_pass():
    """A long conversation with turns that may go either way costs no more for each turn than a short one."""
    turns = [("x", f"{i}.", 0) for i in range(20_000)]
    run = T.Repair()
    for role, text, fault in turns:
        run.turn(role, text, fault)
    cost, audit, digest = run.result()
    assert cost == 20_000 and audit == "R" * 20_000
    assert digest == hashlib.sha256("\n".join(f"{('user', 'assistant')[i % 2]}:{i}." for i in range(20_000)).encode()).hexdigest()
    assert len(run.back) == 4 * 20_000
    run.turn("x", "odd.", 0)
    assert run.result()[:2] == (20_002, "D" + "R" * 20_000)
