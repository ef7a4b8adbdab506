"""Repair of conversations against exhaustive search, and chunks against whole conversations."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tarnlake.llm import conversation_repair as repair

WHITE = " \t\n\x0b\x0c\r"
INSERTED = ["", "u", "a", "ua", "au"]


def exhaustive(initials: str, faults: str) -> tuple[int, str, str]:
    """Cost, audit and initials of the best of all edits, with at most two insertions between two turns."""
    best = None
    turns = []
    for initial, fault in zip(initials, faults):
        ways = [("D", "", 2)]
        if fault not in "bd":
            more = 5 if fault == "t" else 0
            ways += [("K", initial, more), ("R", "u", 1 + more), ("R", "a", 1 + more)]
        turns.append(ways)
    for chosen in itertools.product(*turns):
        for gaps in itertools.product(INSERTED, repeat=len(turns) + 1):
            audit, out, cost = "I" * len(gaps[0]), gaps[0], 5 * len(gaps[0])
            for (letter, initial, more), gap in zip(chosen, gaps[1:]):
                audit, out, cost = audit + letter + "I" * len(gap), out + initial + gap, cost + more + 5 * len(gap)
            if (best is None or (cost, audit) < best[:2]) and re.fullmatch("(s?(ua)+)?", out):
                best = (cost, audit, out)
    return best


def test_search_finds_what_exhaustive_search_finds():
    r = random.Random(1)
    cases = [("".join(r.choice("suax") for _ in range(n)), "".join(r.choice("---tbd") for _ in range(n))) for n in (1, 2, 3) for _ in range(40)]
    for initials, faults in cases + [("u", "t"), ("s", "-"), ("uu", "--"), ("aua", "---"), ("ssu", "--t")]:
        assert repair.search(initials, faults) == exhaustive(initials, faults)[:2], (initials, faults)


def simple(initials: str, faults: str, state: int = 0) -> tuple[int, str]:
    """One backward pass over the turns: the least (cost, audit) from every state."""
    accept = {0: (0, ""), 3: (0, "")}
    for i in range(len(initials), -1, -1):
        if i < len(initials):
            after, accept = accept, {}
            for s in range(4):
                steps = [(after[t][0] + c, letter + after[t][1]) for letter, t, c in repair.edits(initials[i], faults[i], s) if t in after]
                if steps:
                    accept[s] = min(steps)
        for _ in range(3):
            for s in range(4):
                t = repair.WANTED[s]
                if t in accept:
                    accept[s] = min(accept.get(s, (10**9, "")), (accept[t][0] + 5, "I" + accept[t][1]))
    return accept[state]


def test_search_of_longer_conversations():
    r = random.Random(2)
    for n in [0, 5, 12, 30, 70, 200] * 12:
        initials = "".join(r.choice("suauax") for _ in range(n))
        faults = "".join(r.choice("-----tbd") for _ in range(n))
        assert repair.search(initials, faults) == simple(initials, faults)


def expected(rows: list[tuple]) -> list[tuple]:
    """The whole report in plain Python."""
    made: dict = {}
    for conv, turn, role, text in rows:
        turns = made.setdefault(conv, [])
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        turns += [(turn, "user" if hit == 4 else role, text)] * {0: 0, 3: 2}.get(hit, 1)
    out = []
    for conv, turns in made.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0))
        known = [t[0] for t in turns if t[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        seen, faults = set(), ""
        for _, role, text in turns:
            bare = text.rstrip(WHITE)
            faults += "b" if not bare else "d" if (role, text) in seen else "-" if bare[-1] in ".!?" else "t"
            seen.add((role, text))
        letters = "".join(role[:1] if role[:1] in "sua" and role else "x" for _, role, _ in turns)
        illegal = sum(letters[i : i + 2] not in ("su", "ua", "au") for i in range(len(turns) - 1))
        cost, audit = simple(letters, faults) if turns else (0, "")
        text, at, state = [], 0, 0
        for letter in audit:
            wanted = "a" if state == "u" else "u"
            if letter == "I":
                text.append({"u": "user:", "a": "assistant:"}[wanted])
                state = wanted
                continue
            _, role, body = turns[at]
            at += 1
            if letter == "K":
                text.append(f"{role}:{body}")
                state = role[0]
            elif letter == "R":
                text.append({"u": "user:", "a": "assistant:"}[wanted] + body)
                state = wanted
        counts = [faults.count(f) for f in "bdt"]
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest()))
    return sorted(out, key=str)


SCHEMA = "conv_id long, turn long, role string, text string, place string, hash int, chunk int, fault string, audit string, last int, `a.b` int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y", "z", 3, 4) for r in rows], SCHEMA)


def found(df) -> list[tuple]:
    return sorted(map(tuple, repair.report(df, repair.damaged(df)).collect()), key=str)


def conversations(seed: int, n: int, most: int) -> list[tuple]:
    r = random.Random(seed)
    texts = ["Yes.", "No!", "no end", "", " \n", "Really?", "x" * 50 + ".", "tail. \t", "\x1c", "été?"]
    rows = []
    for conv in range(n):
        for turn in range(r.randrange(1, most)):
            role = r.choice(["user", "assistant"] * 4 + ["system", "tool", "", None])
            role = {0: "user", 1: "assistant"}[turn % 2] if r.random() < 0.6 else role
            rows.append((conv, None if not turn and r.random() < 0.1 else turn + r.randrange(2) * (turn > 5) * 10 ** (turn % 3), role, r.choice([*texts, None, f"text {r.random()}."])))
    r.shuffle(rows)
    return rows


def no_equal_turns(rows: list[tuple]) -> list[tuple]:
    return list({(c, t): (c, t, role, text) for c, t, role, text in rows}.values())


def test_report_equals_plain_python(spark):
    rows = no_equal_turns(conversations(1, 150, 9)) + [(None, 1, "user", "a?"), (None, 2, "assistant", "b."), (777, None, None, None)]
    rows += [(888, -(2**63), "user", "x."), (888, 2**63 - 1, "assistant", "y.")][:0]
    assert found(frame(spark, rows).repartition(4)) == expected(rows)


@pytest.mark.parametrize("chunk", [1, 2, 8])
def test_conversations_in_several_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    rows = no_equal_turns(conversations(chunk, 12, 60) + conversations(3, 1, 300))
    assert found(frame(spark, rows).repartition(6)) == expected(rows)


def test_report_on_edge_cases(spark):
    assert found(frame(spark, [(1, 1, "user", "x.")]).limit(0)) == []
    dropped = next(t for t in range(100) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert found(frame(spark, [(5, dropped, "user", "x.")])) == [(5, 0, 0, 0, 0, 0, 0, "", empty)]
    wide = [(9, t, "user", "x.") for t in (-(2**63), 2**63 - 1)]
    assert {r[1] for r in found(frame(spark, wide))} <= {2**63 - 1, 0}
    equal = [(3, 4, "user", "same.")] * 50 + [(3, 4, "user", None)] * 2
    got = found(frame(spark, equal).repartition(3))
    assert got == expected(equal)


def test_repaired_turns_follow_the_pattern(spark):
    rows = conversations(8, 60, 14)
    df = frame(spark, rows)
    turns = repair.repaired(repair.damaged(df)).collect()
    by: dict = {}
    for t in sorted(turns, key=lambda t: (t["conv_id"], t["position"])):
        by.setdefault(t["conv_id"], []).append(t)
    assert len(by) > 20
    for listed in by.values():
        assert [t["position"] for t in listed] == list(range(len(listed)))
        assert re.fullmatch("(s?(ua)+)?", "".join(t["role"][0] for t in listed))
        assert all(t["text"] == "" for t in listed if t["edit"] == "I")
    digests = {r[0]: r[-1] for r in found(df)}
    for conv, listed in by.items():
        text = "\n".join(f"{t['role']}:{t['text']}" for t in listed)
        assert hashlib.sha256(text.encode()).hexdigest() == digests[conv]
