"""Conversation repair: CYK against an enumeration of all edit scripts, and the whole contract."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

from phasewise.llm import repair

SHAPE = re.compile(r"(s?(ua)+)?")


def brute_force(rows):
    """Every edit script of up to two inserted rows between rows: least (cost, audit)."""
    gaps = ["", "u", "a", "ua", "au", "uu", "aa"]
    best = None
    for choices in itertools.product("KuaD", repeat=len(rows)):
        if any(c != "D" and f in ("b", "d") for c, (_, f) in zip(choices, rows)):
            continue
        for fills in itertools.product(gaps, repeat=len(rows) + 1):
            roles, audit, cost = "", "", 0
            for k in range(len(rows) + 1):
                roles += fills[k]
                audit += "I" * len(fills[k])
                cost += repair.INSERT * len(fills[k])
                if k == len(rows):
                    break
                (initial, fault), c = rows[k], choices[k]
                if c == "D":
                    audit, cost = audit + "D", cost + repair.DELETE
                    continue
                cost += repair.TRUNCATED if fault == "t" else 0
                if c == "K":
                    roles, audit = roles + initial, audit + "K"
                else:
                    roles, audit, cost = roles + c, audit + "R", cost + repair.REROLE
            if SHAPE.fullmatch(roles) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def test_cyk_equals_enumeration():
    draw = random.Random(3)
    cases = [[], [("s", "")], [("a", "")], [("u", "b")], [("u", "t"), ("a", "")]]
    cases += [[(draw.choice("suax"), draw.choice(["", "", "b", "d", "t"]))
               for _ in range(draw.randint(1, 3))] for _ in range(40)]
    for rows in cases:
        assert repair.finish(repair.parse(rows)) == brute_force(rows), rows


def test_blocks_combine_to_the_whole():
    draw = random.Random(4)
    for _ in range(20):
        rows = [(draw.choice("suax"), draw.choice(["", "", "b", "d", "t"]))
                for _ in range(draw.randint(1, 12))]
        whole = repair.parse(rows)
        for cut in (1, 3, 5):
            parts = [repair.parse(rows[i:i + cut]) for i in range(0, len(rows), cut)]
            assert repair.combine(parts) == whole


def contract(conversations):
    """The contract of op11 in plain Python, with the enumeration's twin (a row-by-row search)."""
    out = {}
    for cid in {c for c, *_ in conversations}:
        rows = []
        for c, turn, role, text in conversations:
            if c != cid:
                continue
            key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
            code = zlib.crc32(key.encode()) % 20
            role, text = (" " if role is None else role), (" " if text is None else text)
            if code == 0:
                continue
            text = "" if code == 1 else re.sub(r"[.!?]", "", text) if code == 2 else text
            role = "user" if code == 4 else role
            rows += [(turn, role, text)] * (2 if code == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in rows:
            solid = re.sub(r"[\x20\x09-\x0d]", "", text)
            fault = ("b" if not solid else "d" if (role, text) in seen
                     else "t" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
            faults.append(fault)
        turns = {r[0] for r in rows if r[0] is not None}
        initials = [r[1][:1] for r in rows]
        cost, audit = viterbi([(i, f) for i, f in zip(initials, faults)])
        lines, j, t = [], 0, 0
        has_s = False
        for letter in audit:
            if letter == "D":
                j += 1
                continue
            if letter == "K":
                role = rows[j][1]
                has_s = has_s or (t == 0 and role.startswith("s"))
            else:
                role = "user" if (t + has_s) % 2 == 0 else "assistant"
            lines.append(f"{role}:{'' if letter == 'I' else rows[j][2]}")
            j += letter != "I"
            t += 1
        out[cid] = dict(
            gaps=(max(turns) - min(turns) + 1 - len(turns)) if turns else 0,
            blank=faults.count("b"), duplicate=faults.count("d"), truncated=faults.count("t"),
            illegal=sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost=cost, audit=audit,
            repaired_sha256=hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def viterbi(rows):
    """Least (cost, audit) by a search over (rows done, state), row by row."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    best = {(0, 0): (0, "")}
    frontier = [(0, "", 0, 0)]
    import heapq
    while frontier:
        cost, audit, done, state = heapq.heappop(frontier)
        if best.get((done, state)) != (cost, audit):
            continue
        moves = [(done, step[state, r], repair.INSERT, "I") for r in "ua" if (state, r) in step]
        if done < len(rows):
            initial, fault = rows[done]
            moves.append((done + 1, state, repair.DELETE, "D"))
            if fault not in ("b", "d"):
                extra = repair.TRUNCATED if fault == "t" else 0
                if (state, initial) in step:
                    moves.append((done + 1, step[state, initial], extra, "K"))
                moves += [(done + 1, step[state, r], repair.REROLE + extra, "R")
                          for r in "ua" if (state, r) in step]
        for d, s, c, letter in moves:
            value = (cost + c, audit + letter)
            if cost + c <= 30 and (best.get((d, s)) is None or value < best[d, s]):
                best[d, s] = value
                heapq.heappush(frontier, (*value, d, s))
    return min(best[len(rows), q] for q in (0, 3) if (len(rows), q) in best)


def test_contract_on_odd_rows(spark):
    draw = random.Random(11)
    roles = ["system", "user", "assistant", "user", "assistant", None, "", "tool"]
    texts = ["Hello there.", "ok", "  ", None, "", "Why?", "Yes!\n", "same", "cut off"]
    rows = [(cid, turn, draw.choice(roles), draw.choice(texts))
            for cid in range(1, 30) for turn in draw.sample(range(12), draw.randint(0, 9))]
    rows += [(None, 1, "user", "a."), (None, None, "assistant", "b."), (5, None, "user", "x."),
             (7, 3, "user", "dup."), (7, 3, "user", "dup."), (8, 0, "user", "e" * 20000)]
    rows += [(40, t, "user" if t % 2 else "assistant", f"turn {t}.") for t in range(30)]
    frame = spark.createDataFrame(
        [(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, "
        "ck string, block int")
    found = {r["conv_id"]: r.asDict() for r in repair.repair_conversations(frame).collect()}
    expected = contract(rows)
    assert set(found) == set(expected)
    for cid, want in expected.items():
        got = found[cid]
        assert {k: got[k] for k in want} == want, cid


def test_empty_table(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair_conversations(frame).count() == 0
