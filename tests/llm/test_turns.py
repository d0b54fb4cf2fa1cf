import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from newsloom.llm import turns

INITIALS = {"s": 1, "u": 2, "a": 3}


def least(codes, inserts=3):
    """(cost, audit) by trying all edits on the states of the grammar: start, after s, u, a."""

    @lru_cache(None)
    def go(i, state, left):
        found = [(0, "")] if i == len(codes) and state in (0, 3) else []

        def take(cost, edit, rest):
            if rest is not None:
                found.append((cost + rest[0], edit + rest[1]))

        following = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}[state]
        if i < len(codes):
            code = codes[i]
            take(2, "D", go(i + 1, state, left))
            if not code & turns.GO:
                stay = 5 if code & turns.CUT_OFF else 0
                for x in following:
                    if code & 3 == x:
                        take(stay, "K", go(i + 1, x, left))
                    elif x != 1:
                        take(stay + 1, "R", go(i + 1, x, left))
        for x in following:
            if left and x != 1:
                take(5, "I", go(i, x, left - 1))
        return min(found) if found else None

    return go(0, 0, inserts)


def plain(conv):
    """The contract, for one conversation's rows (turn, role, text) in order."""
    rows, seen, codes = sorted(conv, key=lambda r: (r[0] is not None, r[0] or 0)), set(), []
    kinds = {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        dark = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not dark else "duplicate" if (role, text) in seen else "truncated" if dark[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            kinds[fault] += 1
        codes.append(INITIALS.get(role[:1], 0) + {None: 0, "truncated": turns.CUT_OFF}.get(fault, turns.GO))
    have = [r[0] for r in rows if r[0] is not None]
    gaps = max(have) - min(have) + 1 - len(set(have)) if have else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = least(bytes(codes))
    kept = [e for e in audit if e != "D"]
    names = (["system"] if len(kept) % 2 else []) + ["user", "assistant"] * len(kept)
    out, i = [], 0
    for edit in audit:
        if edit == "I":
            out.append(f"{names[len(out)]}:")
            continue
        if edit != "D":
            out.append(f"{rows[i][1] if edit == 'K' else names[len(out)]}:{rows[i][2]}")
        i += 1
    return (gaps, *kinds.values(), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def damaged(rows):
    """The contract's damage by conversation."""
    out = {}
    known = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        role, text, fate = known(role), known(text), zlib.crc32(f"{known(conv)}:{known(turn)}".encode()) % 20
        if fate == 0:
            continue
        role, text = "user" if fate == 4 else role, "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        mine += [(turn, role, text)] * (1 + (fate == 3))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_audits_are_the_least(seed):
    random.seed(seed)
    for _ in range(1500):
        codes = bytes(random.choice([2, 3, 2, 3, 2, 3, 1, 0]) + random.choice([0, 0, 0, 8, 20, 36]) for _ in range(random.randrange(12)))
        assert turns.align(codes) == least(codes), list(codes)


def test_long_conversation():
    random.seed(5)
    codes = bytes((2 + i % 2 if random.random() > 0.05 else 2) + random.choice([0] * 17 + [8, 20]) for i in range(900) if random.random() > 0.05)
    cost, audit = turns.align(codes)
    # the same by the states of the grammar, one row after the other
    far = 10**9
    costs = {0: 0, 1: far, 2: far, 3: far}
    for c in codes:
        stay = 5 if c & 8 else 0
        new = {s: v + 2 for s, v in costs.items()}
        for s, following in ((0, (1, 2)), (1, (2,)), (2, (3,)), (3, (2,))):
            for x in following:
                if not c & turns.GO and (c & 3 == x or x != 1):
                    new[x] = min(new[x], costs[s] + stay + (c & 3 != x))
        costs = new
    assert cost == min(costs[0], costs[3]) and len(audit.replace("I", "")) == len(codes)


def test_tables(spark):
    random.seed(7)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(random.randrange(1, 14)):
            text = random.choice(["Yes. ", "no", "It is so!", "", " \t\n", "Why?", "É ok.", None, "word " * 50 + "end."])
            rows.append((conv, random.choice([turn, turn, turn, turn + 1]) if conv != 7 else None, random.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Ünder"]), text))
    rows = list({(r[0], r[1]): r for r in rows}.values())  # one row a turn, so that the order is given
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, audit string, digest string")
    got = {r.conv_id: tuple(r)[1:] for r in turns.repair(turns.damage(frame)).collect()}
    assert got == {conv: plain(mine) for conv, mine in damaged(rows).items()}
    assert turns.repair(turns.damage(frame.limit(0))).count() == 0
    kept = {r.conv_id: tuple(r)[1:] for r in turns.repair(turns.undamaged(frame)).collect()}
    assert kept == {conv: plain([(t, " " if a is None else a, " " if x is None else x) for c, t, a, x in rows if c == conv]) for conv in {r[0] for r in rows}}


def test_repeats_and_ties(spark):
    rows = [(1, 0, "user", "a."), (1, 0, "user", "a."), (1, 0, "assistant", "b."), (1, None, "user", "c.")] * 2
    got = turns.repair(turns.undamaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    # c., c. again, then role by role: b. twice, a. four times
    assert [tuple(r)[:7] for r in got] == [(1, 0, 0, 5, 0, 5, 12)] and got[0].audit == "KDKDDDDD"[: len(got[0].audit)]
