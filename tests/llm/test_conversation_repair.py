"""Conversation repair: blocks against brute force over edit sequences, and the whole report against a plain reading."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from spanveil.llm import conversation_repair as C

SCHEMA = "conv_id long, turn long, role string, text string"
ROOM = " \t\n\x0b\x0c\r"


def brute_edits(roles, fates):
    """(cost, audit, edits) of the cheapest edits, the audit first in ASCII: every choice at every row, by memory of the state."""
    n = len(roles)

    @lru_cache(None)
    def best(i, have, put_in):
        out = []
        if i == n and re.fullmatch("(s?(ua)+)?", have):
            out.append((0, "", ()))
        # what has been said only matters by its last role
        if put_in < 3:
            for r in "ua":
                if re.fullmatch("(s?(ua)*u?)?", have + r):
                    c, a, e = best(i, short(have + r), put_in + 1)
                    out.append((c + 3, "I" + a, (("I", r), *e)))
        if i < n:
            c, a, e = best(i + 1, have, 0)
            out.append((c + 4, "D" + a, (("D", ""), *e)))
            if fates[i] != "gone":
                extra = 3 * (fates[i] == "truncated")
                for letter, r, price in (("K", roles[i] or "-", 0), ("R", "u", 3), ("R", "a", 3)):
                    if re.fullmatch("(s?(ua)*u?)?", have + r):
                        c, a, e = best(i + 1, short(have + r), 0)
                        out.append((c + price + extra, letter + a, ((letter, r), *e)))
        return min(out, default=(10**9, "~", ()))

    def short(have):
        m = re.fullmatch("(s?)((?:ua)*)(u?)", have)
        return m[1] + m[2][:2] + m[3]

    for i in range(n, -1, -1):  # from the end, so that nothing goes deep
        for have in ("", "s", "u", "su", "ua", "sua", "uau", "suau"):
            best(i, have, 0)
    return best(0, "", 0)


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        got = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            show = [" " if x is None else x for x in (c, turn, role, text)]
            case = zlib.crc32(f"{show[0]}:{show[1]}".encode()) % 20
            role, text = show[2:]
            if case == 0:
                continue
            text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
            got += [(turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)

        def key(r, conv=conv):
            said = f"{len(r[1])}:{r[1]}{r[2]}"
            parts = ["-" if conv is None else conv, "-" if r[0] is None else r[0], said]
            return (r[0] is not None, r[0] or 0, hashlib.sha256(":".join(map(str, parts)).encode()).digest())

        got.sort(key=key)
        fates, seen, faults = [], set(), {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in got:
            last = text.rstrip(ROOM)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else ""
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            fates.append({"": "free", "truncated": "truncated"}.get(fault, "gone"))
        first = [r[1][:1] for r in got]
        cost, audit, edits = brute_edits(tuple(first), tuple(fates))
        lines, at = [], 0
        for letter, r in edits:
            if letter == "I":
                lines.append({"u": "user:", "a": "assistant:"}[r])
                continue
            if letter in "KR":
                lines.append(f"{got[at][1] if letter == 'K' else {'u': 'user', 'a': 'assistant'}[r]}:{got[at][2]}")
            at += 1
        turns = [r[0] for r in got if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
        out[conv] = (gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def report(spark, rows):
    df = C.repair_damaged(spark.createDataFrame(rows, SCHEMA))
    got = df.collect()
    assert len(got) == len({r[0] for r in rows})
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in got}


def some(seed, convs, longest):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "why", " \n", "", None, "a b c?", "Yes.  ", "x.y"]
    out = []
    for c in range(convs):
        for _ in range(r.randint(0, longest)):
            turn = r.choice([None, *range(longest)])
            out.append((r.choice([c, c, c, None]), turn, r.choice(["user", "assistant", "system", "user", "assistant", None, "tool", ""]), r.choice(texts)))
    return out


def test_against_brute_force(spark):
    rows = some(1, 60, 9)
    assert report(spark, rows) == brute(rows)


@pytest.mark.parametrize("bits", [0, 2])
def test_blocks_change_nothing(spark, monkeypatch, bits):
    monkeypatch.setattr(C, "BLOCK_BITS", bits)
    monkeypatch.setattr(C, "PART", 10)
    rows = some(2, 12, 40)
    assert report(spark, rows) == brute(rows)


def test_one_conversation_over_many_partitions(spark):
    r = random.Random(3)
    rows = [(7, k // 2, r.choice(["user", "assistant", "system"]), r.choice(["a.", "b", "", "c!"]) * r.randint(1, 3)) for k in range(900)] + [(7, 5, "user", "a.")] * 500
    rows += [(c, 0, "user", f"{c}.") for c in range(40)]
    assert report(spark, rows) == brute(rows)


def test_matrices_are_the_costs_of_their_blocks():
    r = random.Random(4)
    for _ in range(200):
        n = r.randint(1, 6)
        kinds, copies = "".join(chr(97 + r.randrange(12)) for _ in range(n)), [r.choice([1, 1, 2]) for _ in range(n)]
        m, after = C.matrix(kinds, copies), C.END
        assert C.costs(kinds, copies, after)[0] == tuple(min(m[4 * p + q] + after[q] for q in range(4)) for p in range(4))


def test_odd_tables(spark):
    assert C.repair_damaged(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = spark.createDataFrame([(1, 0, "user", "hi.", 5, "x")], f"{SCHEMA}, cost int, line string")
    assert C.repair_damaged(rows).columns == ["conv_id", *COLUMNS[:6], "audit", "repaired_sha256"]
    # a conversation of which damage leaves nothing
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert report(spark, [(gone, 0, "user", "hi.")])[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    # a very long text
    rows = [(1, t, ("user", "assistant")[t % 2], "word " * 400_000 + str(t) + ".") for t in range(4)]
    assert report(spark, rows) == brute(rows)


def test_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert report(spark, rows) == brute(rows)
