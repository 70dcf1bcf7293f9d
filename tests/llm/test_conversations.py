"""Conversation repair against a search over all edits."""

import hashlib
import random
import zlib
from functools import cache

import pytest

from rowkin.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, seg int, kind string, cells int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 1:
            text = ""
        if fault == 2:
            text = "".join(c for c in text if c not in ".!?")
        out += [(conv, turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def brute_force(rows):
    """Dynamic programming over (row, state), last row first, with whole strings; ``rows`` of one conversation after damage."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
    seen, kinds = set(), []
    for _, _, role, text in rows:
        rest = text.rstrip(C.BLANKS)
        kinds.append("blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else "")
        seen.add((role, text))
    n = len(rows)

    @cache
    def ways(k, state, run):
        """The cheapest (cost, audit, turns) from row k on; at most three insertions follow each other."""
        out = [(0, "", ())] if k == n and state in C.ENDS else []
        options = []
        if run < 3:
            options += [(3, "I", k, C.STEP[state, c], (C.ROLES[c], "")) for c in "ua" if (state, c) in C.STEP]
        if k < n:
            role, text, extra = rows[k][2], rows[k][3], 3 * (kinds[k] == "truncated")
            options.append((4, "D", k + 1, state, None))
            if kinds[k] not in ("blank", "duplicate"):
                if (state, role[:1]) in C.STEP:
                    options.append((extra, "K", k + 1, C.STEP[state, role[:1]], (role, text)))
                options += [(3 + extra, "R", k + 1, C.STEP[state, c], (C.ROLES[c], text)) for c in "ua" if (state, c) in C.STEP]
        for cost, letter, at, to, kept in options:
            rest = ways(at, to, run + 1 if letter == "I" else 0)
            if rest:
                out.append((cost + rest[0], letter + rest[1], ((kept,) if kept else ()) + rest[2]))
        return min(out) if out else None

    for k in range(n, 0, -1):  # from the end, so that calls stay shallow
        for state in range(C.STATES):
            ways(k, state, 0)
    cost, audit, kept = ways(0, 0, 0)
    turns = [r[1] for r in rows if r[1] is not None]
    initials = [r[2][:1] for r in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
        sum(a + b not in C.LEGAL for a, b in zip(initials, initials[1:])),
        cost,
        audit,
        hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(),
    )


def expected(rows):
    by = {conv: [] for conv, *_ in rows}
    for r in damaged(rows):
        by[r[0]].append(r)
    return {conv: brute_force(own) for conv, own in by.items()}


def got(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def some_rows(seed=3, conversations=150):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", " \t", "Why?  ", "Yes.", None, "ä…"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]
    rows = []
    for conv in range(conversations):
        odd = conv % 3 == 0
        for k in range(rng.randrange(1, 14)):
            role = rng.choice(roles) if odd or rng.random() < 0.1 else ("user", "assistant")[k % 2]
            rows.append((conv, rng.choice([k, k, k, k + 3, None]) if odd else k, role, rng.choice(texts) if odd or rng.random() < 0.2 else f"Turn {k}."))
    return [*rows, (None, 1, "user", "Null id."), (None, None, "assistant", None), *[(999, k, ("user", "assistant")[k % 2], f"t {k}" * (k % 7) + ".") for k in range(300)], *[(1000, 4, "user", "Same.")] * 9, (1001, 0, "user", "long " * 300_000)]


def test_repair_equals_search(spark):
    rows = some_rows()
    assert got(C.audits(C.damaged(frame(spark, rows)))) == expected(rows)


def test_repair_across_tasks(spark, monkeypatch):
    """Sixteen ranges over two long conversations, merged two by two."""
    rows = [r for r in some_rows() if r[0] in (999, 1000, 7)]
    monkeypatch.setattr(C, "FANIN", 2)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        assert got(C.audits(C.damaged(frame(spark, rows)))) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_nothing_left(spark):
    conv = next(k for k in range(999) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows = frame(spark, [(conv, 0, "user", "Gone.")])
    assert got(C.audits(C.damaged(rows))) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert C.audits(C.damaged(rows.limit(0))).count() == 0


def test_repaired_turns(spark):
    rows = frame(spark, [(1, 0, "system", "Be brief."), (1, 1, "user", "Hello?"), (1, 2, "user", "Hello?"), (2, 0, "assistant", "Hi."), (3, 0, "user", "")])
    turns = [tuple(r) for r in C.repaired(C.as_turns(rows)).orderBy("conv_id", "place").collect()]
    assert turns == [(1, 0, "system", "Be brief."), (1, 1, "user", "Hello?"), (1, 2, "assistant", ""), (2, 0, "user", ""), (2, 1, "assistant", "Hi.")]


def test_semiring():
    rng = random.Random(1)
    kinds = [C.turn(i, d, t) for i in ("s", "u", "a", "x", "") for d in (False, True) for t in (False, True)]
    for _ in range(200):
        a, b, c = (rng.choice(kinds) for _ in range(3))
        assert C.times(C.times(a, b), c) == C.times(a, C.times(b, c))
    for n in (1, 5, 37):
        own, left = C.Segment(), C.IDENTITY
        for k in range(n):
            initial = rng.choice("sua")
            own.push(k, initial, False, False, False)
            left = C.times(left, C.turn(initial, False, False))
        assert own.product() == left and len(own.parts) <= n.bit_length() + 1


@pytest.mark.parametrize("audit,rows,want", [("", [], []), ("II", [], [("user", ""), ("assistant", "")]), ("DKI", [("x", "1"), ("user", "2")], [("user", "2"), ("assistant", "")])])
def test_replay(audit, rows, want):
    assert list(C.replayed(audit, rows)) == want
