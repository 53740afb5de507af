"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import zlib

import pytest

from rivulet.llm import conversations as c
from rivulet.llm.common import Tables

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def plain(rows):
    """Damaged rows of one conversation, in order: (gaps, blank, duplicate, truncated, illegal, cost, audit, hash)."""
    n, seen, marks = [0, 0, 0], set(), []
    for _, role, text in rows:
        shown = text.rstrip(SPACE)
        fault = 0 if not shown else 1 if (role, text) in seen else 2 if shown[-1] not in ".!?" else None
        seen.add((role, text))
        marks.append(fault)
        if fault is not None:
            n[fault] += 1
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    # best by the number of turns done and the roles so far: "" none, "s", "u", "a" the last one
    best = {"": (0, "", ())}

    def better(to, key, new):
        if key not in to or new[:2] < to[key][:2]:
            to[key] = new

    def grown(now):
        for _ in range(3):
            for k, (cost, audit, out) in list(now.items()):
                role = "assistant" if k == "u" else "user"
                better(now, role[0], (cost + 3, audit + "I", (*out, role + ":")))
        return now

    for (_, role, text), fault in zip(rows, marks):
        nxt = {}
        for k, (cost, audit, out) in grown(best).items():
            better(nxt, k, (cost + 4, audit + "D", out))
            if fault in (0, 1):
                continue
            more = 3 if fault == 2 else 0
            for edit, r, price in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                i = r[:1]
                if (i == "s" and k == "") or (i == "u" and k in ("", "s", "a")) or (i == "a" and k == "u"):
                    better(nxt, i, (cost + price + more, audit + edit, (*out, f"{r}:{text}")))
        best = nxt
    cost, audit, out = min((v for k, v in grown(best).items() if k in ("", "a")), key=lambda v: v[:2])
    return gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        out.setdefault(conv, [])
        text = "" if k == 1 else "".join(x for x in text if x not in ".!?") if k == 2 else text
        out[conv] += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0)) for k, v in out.items()}


def held(spark, rows, block, schema=SCHEMA, extra=()):
    df = spark.createDataFrame([(*r, *extra) for r in rows], schema)
    with Tables() as own:
        got = {r[0]: tuple(r)[1:] for r in c.digest(df, *c.repair(c.damage(df), block)).collect()}
    own.release(spark)
    return got


@pytest.mark.parametrize("block", [3, 4096])
def test_against_plain_search(spark, block):
    rnd = random.Random(block)
    texts = ["Yes.", "No!", "well", " ", "", "Why?\n", None, "ok. "]
    rows = [(conv, t, rnd.choice(["user", "assistant", "system", "tool", None, ""]), rnd.choice(texts)) for conv in range(40) for t in range(rnd.choice([1, 2, 5, 9, 30]))]
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (99, None, "user", "Null turn."), (99, 4, "assistant", "Four.")]
    want = {k: plain(v) if v else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for k, v in damaged(rows).items()}
    assert held(spark, rows, block) == want


def test_one_long_conversation_over_many_blocks(spark):
    rnd = random.Random(5)
    rows = [(7, t, rnd.choice(["user", "assistant"]), f"Turn {t if rnd.random() < 0.9 else 0}{rnd.choice(['.', ''])}") for t in range(3000)]
    assert held(spark, rows, 64)[7] == plain(damaged(rows)[7])


def test_edges(spark):
    assert held(spark, [], 8) == {}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    dropped = next(t for t in range(99) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    assert held(spark, [(1, dropped, "user", "Gone.")], 8) == {1: nothing}
    long = "word " * 400_000 + "."
    fine = [t for t in range(99) if zlib.crc32(f"2:{t}".encode()) % 20 > 4][:2]
    rows = [(2, fine[0], "user", long), (2, fine[1], "assistant", long)]
    clash = SCHEMA + ", rank long, block string, mark int"
    assert held(spark, rows, 8, clash, (1, "x", 2)) == {2: plain(damaged(rows)[2])}
    # rows of one turn: by role, so the order of the table doesn't matter
    rows = [(3, fine[0], "user", "B."), (3, fine[0], "assistant", "A.")]
    assert held(spark, rows, 8) == held(spark, rows[::-1], 8)


def test_edits_are_the_real_output(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hi."), (1, 2, "user", ""), (1, 3, "user", "Bye.")]
    with Tables() as own:
        edits, sums = c.repair(spark.createDataFrame(rows, SCHEMA))
        got = [tuple(r) for r in edits.orderBy("rank", "place").select("edit", "turn", "role", "text").collect()]
        assert sums.collect()[0]["cost"] == 10
    own.release(spark)
    assert got == [("K", 0, "system", "Be kind."), ("I", None, "user", ""), ("K", 1, "assistant", "Hi."), ("D", 2, "user", ""), ("K", 3, "user", "Bye."), ("I", None, "assistant", "")]


def test_product_is_associative():
    rnd = random.Random(1)
    for _ in range(200):
        a, b, d = (c.reduce(bytes(rnd.choices(range(9), k=rnd.randint(1, 6)))) for _ in range(3))
        assert c.product(c.product(a, b), d) == c.product(a, c.product(b, d))
