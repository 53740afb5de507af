"""Conversation structure repair by a min-plus scan: each turn is a 4x4 matrix of (cost, audit), joined by an associative
product over trees.

A repaired conversation's role initials follow (s?(ua)+)?. The states of that pattern: 0 nothing yet, 1 after s, 2 after u,
3 after a; it may end in 0 and 3. A turn's matrix holds for each pair of states the cheapest edits that lead from one to
the other, inserts before the turn included (the closure of inserts); of equal costs the audit that is least in ASCII.
An entry's audit has one letter for each turn besides its inserts and ends with that of the last turn, so that none is
the beginning of another one of the same turns: order by (cost, audit) outlives concatenation, and the product is
associative.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, batches, ordered, table, tasks

#: Turns in a block; a conversation is cut where a block ends, and its pieces meet as matrices only.
BLOCK = 4096
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

_BY_USER, _BY_ASSISTANT = (2, 2, None, 2), (None, None, 3, None)
_NEXT = {"s": (1, None, None, None), "u": _BY_USER, "a": _BY_ASSISTANT}
#: Where an insert leads: it takes the one role that the pattern allows.
_INSERTED = (2, 2, 3, 2)
_ENDS = (0, 3)

Matrix = tuple  # 16 entries (cost, audit) or None, by 4 * from + to


def _closure() -> Matrix:
    """Any number of inserts, from each state to each."""
    out = [None] * 16
    for i in range(4):
        at, steps = i, 0
        while out[4 * i + at] is None:
            out[4 * i + at] = (INSERT * steps, "I" * steps)
            at, steps = _INSERTED[at], steps + 1
    return tuple(out)


def product(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product over (cost, audit)."""
    out = []
    for i in (0, 4, 8, 12):
        for j in range(4):
            best = None
            for k in range(4):
                x, y = a[i + k], b[4 * k + j]
                if x is not None and y is not None:
                    z = (x[0] + y[0], x[1] + y[1])
                    if best is None or z < best:
                        best = z
            out.append(best)
    return tuple(out)


_CLOSURE = _closure()


@lru_cache(maxsize=64)
def turn(initial: str, must_go: bool, truncated: bool) -> Matrix:
    """The matrix of one turn."""
    one: list = [None] * 16
    for i in range(4):
        one[5 * i] = (DELETE, "D")
        if must_go:
            continue
        more = TRUNCATED * truncated
        for edit, cost, to in (("R", RENAME, _NEXT["u"][i]), ("R", RENAME, _NEXT["a"][i]), ("K", 0, _NEXT.get(initial, (None,) * 4)[i])):
            if to is not None and (one[4 * i + to] is None or (cost + more, edit) < one[4 * i + to]):
                one[4 * i + to] = (cost + more, edit)
    return product(_CLOSURE, tuple(one))


_KINDS = [("s", False, False), ("u", False, False), ("a", False, False), ("", False, False), ("s", False, True), ("u", False, True), ("a", False, True), ("", False, True), ("", True, False)]
_KIND = {k: bytes([i]) for i, k in enumerate(_KINDS)}


def kind(initial: str, must_go: bool, truncated: bool) -> bytes:
    if must_go:
        return b"\x08"
    return _KIND[initial if initial in ("s", "u", "a") else "", False, truncated]


@lru_cache(maxsize=1 << 14)
def _short(kinds: bytes) -> Matrix:
    if len(kinds) == 1:
        return turn(*_KINDS[kinds[0]])
    half = len(kinds) // 2
    return product(_short(kinds[:half]), _short(kinds[half:]))


def reduce(kinds: bytes) -> Matrix:
    """The matrix of a run of turns, by a balanced tree; short runs are looked up."""
    if len(kinds) <= 8:
        return _short(kinds)
    half = 1 << ((len(kinds) - 1).bit_length() - 1)
    return product(reduce(kinds[:half]), reduce(kinds[half:]))


def finish(m: list) -> tuple | None:
    """(cost, audit, state before the closing inserts, their number) of the best way through from nothing to an end, given
    the entries from state 0. The pieces' audits are told apart before any closing insert counts."""
    best = None
    for k in range(4):
        for end in _ENDS:
            x, y = m[k], _CLOSURE[4 * k + end]
            if x is not None and y is not None:
                z = (x[0] + y[0], x[1], y[1], k)
                best = z if best is None or z < best else best
    return best


_PIECE = """conv_id {conv}, block long, first long, turns long, blank long, duplicate long, truncated long, illegal long, initials array<string>,
 least {turn}, most {turn}, different long, costs array<long>, places array<int>, audits array<string>"""


def _pieces(frames: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows sorted by rank, a mark before each that is the first of its role and text, to one row for each run of a
    conversation in a block."""
    done: list[dict] = []
    now: dict | None = None
    fresh = None

    def close() -> None:
        m = reduce(bytes(now.pop("kinds")))
        texts = sorted({x[1] for x in m if x})
        now["costs"] = [x and x[0] for x in m]
        now["places"] = [x and texts.index(x[1]) for x in m]
        now["audits"] = [x and x[1] for x in m]
        done.append(now)

    for b in batches(frames):
        cols = [b.column(c).to_pylist() for c in ("conv_id", "block", "rank", "mark", "turn", "initial", "blank", "open")]
        for conv, block, rank, mark, turn_, initial, blank, cut in zip(*cols, strict=True):
            if mark:
                fresh = rank
                continue
            if now is None or now["block"] != block or now["conv_id"] != conv:
                if now is not None:
                    close()
                now = {"conv_id": conv, "block": block, "first": rank, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0,
                       "initials": [initial, initial], "least": None, "most": None, "different": 0, "kinds": bytearray()}
            elif now["initials"][1] + initial not in ("su", "ua", "au"):
                now["illegal"] += 1
            again = not blank and fresh != rank
            cut = cut and not blank and not again
            now["turns"] += 1
            now["blank"] += blank
            now["duplicate"] += again
            now["truncated"] += cut
            now["initials"][1] = initial
            if turn_ is not None:
                if turn_ != now["most"]:
                    now["different"] += 1
                now["least"] = turn_ if now["least"] is None else now["least"]
                now["most"] = turn_
            now["kinds"] += kind(initial, blank or again, cut)
        if len(done) >= 1000:
            yield pa.RecordBatch.from_pylist(done, schema)
            done = []
    if now is not None:
        close()
    if done:
        yield pa.RecordBatch.from_pylist(done, schema)


_CHOICE = "first long, enter int, leave int, closing int, conv_id {conv}, last boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _choose(frames: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by conversation and place, to the states in which the best way enters and leaves each, and the sums of
    the conversation with its last piece. A piece's audits are told by their place among each other, one character."""
    top = (1 << 63) - 1

    def tree(ms: list[Matrix]) -> Matrix:
        while len(ms) > 1:
            ms = [product(ms[i], ms[i + 1]) if i + 1 < len(ms) else ms[i] for i in range(0, len(ms), 2)]
        return ms[0]

    def told(rows: list[dict]) -> list[dict]:
        ms = [tuple(None if c is None else (c, chr(65 + p)) for c, p in zip(r["costs"], r["places"], strict=True)) for r in rows]
        cost, path, closing, leave = finish(list(tree(ms)[:4]))
        out, state = [], 0
        for r, place in zip(rows, path, strict=True):
            to = r["places"].index(ord(place) - 65, 4 * state, 4 * state + 4) - 4 * state
            out.append({"first": r["first"], "enter": state, "leave": to, "closing": 0, "conv_id": r["conv_id"], "last": False})
            state = to
        assert state == leave
        sums = {c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated", "illegal")}
        sums["illegal"] += sum(a["initials"][1] + b["initials"][0] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        given = [r for r in rows if r["most"] is not None]
        different = sum(r["different"] for r in given) - sum(a["most"] == b["least"] for a, b in zip(given, given[1:], strict=False))
        gaps = min(given[-1]["most"] - given[0]["least"] + 1 - different, top) if given else 0
        out[-1] |= {"closing": len(closing), "last": True, "gaps": gaps, "cost": cost, **sums}
        return out

    rows: list[dict] = []
    for b in batches(frames):
        out: list[dict] = []
        for r in b.to_pylist():
            if rows and rows[-1]["conv_id"] != r["conv_id"]:
                out += told(rows)
                rows = []
            rows.append(r)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    if rows:
        yield pa.RecordBatch.from_pylist(told(rows), schema)


def _edit(frames: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows sorted by rank, before the first of each piece its chosen audit, to the edits."""
    role = {2: "user", 3: "assistant"}
    letters, at, state, closing, left = "", 0, 0, 0, 0
    for b in batches(frames):
        out: list[tuple] = []
        cols = [b.column(c).to_pylist() for c in ("conv_id", "rank", "mark", "turn", "role", "text", "audit", "enter", "closing", "turns")]
        for conv, rank, mark, turn_, own, text, audit, enter, close, turns in zip(*cols, strict=True):
            if mark:
                letters, at, state, closing, left = audit, 0, enter, close, turns
                continue
            place = 0
            while letters[at] == "I":
                state = _INSERTED[state]
                out.append((conv, rank, place, "I", None, role[state], ""))
                at, place = at + 1, place + 1
            letter = letters[at]
            at, left = at + 1, left - 1
            if letter == "K":
                state = _NEXT[own[:1]][state]
            elif letter == "R":
                state = _INSERTED[state]
                own = role[state]
            out.append((conv, rank, place, letter, turn_, own, text))
            for _ in range(0 if left else closing):
                place, state = place + 1, _INSERTED[state]
                out.append((conv, rank, place, "I", None, role[state], ""))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _arrow(df_schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(df_schema))


def _mapped(df: DataFrame, step, ddl: str) -> DataFrame:
    schema = _arrow(ddl)
    return df.mapInArrow(lambda frames: step(frames, schema), ddl)


def initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def repair(conversations: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(edits, sums) of conversations (conv_id, turn, role, text; other columns take no part, whatever their names).

    edits: conv_id, rank, place, edit (K keep, R rename, D delete, I insert), turn, role, text. In order of (rank, place) the
    edits of a conversation make its audit, those but D its repaired turns; inserted ones have a null turn and an empty
    text, deleted ones what they were. sums: conv_id, gaps, blank, duplicate, truncated, illegal, cost, for each
    conversation that has rows.

    Rows of a conversation are taken by turn, nulls first, then by role and by the hash of the text. A null role or text counts as one space, rows without a conv_id are one conversation, an empty
    table gives empty results. gaps that a long can't hold are its greatest value.

    A conversation of any length is dealt to blocks of that many turns: a duplicate is one that isn't the first of its role and text,
    which an aggregate finds, and no task holds more of a conversation's turns than a block. The pieces of one
    conversation, one row for each block, meet in one task.
    """
    spark = conversations.sparkSession
    arrow_limits(spark)
    conv, turn_ = (conversations.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    own = conversations.select("conv_id", "turn", space("role"), space("text")).withColumn("same", F.xxhash64("text")).withColumn("id", F.monotonically_increasing_id())
    t = ordered(own, ["conv_id", "turn", "role", "same", "id"])
    t = t.withColumn("block", F.floor(F.col("rank") / block).cast("long"))
    first = t.groupBy("conv_id", "role", F.sha2("text", 256).alias("h")).agg(F.min("rank").alias("rank"))
    marks = first.select(F.floor(F.col("rank") / block).cast("long").alias("block"), "rank", F.lit(True).alias("mark"))
    shown = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    rows = t.select(
        "conv_id", "block", "rank", F.lit(False).alias("mark"), "turn", initial(F.col("role")).alias("initial"),
        (shown == "").alias("blank"), (~F.substring(shown, -1, 1).isin(".", "!", "?")).alias("open"),
    )
    n = tasks(spark)
    both = rows.unionByName(marks, allowMissingColumns=True).repartition(n, "block").sortWithinPartitions("block", "rank", F.desc("mark"))
    pieces = table(_mapped(both, _pieces, _PIECE.format(conv=conv, turn=turn_).replace("\n", "")))
    by_conv = pieces.drop("audits").repartition(n, "conv_id").sortWithinPartitions("conv_id", "first")
    chosen = table(_mapped(by_conv, _choose, _CHOICE.format(conv=conv)))
    entry = F.element_at("audits", F.col("enter") * 4 + F.col("leave") + 1)
    audits = pieces.join(chosen.drop("conv_id", "blank", "duplicate", "truncated", "illegal"), "first")
    audits = audits.select("block", F.col("first").alias("rank"), F.lit(True).alias("mark"), entry.alias("audit"), "enter", "closing", "turns")
    texts = t.select("conv_id", "block", "rank", F.lit(False).alias("mark"), "turn", "role", "text").unionByName(audits, allowMissingColumns=True)
    texts = texts.repartition(n, "block").sortWithinPartitions("block", "rank", F.desc("mark"))
    edits = _mapped(texts, _edit, f"conv_id {conv}, rank long, place int, edit string, turn {turn_}, role string, text string")
    return edits, chosen.where("last").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _hashed(frames: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Edits sorted by conversation and order, to the audit and the hash of each: texts pass by one at a time."""
    now, out = None, []

    def close() -> None:
        out.append({"conv_id": now[0], "audit": now[1].decode(), "repaired_sha256": now[2].hexdigest()})

    for b in batches(frames):
        for conv, edit, role, text in zip(*[b.column(c).to_pylist() for c in ("conv_id", "edit", "role", "text")], strict=True):
            if now is None or now[0] != conv:
                if now is not None:
                    close()
                now = (conv, bytearray(), hashlib.sha256(), [False])
            now[1].extend(edit.encode())
            if edit != "D":
                now[2].update((("\n" if now[3][0] else "") + f"{role}:{text}").encode())
                now[3][0] = True
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist(out, schema)
            out.clear()
    if now is not None:
        close()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def digest(conversations: DataFrame, edits: DataFrame, sums: DataFrame) -> DataFrame:
    """One row for each conv_id of conversations: its sums, audit and repaired_sha256, the SHA-256 of the repaired turns'
    role:text joined by newlines. A conversation without edits has zeros, an empty audit and the hash of nothing.

    The hash of a text depends on all before, so that a conversation's edits pass one task, as a stream: memory holds a
    batch and the audit.
    """
    n, conv = tasks(edits.sparkSession), edits.schema["conv_id"].dataType.simpleString()
    own = edits.select("conv_id", "rank", "place", "edit", "role", "text").repartition(n, "conv_id").sortWithinPartitions("conv_id", "rank", "place")
    told = _mapped(own, _hashed, f"conv_id {conv}, audit string, repaired_sha256 string")
    every = conversations.select("conv_id").distinct().unionByName(sums, allowMissingColumns=True).unionByName(told, allowMissingColumns=True)
    # each side has one row for a conversation
    numbers = [F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    texts = [F.coalesce(F.max(c), F.lit(empty)).alias(c) for c, empty in (("audit", ""), ("repaired_sha256", hashlib.sha256(b"").hexdigest()))]
    return every.groupBy("conv_id").agg(*numbers, *texts)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with faults planted by crc32 of conv_id:turn modulo 20: 0 drops a row, 1 empties its text, 2 takes .!? out of it,
    3 repeats it, 4 makes it the user's. A null counts as one space, in that string too."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind_ = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(kind_ == 1, F.lit("")).when(kind_ == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    copies = F.when(kind_ == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    role = F.when(kind_ == 4, F.lit("user")).otherwise(space("role"))
    return conversations.where(kind_ != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")
