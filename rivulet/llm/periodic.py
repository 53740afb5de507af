"""Periodic runs of words by Kolpakov and Kucherov: Lempel-Ziv factors from a suffix automaton, Main's algorithm for runs that
touch a factor's edge, all others copied from where their factor occurred before."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, mix, portions, rolled, run_hashes, utf8, words

_WORD = np.ones(256, bool)
_WORD[[0x20, *range(9, 14)]] = False
_SAME = np.arange(256, dtype=np.uint8)


def factors(s: list[int]) -> list[tuple[int, int, int | None]]:
    """(begin, end, source): each the longest piece that also begins earlier, at source, or one symbol that is new (None).

    By the suffix automaton of s, whose states know where their strings end first.
    """
    n = len(s)
    moves: list[dict[int, int]] = [{}]
    link, length, first = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(s):
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        first.append(i)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(moves[q].copy())
                length.append(length[p] + 1)
                first.append(first[q])
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    out, i = [], 0
    while i < n:
        state, j = 0, i
        while j < n:
            to = moves[state].get(s[j])
            if to is None or first[to] >= j:
                break
            state, j = to, j + 1
        if j == i:
            out.append((i, i + 1, None))
            i += 1
        else:
            out.append((i, j, first[state] - (j - i) + 1))
            i = j
    return out


def _prefixes(a: list) -> list[int]:
    """For each place of a how long what begins there agrees with the beginning of a."""
    n = len(a)
    z = [0] * n
    lo = hi = 0
    for i in range(1, n):
        k = 0
        if i < hi:
            k = z[i - lo]
            if k < hi - i:
                z[i] = k
                continue
            k = hi - i
        while i + k < n and a[k] == a[i + k]:
            k += 1
        z[i] = k
        lo, hi = i, i + k
    return z


def _touching(s: list[int], before: int, b: int, e: int, least: int, exponent: int) -> Iterator[tuple[int, int, int]]:
    """(begin, end, period) of runs that touch or cross b and end by e, s[before:b] and s[b:e] being factors. Runs that reach
    further back than a period beyond before would have made its factor longer, or were found at its edge."""
    most = (e - before - 1) // (exponent - 1)
    if not most:
        return
    lo = max(0, b - 2 * (b - before) - (e - b))
    x, y = s[lo:b], s[b:e]
    back = x[::-1]
    left = _prefixes([*back, None, *y[::-1], *back])
    right = _prefixes([*y, None, *x, *y])
    nx, ny = len(x), len(y)
    for p in range(1, most + 1):
        spans = []
        if p <= ny:  # a period behind b
            spans.append((b - left[nx + 1 + ny - p], b + p + (right[p] if p < ny else 0)))
        if p <= nx:  # a period before b
            spans.append((b - p - (left[p] if p < nx else 0), b + (right[ny + 1 + nx - p] if ny else 0)))
        for begin, end in spans:
            if end - begin < exponent * p or end - begin < least:
                continue
            if (begin > 0 and s[begin - 1] == s[begin - 1 + p]) or (end < len(s) and s[end] == s[end - p]):
                continue  # it goes on beyond what was looked at, and is found at another edge
            yield begin, end, p


def runs(s: list[int], least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """(begin, length, period) of the runs of s: stretches with a smallest period, of at least least symbols and exponent
    (2 or more) periods, that no neighbouring symbol extends. By begin, then period. Time grows with len(s) and the number
    of runs that periods of half a factor allow."""
    found: dict[int, dict[int, int]] = {}
    before = 0
    for b, e, source in [*factors(s), (len(s), len(s), None)]:
        if b:
            for begin, end, p in _touching(s, before, b, e, least, exponent):
                own = found.setdefault(begin, {})
                own[end] = min(own.get(end, p), p)
        if source is not None and found:
            shift, stop = b - source, source + e - b
            for i in range(b + 1, e):
                if own := found.get(i - shift):
                    inside = {end + shift: p for end, p in own.items() if end < stop}
                    if inside:
                        found.setdefault(i, {}).update(inside)
        before = b
    return sorted((begin, end - begin, p) for begin, own in found.items() for end, p in own.items())


def _repeated(grams: np.ndarray, group: np.ndarray, reach: int) -> np.ndarray:
    """Which places are covered by a gram of reach places that occurs twice in its group. Gram i covers i to i + reach - 1;
    a group is a stretch of places. Grams are told by hash: one met by chance is no harm, as more places stay."""
    n = len(group)
    out = np.zeros(n, bool)
    if n < reach:
        return out
    whole = np.flatnonzero(group[: n - reach + 1] == group[reach - 1 :])
    keys = mix(grams[whole] + group[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    at = whole[np.unique(np.r_[order[1:][same], order[:-1][same]])]
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + reach, -1)
    return np.cumsum(edges[:n]) > 0


def _stretches(h: np.ndarray, row: np.ndarray, least: int, exponent: int) -> list[tuple[int, int]]:
    """Stretches of words, each in one row, that hold all runs of at least least words and exponent periods.

    In a run of L words and period p every gram of g words occurs twice if g is at most L + 1 - 2 * p: a period before or
    behind. So words that no repeated gram covers lie in no run; the text is cut there, and grams need to be repeated in
    their stretch.
    """
    g = max(1, min(max(least, exponent * p) + 1 - 2 * p for p in range(1, least + 1)))
    place = np.arange(len(h))
    group = row
    for _ in range(3):
        if not len(place):
            break
        # grams of words that are neighbours in the text alone: a stretch has no gaps
        stay = _repeated(rolled(h[place], g), group, g)
        place, old = place[stay], group[stay]
        if not len(place):
            break
        new = np.r_[True, (place[1:] != place[:-1] + 1) | (old[1:] != old[:-1])]
        group = np.cumsum(new)
        size = np.bincount(group)[group]
        fine = size >= least
        place, group = place[fine], group[fine]
    if not len(place):
        return []
    begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[begins[1:], len(group)]
    return [(int(place[a]), int(place[z - 1]) + 1) for a, z in zip(begins, ends, strict=True)]


def _scan(frames: Iterator[pa.RecordBatch], schema: pa.Schema, least: int, exponent: int) -> Iterator[pa.RecordBatch]:
    for b in portions(frames, "text"):
        buf, offsets = utf8(b.column("text"))
        starts, ends, row = words(buf, offsets, _WORD)
        first = np.searchsorted(row, np.arange(b.num_rows + 1))
        dropped = np.zeros(len(starts), bool)
        own: list[list[dict]] = [[] for _ in range(b.num_rows)]
        data = buf.tobytes() if len(starts) else b""
        for a, z in _stretches(run_hashes(buf, starts, ends, _SAME), row, least, exponent):
            known: dict[bytes, int] = {}
            symbols = [known.setdefault(data[i:j], len(known)) for i, j in zip(starts[a:z].tolist(), ends[a:z].tolist(), strict=True)]
            at = a - int(first[row[a]])
            for begin, length, period in runs(symbols, least, exponent):
                own[row[a]].append({"start": at + begin, "length": length, "period": period})
                dropped[a + begin + period : a + begin + length] = True
        out, keep = buf.copy(), _WORD[buf] if len(buf) else np.zeros(0, bool)
        for i, j in zip(starts[dropped].tolist(), ends[dropped].tolist(), strict=True):
            keep[i:j] = False
        # between two words that stay in one text, the byte behind the first of them is the space
        stay = np.flatnonzero(~dropped)
        gaps = ends[stay[:-1][row[stay[1:]] == row[stay[:-1]]]]
        keep[gaps], out[gaps] = True, 32
        size = np.r_[0, np.cumsum(keep)][offsets].astype(np.int32)
        text = pa.StringArray.from_buffers(b.num_rows, pa.py_buffer(size), pa.py_buffer(out[keep].tobytes()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(own, schema.field("runs").type), text], schema=schema)


def find_runs(docs: DataFrame, least: int = 6, exponent: int = 4) -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words, by start, then period) and collapsed: the words of text that
    lie in no run behind its first period, joined by one space.

    Words are maximal pieces without space, tab, line feed, vertical tab, form feed and carriage return, of whole texts; null
    and empty texts have none. Words are equal if their bytes are. A run is a stretch with a smallest period, of at least
    least words and exponent periods, that neither neighbouring word extends; runs may overlap, and a longer period may
    cover a shorter one's. Every row has a result, repeated rows and null doc_ids too; columns beside doc_id and text take
    no part, whatever their names. A text is worked on in one task, in memory that grows with it.
    """
    if least < 2 or exponent < 2:
        raise ValueError("least and exponent must be 2 or more")
    arrow_limits(docs.sparkSession)
    id_ = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {id_}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ddl))
    return docs.select("doc_id", "text").mapInArrow(lambda frames: _scan(frames, schema, least, exponent), ddl)


def digest(found: DataFrame) -> DataFrame:
    """n_runs, the run of greatest exact exponent (ties: smallest start, then period) and hashes of runs and text."""
    nearer = lambda a, b: (
        F.when(a["length"] * b["period"] > b["length"] * a["period"], -1).when(a["length"] * b["period"] < b["length"] * a["period"], 1)
        .when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0)
    )
    best = F.get(F.array_sort("runs", nearer), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    own = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * best.length div best.period")
    return own.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def plant(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which by crc32 h of the decimal doc_id, if h % 10 = 0, all words from the a-th on are repeats of the
    p words from there, with g = floor(h / 10), a = g % n, p = 1 + floor((n - a) / (3 + g % 8)). A null doc_id plants nothing."""
    h = F.crc32(F.col("doc_id").cast("string"))
    own = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"))
    own = own.withColumn("n", F.size("w").cast("long")).withColumn("g", F.floor(F.col("h") / 10))
    own = own.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    own = own.withColumn("p", 1 + F.expr("(n - a) div (3 + g % 8)"))
    times = F.expr("CAST((n - a + p - 1) div p AS INT)")
    cut = lambda w, at, size: F.slice(w, (at + 1).cast("int"), size.cast("int"))
    tail = cut(F.flatten(F.array_repeat(cut(F.col("w"), F.col("a"), F.col("p")), times)), F.lit(0), F.col("n") - F.col("a"))
    text = F.array_join(F.concat(cut(F.col("w"), F.lit(0), F.col("a")), tail), " ")
    return own.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))
