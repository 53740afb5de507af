"""Removal of passages that earlier documents hold, by sorting suffixes at sampled places, shallow then deep.

Every string of SPAN bytes has one anchor: of its k-grams that with the least hash. Equal strings have equal anchors, so
only suffixes that begin around equal anchors need to be told apart. Anchors whose whole surroundings agree are settled by
hashes of these. Of the others, a string with more than half of its other bytes before the anchor can only be one with the
same SIDE bytes there, any other string only one with the same SIDE bytes behind; so hashes of both sides tell which can
agree in part. The strings of these are sorted: by multikey quicksort on words of eight bytes to a shallow depth, and what
still agrees there by blind tries. Grams with more rows than a task's share are sorted where they are read first, and what
is left there is dealt by more of its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, batches, drop, mix, run_hashes, table, tasks, utf8

SPAN, GRAM, SHALLOW = 50, 20, 24
#: Bytes on one side of an anchor that every string has on at least one side.
SIDE = (SPAN - GRAM) // 2
_SAME = np.arange(256, dtype=np.uint8)
_BLOCK = 1 << 18
_M = np.uint64(0x9E3779B97F4A7C15)
_LEFT, _RIGHT = np.uint64(1), np.uint64(2)


def gram_hashes(buf: np.ndarray, k: int = GRAM) -> np.ndarray:
    """A hash of the k bytes from each place on, by doubling."""
    h, out, done, span = buf.astype(np.uint64) + np.uint64(1), None, 0, 1
    power = _M
    n = len(buf) - k + 1
    while span <= k:
        if k & span:
            part = h[done : done + n]
            with np.errstate(over="ignore"):
                out = part.copy() if out is None else out * np.uint64(pow(int(_M), span, 1 << 64)) + part
            done += span
        if 2 * span <= k:
            h = h[: len(h) - span] * power + h[span:]
            with np.errstate(over="ignore"):
                power = power * power
        span *= 2
    return mix(out)


def anchors(buf: np.ndarray, offsets: np.ndarray, span: int = SPAN, k: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of consecutive strings with one anchor: row, anchor's place, first and last string's place, hash of the gram,
    the sides: 16 bits each for the SIDE bytes before and behind the anchor (0: the run has fewer there), and the
    surroundings: 64 bits for the run's bytes and the anchor's place in them."""
    runs: list[tuple[np.ndarray, ...]] = []
    n = len(buf)
    want = span - k + 1
    edge = np.zeros(n + 1, np.int32)
    long = np.flatnonzero(np.diff(offsets) >= span)
    np.add.at(edge, offsets[long], 1)
    np.add.at(edge, offsets[long + 1] - span + 1, -1)
    valid = np.cumsum(edge[:-1]) > 0
    for base in range(0, n - span + 1, _BLOCK):
        part = buf[base : base + _BLOCK + span - 1]
        g = gram_hashes(part, k)
        v = (g >> np.uint64(20) << np.uint64(20)) | np.arange(len(g), dtype=np.uint64)
        least, have = v, 1
        while have < want:
            step = min(have, want - have)
            least = np.minimum(least[: len(least) - step], least[step:])
            have += step
        ok = np.flatnonzero(valid[base : base + len(least)])
        if not len(ok):
            continue
        at = (least[ok] & np.uint64((1 << 20) - 1)).astype(np.int64)
        new = np.ones(len(ok), bool)
        new[1:] = (at[1:] != at[:-1]) | (ok[1:] != ok[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(ok)) - 1
        runs.append((at[first] + base, ok[first] + base, ok[last] + base, g[at[first]]))
    if not runs:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.astype(np.uint64), z.astype(np.uint64), z.astype(np.uint64)
    at, a, z, g = (np.concatenate(x) for x in zip(*runs, strict=True))
    joins = np.zeros(len(at), bool)  # a run that a block's end has cut
    joins[1:] = (at[1:] == at[:-1]) & (a[1:] == z[:-1] + 1)
    if joins.any():
        head = np.flatnonzero(~joins)
        z = z[np.append(head[1:], len(at)) - 1]
        at, a, g = at[head], a[head], g[head]
    around = run_hashes(buf, a, z + span, _SAME)
    around = mix(around * np.uint64(0xD6E8FEB86659FD93) + (at - a).astype(np.uint64))
    sides = _side(buf, at - SIDE, at - a >= SIDE) | _side(buf, at + k, z + span - at - k >= SIDE) << np.uint64(16)
    return np.searchsorted(offsets, a, "right") - 1, at, a, z, g, sides, around


def _side(buf: np.ndarray, begin: np.ndarray, there: np.ndarray) -> np.ndarray:
    """16 bits, not all 0, for the SIDE bytes from begin on; 0 where they aren't all there."""
    out = np.zeros(len(begin), np.uint64)
    pad = np.zeros((int(there.sum()), 16), np.uint8)
    pad[:, :SIDE] = np.lib.stride_tricks.sliding_window_view(buf, SIDE)[begin[there]]
    two = pad.view(np.uint64)
    out[there] = mix(mix(two[:, 0] + np.uint64(1)) ^ two[:, 1]) % np.uint64(65535) + np.uint64(1)
    return out


def left_of(sides: np.ndarray) -> np.ndarray:
    return sides & np.uint64(65535)


def right_of(sides: np.ndarray) -> np.ndarray:
    return sides >> np.uint64(16)


def short(g: np.ndarray) -> np.ndarray:
    """The bits of a gram's hash that entries carry; bucket, sides and surroundings are besides."""
    return g >> np.uint64(40)


def pair_code(g24: np.ndarray, bucket: np.ndarray, sides: np.ndarray, around: np.ndarray) -> np.ndarray:
    return mix(mix(mix(g24 + (bucket.astype(np.uint64) << np.uint64(40))) ^ sides) ^ around)


def _pack(doc: np.ndarray, g: np.ndarray, c: np.ndarray, w: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending ids as a width, the first id and the steps in that width; 15 bytes for each anchor."""
    raw = np.empty((len(doc), 15), np.uint8)
    for x, a, z in ((g, 0, 3), (c, 3, 7), (w, 7, 15)):
        raw[:, a:z] = x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : z - a]
    steps = np.diff(doc.astype("<i8").view("<u8"))
    width = next(w for w in (1, 2, 4, 8) if not len(steps) or int(steps.max()) < 1 << 8 * w)
    return bytes([width]) + doc[:1].astype("<i8").tobytes() + steps.astype(f"<u{width}").tobytes(), raw.tobytes()


def _unpack(docs: bytes, raw: bytes) -> tuple[np.ndarray, ...]:
    m = np.frombuffer(raw, np.uint8).reshape(-1, 15)
    wide = np.zeros((len(m), 24), np.uint8)
    wide[:, :3], wide[:, 8:12], wide[:, 16:] = m[:, :3], m[:, 3:7], m[:, 7:]
    each = wide.view("<u8")
    steps = np.frombuffer(docs[9:], f"<u{docs[0]}").astype(np.uint64)
    return np.cumsum(np.append(np.frombuffer(docs[1:9], "<u8"), steps), dtype=np.uint64).view(np.int64), each[:, 0], each[:, 1], each[:, 2]


ENTRIES = "bucket int, doc_id long, docs binary, codes binary"
_ENTRY = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("docs", pa.binary()), ("codes", pa.binary())])


def _answers(doc: np.ndarray, code: np.ndarray, mixed: np.ndarray, n: int) -> list[tuple]:
    """Rows for documents: the codes of covered anchors, and of those to be sorted."""
    out: list[tuple] = []
    if not len(doc):
        return out
    order = np.argsort(doc, kind="stable")
    doc, code, mixed = doc[order], code[order], mixed[order]
    cut = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(doc)], strict=True):
        m = mixed[a:z]
        out.append((n + int(doc[a]) % n, int(doc[a]), code[a:z][m].tobytes(), code[a:z][~m].tobytes()))
    return out


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ENTRY, strict=True)], schema=_ENTRY)


def _collect(n: int):
    """Anchors of a batch by bucket, of equal surroundings only the first document's; the others are covered."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames):
            ids = b.column("doc_id").to_numpy()
            row, _, _, _, g, c, w = anchors(*utf8(b.column("text")))
            if not len(row):
                continue
            doc, bucket, g = ids[row], (g % np.uint64(n)).astype(np.int64), short(g)
            order = np.lexsort((doc, w, c, g, bucket))
            doc, bucket, g, c, w = doc[order], bucket[order], g[order], c[order], w[order]
            new = np.ones(len(doc), bool)
            new[1:] = (bucket[1:] != bucket[:-1]) | (g[1:] != g[:-1]) | (c[1:] != c[:-1]) | (w[1:] != w[:-1])
            least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
            later = doc > least
            out = _answers(doc[later], pair_code(g[later], bucket[later], c[later], w[later]), np.zeros(int(later.sum()), bool), n)
            doc, bucket, g, c, w = doc[new], bucket[new], g[new], c[new], w[new]
            cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(doc)], strict=True):
                o = np.argsort(doc[a:z], kind="stable")
                out.append((int(bucket[a]), None, *_pack(doc[a:z][o], g[a:z][o], c[a:z][o], w[a:z][o])))
            yield _rows(out)

    return run


def _settle(n: int):
    """Of each bucket's anchors, which are covered by equal surroundings and which must be sorted, on which side."""

    def shared(g: np.ndarray, side: np.ndarray) -> np.ndarray:
        """Which anchors have a gram and a side in common with others."""
        out = np.zeros(len(g), bool)
        there = np.flatnonzero(side)
        _, at, n = np.unique((g[there] << np.uint64(16)) | side[there], return_inverse=True, return_counts=True)
        out[there] = n[at] > 1
        return out

    def settle(bucket: int, parts: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        doc, g, c, w = (np.concatenate(x) for x in zip(*(_unpack(*p) for p in parts), strict=True))
        order = np.lexsort((doc, w, c, g))
        doc, g, c, w = doc[order], g[order], c[order], w[order]
        new_g = np.append(True, g[1:] != g[:-1])
        new = new_g | np.append(True, (c[1:] != c[:-1]) | (w[1:] != w[:-1]))
        least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        several = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_g))[np.cumsum(new_g) - 1] > 1
        later = doc > least
        code = pair_code(g, np.full(len(g), bucket), c, w)
        docs, codes, mixed = [doc[later]], [code[later]], [np.zeros(int(later.sum()), bool)]
        # equal surroundings count once; rows with one doc_id and equal surroundings all take part
        one = np.flatnonzero(several & new)
        for side, mark in ((left_of(c), _LEFT), (right_of(c), _RIGHT)):
            common = np.zeros(len(g), bool)
            common[one] = shared(g[one], side[one])
            common = common[np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))] & ~later
            docs.append(doc[common])
            codes.append(mix(code[common] + mark))
            mixed.append(np.ones(int(common.sum()), bool))
        return _rows(_answers(np.concatenate(docs), np.concatenate(codes), np.concatenate(mixed), n))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for b in batches(frames):
            for bucket, doc, docs, codes in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if bucket != now and parts:
                    yield settle(now, parts)
                    parts = []
                now = bucket
                if doc is None:
                    parts.append((docs, codes))
                else:
                    yield _rows([(bucket, doc, docs, codes)])
        if parts:
            yield settle(now, parts)

    return run


JUDGED = "kind int, doc_id long, row binary, text binary, places binary, gram long, before int, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin: long, end: long>>"
_NAMES = [x.split()[0] for x in JUDGED.split("<")[0].split(", ")]
_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
_TYPES = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), _SPANS]


def digest(text: bytes, first: np.ndarray, last: np.ndarray, span: int = SPAN) -> tuple[int, int, int, str, list[dict]]:
    """n_bytes, n_removed, n_spans, kept_sha256 and spans (bytes begin to end are removed) of a text without the strings
    that begin at first to last."""
    n = len(text)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, last + span, -1)
    gone = np.cumsum(edge[:-1]) > 0
    if not gone.any():
        return n, 0, 0, hashlib.sha256(text).hexdigest(), []
    turn = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))).tolist()
    spans = [{"begin": a, "end": z} for a, z in zip(turn[::2], turn[1::2], strict=True)]
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
    return n, int(gone.sum()), len(spans), hashlib.sha256(kept).hexdigest(), spans


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], names=_NAMES)


def _told(code: np.ndarray, row: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Which anchors' codes are among those that their rows were told, a list of joined codes for each."""
    parts = [b"".join(x or []) for x in lists.to_pylist()]
    known = np.frombuffer(b"".join(parts), np.uint64)
    of = np.repeat(np.arange(len(parts), dtype=np.uint64), [len(x) // 8 for x in parts])
    # codes of different rows are kept apart by the row
    return np.isin(mix(code ^ mix(row.astype(np.uint64) + _M)), mix(known ^ mix(of + _M)))


def _judge(n: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames):
            ids = b.column("doc_id").to_pylist()
            buf, offsets = utf8(b.column("text"))
            row, at, a, z, g, c, w = anchors(buf, offsets)
            code = pair_code(short(g), g % np.uint64(n), c, w)
            covered = _told(code, row, b.column("covered"))
            left, right = (_told(mix(code + mark), row, b.column("mixed")) & ~covered for mark in (_LEFT, _RIGHT))
            mixed = left | right
            cut = np.searchsorted(row, np.arange(b.num_rows + 1))
            any_mixed = np.bincount(row[mixed], minlength=b.num_rows) > 0
            begin = offsets[row]
            first, last = a - begin, z - begin
            whole = buf.tobytes()
            out = []
            for r, doc in enumerate(ids):
                lo, hi = cut[r], cut[r + 1]
                text, own = whole[offsets[r] : offsets[r + 1]], covered[lo:hi]
                p, q = first[lo:hi][own], last[lo:hi][own]
                if any_mixed[r]:
                    out.append((1, doc, hashlib.sha256(text).digest()[:8], text, np.stack((p, q)).astype("<i8").tobytes(), None, None, None, None, None, None, None))
                else:
                    out.append((0, doc, None, None, None, None, None, *digest(text, p, q)))
            yield _batch(out)
            names = {r: out[r][2] for r in np.flatnonzero(any_mixed).tolist()}
            middle = at - begin - SIDE  # the last string that has SIDE bytes before its anchor
            out = []
            for there, x, y, side, mark in (
                (left, first, np.minimum(last, middle), left_of, _LEFT), (right, np.maximum(first, middle + 1), last, right_of, _RIGHT),
            ):
                i = np.flatnonzero(there & (x <= y))
                keys = mix(mix(g[i] + mark) ^ side(c[i])).view(np.int64).tolist()
                places = x[i].astype("<i8").tobytes()
                p, q, before = (begin[i] + x[i]).tolist(), (begin[i] + y[i] + SPAN).tolist(), (middle[i] + SIDE - x[i]).tolist()
                for k, r in enumerate(row[i].tolist()):
                    out.append((2, ids[r], names[r], whole[p[k] : q[k]], places[8 * k : 8 * k + 8], keys[k], before[k], None, None, None, None, None))
                    if len(out) == 20_000:
                        yield _batch(out)
                        out = []
            yield _batch(out)

    return run


class _Node:
    __slots__ = ("depth", "kids", "leaf")

    def __init__(self, depth: int, leaf: bytes | None = None):
        self.depth, self.kids, self.leaf = depth, {}, leaf


def blind_trie(strings: list[bytes]) -> list[bytes]:
    """Distinct strings of one length in order, by a trie that keeps only the places where they part."""
    root = _Node(len(strings[0]), strings[0])
    for s in strings[1:]:
        node = root  # blindly down to some leaf
        while node.leaf is None:
            node = node.kids.get(s[node.depth]) or next(iter(node.kids.values()))
        other, d = node.leaf, 0
        while s[d] == other[d]:
            d += 1
        parent, node = None, root
        while node.leaf is None and node.depth < d:
            parent, node = node, node.kids[s[node.depth]]
        if node.leaf is None and node.depth == d:
            node.kids[s[d]] = _Node(len(s), s)
            continue
        fork = _Node(d)
        fork.kids[other[d]], fork.kids[s[d]] = node, _Node(len(s), s)
        if parent is None:
            root = fork
        else:
            parent.kids[s[parent.depth]] = fork
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.leaf is not None:
            out.append(node.leaf)
        else:
            stack.extend(node.kids[k] for k in sorted(node.kids, reverse=True))
    return out


_MANY = 4096


def multikey_quicksort(word: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts rows of words, given by order, by all their columns; returns the order and where each group of equal rows
    begins among its places.

    Every group of rows that agree so far is split around the median of three of its words in the column where they may
    differ: the lesser and the greater rows stay at that column, the equal ones go on to the next. All groups are split at
    once, so that a round is a few passes over the rows not yet in place.
    """
    n, width = len(order), word.shape[1]
    order, head = order.copy(), np.zeros(n, np.int64)
    column = np.zeros(n, np.int64)  # of a group, at the place where it begins
    if n > _MANY and width:
        # all rows at once are split around many words, evenly drawn, instead of one
        x = word[order, 0]
        pivots = np.unique(x[:: max(1, n // 1024)])
        at = np.searchsorted(pivots, x)
        side = 2 * at + (pivots[np.minimum(at, len(pivots) - 1)] == x)
        by = np.argsort(side.astype(np.int16), kind="stable")
        order, side = order[by], side[by]
        begin = np.flatnonzero(np.append(True, side[1:] != side[:-1]))
        head = np.repeat(begin, np.diff(np.append(begin, n)))
        column[begin] = side[begin] & 1
    sizes = np.bincount(head, minlength=n)
    live = np.flatnonzero((sizes[head] > 1) & (column[head] < width))
    while len(live):
        first = np.flatnonzero(np.append(True, head[live[1:]] != head[live[:-1]]))
        size = np.diff(np.append(first, len(live)))
        begin = live[first]
        group = np.repeat(np.arange(len(first)), size)
        x = word[order[live], column[begin][group]]
        three = np.sort(np.stack((x[first], x[first + size // 2], x[first + size - 1])), axis=0)
        pivot = three[1][group]
        side = (x > pivot).astype(np.int64) - (x < pivot) + 1
        counts = np.stack([np.bincount(group[side == k], minlength=len(first)) for k in range(3)], axis=1)
        starts = np.cumsum(counts, axis=1) - counts
        # a row's new place: its group's begin, its side's begin there, and its number on that side
        to = np.empty(len(live), np.int64)
        for k in range(3):
            own = side == k
            number = np.cumsum(own) - 1
            before = np.append(0, np.cumsum(counts[:, k]))[:-1]
            to[own] = begin[group[own]] + starts[group[own], k] + number[own] - before[group[own]]
        order[to] = order[live].copy()
        heads = begin[:, None] + starts
        at = column[begin].copy()
        for k in range(3):
            some = counts[:, k] > 0
            column[heads[some, k]] = at[some] + (k == 1)
        head[to] = heads[group, side]
        live = np.sort(to)
        sizes = np.bincount(head[live])
        live = live[(sizes[head[live]] > 1) & (column[head[live]] < width)]
    return order, head


def deep_shallow_sort(m: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows of a byte matrix, and for each place in it whether its row is unequal to the one before:
    multikey quicksort on words of eight bytes to the shallow depth, blind tries for what still agrees there."""
    n, width = m.shape
    pad = np.zeros((n, -(-width // 8) * 8), np.uint8)
    pad[:, :width] = m
    word = pad.view(">u8").astype(np.uint64)[:, : shallow // 8]
    order, group = multikey_quicksort(word, np.arange(n))
    unequal = np.append(True, group[1:] != group[:-1]) if n else np.zeros(0, bool)
    live = np.flatnonzero(np.bincount(group, minlength=n)[group] > 1) if n else np.zeros(0, np.int64)
    if len(live):
        at = group[live]
        cut = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        size = np.diff(np.append(cut, len(live)))
        rest = np.ascontiguousarray(m[order[live], min(shallow // 8 * 8, width) :])
        step, raw = rest.shape[1], rest.tobytes()
        # groups of equal rows are in order as they stand
        differ = np.bincount(np.repeat(np.arange(len(cut)), size), (rest != np.repeat(rest[cut], size, axis=0)).any(axis=1)) > 0
        for a, z in zip(cut[differ].tolist(), (cut + size)[differ].tolist(), strict=True):
            first = live[a]
            rows = order[first : first + z - a].copy()
            by: dict[bytes, list[int]] = {}
            for i in range(a, z):
                by.setdefault(raw[i * step : (i + 1) * step], []).append(i - a)
            if len(by) > 1:
                k = first
                for s in blind_trie(list(by)):
                    unequal[k] = True
                    for i in by[s]:
                        order[k] = rows[i]
                        k += 1
    return order, unequal


#: Rows that are sorted at once: at least, where there are more, and at most, but for one string of each kind found before.
AT_ONCE, MOST = 8192, 32768
#: Of hot grams, so many neighbouring strings go together, by the bytes that all of them have.
TOGETHER = 4
STARTS = "doc_id long, row binary, starts binary"
DEALT = "gram long, doc_id long, row binary, text binary, places binary, starts binary"


def _sort_rows(rows: list[tuple]) -> tuple[np.ndarray, ...]:
    """All strings of rows (doc_id, row, text, place), sorted: the row of each, its place in the row's text, whether a
    smaller doc_id has it too; and one string of each kind, with the least doc_id."""
    doc = np.array([r[0] for r in rows], np.int64)
    n = np.array([len(r[2]) - SPAN + 1 for r in rows], np.int64)
    flat = np.frombuffer(b"".join(r[2] for r in rows), np.uint8)
    size = n + SPAN - 1
    src = np.repeat(np.arange(len(rows)), n)
    into = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    m = np.lib.stride_tricks.sliding_window_view(flat, SPAN)[np.repeat(np.cumsum(size) - size, n) + into]
    order, unequal = deep_shallow_sort(m)
    owner, kind = doc[src[order]], np.cumsum(unequal) - 1
    least = np.minimum.reduceat(owner, np.flatnonzero(unequal))[kind]
    covered = np.zeros(len(src), bool)
    covered[order] = least < owner
    at = np.flatnonzero(least == owner)
    return src, into, covered, order[at[np.append(True, kind[at[1:]] != kind[at[:-1]])]]


def _covered(rows: list[tuple], src: np.ndarray, into: np.ndarray, covered: np.ndarray) -> list[tuple]:
    """Where covered strings begin: doc_id, row, places; rows without a name are there for comparison alone."""
    out: dict[tuple[int, bytes], list[int]] = {}
    where = np.frombuffer(b"".join(r[3] for r in rows), "<i8")[src] + into
    for i in np.flatnonzero(covered).tolist():
        r = rows[src[i]]
        if r[1]:
            out.setdefault((r[0], r[1]), []).append(int(where[i]))
    return [(*k, np.array(v, "<i8").tobytes()) for k, v in out.items()]


def _sorted_spans(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings around anchors of equal grams, sorted; those that a smaller doc_id also has, by document.

    Rows come by gram and ascending doc_id. Of a gram with more rows than are sorted at once, one string of each kind is
    carried on: it has the kind's least doc_id.
    """

    def batch(found: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*found, strict=True)) or [(), (), ()]
        types = (pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "row", "starts"])

    rows: list[tuple] = []
    carried, last = 0, None
    for b in batches(frames):
        for g, *row in zip(*(b.column(c).to_pylist() for c in ("gram", "doc_id", "row", "text", "places")), strict=True):
            if len(rows) >= (AT_ONCE if g != last else max(MOST, 2 * carried)):
                src, into, covered, one = _sort_rows(rows)
                yield batch(_covered(rows, src, into, covered))
                if g == last:
                    rows = [(rows[k][0], b"", rows[k][2][j : j + SPAN], bytes(8)) for k, j in zip(src[one].tolist(), into[one].tolist(), strict=True)]
                else:
                    rows = []
                carried = len(rows)
            last = g
            rows.append(tuple(row))
    if rows:
        yield batch(_covered(rows, *_sort_rows(rows)[:3]))


def _deal(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of hot grams: strings that a smaller doc_id among the rows at hand has are settled (starts), and the others go
    on in runs of up to TOGETHER, which lie evenly around the anchor, with a hash of what these share instead of the gram.

    Equal strings lie equally around equal anchors, so they share these bytes and meet again.
    """

    def deal(rows: list[tuple]) -> pa.RecordBatch:
        src, into, covered, _ = _sort_rows(rows)
        out = [(None, doc, name, None, None, starts) for doc, name, starts in _covered(rows, src, into, covered)]
        rest = np.flatnonzero(~covered)
        src, into = src[rest], into[rest]
        block = (np.array([r[4] for r in rows])[src] - into) // TOGETHER
        new = np.append(True, (src[1:] != src[:-1]) | (into[1:] != into[:-1] + 1) | (block[1:] != block[:-1])) if len(rest) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(rest)) - 1
        for k, a, z, d in zip(src[first].tolist(), into[first].tolist(), into[last].tolist() if len(first) else [], block[first].tolist(), strict=True):
            doc, name, text, place, before = rows[k]
            common = text[before - TOGETHER * d : before - TOGETHER * d - TOGETHER + 1 + SPAN]
            key = int.from_bytes(hashlib.blake2b(common + bytes([d]), digest_size=8).digest(), "little", signed=True)
            out.append((key, doc, name, text[a : z + SPAN], (int.from_bytes(place, "little") + a).to_bytes(8, "little"), None))
        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        names = ["gram", "doc_id", "row", "text", "places", "starts"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    rows: list[tuple] = []
    for b in batches(frames):
        rows.extend(zip(*(b.column(c).to_pylist() for c in ("doc_id", "row", "text", "places", "before")), strict=True))
        if len(rows) >= AT_ONCE:
            yield deal(rows)
            rows = []
    if rows:
        yield deal(rows)


def _finish(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(frames):
        out = []
        for text, places, starts in zip(*(b.column(c).to_pylist() for c in ("text", "places", "starts")), strict=True):
            first, last = np.frombuffer(places, "<i8").reshape(2, -1)
            one = np.frombuffer(b"".join(starts or []), "<i8")
            out.append(digest(text, np.concatenate((first, one)), np.concatenate((last, one))))
        cols = list(zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), _SPANS), strict=True))],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
        )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (bytes from begin up to end are removed, maximal, in order)
    of every row of docs, its text taken as UTF-8 bytes. cut() removes spans from texts.

    Removed is each byte within a string of 50 bytes that also begins in a row with a smaller doc_id; strings are those of
    the input and don't cross documents. A null text is empty; texts under 50 bytes lose nothing; a passage repeated in
    one document alone stays. Rows with equal doc_id don't count against each other. A null doc_id comes before all
    others. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    arrow_limits(spark, 1000)
    n = 4 * tasks(spark)
    least = -(1 << 63)
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("doc_id"), "text")
    entries = own.mapInArrow(_collect(n), ENTRIES)
    told = table(entries.repartition(tasks(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(_settle(n), ENTRIES))
    answers = told.groupBy("doc_id").agg(F.collect_list("codes").alias("covered"), F.collect_list("docs").alias("mixed"))
    judged = table(own.join(answers, "doc_id", "left").select("doc_id", "text", "covered", "mixed").mapInArrow(_judge(n), JUDGED))
    drop(told)
    around = judged.where("kind = 2").select("gram", "doc_id", "row", "text", "places", "before")
    # more than a fourth of a task's share each, so fewer than four times the tasks
    hot = table(around.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * 4 * tasks(spark) > around.count()).select("gram"))
    dealt = table(around.join(F.broadcast(hot), "gram", "left_semi").mapInArrow(_deal, DEALT))
    each = around.drop("before").join(F.broadcast(hot), "gram", "left_anti").unionByName(dealt.where("starts IS NULL").drop("starts"))
    spans = each.repartition(tasks(spark), "gram").sortWithinPartitions("gram", "doc_id").mapInArrow(_sorted_spans, STARTS)
    spans = spans.unionByName(dealt.where("starts IS NOT NULL").select("doc_id", "row", "starts"))
    by = spans.groupBy("doc_id", "row").agg(F.collect_list("starts").alias("starts"))
    rest = judged.where("kind = 1").select("doc_id", "row", "text", "places").join(by, ["doc_id", "row"], "left")
    digests = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin: long, end: long>>"
    out = judged.where("kind = 0").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans").unionByName(
        rest.select("doc_id", "text", "places", "starts").mapInArrow(_finish, digests)
    )
    return out.withColumn("doc_id", F.when(F.col("doc_id") != least, F.col("doc_id")))


def cut(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id and kept (binary: a cut may split a character) of rows of docs, without the spans that remove_repeats() has
    found. doc_id names one row each."""
    spark = docs.sparkSession
    arrow_limits(spark, 1000)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames):
            out = []
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                raw, at, parts = (text or "").encode(), 0, []
                for s in spans or []:
                    parts.append(raw[at : s["begin"]])
                    at = s["end"]
                out.append(b"".join([*parts, raw[at:]]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "kept"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(found.select("doc_id", "spans"), "doc_id", "left")
    return own.mapInArrow(run, "doc_id long, kept binary")
