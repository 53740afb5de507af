"""Benchmark decontamination by winnowing: minimum k-gram hashes of sliding windows, joined and extended.

Each window of a document chooses the least of its k-grams. Chosen k-grams that an item's windows also choose are
candidates; each is extended to the windows that chose it, and a window counts if all its words are an item's. Equal windows
of items are one class, so that the work is linear however often a text repeats itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, batches, free, mix, rolled, run_hashes, share, table, utf8, words

#: Words of a window that counts as leaked, and of a k-gram; a window holds WINDOW - GRAM + 1 k-grams.
WINDOW, GRAM = 10, 4
#: A benchmark of up to so many bytes of text is broadcast as an index; a larger one is joined by shuffles.
INDEX_BYTES = 16 << 20

#: Word bytes: all but 00-2F, 3A-60 and 7B-7F; A-Z are lower-cased first and so are word bytes too.
WORD = np.ones(256, bool)
WORD[0x00:0x30] = WORD[0x3A:0x61] = WORD[0x7B:0x80] = False
WORD[0x41:0x5B] = True

_AT_ONCE = 1 << 22
_SHIFT = np.uint64(23)
_MASK = np.uint64((1 << 23) - 1)

MARKED = "n_words long, spans array<struct<begin:long,end:long>>, items array<string>"


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the row of each word."""
    buf, offsets = utf8(texts)
    s, e, row = words(buf, offsets, WORD)
    return run_hashes(buf, s, e), row


def chosen(h: np.ndarray, row: np.ndarray, window: int = WINDOW, k: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By blocks: the places where windows within a row begin, the places of their least k-grams, of equal ones the first,
    and these k-grams' hashes."""
    for base in range(0, max(0, len(h) - window + 1), _AT_ONCE):
        own = h[base : base + _AT_ONCE + window - 1]
        g = rolled(own, k)
        v = (g >> _SHIFT << _SHIFT) | np.arange(len(g), dtype=np.uint64)
        least, span, want = v, 1, window - k + 1
        while span < want:
            step = min(span, want - span)
            least = np.minimum(least[: len(least) - step], least[step:])
            span += step
        n = len(own) - window + 1
        begin = np.flatnonzero(row[base : base + n] == row[base + window - 1 : base + window - 1 + n])
        at = (least[begin] & _MASK).astype(np.int64)
        yield begin + base, at + base, g[at]


def named(h: np.ndarray, n: int) -> np.ndarray:
    """Two independent hashes of every n consecutive words: 128 bits that name a window."""
    return np.stack((rolled(h, n), rolled(mix(h ^ np.uint64(0xA0761D6478BD642F)), n)), axis=1)


def _among(known: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Where each found value is in known, which is sorted and distinct; -1 if it isn't."""
    if not len(known):
        return np.full(len(found), -1)
    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
    return np.where(known[at] == found, at, -1)


def candidates(h: np.ndarray, row: np.ndarray, fps: np.ndarray, window: int = WINDOW, k: int = GRAM) -> np.ndarray:
    """Where the windows begin whose chosen k-gram is one of fps, which is sorted and distinct."""
    out = []
    for begin, at, g in chosen(h, row, window, k):
        new = np.append(True, at[1:] != at[:-1]) if len(at) else np.zeros(0, bool)
        hit = _among(fps, g[new]) >= 0
        out.append(begin[hit[np.cumsum(new) - 1]])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Index:
    """The windows of items by class: of each length, the classes' names, a place where their words stand, and items."""

    def __init__(self, texts: list[str], window: int = WINDOW, k: int = GRAM):
        self.window, self.k, self.rows = window, k, len(texts)
        h, row = hashed(pa.array(texts, pa.large_string()))
        self.h = h
        self.fps = np.unique(np.concatenate([np.zeros(0, np.uint64), *(g for _, _, g in chosen(h, row, window, k))]))
        size = np.bincount(row, minlength=len(texts))
        first = np.cumsum(size) - size
        self.classes: dict[int, tuple[np.ndarray, ...]] = {}
        for n in range(1, window + 1):
            if n == window:
                begin = np.flatnonzero(row[: max(0, len(h) - n + 1)] == row[n - 1 :]) if len(h) >= n else np.zeros(0, np.int64)
            else:
                begin = first[size == n]
            if not len(begin):
                continue
            name, owner = rolled(h, n)[begin], row[begin]
            order = np.lexsort((owner, name))
            name, owner, begin = name[order], owner[order], begin[order]
            new = np.append(True, (name[1:] != name[:-1]) | (owner[1:] != owner[:-1]))
            name, owner, begin = name[new], owner[new], begin[new]
            head = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
            self.classes[n] = name[head], begin[head], np.append(head, len(name)), owner

    def find(self, h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where windows of n words are an item's, and of which class."""
        names, begin, _, _ = self.classes[n]
        if n == self.window:
            p = candidates(h, row, self.fps, n, self.k)
        else:
            p = np.arange(max(0, len(h) - n + 1))
            p = p[row[p] == row[p + n - 1]]
        own = rolled(h, n)[p] if len(p) else np.zeros(0, np.uint64)
        c = _among(names, own)
        p, c = p[c >= 0], c[c >= 0]
        same = np.ones(len(p), bool)
        for d in range(n):
            same &= h[p + d] == self.h[begin[c] + d]
        return p[same], c[same]

    def mark(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Row of each word, whether it is hit, words by row, and for each row the numbers of items with an occurring
        window, ascending."""
        h, row = hashed(texts)
        edge = np.zeros(len(h) + 1, np.int64)
        found: list[list[np.ndarray]] = [[] for _ in range(len(texts))]
        for n, (names, _, cut, owner) in self.classes.items():
            p, c = self.find(h, row, n)
            edge += np.bincount(p, minlength=len(edge)) - np.bincount(p + n, minlength=len(edge))
            pair = np.unique(row[p] * len(names) + c)
            for r, k in zip((pair // len(names)).tolist(), (pair % len(names)).tolist(), strict=True):
                found[r].append(owner[cut[k] : cut[k + 1]])
        items = [np.unique(np.concatenate(x)) if x else np.zeros(0, np.int64) for x in found]
        return row, np.cumsum(edge[:-1]) > 0, np.bincount(row, minlength=len(texts)), items


def spans_of(row: np.ndarray, hit: np.ndarray, n_words: np.ndarray) -> list[list[dict]]:
    """Maximal runs of hit words by row, counted from the row's first word."""
    first = np.cumsum(n_words) - n_words
    spans: list[list] = [[] for _ in range(len(n_words))]
    begin = np.flatnonzero(hit & ~(np.append(False, hit[:-1]) & np.append(False, row[1:] == row[:-1]))) if len(row) else []
    end = np.flatnonzero(hit & ~(np.append(hit[1:], False) & np.append(row[1:] == row[:-1], False))) if len(row) else []
    for a, z in zip(np.asarray(begin).tolist(), np.asarray(end).tolist(), strict=True):
        r = int(row[a])
        spans[r].append({"begin": a - int(first[r]), "end": z + 1 - int(first[r])})
    return spans


_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def _mark(shared):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, index = shared.value
        for b in batches(frames):
            row, hit, n_words, items = index.mark(b.column("text"))
            named_ = [sorted({ids[x] for x in own.tolist()}) for own in items]
            out = [b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(spans_of(row, hit, n_words), _SPANS), pa.array(named_, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_words", "spans", "items"])

    return run


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.where("text IS NOT NULL").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")


def _index(items: DataFrame, index_bytes: int):
    """The broadcast index of all items, or None if their texts, summed first, are more than index_bytes."""
    total = items.agg(F.sum(F.octet_length("text") + F.octet_length("item_id") + 32).alias("n")).first()["n"] or 0
    if total > index_bytes:
        return None
    rows = items.collect()  # bounded by index_bytes
    return share(items.sparkSession, ([r["item_id"] for r in rows], Index([r["text"] for r in rows])))


# ---- a benchmark of any size, by shuffles ----

GRAMS = "n int, gram long"
WINDOWS = "n int, one long, two long"


def _item_rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of each item, with the k-gram it chooses; an item of fewer words is its own k-gram."""
    for b in batches(frames):
        h, row = hashed(b.column("text"))
        parts = [(WINDOW, begin, g) for begin, _, g in chosen(h, row)]
        size = np.bincount(row, minlength=b.num_rows)
        first = np.cumsum(size) - size
        for n in range(1, WINDOW):
            begin = first[size == n]
            if len(begin):
                parts.append((n, begin, rolled(h, n)[begin]))
        for n, begin, g in parts:
            name = named(h, n)[begin] if len(begin) else np.zeros((0, 2), np.uint64)
            cols = [np.full(len(begin), n, np.int32), g.view(np.int64), name[:, 0].copy().view(np.int64), name[:, 1].copy().view(np.int64)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), b.column("item_id").take(pa.array(row[begin]))], names=["n", "gram", "one", "two", "item_id"])


def _doc_grams(short: list[int]):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The chosen k-grams of each document, and all runs of as many words as a short item has."""
        for b in batches(frames):
            h, row = hashed(b.column("text"))
            rid = b.column("rid").to_numpy()
            parts = [(WINDOW, row[at], g) for _, at, g in chosen(h, row)]
            for n in short:
                p = np.arange(max(0, len(h) - n + 1))
                p = p[row[p] == row[p + n - 1]]
                parts.append((n, row[p], rolled(h, n)[p] if len(p) else np.zeros(0, np.uint64)))
            for n, r, g in parts:
                order = np.lexsort((g, r))
                r, g = r[order], g[order]
                new = np.append(True, (r[1:] != r[:-1]) | (g[1:] != g[:-1])) if len(r) else np.zeros(0, bool)
                cols = [np.full(int(new.sum()), n, np.int32), g[new].view(np.int64), rid[r[new]]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols)], names=["n", "gram", "rid"])

    return run


def _doc_windows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate windows of documents with grams in common."""
    for b in batches(frames):
        for i in range(b.num_rows):
            h, row = hashed(b.column("text").slice(i, 1))
            by: dict[int, list[int]] = {}
            for x in b.column("grams")[i].as_py():
                by.setdefault(x["n"], []).append(x["gram"])
            for n, grams in by.items():
                fps = np.unique(np.array(grams, np.int64).view(np.uint64))
                p = candidates(h, row, fps) if n == WINDOW else np.flatnonzero(_among(fps, rolled(h, n)) >= 0)
                if len(p):
                    name = named(h, n)[p]
                    cols = [np.full(len(p), b.column("rid")[i].as_py()), p, np.full(len(p), n, np.int32), name[:, 0].copy().view(np.int64), name[:, 1].copy().view(np.int64)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, cols)], names=["rid", "at", "n", "one", "two"])


def _union(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words by text, and the windows of each united."""
    for b in batches(frames):
        row, n_words = hashed(b.column("text"))[1], None
        n_words = np.bincount(row, minlength=b.num_rows)
        first = np.cumsum(n_words) - n_words
        edge = np.zeros(len(row) + 1, np.int64)
        for r, own in enumerate(b.column("windows").to_pylist()):
            if own:
                p, n = (np.array([w[c] for w in own], np.int64) for c in ("at", "n"))
                np.add.at(edge, first[r] + p, 1)
                np.add.at(edge, first[r] + p + n, -1)
        spans = pa.array(spans_of(row, np.cumsum(edge[:-1]) > 0, n_words), _SPANS)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words, pa.int64()), spans, b.column("items")], names=["doc_id", "n_words", "spans", "items"])


def _joined(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (rid, text) against items of any size: (rid, at, n) of the windows that are an item's, and (rid, items)."""
    # windows of items by name: a row for each, with its items
    own = table(items.mapInArrow(_item_rows, f"{GRAMS}, one long, two long, item_id string").distinct())
    short = sorted(r["n"] for r in own.select("n").distinct().collect() if r["n"] < WINDOW)
    grams = own.select("n", "gram").distinct()
    hits = docs.mapInArrow(_doc_grams(short), f"{GRAMS}, rid long").join(grams, ["n", "gram"], "left_semi")
    some = hits.groupBy("rid").agg(F.collect_list(F.struct("n", "gram")).alias("grams"))
    found = docs.join(some, "rid").select("rid", "text", "grams").mapInArrow(_doc_windows, f"rid long, at long, {WINDOWS}")
    names = own.select("n", "one", "two").distinct()
    windows = table(found.join(names, ["n", "one", "two"], "left_semi"))
    each = windows.select("rid", "n", "one", "two").distinct().join(own.select("n", "one", "two", "item_id").distinct(), ["n", "one", "two"])
    named_ = each.select("rid", "item_id").distinct().groupBy("rid").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    return windows.select("rid", "at", "n"), named_


def mark(docs: DataFrame, benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """doc_id, n_words, spans (hit words, from begin up to end, maximal, in order) and items (ids with an occurring
    window, distinct, in order) of every document.

    A word of a document is hit if it lies in an occurrence of a window: 10 consecutive words of an item, or all words
    of a shorter item. A null text, an empty one and one of other bytes have no words. Rows with equal doc_id are
    judged each, a null doc_id stays null; items with equal ids count as one, a null item_id counts as the empty string.
    Without documents the result is empty; without items nothing is hit. Other columns are ignored. Texts of any length
    and any repetition are judged whole. If the benchmark's texts take up to index_bytes, documents are read once and
    nothing is shuffled; else fingerprints, and then the windows they lead to, are joined by shuffles.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    items = _items(benchmark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = _index(items, index_bytes)
    if shared is not None:
        return own.mapInArrow(_mark(shared), f"doc_id long, {MARKED}")
    rows = table(own.withColumn("rid", F.monotonically_increasing_id()))
    windows, named_ = _joined(rows.select("rid", "text"), items)
    by = windows.groupBy("rid").agg(F.collect_list(F.struct("at", "n")).alias("windows"))
    out = rows.join(by, "rid", "left").join(named_, "rid", "left")
    out = out.select("doc_id", "text", "windows", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.mapInArrow(_union, f"doc_id long, {MARKED}")


def digest(marked: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return marked.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """docs without the rows whose text has a leaked window; all columns as they were, whatever their names. Rows without
    words stay; repeated rows and those without a doc_id are judged by their text like any other."""
    spark = docs.sparkSession
    arrow_limits(spark)
    items = _items(benchmark)
    shared = _index(items, index_bytes)
    if shared is None:
        (rid,) = free(docs, "rid")
        rows = table(docs.withColumn(rid, F.monotonically_increasing_id()))
        gone = _joined(rows.select(F.col(rid).alias("rid"), "text"), items)[0].select(F.col("rid").alias(rid)).distinct()
        return rows.join(gone, rid, "left_anti").select(*docs.columns)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value[1]
        for b in batches(frames):
            h, row = hashed(b.column("text"))
            keep = np.ones(b.num_rows, bool)
            for n in index.classes:
                keep[row[index.find(h, row, n)[0]]] = False
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
