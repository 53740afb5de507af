"""Language identification by prediction by partial matching: byte contexts of variable order, escapes, frozen counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, arrow_limits, batches, share, utf8

#: Longest context in bytes.
ORDER = 3
#: Documents of each language that the counts are learnt from, about; those with the least hash of doc_id. Whole texts.
SAMPLE = 4000
UNKNOWN = "und"


def grams(buf: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For each byte, itself and the order bytes before it in its row as one integer; a row starts behind zero bytes."""
    b = LOWER[buf].astype(np.uint64)
    n = len(b)
    out = b.copy()
    into = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, order + 1):
        before = np.zeros(n, np.uint64)
        before[k:] = b[: n - k]
        before[into < k] = 0
        out |= before << np.uint64(8 * k)
    return out


def _count(order: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def flush():
            for lang, (g, n) in totals.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

        for b in batches(frames):
            langs = b.column("lang").to_pylist()
            for lang in sorted(set(langs)):
                mine = b.filter(pa.array([x == lang for x in langs]))
                g, n = np.unique(grams(*utf8(mine.column("text")), order), return_counts=True)
                if lang in totals:
                    old, m = totals[lang]
                    g, at = np.unique(np.concatenate((old, g)), return_inverse=True)
                    n = np.bincount(at, weights=np.concatenate((m, n))).astype(np.int64)
                totals[lang] = g, n.astype(np.int64)
        yield from flush()

    return run


def learn(docs: DataFrame, sample: int = SAMPLE, order: int = ORDER) -> Model:
    """Counts from the labelled documents with the least hashes, about sample of each language.

    The bound is on rows; the counts gathered are at most one for each distinct string of order + 1 bytes in them.
    """
    own = docs.where("lang IS NOT NULL AND text IS NOT NULL AND pmod(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)), 4) <> 2")
    own = own.withColumn("_h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))
    limits = {r["lang"]: (1 << 30) * min(1.0, sample / r["n"]) for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not limits:
        return Model({}, order)
    limit = F.element_at(F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))]), F.col("lang"))
    counted = own.where(F.col("_h") < limit).select("lang", "text").mapInArrow(_count(order), "lang string, gram long, n long")
    # numbers in Arrow's columns, not rows of objects, and each language once: the driver holds 20 bytes a gram
    names = sorted(limits)
    number = F.element_at(F.create_map(*[x for i, k in enumerate(names) for x in (F.lit(k), F.lit(i))]), F.col("lang"))
    found = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).select(number.alias("lang"), "gram", "n").toArrow()
    lang, gram, n = (found.column(c).to_numpy() for c in ("lang", "gram", "n"))
    counts = {k: (gram[lang == i].view(np.uint64), n[lang == i]) for i, k in enumerate(names) if (lang == i).any()}
    return Model({k: counts.get(k, (np.zeros(0, np.uint64), np.zeros(0, np.int64))) for k in sorted(limits)}, order)


#: Bytes that a model may take: the driver builds it, and every worker holds it.
MODEL_BYTES = 1 << 28
#: Contexts whose costs are worked out at once.
_ROWS = 1 << 10


def _costs(row: np.ndarray, symbol: np.ndarray, n: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """The costs of each symbol after contexts in which symbols were seen n times; parent: what they cost after the
    contexts less their first byte."""
    table = np.zeros(parent.shape)
    np.add.at(table, (row, symbol), n)
    total, kinds = table.sum(1, keepdims=True), (table > 0).sum(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        here = np.where(table > 0, -np.log2(table / (total + kinds)), -np.log2(kinds / (total + kinds)) + parent)
    return np.where(total > 0, here, parent)


class Model:
    """Exact code lengths in bits, by language, of each byte after each context; escapes as in method C.

    After a context seen n times with d distinct bytes, a byte seen c times there costs -log2(c / (n + d)); another byte
    costs the escape, -log2(d / (n + d)), and then what it costs after the context less its first byte; under the empty
    context a byte is one of 256. A context not seen costs nothing. Counts stay as learnt. The costs are a table of
    languages by contexts by bytes: one that would take more than most bytes isn't built.
    """

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int, most: int = MODEL_BYTES):
        self.langs, self.order = list(counts), order
        seen = np.unique(np.concatenate([g & np.uint64(255) for g, _ in counts.values()] or [np.zeros(0, np.uint64)]))
        # symbol 0: before the row; 1: a byte not learnt; then the bytes learnt
        self.symbol = np.ones(256, np.int64)
        self.symbol[seen.astype(np.int64)] = np.arange(len(seen)) + 2
        self.base = len(seen) + 2
        self.bits = max(1, int(self.base - 1).bit_length())
        contexts = []
        per = []
        for g, n in counts.values():
            parts = [self._code(g >> np.uint64(8 * k) & np.uint64(255), k) for k in range(order + 1)]
            per.append((parts, n))
            c = np.zeros(len(g), np.int64)
            for k in range(order, 0, -1):
                c = (c << self.bits) | parts[k]
            contexts.append(c)
        known = np.unique(np.concatenate(contexts or [np.zeros(0, np.int64)]))
        # each level has the contexts of its length
        self.levels = [np.unique(known & ((1 << (self.bits * k)) - 1)) for k in range(order + 1)]
        first = np.cumsum([0] + [len(x) for x in self.levels])
        size = int(first[-1])
        need = 4 * len(self.langs) * max(1, size) * self.base + (4 << (self.bits * order))
        if need > most:
            raise ValueError(f"a model of {len(self.langs)} languages and {size} contexts takes {need} bytes, {most} are allowed: learn from fewer rows or a smaller order")
        self.cost = np.zeros((len(self.langs), max(1, size), self.base), np.float32)
        for lang, (parts, n) in enumerate(per):
            below = np.full((1, self.base), 8.0)
            for k in range(order + 1):
                rows = self.levels[k]
                c = np.zeros(len(n), np.int64)
                for j in range(k, 0, -1):
                    c = (c << self.bits) | parts[j]
                at = np.searchsorted(rows, c)
                by = np.argsort(at, kind="stable")
                cut = np.searchsorted(at[by], np.arange(0, len(rows) + _ROWS, _ROWS))
                parents = np.searchsorted(self.levels[k - 1], rows & ((1 << (self.bits * (k - 1))) - 1)) if k else np.zeros(1, np.int64)
                here = np.empty((len(rows), self.base)) if k < order else None
                for i in range(0, len(rows), _ROWS):  # so many contexts at once: the driver builds the model
                    own = by[cut[i // _ROWS] : cut[i // _ROWS + 1]]
                    cost = _costs(at[own] - i, parts[0][own], n[own], below[parents[i : i + _ROWS]])
                    self.cost[lang, first[k] + i : first[k] + i + len(cost)] = cost
                    if here is not None:
                        here[i : i + _ROWS] = cost
                below = here
        # a context's row, by its code: the longest known suffix
        self.row_of = np.zeros(1 << (self.bits * order), np.int32) if size else np.zeros(1, np.int32)
        for k in range(order + 1):
            shape = self.row_of.reshape(-1, 1 << (self.bits * k)) if size else None
            if size:
                shape[:, self.levels[k]] = (np.arange(len(self.levels[k])) + first[k]).astype(np.int32)

    def _code(self, byte: np.ndarray, k: int) -> np.ndarray:
        out = self.symbol[byte.astype(np.int64)]
        return np.where(byte == 0, 0, out) if k else out

    def lengths(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits that each row takes under each language: languages by rows."""
        rows = len(offsets) - 1
        out = np.zeros((len(self.langs), rows))
        if not len(buf) or not self.langs:
            return out
        sym = self.symbol[LOWER[buf]]
        prior = np.where(buf == 0, 0, sym)
        into = np.arange(len(buf)) - np.repeat(offsets[:-1], np.diff(offsets))
        code = np.zeros(len(buf), np.int64)
        for k in range(self.order, 0, -1):
            before = np.zeros(len(buf), np.int64)
            before[k:] = prior[: len(buf) - k]
            before[into < k] = 0
            code = (code << self.bits) | before
        at = self.row_of[code].astype(np.int64) * self.base + sym
        full = np.flatnonzero(np.diff(offsets) > 0)
        for lang in range(len(self.langs)):
            out[lang, full] = np.add.reduceat(self.cost[lang].ravel()[at], offsets[:-1][full], dtype=np.float64)
        return out


_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True


def lettered(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which rows have a letter."""
    seen = np.concatenate(([0], np.cumsum(_ASCII[buf])))
    out = np.diff(seen[offsets]) > 0
    for r in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[r] = any(c.isalpha() for c in buf[offsets[r] : offsets[r + 1]].tobytes().decode())
    return out


_SLICE = 1 << 17


def predict(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    buf, offsets = utf8(texts)
    rows = len(offsets) - 1
    bits = np.zeros((len(model.langs), rows))
    i = 0
    while i < rows:  # as many rows at once as stay in the cache
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _SLICE, "right")) - 1)
        bits[:, i:j] = model.lengths(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j
    good = lettered(buf, offsets)
    if not model.langs:
        return [UNKNOWN] * rows, np.zeros(rows)
    best = bits.argmin(0)
    with np.errstate(under="ignore"):
        score = 1 / np.exp2(np.maximum(bits.min(0) - bits, -1000)).sum(0)
    return [model.langs[k] if g else UNKNOWN for k, g in zip(best.tolist(), good.tolist(), strict=True)], np.where(good, score, 0.0)


def _predict(shared):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames):
            langs, score = predict(shared.value, b.column("text"))
            cols = [c for c, name in zip(b.columns, b.schema.names, strict=True) if name != "text"]
            names = [name for name in b.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model | None = None, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document.

    lang_pred is the language under which the whole text is shortest, of equal ones the first by name; score is its
    share of 2 ** -bits over all languages. A text that is null or has no letter is und, with score 0, and so is every
    text if no labelled one was there to learn from. held_out rows, whose crc32(doc_id as text) mod 4 is 2, aren't
    learnt from; a null doc_id isn't held out and isn't learnt from. Rows with equal doc_id are judged each. Columns but
    doc_id, text and lang are ignored.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    shared = share(spark, model or learn(docs, sample))
    held = F.coalesce(F.expr("pmod(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)), 4) = 2"), F.lit(False))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    return own.mapInArrow(_predict(shared), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs without the rows whose language is und; all columns as they were."""
    spark = docs.sparkSession
    arrow_limits(spark)
    shared = share(spark, learn(docs, sample))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames):
            yield b.filter(pa.array([x != UNKNOWN for x in predict(shared.value, b.column("text"))[0]]))

    return docs.mapInArrow(run, docs.schema)
