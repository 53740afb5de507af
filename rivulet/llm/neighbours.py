"""Nearest vectors by cosine: a block matrix join of int8 tiles with error bounds, exact products for what survives, heaps."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_limits, batches, table, tasks

#: Query vectors in a block, rows of a tile of candidates.
BLOCK, TILE = 8192, 512
#: Beyond the quantisation's own error: rounding of the bounds and of the cosine in float.
_SLACK = 1e-5


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Those with a vector that isn't empty or zero and has only finite components."""
    # no comparison with infinity is needed for NaN: it counts as greater
    fine = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vectors.where(F.col(vector).isNotNull() & fine & F.exists(vector, lambda x: x != 0))


class Coded:
    """Vectors as int8 codes: unit vector = scale * code + rest; their exact values for the survivors."""

    def __init__(self, vectors: np.ndarray) -> None:
        top = np.abs(vectors).max(1)
        # cosines don't change with scale; powers of two change no digit, and squares can't overflow
        self.exact = np.ldexp(vectors, -np.frexp(top)[1][:, None])
        self.square = sequential(self.exact, self.exact)
        unit = self.exact / np.sqrt(self.square)[:, None]
        scale = np.abs(unit).max(1) / 127
        code = np.rint(unit / scale[:, None]).astype(np.int8)
        rest = unit - code * scale[:, None]
        # products of codes are integers below 127 * 127 * d: floats hold them exactly
        self.code = code.astype(np.float32 if vectors.shape[1] <= 1024 else np.float64)
        self.scale = scale.astype(np.float32)
        self.rest = np.sqrt((rest * rest).sum(1)).astype(np.float32)
        self.near = 1 + self.rest  # no less than the length of scale * code


def sequential(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row products, summed component by component in double: a pair's value depends on nothing but the pair."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


class Best:
    """The k nearest candidates of each query of a block, in heaps whose root is the worst one kept."""

    def __init__(self, rows: np.ndarray, ids: list, vectors: np.ndarray, k: int) -> None:
        order = np.argsort(rows)
        self.rows, self.ids, self.k = rows[order], [ids[i] for i in order], k
        self.coded = Coded(vectors[order])
        self.heaps: list[list] = [[] for _ in rows]
        self.least = np.full(len(rows), -np.inf)

    def offer(self, rows: np.ndarray, ids: list, vectors: np.ndarray) -> None:
        q, c = self.coded, Coded(vectors)
        # |u.v - scales * codes| <= |scale code_u| |rest_v| + |rest_u| |v|
        about = (q.code @ c.code.T) * q.scale[:, None] * c.scale[None, :]
        bound = q.near[:, None] * c.rest[None, :] + q.rest[:, None] + _SLACK
        own = np.searchsorted(self.rows, rows)
        own[own == len(self.rows)] = 0
        same = np.flatnonzero(self.rows[own] == rows)
        about[own[same], same] = -np.inf
        least = self.least
        open_ = np.isinf(least)
        if open_.any() and len(rows) > self.k:
            # before a heap is full: the k-th greatest of what the cosines can't be less than
            sure = np.partition(about[open_] - bound[open_], len(rows) - self.k, axis=1)[:, len(rows) - self.k]
            least = least.copy()
            least[open_] = sure
        at, of = np.nonzero((about + bound >= least[:, None]) & (about > -np.inf))
        for s in range(0, len(at), 1 << 17):
            self._exact(at[s : s + (1 << 17)], of[s : s + (1 << 17)], c, rows, ids)

    def _exact(self, at: np.ndarray, of: np.ndarray, c: Coded, rows: np.ndarray, ids: list) -> None:
        q = self.coded
        score = sequential(q.exact[at], c.exact[of]) / np.sqrt(q.square[at] * c.square[of])
        score = np.clip(score, -1.0, 1.0)
        good = score >= self.least[at]
        at, of, score = at[good], of[good], score[good]
        # of one query's survivors the k first in order are enough
        rank = np.array([(1 << 63) - 1 if i is None else i for i in ids], np.int64)[of]
        order = np.lexsort((rows[of], rank, -score, at))
        at, of, score = at[order], of[order], score[order]
        begins = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else at
        place = np.arange(len(at)) - np.repeat(begins, np.diff(np.r_[begins, len(at)]))
        for i in np.flatnonzero(place < self.k):
            heap = self.heaps[at[i]]
            item = _item(float(score[i]), ids[of[i]], int(rows[of[i]]))
            if len(heap) < self.k:
                heapq.heappush(heap, item)
            elif item > heap[0]:
                heapq.heapreplace(heap, item)
            if len(heap) == self.k:
                self.least[at[i]] = heap[0][0]


def _item(score: float, vec_id: int | None, row: int) -> tuple:
    """Greater is nearer: the score, then the smaller id, null last."""
    return score, vec_id is not None, -(vec_id or 0), -row


_FOUND = "query_row long, query_id long, score double, vec_id long, row long"


def _cells(frames: Iterator[pa.RecordBatch], schema: pa.Schema, k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell, in each the queries first: the k nearest of each query among the cell's candidates."""
    cell, waiting, best = None, {}, {}

    def matrix(b: pa.RecordBatch, take: np.ndarray, d: int) -> np.ndarray:
        return b.column("vector").take(pa.array(take)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)

    def found() -> Iterator[pa.RecordBatch]:
        out = [[], [], [], [], []]
        for one in best.values():
            for row, vec_id, heap in zip(one.rows, one.ids, one.heaps, strict=True):
                for score, known, minus, minus_row in heap:
                    for c, x in zip(out, (int(row), vec_id, score, -minus if known else None, -minus_row), strict=True):
                        c.append(x)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    for b in batches(frames):
        cells = b.column("cell").to_numpy()
        asks = b.column("asks").to_numpy(zero_copy_only=False)
        rows, sizes = b.column("row").to_numpy(), b.column("d").to_numpy()
        ids = b.column("vec_id").to_pylist()
        edges = np.flatnonzero((cells[1:] != cells[:-1]) | (asks[1:] != asks[:-1])) + 1
        for s, e in zip([0, *edges], [*edges, len(cells)], strict=True):
            if cells[s] != cell:
                yield from found()
                cell, waiting, best = cells[s], {}, {}
            for d in np.unique(sizes[s:e]):
                own = np.flatnonzero(sizes[s:e] == d) + s
                if asks[s]:
                    waiting.setdefault(d, []).append((rows[own], [ids[i] for i in own], matrix(b, own, d)))
                    continue
                if d in waiting:
                    parts = waiting.pop(d)
                    best[d] = Best(np.concatenate([p[0] for p in parts]), [i for p in parts for i in p[1]], np.concatenate([p[2] for p in parts]), k)
                if d in best:
                    for t in range(0, len(own), TILE):
                        part = own[t : t + TILE]
                        best[d].offer(rows[part], [ids[i] for i in part], matrix(b, part, d))
    yield from found()


_NEAREST = "query_row long, query_id long, rank int, vec_id long, score double"


def _merged(frames: Iterator[pa.RecordBatch], schema: pa.Schema, k: int) -> Iterator[pa.RecordBatch]:
    """The cells' findings, sorted by query, to the k nearest of each."""
    now, heap = None, []

    def told() -> list[tuple]:
        ranked = sorted(heap, reverse=True)
        return [(*now, i + 1, -minus if known else None, score) for i, (score, known, minus, _) in enumerate(ranked)]

    for b in batches(frames):
        out = []
        for query_row, query_id, score, vec_id, row in zip(*[b.column(c).to_pylist() for c in ("query_row", "query_id", "score", "vec_id", "row")], strict=True):
            if now is None or now[0] != query_row:
                if now is not None:
                    out += told()
                now, heap = (query_row, query_id), []
            item = _item(score, vec_id, row)
            if len(heap) < k:
                heapq.heappush(heap, item)
            elif item > heap[0]:
                heapq.heapreplace(heap, item)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
    if now is not None:
        out = told()
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, id_: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id is divisible by every, the k other rows of greatest
    cosine, nearest first, ties to the smaller id. Exact: nothing is left out that could be among them.

    Vectors that are null, empty or zero or hold null or non-finite components take no part; others meet those of their own
    length alone. A null id is no query; as a candidate it comes after all ids of its score. Rows that share an id are
    rows of their own: each is a query and the other a candidate. A query with fewer than k candidates has them all; an
    empty table gives none. Other columns take no part, whatever their names.

    Queries, in blocks of at most block, meet parts of the candidates in the cells of a grid, so that no task holds more
    than a block of queries and a tile of candidates, and a cell returns k rows of each query. Of equal vectors those of
    the k + 1 least ids can be found at all (they tie, and one may be the query itself), so that a group of copies of any
    size is k + 1 candidates, cut before they are shuffled.
    """
    spark = vectors.sparkSession
    arrow_limits(spark)
    own = usable(vectors, vector).select(F.col(id_).cast("long").alias("vec_id"), F.col(vector).alias("vector"), F.size(vector).alias("d"))
    t = table(own.withColumn("row", F.monotonically_increasing_id()))
    asked = t.where(F.col("vec_id") % every == 0)
    n_asked, n_all = asked.count(), t.count()
    blocks = max(1, -(-n_asked // block))
    # as many cells as tasks at least, and no fewer parts than keep a cell's candidates in reach of one task
    parts = max(1, -(-2 * tasks(spark) // blocks), -(-n_all // (1 << 20)))
    first = Window.partitionBy("vector").orderBy(F.col("vec_id").asc_nulls_last(), "row")
    others = t.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1).drop("_n")
    deal = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")
    cell = lambda df, b, p: df.select((b * parts + p).alias("cell"), "vec_id", "vector", "d", "row")
    queries = cell(asked.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), deal(blocks, 1), F.col("p"))
    candidates = cell(others.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), F.col("b"), deal(parts, 2))
    grid = queries.withColumn("asks", F.lit(True)).unionByName(candidates.withColumn("asks", F.lit(False)))
    grid = grid.repartitionById(blocks * parts, "cell").sortWithinPartitions("cell", F.desc("asks"))
    found_schema, nearest_schema = _schemas()
    found = grid.mapInArrow(lambda frames: _cells(frames, found_schema, k), _FOUND)
    found = found.repartition(tasks(spark), "query_row").sortWithinPartitions("query_row")
    return found.mapInArrow(lambda frames: _merged(frames, nearest_schema, k), _NEAREST).select("query_id", "rank", "vec_id", "score")


def _schemas() -> tuple[pa.Schema, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(_FOUND)), to_arrow_schema(StructType.fromDDL(_NEAREST))
