"""Packing along a space-filling curve: documents close in a projected vector space share sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, batches, mix, ordered, portions, table, utf8
from .tokens import default_path, encoder

DIMS, BITS, BUCKETS = 3, 16, 1 << 14
#: Distinct words that a worker keeps the ids of: with more of them, two workers and a full heap outgrow an executor.
WORDS = 400_000

ENCODED = "rid long, doc_id long, curve long, n long, width int, ids binary"
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def projection(dims: int = DIMS, buckets: int = BUCKETS) -> np.ndarray:
    """A fixed matrix of +1 and -1 from hashed buckets to dims."""
    bits = mix(np.arange(1, buckets + 1, dtype=np.uint64))
    return np.stack([np.where((bits >> np.uint64(d)) & np.uint64(1), 1.0, -1.0) for d in range(dims)], axis=1).astype(np.float32)


def vectors(ids: np.ndarray, at: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """For each row, its ids hashed to buckets, counted, scaled by the root of the row's length and projected."""
    rows, out = len(at) - 1, np.zeros((len(at) - 1, matrix.shape[1]))
    bucket = (mix(ids.astype(np.uint64) + np.uint64(1)) & np.uint64(len(matrix) - 1)).astype(np.int64)
    full = np.flatnonzero(np.diff(at) > 0)
    for d in range(matrix.shape[1]):
        if len(full):
            out[full, d] = np.add.reduceat(matrix[bucket, d].astype(np.float64), at[full])
    return out / np.sqrt(np.maximum(np.diff(at), 1)).reshape(rows, 1)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of integer points, one a row, each coordinate under 2 ** bits."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # from the highest bit: undo the turns and mirrorings of the larger cells
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: np.ndarray, at: np.ndarray, matrix: np.ndarray, bits: int = BITS) -> np.ndarray:
    v = vectors(ids, at, matrix)
    side = 1 << bits
    return hilbert(np.clip((np.arctan(v / 4) / np.pi + 0.5) * side, 0, side - 1), bits)


def _encode(path: str, end: int):
    matrix = projection()

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        enc.cap = WORDS
        width = 2 if max(enc.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else 4
        for b in portions(frames):
            ids, at = enc.encode_ended(*utf8(b.column("text")), end)
            keys, small = curve_keys(ids, at, matrix), ids.astype(f"<u{width}")
            bounds = at.tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("rid"), b.column("doc_id").cast(pa.int64()), pa.array(keys, pa.int64()), pa.array(np.diff(at), pa.int64()),
                    pa.array([width] * b.num_rows, pa.int32()), pa.array([small[a:z].tobytes() for a, z in zip(bounds, bounds[1:], strict=False)], pa.binary()),
                ],
                names=["rid", "doc_id", "curve", "n", "width", "ids"],
            )

    return run


def _cut(length: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames):
            out = []
            for doc, begin, n, width, raw in zip(*(b.column(c).to_pylist() for c in ("doc_id", "begin", "n", "width", "ids")), strict=True):
                ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
                a = 0
                while a < n:
                    seq, off = divmod(begin + a, length)
                    z = min(n, a + length - off)
                    out.append((doc, a, z - a, n, seq, off, ids[a:z].tobytes()))
                    a = z
            cols = list(zip(*out, strict=True)) or [[]] * 7
            names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "ids" else pa.int64()) for c, k in zip(cols, names, strict=True)], names=names)

    return run


def pack(docs: DataFrame, path: str | None = None, length: int = 4096, end: int = 2) -> DataFrame:
    """Cuts the documents, laid end to end along the curve, into sequences of length ids; the last may be shorter.

    Returns doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit ids) and
    ids_crc32 (theirs), a row for each piece. Documents of equal
    key on the curve follow by doc_id, then by a row number, so one key may fill any number of partitions. A null text
    is empty and has the end id alone. Rows with equal doc_id are packed each; those with a null one come first of their
    key. Texts of any length are cut whole. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    encoded = table(rows.mapInArrow(_encode(path or default_path(), end), ENCODED))
    begins = ordered(encoded.select("curve", "doc_id", "rid", "n"), ["curve", "doc_id", "rid"], {"begin": "n"}).select("rid", "begin")
    # begins has a row for each document: it grows with the input and is never broadcast
    joined = encoded.join(begins.hint("merge"), "rid").select("doc_id", "begin", "n", "width", "ids")
    return joined.mapInArrow(_cut(length), PIECES).withColumn("ids_crc32", F.crc32("ids"))

