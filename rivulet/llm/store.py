"""Token ids in a content-addressed store of Parquet files.

A store is a folder of three tables:

- parts/kind=1, the chunks: key (SHA-256 of payload) and payload (the chunk's ids, little-endian, `width` bytes each),
  stored once each.
- recipes, in ascending doc_id from file to file and within each: doc_id, n_tokens, at (ids of the documents before it in
  the file), the keys and sizes of its chunks in order, and root, the SHA-256 of the keys joined. Behind a file's
  documents, a row of kind 2 has their number, their ids and the SHA-256 of their roots joined.
- manifest: a row for each recipe file, with its ids before (start) and the hash that ends it; the row of part -1 has the
  SHA-256 of these hashes joined, the root of all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _delete, arrow_limits, batches, folder, mix, portions, rolled, tasks, utf8
from .tokens import default_path, encoder

#: Ids under the rolling hash; a chunk has LEAST ids or more, MEAN - 1 more on average, MOST at most.
WINDOW, LEAST, MEAN, MOST = 8, 256, 512, 4096

STORED = "kind int, key binary, doc_id long, n_tokens long, keys array<binary>, sizes array<int>, width int, payload binary"


def cuts(ids: np.ndarray, at: np.ndarray, least: int = LEAST, mean: int = MEAN, most: int = MOST) -> list[list[int]]:
    """For each row, where its chunks end: behind ids whose rolling hash is 0 modulo mean, within the two sizes."""
    h = rolled(mix(ids.astype(np.uint64)), WINDOW)
    marks = np.flatnonzero(h % np.uint64(mean) == 0) + WINDOW
    lo, hi = np.searchsorted(marks, at[:-1] + WINDOW), np.searchsorted(marks, at[1:], "right")
    out = []
    for r in range(len(at) - 1):
        a, end, mine = int(at[r]), int(at[r + 1]), []
        for m in [*marks[lo[r] : hi[r]].tolist(), end]:
            while m - a > most:
                a += most
                mine.append(a)
            if m - a >= least and m < end:
                mine.append(m)
                a = m
        if end > a:
            mine.append(end)
        out.append(mine)
    return out


def _encode(path: str, end: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        width = 2 if max(enc.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else 4
        seen: set[bytes] = set()  # of this task, so that a chunk in many documents is sent a few times at most
        for b in portions(frames):
            ids, at = enc.encode_ended(*utf8(b.column("text")), end)
            raw = ids.astype(f"<u{width}").tobytes()
            ends = cuts(ids, at)
            number = np.array([len(x) for x in ends], np.int64)
            z = np.array([x for own in ends for x in own], np.int64)
            a = np.empty_like(z)
            a[1:] = z[:-1]
            first = np.cumsum(number) - number
            a[first[number > 0]] = at[:-1][number > 0]
            parts = [raw[x:y] for x, y in zip((a * width).tolist(), (z * width).tolist(), strict=True)]
            keys = [hashlib.sha256(x).digest() for x in parts]
            new = []
            for k, key in enumerate(keys):
                if key not in seen:
                    seen.add(key)
                    new.append(k)
            if len(seen) > 500_000:
                seen.clear()
            flat = b"".join(keys)
            cut = np.concatenate((first, [len(z)])).astype(np.int32)
            roots = [hashlib.sha256(flat[32 * x : 32 * y]).digest() for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            n, k = b.num_rows, len(new)
            listed = np.concatenate((cut, np.full(k, cut[-1], np.int32)))
            none = pa.array(np.arange(n + k) >= n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array([0, 1], np.int32), (n, k))),
                    pa.array(roots + [keys[x] for x in new], pa.binary()),
                    pa.concat_arrays([b.column("doc_id").cast(pa.int64()), pa.nulls(k, pa.int64())]),
                    pa.array(np.concatenate((np.diff(at), (z - a)[new]))),
                    pa.ListArray.from_arrays(pa.array(listed), pa.array(keys, pa.binary()), mask=none),
                    pa.ListArray.from_arrays(pa.array(listed), pa.array((z - a).astype(np.int32)), mask=none),
                    pa.array(np.full(n + k, width, np.int32)),
                    pa.array([None] * n + [parts[x] for x in new], pa.binary()),
                ],
                names=[x.split()[0] for x in STORED.split(", ")],
            )

    return run


def _once(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of chunks sorted by key, the first of each, compared with the others."""
    last, held = None, None
    for b in batches(frames):
        key, payload, chunk = b.column("key"), b.column("payload"), b.column("kind").to_numpy() == 1
        same = np.zeros(b.num_rows, bool)
        same[1:] = pc.equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False) & chunk[1:]
        same[0] = chunk[0] and last == key[0].as_py()
        for i in np.flatnonzero(same).tolist():
            if payload[i].as_py() != (payload[i - 1].as_py() if i else held):
                raise ValueError(f"two chunks share the SHA-256 {key[i].as_py().hex()}")
        if chunk[-1]:
            last, held = key[-1].as_py(), payload[-1].as_py()
        yield b.filter(pa.array(~same))


SEALED = "kind int, part int, i long, doc_id long, root binary, n_tokens long, at long, keys array<binary>, sizes array<int>"


def _seal(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the running sums of a recipe file, and its last row."""
    whole, i, at, part, schema = hashlib.sha256(), 0, 0, None, None
    for b in batches(frames):
        whole.update(b"".join(b.column("root").to_pylist()))
        n, part = b.column("n_tokens").to_numpy(), b.column("part")[0].as_py()
        rows = b.num_rows
        out = [
            pa.array(np.zeros(rows, np.int32)), b.column("part"), pa.array(np.arange(i, i + rows)), b.column("doc_id"), b.column("root"), b.column("n_tokens"),
            pa.array(np.cumsum(n) - n + at), b.column("keys"), b.column("sizes"),
        ]
        i, at = i + rows, at + int(n.sum())
        out = pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in SEALED.split(", ")])
        schema = out.schema
        yield out
    if i:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((2, part, i, None, whole.digest(), at, at, None, None), schema, strict=True)], schema=schema)


MANIFEST = "part int, n_docs long, n_tokens long, start long, root binary"


def write_store(docs: DataFrame, path: str | None = None, end: int = 1) -> str:
    """Encodes every text by the tokenizer file at path, id end behind each, writes a store and returns its folder.

    A null text is empty and has the end id alone. Rows with equal doc_id are separate documents, in the order of their
    roots; a null doc_id comes first. Texts of any length are encoded and cut whole. An empty table gives an empty store.
    Columns but doc_id and text are ignored.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    to, n = folder(spark, "store"), tasks(spark)
    rows = docs.select("doc_id", "text").mapInArrow(_encode(path or default_path(), end), STORED)
    dealt = F.when(F.col("kind") == 1, F.xxhash64("key")).otherwise(F.xxhash64("doc_id", "key"))
    once = rows.repartition(n, dealt).sortWithinPartitions("kind", "key").mapInArrow(_once, STORED)
    once.write.partitionBy("kind").option("compression", "zstd").parquet(f"{to}/parts")
    own = _read(spark, to, "parts", STORED).where("kind = 0").select("doc_id", F.col("key").alias("root"), "n_tokens", "keys", "sizes")
    own = own.repartitionByRange(n, "doc_id", "root").sortWithinPartitions("doc_id", "root").withColumn("part", F.spark_partition_id())
    own.mapInArrow(_seal, SEALED).write.option("compression", "zstd").parquet(f"{to}/recipes")
    _delete(spark, f"{to}/parts/kind=0")
    start, parts = 0, []  # a row for each file
    for r in _ends(spark, to):
        parts.append((r["part"], r["i"], r["n_tokens"], start, bytes(r["root"])))
        start += r["n_tokens"]
    parts.append((-1, sum(p[1] for p in parts), start, 0, hashlib.sha256(b"".join(p[4] for p in parts)).digest()))
    spark.createDataFrame(parts, MANIFEST).coalesce(1).write.parquet(f"{to}/manifest")
    return to


def _read(spark: SparkSession, store: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{store}/{name}")


def _ends(spark: SparkSession, store: str) -> list:
    """The last rows of the recipe files, in order."""
    return _read(spark, store, "recipes", SEALED).where("kind = 2").select("part", "i", "n_tokens", "root").orderBy("part").collect()


def _starts(spark: SparkSession, store: str) -> dict[int, int]:
    """The ids before each recipe file, by a manifest that agrees with itself and with what ends the files."""
    rows = sorted(_read(spark, store, "manifest", MANIFEST).collect(), key=lambda r: r["part"])
    ends = [(r["part"], r["i"], r["n_tokens"], bytes(r["root"])) for r in _ends(spark, store)]
    top, parts = rows[0], [(r["part"], r["n_docs"], r["n_tokens"], bytes(r["root"])) for r in rows[1:]]
    if parts != ends or top["part"] != -1 or bytes(top["root"]) != hashlib.sha256(b"".join(p[3] for p in parts)).digest():
        raise ValueError("the manifest and the recipe files differ")
    return {r["part"]: r["start"] for r in rows[1:]}


CHECKED = "part int, i long, doc_id long, start long, n_tokens long, keys array<binary>, sizes array<int>, after array<long>"


def _checked(starts: dict[int, int]):
    """Recipes of whole files in order, each held against its root, and all against what ends the file."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, at, whole = None, 0, 0, hashlib.sha256()
        for b in batches(frames):
            fields = [b.column(c).to_pylist() for c in ("kind", "part", "i", "root", "n_tokens", "at", "keys", "sizes")]
            for kind, own, i, root, n, before, keys, sizes in zip(*fields, strict=True):
                if part is None:
                    part, rows, at, whole = own, 0, 0, hashlib.sha256()
                if own != part:
                    raise ValueError(f"recipe file {part} has no end")
                if kind == 2:
                    if (i, n, root) != (rows, at, whole.digest()):
                        raise ValueError(f"recipe file {part} is damaged")
                    part = None
                elif (i, before) != (rows, at) or sum(sizes) != n or hashlib.sha256(b"".join(keys)).digest() != root:
                    raise ValueError(f"recipe {rows} of file {part} is damaged")
                else:
                    rows, at = rows + 1, at + n
                    whole.update(root)
            b = b.filter(pc.equal(b.column("kind"), 0))
            start = b.column("at").to_numpy() + np.array([starts[p] for p in b.column("part").to_pylist()], np.int64)
            sizes = b.column("sizes")
            cut = sizes.offsets.to_numpy()
            # the ids behind each chunk: those of the document, less those up to the chunk's end
            ends = np.append(0, np.cumsum(sizes.flatten().to_numpy(), dtype=np.int64))
            after = np.repeat(ends[cut[1:] - cut[0]], np.diff(cut)) - ends[1:]
            after = pa.ListArray.from_arrays(pa.array((cut - cut[0]).astype(np.int32)), pa.array(after))
            cols = [*(b.column(c) for c in ("part", "i", "doc_id")), pa.array(start), *(b.column(c) for c in ("n_tokens", "keys", "sizes")), after]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in CHECKED.split(", ")])
        if part is not None:
            raise ValueError(f"recipe file {part} has no end")

    return run


def recipes(spark: SparkSession, store: str) -> DataFrame:
    """The verified recipes with start, the ids of all documents before each."""
    rows = _read(spark, store, "recipes", SEALED).repartition(tasks(spark), "part").sortWithinPartitions("part", "i", "kind")
    return rows.mapInArrow(_checked(_starts(spark, store)), CHECKED)


def chunks(spark: SparkSession, store: str) -> DataFrame:
    return _read(spark, store, "parts", STORED).where("kind = 1").select("key", "width", "payload")


def _facts(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(frames):
        n, crc = [], []
        for k, w, x in zip(b.column("key").to_pylist(), b.column("width").to_pylist(), b.column("payload").to_pylist(), strict=True):
            if hashlib.sha256(x).digest() != k:
                raise ValueError(f"chunk {k.hex()} is damaged")
            n.append(len(x) // w)
            crc.append(crc32(np.frombuffer(x, f"<u{w}").astype("<u4")))
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["key", "n", "crc"])


_POLY = 0xEDB88320


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2) modulo CRC-32's, bit 31 the lowest power."""
    a, b = np.broadcast_arrays(a.astype(np.uint32), b.astype(np.uint32))
    out, b = np.zeros(a.shape, np.uint32), b.copy()
    for i in range(32):
        out ^= b * ((a >> np.uint32(31 - i)) & np.uint32(1))
        b = (b >> np.uint32(1)) ^ (np.uint32(_POLY) * (b & np.uint32(1)))
    return out


_STEP = 1 << 12


def _powers(base: np.ndarray, n: int = _STEP) -> np.ndarray:
    """base to the powers 0 to n - 1, by doubling."""
    out = np.array([1 << 31], np.uint32)
    while len(out) < n:
        out = np.concatenate((out, _times(out, _times(out[-1:], base))))
    return out[:n]


class Shift:
    """Powers of x by 32 n for numbers n of ids, as products of one table entry for each 12 bits of n."""

    def __init__(self) -> None:
        self.tables: list[np.ndarray] = []
        base = np.array([1 << 30], np.uint32)  # x
        for _ in range(5):
            base = _times(base, base)  # at last x ** 32
        self.base = base

    def __call__(self, n: np.ndarray) -> np.ndarray:
        out, level = np.full(len(n), 1 << 31, np.uint32), 0
        n = n.astype(np.int64)
        while n.any():
            if level == len(self.tables):
                self.tables.append(_powers(self.base))
                self.base = _times(self.tables[-1][-1:], self.base)
            own = np.flatnonzero(n & (_STEP - 1))
            out[own] = _times(out[own], self.tables[level][n[own] & (_STEP - 1)])
            n, level = n >> 12, level + 1
        return out


_shift: list[Shift] = []


def _shares(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each chunk adds to its document's CRC-32: its own, times x to the power of the bits behind it; all are
    joined by exclusive or."""
    if not _shift:
        _shift.append(Shift())
    for b in batches(frames):
        crc = b.column("crc").to_numpy()
        own = _times(crc, _shift[0](b.column("after").to_numpy())).astype(np.int64)
        yield b.drop_columns(["crc", "after"]).append_column("share", pa.array(own))


def read_digests(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from a store's files.

    The manifest, every recipe's root and every chunk's key are recomputed; a damaged, swapped or missing row raises. A
    document's sum follows from those of its chunks, one row each, so a long document is spread like any other.
    """
    arrow_limits(spark)
    facts = chunks(spark, store).mapInArrow(_facts, "key binary, n long, crc long")
    rows = recipes(spark, store)
    each = rows.select("part", "i", "doc_id", "start", "n_tokens", F.explode(F.arrays_zip("keys", "sizes", "after")).alias("c"))
    found = each.select("part", "i", "doc_id", "start", "n_tokens", F.col("c.keys").alias("key"), "c.sizes", "c.after").join(facts, "key", "left")
    whole = F.coalesce(F.col("n") == F.col("sizes"), F.lit(False))
    fine = found.withColumn("crc", F.when(whole, F.col("crc")).otherwise(F.raise_error(F.lit("a recipe's chunk is missing or of another size")).cast("long")))
    columns = ["part", "i", "doc_id", "start", "n_tokens"]
    schema = "part int, i long, doc_id long, start long, n_tokens long, share long"
    shares = fine.select(*columns, "crc", "after").mapInArrow(_shares, schema)
    one = shares.groupBy(*columns).agg(F.bit_xor("share").alias("ids_crc32"))
    return one.select("doc_id", "start", "n_tokens", "ids_crc32")


def read_documents(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, start and ids of every document, put together from its chunks; verified as by read_digests()."""
    arrow_limits(spark)
    rows = recipes(spark, store)
    each = rows.select("part", "i", "doc_id", "start", F.posexplode("keys").alias("pos", "key")).join(chunks(spark, store), "key", "left")
    got = each.groupBy("part", "i", "doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("pos", "key", "width", "payload"))).alias("got"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames):
            ids = []
            for row in b.column("got").to_pylist():
                for c in row:
                    if c["payload"] is None or hashlib.sha256(c["payload"]).digest() != c["key"]:
                        raise ValueError(f"chunk {c['key'].hex()} is missing or damaged")
                ids.append([int(x) for c in row for x in np.frombuffer(c["payload"], f"<u{c['width']}")])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    return got.select("doc_id", "start", "got").mapInArrow(run, "doc_id long, start long, ids array<long>")


def token_store(docs: DataFrame, path: str | None = None, end: int = 1) -> DataFrame:
    """Writes the store of docs and returns read_digests() of its files."""
    return read_digests(docs.sparkSession, write_store(docs, path, end))
