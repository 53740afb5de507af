"""What the operators share: intermediate tables, Arrow access, word hashes, global row numbers."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only in local mode where the session names no shared folder, as in tests.
LOCAL_SHARED = "/tmp/checkpoints/rivulet"

_active: list[Tables] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; without one, only local mode goes on."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (own or LOCAL_SHARED).rstrip("/")


class Tables:
    """Owns the intermediate tables that are written and the values that are broadcast while it is entered; release()
    deletes these and no others.

    A result may read them, so release() is for use once it is stored.
    """

    def __init__(self) -> None:
        self.paths: list[str] = []
        self.shared: list[Broadcast] = []

    def __enter__(self) -> Tables:
        _active.append(self)
        return self

    def __exit__(self, *_) -> None:
        _active.remove(self)

    def release(self, spark: SparkSession) -> None:
        while self.paths:
            _delete(spark, self.paths.pop())
        while self.shared:
            self.shared.pop().destroy()


def share(spark: SparkSession, value) -> Broadcast:
    """value as a broadcast, owned by the Tables in use: the driver and the executors hold it until these are released."""
    out = spark.sparkContext.broadcast(value)
    if _active:
        _active[-1].shared.append(out)
    return out


def free(df: DataFrame, *names: str) -> list[str]:
    """names, each with as many underscores behind as it takes to be no column of df's, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def folder(spark: SparkSession, name: str = "rivulet") -> str:
    """A new folder's path in the shared folder, owned by the Tables in use."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _active:
        _active[-1].paths.append(path)
    return path


#: Shuffle files of a query are deleted when it ends; the table it wrote is what goes on.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts lineage, survives lost executors. What the write
    shuffled is deleted with its end."""
    spark = df.sparkSession
    path, before = folder(spark), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._rivulet_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop(*tables: DataFrame) -> None:
    """Deletes tables that nothing still to be run reads."""
    for t in tables:
        for own in _active:
            if t._rivulet_path in own.paths:
                own.paths.remove(t._rivulet_path)
        _delete(t.sparkSession, t._rivulet_path)


def arrow_limits(spark: SparkSession, rows: int = 2000) -> None:
    """Keeps the batches that Python workers hold small. Plans read these settings when they run, so they stay."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    except Exception:  # noqa: BLE001  not known to every Spark version
        pass


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _summed(order_sums: dict[str, str]):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = dict.fromkeys(order_sums, 0)
        rows = 0
        for b in batches(frames):
            b = b.append_column("i", pa.array(np.arange(rows, rows + b.num_rows), pa.int64()))
            rows += b.num_rows
            for name, column in order_sums.items():
                own = b.column(column).to_numpy(zero_copy_only=False)
                b = b.append_column(name, pa.array(np.cumsum(own) - own + at[name], pa.int64()))
                at[name] += int(own.sum())
            yield b

    return run


def ordered(df: DataFrame, order: list[str], sums: dict[str, str] | None = None) -> DataFrame:
    """df as a table sorted by order over range partitions, with part, rank (place in the whole order, from 0) and, by
    each name in sums, what that column adds up to in all rows before.

    Sums run within a part as it is written; the parts' own, one row each, are added by a join. A key is spread over as
    many parts as its rows need if order ends in distinct columns.
    """
    spark, sums = df.sparkSession, sums or {}
    own = df.repartitionByRange(tasks(spark), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema] + [f"`{x}` long" for x in ("i", *sums)])
    t = table(own.mapInArrow(_summed(sums), schema))
    totals = t.groupBy("part").agg(F.count(F.lit(1)).alias("i"), *[F.sum(c).alias(x) for x, c in sums.items()]).collect()
    at, rows = [0] * (1 + len(sums)), []
    for r in sorted(totals, key=lambda r: r["part"]):
        rows.append((r["part"], *at))
        at = [a + int(n) for a, n in zip(at, r[1:], strict=True)]
    parts = spark.createDataFrame(rows, ", ".join(["part int", *[f"`_{x}` long" for x in ("i", *sums)]]))
    out = t.join(F.broadcast(parts), "part")  # a row for each part
    before = {x: F.col(x) + F.col(f"_{x}") for x in sums}
    return out.withColumns({"rank": F.col("i") + F.col("_i"), **before}).select(*df.columns, "part", "rank", *sums)


def join_hot(left: DataFrame, right: DataFrame, key: str, rows: str, total: int, spread: str) -> DataFrame:
    """left with the columns of right, which has each key once, null where it lacks the key.

    rows is a column of right: how many rows of left have the key, of total in all. Keys that hold more than a fourth of a
    task's share are fewer than four times the tasks; these, proven so few, are broadcast, and their rows are dealt by
    spread, a column of left, instead of by key. The other keys are joined by a shuffle.
    """
    few = 4 * tasks(left.sparkSession)
    hot = F.col(rows) * few > total
    values = [c for c in right.columns if c != key]
    packed = F.struct(*[F.col(c).alias(c) for c in values])
    near = F.broadcast(right.where(hot).select(F.col(key).alias("_hot_key"), packed.alias("_hot")))
    # 0, but no constant: the optimiser would take it out of the join's keys, and hot rows would meet again
    none = F.least(F.col(rows).cast("long"), F.lit(0).cast("long"))
    far = right.where(~hot).select(F.col(key).alias("_key"), none.alias("_salt_"), packed.alias("_cold"))
    out = left.join(near, F.col(key) == F.col("_hot_key"), "left")
    salt = F.when(F.col("_hot_key").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), F.lit(1 << 20)) + 1)
    out = out.withColumn("_salt", salt.cast("long")).join(far, (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_salt_")), "left")
    return out.withColumn("_both", F.coalesce("_hot", "_cold")).select(*left.columns, *[F.col(f"_both.{c}").alias(c) for c in values])


# ---- Arrow columns as bytes ----


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    n = len(column)
    if at is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    buf = whole[offsets[0] : offsets[-1]]
    return buf, offsets - offsets[0]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BLOCK, _LONG = 1 << 18, 1 << 12
_M = 0x9E3779B97F4A7C15
_POW = _INV = None


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers() -> None:
    global _POW, _INV
    if _POW is None:
        n = _BLOCK + 1
        p, q = np.full(n, _M, np.uint64), np.full(n, pow(_M, -1, 1 << 64), np.uint64)
        p[0] = q[0] = 1
        _POW, _INV = np.multiply.accumulate(p), np.multiply.accumulate(q)


def words(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes in the class inside (256 booleans), never across rows."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    m = np.zeros(n + 2, bool)
    m[1:-1] = inside[buf]
    first = np.zeros(n + 2, bool)
    first[offsets[:-1][offsets[:-1] < n] + 1] = True
    starts = np.flatnonzero(m[1:-1] & (~m[:-2] | first[1:-1]))
    ends = np.flatnonzero(m[:-1] & (~m[1:] | first[1:]))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def run_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """64-bit hash of each run, its bytes mapped by fold (A-Z lower-cased); depends on these bytes alone."""
    _powers()
    out = np.empty(len(starts), np.uint64)
    i, n = 0, len(starts)
    while i < n:
        base = starts[i]
        j = int(np.searchsorted(ends, base + _BLOCK, "right"))
        if j > i:
            b = fold[buf[base : ends[j - 1]]].astype(np.uint64)
            b += np.uint64(1)
            total = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(b * _POW[: len(b)], out=total[1:])
            s, e = starts[i:j] - base, ends[i:j] - base
            out[i:j] = mix((total[e] - total[s]) * _INV[s] + (e - s).astype(np.uint64))
        i = max(j, i + 1)
    for k in np.flatnonzero(ends - starts > _LONG):
        out[k] = int.from_bytes(hashlib.blake2b(fold[buf[starts[k] : ends[k]]].tobytes(), digest_size=8).digest(), "little")
    return out


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values; entry i covers i to i + k - 1."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += h[j : j + n]
    return mix(out)


def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in frames:
        if b.num_rows:
            yield b


def portions(frames: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a column's bytes stay under most, or a row stands alone: the arrays made of them are small."""
    for b in batches(frames):
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < b.num_rows:
            z = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + most, "right")))
            yield b.slice(a, z - a)
            a = z
