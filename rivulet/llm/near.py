"""Near-duplicates by MinHash: universal hash minima, banding, verification, large-star and small-star components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, batches, drop, free, join_hot, mix, rolled, run_hashes, table, tasks, utf8, words

#: Words of a shingle; a link needs 100 * intersection >= PERCENT * union.
SHINGLE, PERCENT = 5, 75
#: BANDS bands of ROWS minima: at similarity 0.75 a pair meets in no band with probability (1 - 0.75 ** 5) ** 48 = 2e-6.
BANDS, ROWS = 48, 5

#: Bits of each minimum that are compared before whole sets are; of pairs at similarity 0.75, 1 in 30,000 has more than
#: DIFFER of the MINIMA apart (4 standard deviations); the bands take the first of them.
MINIMA, PLANES, DIFFER = 480, 4, 150

#: Sets of up to LISTED shingles go into the comparison within a bucket themselves; longer ones by their signature alone.
LISTED = 2048

#: Word bytes: all but the space and 09-0D.
WORD = np.ones(256, bool)
WORD[0x20] = False
WORD[0x09:0x0E] = False


def shingles(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all rows, ascending in each row, and where each row's begin."""
    rows = len(texts)
    buf, offsets = utf8(texts)
    s, e, row = words(buf, offsets, WORD)
    h = run_hashes(buf, s, e)
    n = np.bincount(row, minlength=rows)
    g = rolled(h, k)
    whole = row[: len(g)] == row[k - 1 :] if len(g) else np.zeros(0, bool)
    own, at = g[whole], row[: len(g)][whole]
    first = np.cumsum(n) - n
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        one = np.array([rolled(h[first[r] : first[r] + n[r]], int(n[r]))[0] for r in few], np.uint64)
        own, at = np.concatenate((own, one + few_mark(n[few]))), np.concatenate((at, few))
    order = np.lexsort((own, at))
    own, at = own[order], at[order]
    if len(own):
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1])
        own, at = own[new], at[new]
    return own, np.searchsorted(at, np.arange(rows + 1))


def few_mark(n: np.ndarray) -> np.ndarray:
    """Keeps sequences of different lengths apart."""
    return mix(n.astype(np.uint64) + np.uint64(77))


def coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed odd multipliers and summands of n universal (multiply-shift) hash functions."""
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:n] | np.uint64(1), x[n:]


def minima(own: np.ndarray, at: np.ndarray, n: int = MINIMA) -> np.ndarray:
    """The least value of n universal hash functions over each row's shingles: rows by n; rows must not be empty."""
    a, b = coefficients(n)
    out = np.empty((len(at) - 1, n), np.uint32)
    step = max(1, len(at) - 1)
    i = 0
    while i < len(at) - 1:  # some 32,768 shingles at once stay in the cache
        step = max(1, int(np.searchsorted(at, at[i] + 32768, "right")) - 1 - i)
        x, cut = own[at[i] : at[i + step]], at[i : i + step] - at[i]
        y = np.empty_like(x)
        for j in range(n):
            np.multiply(x, a[j], out=y)
            y += b[j]
            z = (y >> np.uint64(32)).astype(np.uint32)
            out[i : i + step, j] = np.minimum.reduceat(z, cut)
        i += step
    return out


def bands(signature: np.ndarray, n: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit bucket for each band; the band is part of it."""
    out = np.empty((len(signature), n), np.uint64)
    for j in range(n):
        x = np.full(len(signature), j + 1, np.uint64)
        for r in range(rows):
            x = mix(x * np.uint64(0xD6E8FEB86659FD93) + signature[:, j * rows + r].astype(np.uint64))
        out[:, j] = x
    return out


def set_hashes(own: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell sets apart: two independent hashes of the elements, summed."""
    lo, hi = np.zeros(len(at) - 1, np.uint64), np.zeros(len(at) - 1, np.uint64)
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        lo[full] = np.add.reduceat(mix(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at[full])
        hi[full] = np.add.reduceat(mix(own + np.uint64(0x632BE59BD9B4E019)), at[full])
    return lo, hi


def planes(signature: np.ndarray, n: int = PLANES) -> np.ndarray:
    """The low n bits of each minimum, as words of 64 of one bit each: rows by n times words."""
    pad = -signature.shape[1] % 64
    out = []
    for j in range(n):
        bit = np.pad(((signature >> np.uint32(j)) & np.uint32(1)).astype(np.uint8), ((0, 0), (0, pad)))
        out.append(np.packbits(bit, axis=1).view(">u8").astype(np.uint64))
    return np.concatenate(out, axis=1)


def _buckets(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, number of shingles, a hash of the whole set, and the buckets if it isn't empty."""
    for b in batches(frames):
        own, at = shingles(b.column("text"))
        lo, hi = set_hashes(own, at)
        size = np.diff(at)
        full = np.flatnonzero(size > 0)
        signature = minima(own, np.append(at[:-1][full], len(own))) if len(full) else np.zeros((0, MINIMA), np.uint32)
        found, bits = bands(signature), planes(signature)
        ends = np.concatenate(([0], np.cumsum(np.where(size > 0, BANDS, 0)))).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel().view(np.int64)))
        ends = np.concatenate(([0], np.cumsum(np.where(size > 0, bits.shape[1], 0)))).astype(np.int32)
        sketch = pa.ListArray.from_arrays(pa.array(ends), pa.array(bits.ravel().view(np.int64)))
        cols = [b.column("doc_id"), pa.array(size, pa.int64()), pa.array(lo.view(np.int64)), pa.array(hi.view(np.int64)), listed, sketch]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "lo", "hi", "buckets", "sketch"])


#: A text goes to so many of its partners at once.
PARTNERS = 64

_TEXTS = "a long, block long, b long, text string"


def _linked(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by a and block, the text of a first (b is null), those b whose whole shingle sets are similar enough
    to that of a."""
    of, own = None, np.zeros(0, np.uint64)
    for batch in batches(frames):
        first, second = [], []
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            sets, at = shingles(part.column("text"))
            for k, (a, b) in enumerate(zip(part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True)):
                q = sets[at[k] : at[k + 1]]
                if b is None:
                    of, own = a, q
                    continue
                if a != of:
                    raise ValueError(f"the text of {a} is missing")
                if 100 * min(len(own), len(q)) >= PERCENT * max(len(own), len(q)):
                    both = len(np.intersect1d(own, q, assume_unique=True))
                    if 100 * both >= PERCENT * (len(own) + len(q) - both):
                        first.append(a)
                        second.append(b)
            own = own.copy()  # not a view of the part
        yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(second, pa.int64())], names=["a", "b"])


def _listed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, number of shingles and, up to LISTED, the distinct 32-bit halves of their hashes, else null."""
    for b in batches(frames):
        own, at = shingles(b.column("text"))
        n = np.diff(at)
        halves = [np.unique((own[x:y] >> np.uint64(32)).astype(np.uint32)).view(np.int32) if y - x <= LISTED else None for x, y in zip(at[:-1], at[1:], strict=True)]
        cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(halves, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "listed"])


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked, held against whole texts; (doc_id, text) has each id once.

    The partners of a are dealt to blocks of about PARTNERS; its text goes to each block, not to each pair.
    """
    spark = pairs.sparkSession
    total = pairs.count()
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    block = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / PARTNERS))
    dealt = join_hot(pairs, sizes, "a", "n", total, "b").select("a", block.alias("block"), "b")
    theirs = dealt.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "block", "b", "text")
    own = dealt.select("a", "block").distinct().join(texts.withColumnRenamed("doc_id", "a"), "a").select("a", "block", F.lit(None).cast("long").alias("b"), "text")
    rows = own.unionByName(theirs).repartition(tasks(spark), "a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())
    return rows.mapInArrow(_linked, "a long, b long")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) of every node of edges (a, b): its component's least node.

    Alternates large-star (a node's larger neighbours are linked to the least of its neighbours and itself) and
    small-star (its smaller neighbours and itself are), each a minimum per node, joined, until what is left are stars:
    each node has one smaller neighbour, which has none. A node with any number of neighbours has one minimum, found
    before the shuffle; its links are split at run time.
    """
    now = table(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct())
    n, settled = _stars(now)
    for _ in range(rounds):
        if settled:
            break
        large = table(_star(now, n, large=True))
        drop(now)
        now = table(_star(large, large.count(), large=False))
        drop(large)
        n, settled = _stars(now)
    if not settled:
        raise RuntimeError("components did not settle")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))


def _stars(edges: DataFrame) -> tuple[int, bool]:
    """The number of distinct edges, and whether each hi has one lo that is no hi itself: then a node's lo is its
    component, and a further round would change nothing."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("hi").alias("node"), F.lit(1).alias("up")), F.struct(F.col("lo").alias("node"), F.lit(0).alias("up")))).alias("e"))
    by = ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.min("e.up").alias("least"))
    n, open_ = by.agg(F.sum("up"), F.count_if(F.expr("up > 1 OR (up = 1 AND least = 0)"))).first()
    return n or 0, not open_


def _star(edges: DataFrame, n: int, large: bool) -> DataFrame:
    """One of the two steps over n edges. A node's links beyond a task's share are dealt by their other end."""
    both = edges.select(F.col("hi").alias("node"), F.col("lo").alias("to"))
    if large:
        both = both.unionByName(edges.select(F.col("lo").alias("node"), F.col("hi").alias("to")))
    least = both.groupBy("node").agg(F.min("to").alias("m"), F.count(F.lit(1)).alias("links"))
    if large:
        least = least.select("node", F.least("node", "m").alias("m"), "links")
        out = join_hot(both, least, "node", "links", 2 * n, "to").where("to > node").select(F.col("m").alias("lo"), F.col("to").alias("hi"))
    else:
        own = least.select(F.col("m").alias("lo"), F.col("node").alias("hi"))
        out = join_hot(both, least, "node", "links", n, "to").select(F.col("m").alias("lo"), F.col("to").alias("hi")).unionByName(own)
    return out.where("lo < hi").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    1. Rows with equal shingle sets form a class, represented by its least doc_id; only classes go on.
    2. Each class falls into BANDS buckets. In each, it is paired with the least class; the pairs are verified on whole
       texts, and verified links give components by large-star and small-star.
    3. Classes of one bucket that are still in different components are compared by signature and listed shingles with
       each of those they don't share a component with, and what may be a link verified: none is left out because a
       bucket is large.
    4. The last components follow from all links.

    Null, empty and white-space texts have no shingles and are linked with nothing; each such row is its own
    component. A row with a null doc_id has component_id null, is kept, and takes no part in links. Rows that share a
    doc_id are linked: what any of them is linked with, all are. If ids are shared by different sets, rows are told by
    numbers of their own in all steps, and ids come back with the result. An empty table gives an empty result. Other
    columns are ignored.
    """
    arrow_limits(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = table(slim.mapInArrow(_buckets, _SIGNED))
    one = F.struct("lo", "hi", "n_shingles")
    shared = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(one).alias("a"), F.max(one).alias("b")).where("a <> b")
    if shared.isEmpty():
        return _linked_rows(slim, signed)
    rows = table(slim.withColumn("row", F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())))
    drop(signed)
    own = rows.select(F.col("row").alias("doc_id"), "text")
    least = rows.where("row IS NOT NULL").groupBy("doc_id").agg(F.min("row").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    ids = rows.where("row IS NOT NULL").select("doc_id", "row")
    same = join_hot(ids, least, "doc_id", "n", rows.count(), "row").where("a < row").select("a", F.col("row").alias("b"))
    got = table(_linked_rows(own, table(own.mapInArrow(_buckets, _SIGNED)), same).withColumnsRenamed({"doc_id": "row", "component_id": "component"}))
    known = got.where("row IS NOT NULL").select("row", "n_shingles", "component").join(ids, "row")
    first = known.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    out = join_hot(known, first, "component", "n", rows.count(), "row").select("doc_id", "n_shingles", "component_id")
    none = got.where("row IS NULL").select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


_SIGNED = "doc_id long, n_shingles long, lo long, hi long, buckets array<long>, sketch array<long>"


def _linked_rows(slim: DataFrame, signed: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """near_duplicates() of rows (doc_id, text) whose doc_ids have one shingle set each; more has further links (a, b)."""
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").withColumn("set", F.concat_ws(":", "lo", "hi", "n_shingles"))
    n_full = full.count()
    classes = full.groupBy("set").agg(F.min("doc_id").alias("class"), F.count(F.lit(1)).alias("n"))
    # a class of one row is its own; the rest learn theirs by a join whose right side has a row for each class
    several = table(classes.where("n > 1"))
    member = (
        join_hot(full.select("doc_id", "set"), several, "set", "n", n_full, "doc_id")
        .select("doc_id", F.coalesce("class", "doc_id").alias("class"))
    )
    same = table(member.where("doc_id <> class").distinct())
    heads = full.join(same.select("doc_id").distinct(), "doc_id", "left_anti").select(F.col("doc_id").alias("class"), F.explode("buckets").alias("bucket"))
    count = heads.groupBy("bucket").agg(F.min("class").alias("first"), F.max("class").alias("last"), F.count(F.lit(1)).alias("size")).where("first < last")
    found = join_hot(heads, count.select("bucket", "first", "size"), "bucket", "size", BANDS * n_full, "class")
    met = table(found.where("first IS NOT NULL").select("bucket", "class", "first"))
    texts = _texts(slim, met)
    star = met.where("class > first").select(F.col("first").alias("a"), F.col("class").alias("b")).distinct()
    links = table(verify(star, texts))
    label = table(components(links))
    second = _apart(met, label, full, texts)
    # label links what links does, in stars that are settled already
    known = label.select(F.col("component").alias("a"), F.col("node").alias("b"))
    if not second.isEmpty():
        known = known.unionByName(verify(second, texts))
    every = known.unionByName(same.select(F.col("class").alias("a"), F.col("doc_id").alias("b")))
    if more is not None:
        every = every.unionByName(more)
    final = table(components(every))
    out = signed.select("doc_id", "n_shingles").join(final, F.col("doc_id") == F.col("node"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _texts(slim: DataFrame, met: DataFrame) -> DataFrame:
    """The texts of the classes that share a bucket, each id once."""
    ids = met.select(F.col("class").alias("doc_id")).distinct()
    return table(slim.join(ids, "doc_id").groupBy("doc_id").agg(F.max("text").alias("text")))


def _apart(met: DataFrame, label: DataFrame, signed: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of a bucket's classes in different components, but those with its least class, which were verified.

    Buckets within one component, however large, give nothing. In the others, those outside the least class's component
    meet all that they aren't linked with; a pair goes on if the sizes of the sets allow a link, its signatures are as
    close as those of a link are, and the listed shingles have enough in common. All of this is within the join: of a
    large group, only pairs that are links, but for clashes of 32 bits, become rows. Shingles of one set that clash
    count as common, so that no link is lost by it. Sets too long to be listed pass by their signatures, in the first
    of their common buckets. A bucket beyond a task's share is a grid of parts, each pair of which meets in one task.
    """
    by = met.join(label.withColumnRenamed("node", "class"), "class", "left").select(
        "bucket", "first", "class", F.coalesce("component", "class").alias("component")
    )
    of_first = label.select(F.col("node").alias("first"), F.col("component").alias("of_first"))
    # a bucket's rows share their first: one of many rows is dealt apart
    by = table(by)
    sizes_of = by.groupBy("first").agg(F.count(F.lit(1)).alias("n"))
    by = join_hot(by, of_first.join(sizes_of, "first"), "first", "n", by.count(), "class").select("bucket", "first", "class", "component", F.coalesce("of_first", "first").alias("main"))
    by = table(by.where("class <> first"))
    outside = F.count_if(F.col("component") != F.col("main"))
    split = by.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), outside.alias("outside")).where("outside > 0")
    by = table(join_hot(by, split, "bucket", "size", by.count(), "class").where("size IS NOT NULL"))
    total = by.count()
    needed = by.select(F.col("class").alias("doc_id")).distinct()
    # Rows with equal doc_id hold one sketch each; one of them speaks for the id
    own = signed.join(needed, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = texts.join(needed, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_listed, "doc_id long, n long, listed array<int>")
    facts = own.join(sets, "doc_id").select(
        F.col("doc_id").alias("class"), "n", "sketch", "listed", F.when(F.col("listed").isNull(), F.col("buckets")).alias("buckets")
    )
    rows = table(by.join(facts, "class"))
    main = (F.col("component") == F.col("main")).alias("in_main")
    own = ("class", "component", "n", "sketch", "listed", "buckets")
    # a bucket's comparisons are a grid of parts of its classes by parts of those outside, so that no task has a large bucket alone
    side, theirs = _parts("size", total, tasks(texts.sparkSession)), _parts("outside", total, tasks(texts.sparkSession))
    part = F.xxhash64("class")
    mine = rows.select("bucket", *own, main, F.pmod(part, side).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), theirs - 1)).alias("j"))
    out = rows.where("component <> main").select(
        "bucket", *[F.col(c).alias(f"_{c}") for c in own], F.explode(F.sequence(F.lit(0).cast("long"), side - 1)).alias("i"), F.pmod(part, theirs).alias("j")
    )
    words = (MINIMA + 63) // 64
    apart = F.lit(0)
    for w in range(words):
        any_bit = F.lit(0).cast("long")
        for j in range(PLANES):
            at = F.lit(j * words + w)
            any_bit = any_bit.bitwiseOR(F.get("sketch", at).bitwiseXOR(F.get("_sketch", at)))
        apart = apart + F.bit_count(any_bit)
    sizes = 100 * F.least("n", "_n") >= PERCENT * F.greatest("n", "_n")
    # both outside the main component: each such pair would come twice
    twice = (F.col("class") < F.col("_class")) | F.col("in_main")
    common = F.size(F.array_intersect("listed", "_listed")) + F.col("n") - F.size("listed")
    enough = (100 + PERCENT) * common >= PERCENT * (F.col("n") + F.col("_n"))
    equal = F.zip_with("buckets", "_buckets", lambda x, y: x == y)
    once = F.array_position(equal, True) == F.array_position("buckets", F.col("bucket"))
    unlisted, both = F.col("listed").isNull() | F.col("_listed").isNull(), F.col("listed").isNull() & F.col("_listed").isNull()
    fine = F.when(both, once).when(unlisted, F.lit(True)).otherwise(enough)
    pairs = mine.join(out, ["bucket", "i", "j"]).where((F.col("component") != F.col("_component")) & twice & sizes & (apart <= DIFFER) & fine)
    return table(pairs.select(F.least("class", "_class").alias("a"), F.greatest("class", "_class").alias("b")).distinct())


def _parts(rows: str, total: int, few: int) -> Column:
    """The root of how many tasks' shares a bucket's rows are, at least 1: 1 for buckets up to a share."""
    return F.greatest(F.lit(1), F.ceil(F.sqrt(F.col(rows) * few / max(1, total)))).cast("long")


def keep_near(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, that with the least doc_id; all columns as they were, whatever their names.
    Rows that share that doc_id all stay, and so do those without a doc_id."""
    (name,) = free(docs, "gone")
    gone = near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")
