"""Sharding: contiguous runs of atomic groups with the least possible largest shard."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, join_hot, ordered, table

#: The driver looks at so many sums of the ordered groups at once; finer ones are fetched where a cut may fall.
POINTS = 1 << 15


class Ends:
    """Some of the ends (running sums) of the ordered groups, and between which neighbours no other lies."""

    def __init__(self, points: list[int], whole: set[int]):
        self.points, self.whole = points, whole  # whole: points behind which, up to the next point, no end is left out

    def below(self, x: int) -> tuple[int, int]:
        """Bounds of the largest end that is at most x."""
        i = bisect_right(self.points, x) - 1
        low = self.points[i]
        return low, low if low == x or low in self.whole else x

    def shards(self, capacity: int, n: int, high: bool) -> list[tuple[int, int]] | None:
        """Greedy cuts as (from the last cut plus capacity, cut) with all unknown ends as near as can be, or as far; None
        if n shards don't hold all."""
        at, out = 0, []
        for _ in range(n):
            want = min(at + capacity, self.points[-1])
            at = self.below(want)[1 if high else 0]
            out.append((want, at))
            if at == self.points[-1]:
                return out
        return None


def least_capacity(fetch, total: int, largest: int, n: int) -> tuple[int, list[int]]:
    """The smallest capacity under which greedy filling takes n shards at most, and the ends of balanced shards within it.

    fetch(intervals) gives, for disjoint (low, high], points of the ends there as (end, whole): some ends in order, the
    last one included, and whether none is left out between it and the one before. Binary search runs twice: with
    unknown ends as favourable as can be, and as unfavourable. Where the two differ, finer points are fetched.
    """
    if not total:
        return 0, [0] * n
    ends = Ends([0], set())
    intervals = [(0, total)]
    while True:
        points, whole = set(ends.points), set(ends.whole)
        for low, high, found in fetch(intervals):
            before = low
            for end, alone in found:
                if alone:
                    whole.add(before)
                else:
                    whole.discard(before)
                points.add(end)
                before = end
            if before < high:  # no end lies between the last one found and high
                whole.add(before)
        ends = Ends(sorted(points), whole)
        lo, hi = max(largest, -(-total // n)) - 1, total

        def least(high: bool, lo: int = lo, hi: int = hi) -> int:
            while hi - lo > 1:
                mid = (lo + hi) // 2
                if ends.shards(mid, n, high):
                    hi = mid
                else:
                    lo = mid
            return hi

        best, worst = least(True), least(False)
        if best == worst:
            exact = all(ends.below(w)[0] == ends.below(w)[1] for w, _ in ends.shards(worst, n, False))
            if exact:
                return worst, balanced(ends.points, n, worst)
        # a cut of any capacity in question lies between that of best, all unknown ends near, and that of worst
        intervals, a, z = [], 0, 0
        for _ in range(n):
            want_a, want_z = min(a + best, total), min(z + worst, total)
            a, far = ends.below(want_a)[0], ends.below(want_z)[1]
            i = bisect_left(ends.points, far)
            z = far
            intervals.append((a, ends.points[min(i, len(ends.points) - 1)]))
        merged: list[tuple[int, int]] = []
        for low, high in sorted(intervals):
            if low >= high:
                continue
            if merged and low <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
            else:
                merged.append((low, high))
        intervals = [
            (p, q)
            for low, high in merged
            for p, q in _open(ends, low, high)
        ]


def balanced(points: list[int], n: int, capacity: int) -> list[int]:
    """Ends of n shards of at most capacity, as near equal as the points, some of the ends in order from 0 on, allow.

    First the least level at which n shards are enough, where a step between points that is larger stands alone. Then the
    runs between such steps are divided evenly: each gets the shards it needs at that level, spare ones go where shards
    are largest, and every cut falls as near to an equal share of its run's rest as the level allows. Shards stay empty
    only if there are fewer steps than shards.
    """

    def runs(level: int) -> list[tuple[int, int, int]]:
        """First and last place among points, and shards needed, of every run without larger steps, and of these steps."""
        out, at, begin, need = [], 0, 0, 0
        while at < len(points) - 1:
            to = bisect_right(points, points[at] + level) - 1
            if to == at:
                if need:
                    out.append((begin, at, need))
                out.append((at, at + 1, 1))
                begin, need = at + 1, 0
                to = at + 1
            else:
                need += 1
            at = to
            if len(out) + need > n:  # too many already
                break
        return out + ([(begin, at, need)] if need else [])

    def fits(level: int) -> bool:
        got = runs(level)
        return (not got or got[-1][1] == len(points) - 1) and sum(x[2] for x in got) <= n

    low, level = 0, capacity
    while level - low > 1:
        mid = (low + level) // 2
        if fits(mid):
            level = mid
        else:
            low = mid
    parts = runs(level)
    shards = [need for _, _, need in parts]
    for _ in range(n - sum(shards)):
        able = [i for i, (a, z, _) in enumerate(parts) if shards[i] < z - a]
        if not able:
            break
        shards[max(able, key=lambda i: (points[parts[i][1]] - points[parts[i][0]]) / shards[i])] += 1
    out: list[int] = []
    for (a, z, _), m in zip(parts, shards, strict=True):
        if z - a == 1:
            out.append(points[z])
            continue
        least = [z]  # from behind: the first places from which 0, 1, ... shards hold the rest
        for _ in range(m - 1):
            least.append(max(a, bisect_left(points, points[least[-1]] - level)))
        for rest in range(m - 1, 0, -1):
            want = points[a] + (points[z] - points[a]) / (rest + 1)
            first, last = max(a + 1, least[rest]), min(z - rest, bisect_right(points, points[a] + level) - 1)
            k = min(max(bisect_left(points, want), first), last)
            if k > first and want - points[k - 1] <= points[k] - want:
                k -= 1
            out.append(points[k])
            a = k
        out.append(points[z])
    return out + [points[-1]] * (n - len(out))


def _open(ends: Ends, low: int, high: int) -> list[tuple[int, int]]:
    """The parts of (low, high] where ends may be left out."""
    i, j = bisect_left(ends.points, low), bisect_left(ends.points, high)
    out: list[tuple[int, int]] = []
    for p, q in zip(ends.points[i:j], ends.points[i + 1 : j + 1], strict=False):
        if p in ends.whole:
            continue
        if out and out[-1][1] == p:
            out[-1] = (out[-1][0], q)
        else:
            out.append((p, q))
    return out


def _fetch(groups: DataFrame, points: int):
    """Ends in intervals: each is divided evenly into bins, and each bin's first and last end are taken."""

    def fetch(intervals: list[tuple[int, int]]):
        bins = max(2, points // max(1, len(intervals)))
        lows = F.array(*[F.lit(a).cast("long") for a, _ in intervals])
        highs = F.array(*[F.lit(b).cast("long") for _, b in intervals])
        inside = groups.where(F.col("end") > intervals[0][0]).where(F.col("end") <= intervals[-1][1])
        k = F.size(F.filter(lows, lambda a: a < F.col("end")))
        placed = inside.withColumn("k", k).where("k > 0").withColumn("a", F.element_at(lows, F.col("k"))).withColumn("b", F.element_at(highs, F.col("k")))
        placed = placed.where(F.col("end") <= F.col("b"))
        bin_ = F.floor((F.col("end") - F.col("a") - 1).cast("decimal(38,0)") * bins / (F.col("b") - F.col("a")))
        rows = placed.groupBy("k", bin_.cast("long").alias("bin")).agg(F.min("end").alias("low"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n")).collect()
        by: dict[int, list] = {}
        for r in sorted(rows, key=lambda r: r["end"]):
            by.setdefault(r["k"], []).append((r["low"], True))
            if r["n"] > 1:
                by[r["k"]].append((r["end"], r["n"] == 2))
        return [(a, b, by.get(i + 1, [])) for i, (a, b) in enumerate(intervals)]

    return fetch


def shard(docs: DataFrame, n: int = 40, overhead: int = 16, points: int = POINTS) -> DataFrame:
    """Puts every document into one of n shards, equal texts together, the largest shard as small as can be.

    The groups of equal texts are ordered by their least doc_id. Returns doc_id, size (UTF-8 bytes of the text plus
    overhead), text_crc32, law ("bytes"), shard, slot (from 0 without gaps, groups in order, then by doc_id) and
    grown_shard (null: this law moves documents when the number of shards changes). A null text counts as empty: no
    bytes, CRC-32 0. A group larger than the others' shards fills one alone, and the rest is balanced over the others to
    within a bin of the points; shards stay empty only where groups are too few. Rows with equal doc_id
    are placed each; a null doc_id comes first. An empty table gives an empty result. Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key"),
    )
    own = table(own)
    # copies meet where they are read, then once for each text
    groups = own.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("first"))
    order = ordered(groups, ["first", "key"], {"begin_bytes": "bytes", "begin": "rows"})
    sums = order.withColumn("end", F.col("begin_bytes") + F.col("bytes"))
    top = sums.agg(F.max("end").alias("total"), F.max("bytes").alias("largest"), F.sum("rows").alias("rows")).first()
    _, cuts = least_capacity(_fetch(sums.select("end"), points), int(top["total"] or 0), int(top["largest"] or 0), n)
    where = F.size(F.filter(F.array(*[F.lit(int(c)).cast("long") for c in cuts[:-1]]), lambda c: c < F.col("end"))) if n > 1 else F.lit(0)
    placed = table(sums.select("key", "rows", "begin", where.cast("int").alias("shard")))
    # a row for each shard
    begins = placed.groupBy("shard").agg(F.min("begin").alias("shard_begin"))
    joined = join_hot(own, placed, "key", "rows", int(top["rows"] or 0), "doc_id")
    ranked = ordered(joined.select("doc_id", "size", "text_crc32", "shard", "begin"), ["begin", "doc_id"])
    drop(own)
    at = F.col("rank") - F.col("shard_begin")
    return ranked.join(F.broadcast(begins), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", at.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )

