"""Windows over keys that hold a large part of all rows: a hot key's sequence is cut into segments, each is one window, and
what one segment leaves to the next is carried over by a table of one row for each segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEG = "_seg"


def hot_keys(rows: DataFrame, keys: list[str], seq: str, few: int | None = None) -> DataFrame | None:
    """(keys, _cuts): keys with more than 1/few of all rows, by default a fourth of a task's share, with few - 1 splitters of
    their sequence, or None if there is no such key. Fewer than few keys can have that much, so that the result is small
    whatever the input. Runs two aggregations."""
    spark = rows.sparkSession
    few = few or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).persist()
    try:
        total = counts.agg(F.sum("_n")).first()[0] or 0
        found = counts.where(F.col("_n") * few > total).select(*keys)
        local = spark.createDataFrame(found.collect(), found.schema)  # fewer than few rows
    finally:
        counts.unpersist()
    if local.isEmpty():
        return None
    cuts = beside(rows, local, keys).where("_hot").groupBy(*keys)
    cuts = cuts.agg(F.percentile_approx(seq, [i / few for i in range(1, few)], 10 * few).alias("_cuts"))
    return spark.createDataFrame(cuts.collect(), cuts.schema)


def beside(rows: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of hot besides the keys, null keys being equal, and _hot. hot is a small table."""
    other = hot.select(*[F.col(k).alias(f"_hot_{i}") for i, k in enumerate(keys)], *[c for c in hot.columns if c not in keys], F.lit(True).alias("_hot"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_hot_{i}"))
    return rows.join(F.broadcast(other), same, "left").drop(*[f"_hot_{i}" for i in range(len(keys))])


def segmented(rows: DataFrame, hot: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """rows with _seg: of a hot key 1 and the number of its splitters below seq, of other keys 0. Equal places share a segment.

    The splitters are in order, so that a row is compared with the logarithm of their number, not with each of them: by
    steps of halved width. One expression with a variable, as columns made of each other are written out when a filter on
    the last is pushed below them.
    """
    most = max((r[0] for r in hot.select(F.size("_cuts")).collect()), default=0)
    widths = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, most.bit_length())))])
    below = F.aggregate(widths, F.lit(0), lambda at, width: at + F.when(F.get("_cuts", at + width - 1) < F.col(seq), width).otherwise(0))
    return beside(rows, hot, keys).withColumn(SEG, F.when(F.col("_hot"), below + 1).otherwise(0)).drop("_cuts", "_hot")


def along(keys: list[str]):
    """The segments of a key in order: one row each, fewer than few to a key."""
    return Window.partitionBy(*keys).orderBy(SEG)
