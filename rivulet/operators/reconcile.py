"""Expected state from events, and its comparison with a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconcile(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, mismatch, column): rows missing, unexpected, or different in a column, nulls being equal."""
    cols = [c for c in expected.columns if c != key]
    e = expected.select(F.col(key).alias("_e"), F.struct(*cols).alias("e"))
    a = actual.select(F.col(key).alias("_a"), F.struct(*cols).alias("a"))
    both = e.join(a, F.col("_e") == F.col("_a"), "full_outer")
    one = lambda kind, c=None: F.struct(F.lit(kind).alias("mismatch"), F.lit(c).cast("string").alias("column"))
    differ = F.array_compact(F.array(*[F.when(~F.col(f"e.{c}").eqNullSafe(F.col(f"a.{c}")), one("VALUE", c)) for c in cols]))
    kind = F.when(F.col("_a").isNull(), F.array(one("MISSING"))).when(F.col("_e").isNull(), F.array(one("UNEXPECTED"))).otherwise(differ)
    return both.select(F.coalesce("_e", "_a").alias(key), F.explode(kind).alias("m")).select(key, "m.mismatch", "m.column")


def _leaves(df: DataFrame, key: str, cols: list[str], leaves: int) -> DataFrame:
    """df with its leaf, which its key gives."""
    return df.select(*[F.col(c) for c in (key, *cols)], F.pmod(F.xxhash64(F.lit("leaf"), F.col(key).cast("string")), F.lit(leaves)).alias("_leaf"))


def digests(df: DataFrame, key: str, cols: list[str], leaves: int) -> DataFrame:
    """(_leaf, rows, sum, mixed): for each leaf a digest of its rows that no order of them changes. Two independent 64-bit
    hashes of a row: one is added up, the other combined by exclusive or, so that a pair of equal rows doesn't vanish."""
    flat = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (key, *cols)]
    null = [F.col(c).isNull() for c in (key, *cols)]
    own = _leaves(df, key, cols, leaves)
    return own.groupBy("_leaf").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*flat, *null).cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64(F.lit(1), *flat, *null)).alias("mixed"),
    )


def _differing(e: DataFrame, a: DataFrame) -> DataFrame:
    other = a.select(F.col("_leaf").alias("_l"), F.struct("rows", "sum", "mixed").alias("_a"))
    both = e.select("_leaf", F.struct("rows", "sum", "mixed").alias("_e")).join(other, F.col("_leaf") == F.col("_l"), "full_outer")
    return both.where(~F.col("_e").eqNullSafe(F.col("_a"))).select(F.coalesce("_leaf", "_l").alias("_leaf"))


def reconcile_hashed(expected: DataFrame, actual: DataFrame, key: str, leaves: int = 4096) -> DataFrame:
    """What reconcile() gives, for tables that are nearly the same: rows are told by digests of leaves first, and only those
    of leaves that differ are moved and compared.

    The digests cost one pass over each table and a shuffle of a row for each leaf and task. A leaf counts as the same if
    the number of its rows and both sums of 64-bit hashes agree; the hashes are no defence against rows that are made to
    collide. Values are hashed as text, so that both tables need the same types. A row that differs moves a leaf,
    1/leaves of the tables: with more differences than leaves all is moved, as by reconcile(). Rows without a key are
    told only if their leaf differs.
    """
    cols = [c for c in expected.columns if c != key]
    own = [df.select(key, *cols) for df in (expected, actual)]
    found = _differing(*[digests(df, key, cols, leaves) for df in own])
    # at most as many rows as leaves
    some = [_leaves(df, key, cols, leaves).join(F.broadcast(found), "_leaf", "left_semi").drop("_leaf") for df in own]
    return reconcile(*some, key)


def expected_state(snapshot: DataFrame, events: DataFrame, key: str, seq: str, op: str) -> DataFrame:
    """snapshot (sequence 0) under events with its columns, seq and op: per key the latest row, none if it is a DELETE.
    Of events with one event_id the first counts; those not above an earlier applied number have no effect, which the
    greatest number per key implies."""
    cols = snapshot.columns
    every = snapshot.withColumn(seq, F.lit(0).cast("long")).withColumn(op, F.lit("SNAPSHOT")).unionByName(events.select(*cols, seq, op))
    top = every.groupBy(key).agg(F.max_by(F.struct(*[c for c in cols if c != key], op), seq).alias("r"))
    return top.where(F.col(f"r.{op}") != "DELETE").select(*[F.col(key) if c == key else F.col(f"r.{c}").alias(c) for c in cols])


def row_counts(expected: dict[str, DataFrame], actual: dict[str, DataFrame]) -> DataFrame:
    """(table_name, expected, actual, matches): the rows of each table on both sides, in one plan."""
    one = lambda kind, tables: [df.select(F.lit(t).alias("table_name"), F.lit(kind).alias("side")) for t, df in tables.items()]
    every = reduce(DataFrame.unionByName, [*one("expected", expected), *one("actual", actual)])
    count = lambda side: F.count_if(F.col("side") == side).alias(side)
    found = every.groupBy("table_name").agg(count("expected"), count("actual"))
    names = sorted({*expected, *actual})
    all_ = every.sparkSession.createDataFrame([(t,) for t in names], "table_name string")
    out = all_.join(found, "table_name", "left").fillna(0, ["expected", "actual"])
    return out.withColumn("matches", F.col("expected") == F.col("actual"))


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    return child.where(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")
