"""Change feeds: from two states, into an idempotent archive, by checkpointed consumers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.errors import CDFNotEnabledError, CDFSourceNotFoundError
from rivulet.functions.canonical import change_id
from rivulet.operators.ledger import Slotted
from rivulet.sources.control import ControlStore
from rivulet.sources.vtable import CHANGE_COLUMNS, VersionedTable


def diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Change rows that lead from old to new: insert, delete, or the pair of images where a value differs."""
    cols = old.columns
    both = old.select(F.col(key).alias("_ok"), F.struct(*cols).alias("o")).join(
        new.select(F.col(key).alias("_nk"), F.struct(*cols).alias("n")), F.col("_ok") == F.col("_nk"), "full_outer"
    )
    one = lambda t, c: F.struct(F.lit(t).alias("t"), F.col(c).alias("r"))
    kind = (
        F.when(F.col("_ok").isNull(), F.array(one("insert", "n")))
        .when(F.col("_nk").isNull(), F.array(one("delete", "o")))
        .when(~F.col("o").eqNullSafe(F.col("n")), F.array(one("update_preimage", "o"), one("update_postimage", "n")))
    )
    return both.select(F.explode(kind).alias("c")).select("c.r.*", F.col("c.t").alias("_change_type"))


def with_change_id(changes: DataFrame, source: str, key: str) -> DataFrame:
    missing = {*CHANGE_COLUMNS} - {*changes.columns}
    if missing:
        raise CDFNotEnabledError(f"not a change feed, it lacks {sorted(missing)}")
    return changes.withColumn("_change_id", change_id(source, key, changes.columns)).withColumn("_source_table", F.lit(source))


def insert_absent(archive: DataFrame, rows: DataFrame, key: str = "_change_id") -> DataFrame:
    """Those of rows, one for each key, that the archive lacks."""
    return rows.dropDuplicates([key]).join(archive.select(key), key, "left_anti").select(*rows.columns)


@dataclass
class Archive:
    """Change rows by source and range of versions: rows with one _change_id have one version, so that a write looks for
    them in the ranges of its own versions alone, whatever else the archive holds."""

    spark: SparkSession
    root: str
    #: Versions in a range.
    span: int = 16

    def of(self, source: str) -> Slotted:
        span = self.span
        return Slotted(self.spark, f"{self.root}/{source}_changes", "_commit_version", lambda version: F.floor(version / span).cast("int"))

    def write(self, source: str, key: str, changes: DataFrame) -> int:
        """Appends what isn't there; returns the number of rows added."""
        rows, to = with_change_id(changes, source, key), self.of(source)
        if not to.exists():
            rows = rows.dropDuplicates(["_change_id"])
            to.create(rows)
            return to.read().count()
        base = to.version()
        touched = to.touched(rows)
        old = to.read(base, touched)
        new = insert_absent(old, rows).persist()
        try:
            if n := new.count():
                to.append(new, "ARCHIVE", base)
            return n
        finally:
            new.unpersist()

    def read(self, source: str) -> DataFrame:
        return self.of(source).read()

    def versions(self, source: str, start: int, end: int) -> DataFrame:
        """Archived rows of versions start to end, both included; only their ranges are read."""
        rows = self.of(source).read(buckets=list(range(start // self.span, end // self.span + 1)))
        return rows.where(F.col("_commit_version").between(start, end))


@dataclass
class Consumer:
    """Reads bounded version ranges of registered tables into the archive, then moves the checkpoint: what a crash repeats
    has no second effect."""

    store: ControlStore
    archive: Archive
    tables: dict[str, VersionedTable]

    def register(self, name: str, if_exists: str = "error") -> dict:
        """Turns the feed on if it is off; consumption starts with the version that did, or the current one."""
        if name not in self.tables or not self.tables[name].exists():
            raise CDFSourceNotFoundError(name)
        t = self.tables[name]
        if self.store.reader(name, missing_ok=True):
            return self.store.register(name, t.path, 0, if_exists)
        start = t.version() if t.feed_enabled else t.enable_feed()
        return self.store.register(name, t.path, start, if_exists)

    def consume(self, name: str, up_to: int | None = None, before_checkpoint: Callable[[], None] | None = None) -> dict:
        state, t = self.store.reader(name), self.tables[name]
        if not t.feed_enabled:
            raise CDFNotEnabledError(name)
        start, end = state["done_version"] + 1, min(t.version(), t.version() if up_to is None else up_to)
        if end < start:
            return {"source": name, "no_op": True, "start": start, "end": end, "archived": 0}
        changes = t.changes(start, end)
        n = 0 if changes.isEmpty() else self.archive.write(name, t.key, changes)
        if before_checkpoint:
            before_checkpoint()
        self.store.checkpoint(name, end)
        return {"source": name, "no_op": False, "start": start, "end": end, "archived": n}

    def consume_all(self) -> list[dict]:
        return [self.consume(s["feed"]) for s in self.store.readers()]

    def replay(self, name: str, start: int, end: int | None = None) -> DataFrame:
        self.store.reader(name)
        return self.tables[name].changes(start, end)
