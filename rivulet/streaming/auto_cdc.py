"""Declarative change flows run by Structured Streaming into versioned tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulet.operators import scd
from rivulet.sources.vtable import VersionedTable, no_rows
from rivulet.spec import FlowSpec


@dataclass
class AutoCdc:
    """Keeps the target of a flow up to date. columns are those stored besides the keys.

    SCD 1 targets hold tombstones (_deleted, with the time they came) and the sequence of each key; purge() drops those
    older than the flow's retention. SCD 2 targets hold the versions, and beside them a table of the events they are made of:
    a batch makes anew the versions of its keys (of their buckets, if it has more than few events), and rewrites the buckets of
    its keys alone. A batch that is repeated after a crash has no second effect, as equal sequences
    lose to what is stored. Several flows may have one target, first the one that runs once.
    """

    spark: SparkSession
    root: str
    flow: FlowSpec
    columns: tuple[str, ...]
    buckets: int = 8
    #: Events of a batch up to which its keys are broadcast.
    few: int = 100_000

    @property
    def table(self) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.root}/{self.flow.target}", self.flow.keys[0])

    @property
    def events(self) -> VersionedTable:
        """What an SCD 2 target's versions are made of."""
        return VersionedTable(self.spark, f"{self.root}/{self.flow.target}__events", self.flow.keys[0])

    def _history(self, events: DataFrame) -> DataFrame:
        f = self.flow
        return scd.scd2(events, list(f.keys), f.sequence_by, list(self.columns), list(f.track_history or self.columns), F.col("_deleted"))

    def _stored(self, like: DataFrame) -> DataFrame:
        deleted = F.coalesce(F.expr(self.flow.delete_when), F.lit(False))
        at = [F.when(deleted, F.current_timestamp()).alias("_deleted_at")] if self.flow.scd_type == 1 else []
        return like.select(*self.flow.keys, *self.columns, *at, F.col(self.flow.sequence_by), deleted.alias("_deleted"))

    def create(self, like: DataFrame) -> None:
        """Registers the target with the flow's properties, empty, if it isn't there."""
        f = self.flow
        if not self.table.exists():
            props = {"tombstone_retention_seconds": str(f.tombstone_retention_seconds), **f.properties}
            own = self._stored(like.limit(0))
            if f.scd_type == 2 and not self.events.exists():
                self.events.create(own, self.buckets)
            self.table.create(own if f.scd_type == 1 else self._history(own), self.buckets, properties=props)

    def apply(self, batch: DataFrame, _id: int | None = None) -> None:
        f, t = self.flow, self.table
        own = self._stored(batch.where(" AND ".join(f"{k} IS NOT NULL" for k in (*f.keys, f.sequence_by))))
        if not t.exists():
            self.create(no_rows(batch.sparkSession, batch.schema))
        base, touched = t.version(), t.touched(own)
        if not touched:
            return
        if f.scd_type == 1:
            old = t.read(base, touched)
            new = scd.scd1_merge(old, own, list(f.keys), f.sequence_by, [*self.columns, "_deleted_at"], F.col("_deleted"), f.ignore_null_updates)
            new = new.withColumn("_deleted_at", F.when(F.col("_deleted"), F.col("_deleted_at")))
            t.replace(new.select(*old.columns), touched, "AUTO CDC", base=base)
        else:
            self._splice(own, touched, base)

    def _splice(self, own: DataFrame, touched: list[int], base: int) -> None:
        """The versions first, then the events: a batch that is repeated after a crash between finds its events missing,
        and making the same versions again changes nothing."""
        f, t, at = self.flow, self.table, self.events.version()
        known, keys = self.events.read(at, touched), [*f.keys, f.sequence_by]
        one = F.row_number().over(Window.partitionBy(*keys).orderBy(f.sequence_by))  # sorted once, as the join needs it
        fresh = own.withColumn("_n", one).where("_n = 1").join(known.select(*keys), keys, "left_anti").select(*known.columns)
        files, fresh = self.events.stage(fresh, at)
        if not files:
            return
        met, track = sorted(map(int, files)), list(f.track_history or self.columns)
        new = scd.splice(t.read(base, met), self.events.read(at, met), fresh, list(f.keys), f.sequence_by, list(self.columns), track, "_deleted", fresh.count() <= self.few)
        t.replace(new, met, "AUTO CDC", base=base)
        self.events.append(fresh, "AUTO CDC", at, files)

    def purge(self, now: Column | None = None) -> int:
        """Drops the tombstones that are older than the target's retention at now; returns how many. A late event of such
        a key counts as new from then on."""
        t = self.table
        if self.flow.scd_type != 1:
            return 0
        seconds, base = int(t.properties()["tombstone_retention_seconds"]), t.version()
        before = (F.current_timestamp() if now is None else now) - F.make_dt_interval(secs=F.lit(seconds))
        gone = t.read(base).where(F.col("_deleted") & (F.col("_deleted_at") < before))
        if n := gone.count():
            touched = t.touched(gone)
            t.replace(scd.purge_tombstones(t.read(base, touched), "_deleted_at", before), touched, "PURGE", base=base)
        return n

    def result(self) -> DataFrame:
        f, out = self.flow, self.table.read()
        if f.scd_type == 1:
            out = out.where(~F.col("_deleted")).drop("_deleted", "_deleted_at")
        return out.drop(*[c for c in f.except_columns if c in out.columns])

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Processes what is there and stops. A flow that runs once is marked when it has, and then does nothing."""
        f = self.flow
        if f.once and self.table.exists() and self.table.properties().get(f"done.{f.name}") == "true":
            return
        self.create(no_rows(self.spark, stream.schema))
        q = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        if f.once:
            self.table.set_properties({f"done.{f.name}": "true"})


def snapshot_events(snapshot: DataFrame) -> DataFrame:
    """Rows of a snapshot as change events before all others."""
    return snapshot.withColumn("operation", F.lit("SNAPSHOT")).withColumn("sequence_number", F.lit(0).cast("long"))
