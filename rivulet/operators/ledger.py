"""The ledger of applied events, kept so that a run reads what its own events can meet, not all history.

Three tables: applied events, appended to and never rewritten, in slots of event ids; the pending ones of the run under
way; the greatest applied sequence number of each entity, brought up to date from what was appended since.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rivulet.sources.vtable import VersionedTable

ROW = (
    "event_id string, event_fingerprint string, entity_sequence_key string, table_name string, business_key_canonical string, sequence_number long,"
    " operation string, source_commit_timestamp string, processing_id string, source_file string, status string"
)
HIGH = "entity_sequence_key string, max_sequence long"


def id_ranges(width: int) -> Callable[[Column], Column]:
    """Slots for ids that are numbers and grow with time (log positions, snowflake ids): ids of one stretch of width share
    a slot. Ids that aren't numbers share one more."""
    return lambda c: F.coalesce(F.floor(c.try_cast("decimal(38,0)") / width).try_cast("int"), F.lit(-1))


@dataclass
class Slotted(VersionedTable):
    """A versioned table in slots that an expression of the key gives, instead of a fixed number of hash buckets."""

    slot: Callable[[Column], Column] | None = None

    def bucket(self, n: int) -> Column:
        return super().bucket(n) if self.slot is None else self.slot(F.col(self.key))


@dataclass
class Ledger:
    """slot maps an event id to an integer. A run reads the slots of its events' ids: with ids that grow with time, as
    id_ranges() takes them, these are the newest and those that late copies point to, whatever the age of the ledger. Without
    one, ids are hashed to buckets, and a large batch meets them all. One id always has one slot, so that no copy and no
    conflict is missed.

    Events are pending from open() to close(). close() appends them as applied, then takes them out of the pending ones and
    brings the greatest numbers up to date. A crash after the first step leaves what ready() puts right: applied rows
    outweigh pending ones, and the numbers know up to which version of the applied events they go.
    """

    spark: SparkSession
    root: str
    slot: Callable[[Column], Column] | None = None
    buckets: int = 8
    #: Entities in a bucket of the greatest numbers, on average, from which the buckets are doubled.
    most: int = 4_000_000

    @property
    def applied(self) -> Slotted:
        return Slotted(self.spark, self.root, "event_id", self.slot)

    @property
    def opened(self) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.root}_open", "event_id")

    @property
    def highs(self) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.root}_high", "entity_sequence_key")

    def ready(self) -> None:
        """Creates the tables where they are missing and takes up what a crash has left."""
        for t, schema in ((self.applied, ROW), (self.opened, ROW), (self.highs, HIGH)):
            if not t.exists():
                t.create(self.spark.createDataFrame([], schema), self.buckets)
        self.advance()

    def version(self) -> tuple[int, int]:
        return self.applied.version(), self.opened.version()

    def read(self) -> DataFrame:
        """All rows, applied and pending: for people and tests, not for runs."""
        return self.applied.read().unionByName(self.pending())

    def pending(self) -> DataFrame:
        """Rows of a run that hasn't ended."""
        rows = self.opened.read()
        if self.opened.empty():
            return rows
        slots = self.applied.touched(rows)
        return rows.join(self.applied.read(buckets=slots).select("event_id"), "event_id", "left_anti").select(*rows.columns) if slots else rows

    def look(self, events: DataFrame) -> DataFrame:
        """Rows that events can meet by their id: those of its slots, and the pending ones."""
        rows = self.applied.read(buckets=self.applied.touched(events))
        return rows if self.opened.empty() else rows.unionByName(self.pending())

    def maxima(self, events: DataFrame) -> DataFrame:
        """(entity_sequence_key, max_sequence) of the buckets of events' entities."""
        return self.highs.read(buckets=self.highs.touched(events))

    def open(self, events: DataFrame) -> None:
        self.opened.append(_rows(events, "PENDING"), "PENDING")

    def close(self, events: DataFrame) -> None:
        """events become applied in one commit."""
        self.record(events, advance=False)
        base, t = self.opened.version(), self.opened
        touched = t.touched(events)
        rest = t.read(base, touched).join(events.select("event_id"), "event_id", "left_anti")
        t.replace(rest.select(*[c.split()[0] for c in ROW.split(", ")]), touched, "CLOSE", base=base)
        self.advance()

    def record(self, events: DataFrame, advance: bool = True) -> None:
        """Events that were never pending become applied."""
        self.applied.append(_rows(events, "APPLIED"), "APPLIED")
        if advance:
            self.advance()

    def advance(self) -> None:
        """Takes the applied rows that came since into the greatest numbers: reads those rows, rewrites the buckets of their
        entities. Doing it twice changes nothing."""
        now, t = self.applied.version(), self.highs
        old = t.log()
        through = int(old["metrics"].get("through", -1))
        if through >= now:
            return
        known = {d for dirs in self.applied.log(through)["buckets"].values() for d in dirs} if through >= 0 else set()
        new = [d for dirs in self.applied.log(now)["buckets"].values() for d in dirs if d not in known]
        if not new:
            return
        tops = self.spark.read.schema(ROW).parquet(*new).groupBy("entity_sequence_key").agg(F.max("sequence_number").alias("max_sequence"))
        touched, seen = t.touched(tops), Observation()
        both = t.read(old["version"], touched).unionByName(tops).groupBy("entity_sequence_key").agg(F.max("max_sequence").alias("max_sequence"))
        t.replace(both.observe(seen, F.count(F.lit(1)).alias("n")), touched, "ADVANCE", metrics={"through": now}, base=old["version"])
        if seen.get["n"] > self.most * len(touched):
            t.rebucket(2 * int(t.properties()["buckets"]))


def _rows(events: DataFrame, status: str) -> DataFrame:
    return events.withColumn("status", F.lit(status)).select(*[c.split()[0] for c in ROW.split(", ")])
