"""What becomes of each change event when events are applied one after the other to a snapshot, as windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.operators.reconcile import expected_state

APPLIED, DUPLICATE, STALE, INVALID = "APPLIED", "DUPLICATE", "STALE", "INVALID"


def outcomes(events: DataFrame, keys: list[str], seq: str, event_id: str, order: list[str], valid: Column | None = None) -> DataFrame:
    """Adds outcome. order is that in which events come.

    INVALID events have no effect at all. Of valid ones with one event_id all but the first are DUPLICATE. The others are
    STALE unless their number is above 0, the snapshot's, and above those of all earlier ones of the key; a delete of an
    absent row counts like any other event.
    """
    fine = F.coalesce(F.lit(True) if valid is None else valid, F.lit(False))
    e = events.withColumn("_fine", fine)
    again = F.row_number().over(Window.partitionBy(event_id, "_fine").orderBy(*order)) > 1
    e = e.withColumn("_counts", F.col("_fine") & ~again)
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    top = F.coalesce(F.max(F.when(F.col("_counts"), F.col(seq))).over(before), F.lit(0))
    outcome = F.when(~F.col("_fine"), INVALID).when(~F.col("_counts"), DUPLICATE).when(F.coalesce(F.col(seq) <= F.greatest(top, F.lit(0)), F.lit(True)), STALE).otherwise(APPLIED)
    return e.withColumn("outcome", outcome).drop("_fine", "_counts")


def counters(told: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each value of by) with the number of events of each outcome."""
    return told.groupBy(*by).agg(*[F.count_if(F.col("outcome") == o).alias(o.lower()) for o in (APPLIED, DUPLICATE, STALE, INVALID)])


@dataclass
class Mutations:
    """A snapshot under the events applied to it; events have the snapshot's columns, seq, op and event_id."""

    snapshot: DataFrame
    events: DataFrame
    key: str
    order: tuple[str, ...]
    seq: str = "sequence_number"
    op: str = "operation"
    event_id: str = "event_id"
    valid: Column | None = None

    @property
    def told(self) -> DataFrame:
        return outcomes(self.events, [self.key], self.seq, self.event_id, list(self.order), self.valid)

    def records(self) -> DataFrame:
        """The table as it stands; an update without updated_at has the event's time there."""
        own = self.told.where(F.col("outcome") == APPLIED)
        if {"updated_at", "event_timestamp"} <= {*own.columns}:
            at = F.col("event_timestamp").cast(dict(self.snapshot.dtypes)["updated_at"])
            own = own.withColumn("updated_at", F.when(F.col(self.op) == "UPDATE", F.coalesce("updated_at", at)).otherwise(F.col("updated_at")))
        return expected_state(self.snapshot, own, self.key, self.seq, self.op)

    def record(self, key) -> dict | None:
        row = self.records().where(F.col(self.key) == F.lit(key)).first()
        return row.asDict() if row else None

    def row_count(self) -> int:
        return self.records().count()

    def counters(self) -> dict[str, int]:
        return counters(self.told).first().asDict()
