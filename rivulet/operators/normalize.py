"""At-least-once change events to ordered, unique ones: duplicates, conflicts, sequence collisions, late flags, quarantine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulet.functions.canonical import canonical_json, canonical_key, entity_key, event_fingerprint
from rivulet.operators.validate import sequence, validate_first
from rivulet.sources import staging
from rivulet.sources.events import logical_file_id, processing_id, read_events, write_normalized
from rivulet.spec import DOMAIN, TableSpec

#: The order in which accepted events apply: by entity, and in it by number.
AUTHORITATIVE = ("table_name", "business_key_canonical", "sequence_number", "event_id")
ARRIVAL = ("batch_id", "ingestion_batch_id", "source_file", "ingestion_order")


def classify_duplicates(df: DataFrame, event: str = "event_id", fingerprint: str = "event_fingerprint", arrival: tuple[str, ...] = ARRIVAL) -> DataFrame:
    """Adds duplicate_class: KEEP for the first arrival of an event, EXACT_DUPLICATE for its other copies, and CONFLICT for
    all copies of an event id with different contents."""
    w = Window.partitionBy(event)
    rank = F.row_number().over(w.orderBy(*arrival))
    differ = F.min(fingerprint).over(w) != F.max(fingerprint).over(w)
    return df.withColumn("duplicate_class", F.when(differ, "CONFLICT").when(rank == 1, "KEEP").otherwise("EXACT_DUPLICATE"))


def duplicate_counts(df: DataFrame) -> DataFrame:
    """One row of what classify_duplicates() has told: raw = accepted + duplicates + quarantined. One pass, no shuffle of rows."""
    n = lambda x, c: F.count_if(F.col("duplicate_class") == x).alias(c)
    return df.agg(F.count(F.lit(1)).alias("raw"), n("KEEP", "accepted"), n("EXACT_DUPLICATE", "duplicates"), n("CONFLICT", "quarantined"))


def positions(df: DataFrame, entity: tuple[str, ...] = AUTHORITATIVE[:2], order: tuple[str, ...] = AUTHORITATIVE[2:]) -> DataFrame:
    """Adds position, from 1: the place of each event among those of its entity, in the order in which they apply."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*entity).orderBy(*order)).cast("long"))


def flag_sequence_collisions(df: DataFrame, entity: str = "entity_sequence_key", seq: str = "sequence_number") -> DataFrame:
    """Adds sequence_conflict: another event of the entity has the same number."""
    return df.withColumn("sequence_conflict", F.count(F.lit(1)).over(Window.partitionBy(entity, seq)) > 1)


def late_boundaries(df: DataFrame, batch: str, stamp: str) -> DataFrame:
    """(batch, prior_max): the latest stamp of all batches that sort before, as texts; null for the first. The window runs
    over one row for each batch."""
    tops = df.groupBy(batch).agg(F.max(stamp).alias("_top"))
    w = Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)
    return tops.select(batch, F.max("_top").over(w).alias("prior_max"))


def flag_late(df: DataFrame, batch: str, stamp: str) -> DataFrame:
    """Adds is_late_arrival: the stamp lies before the latest one of earlier batches. AQE broadcasts the boundaries if they
    are few."""
    out = df.join(late_boundaries(df, batch, stamp).withColumnRenamed(batch, "_b"), F.col(batch) == F.col("_b"), "left")
    return out.withColumn("is_late_arrival", F.coalesce(F.col(stamp) < F.col("prior_max"), F.lit(False))).drop("_b", "prior_max")


@dataclass
class Normalized:
    accepted: DataFrame
    quarantined: DataFrame
    events: DataFrame
    kept: tuple[DataFrame, ...] = ()

    def metrics(self) -> dict:
        """Counts in one pass; raw = accepted + duplicates + quarantined."""
        n = lambda c, x: F.count_if(F.col(c) == x).alias(x)
        row = self.events.agg(
            F.count(F.lit(1)).alias("raw"), n("disposition", "ACCEPTED"), n("disposition", "DUPLICATE"), n("disposition", "QUARANTINED"),
            F.count_if(F.col("malformed")).alias("malformed"), F.count_if(F.col("quarantine_code") == "DUPLICATE_EVENT_CONFLICT").alias("conflicts"),
        ).first()
        out = {"raw": row["raw"], "accepted": row["ACCEPTED"], "duplicates": row["DUPLICATE"], "quarantined": row["QUARANTINED"], "malformed": row["malformed"], "conflicts": row["conflicts"]}
        return out | {"status": "SUCCESS_WITH_QUARANTINE" if row["QUARANTINED"] else "SUCCESS"}

    def release(self) -> None:
        """Frees what normalize() keeps for the branches."""
        for df in self.kept:
            df.unpersist()

    def sequences(self) -> DataFrame:
        return self.accepted.groupBy("table_name").agg(
            F.min("sequence_number").alias("min_sequence"), F.max("sequence_number").alias("max_sequence"), F.count(F.lit(1)).alias("events")
        )


def normalize(raw: DataFrame, specs: dict[str, TableSpec] = DOMAIN) -> Normalized:
    """raw as read_events() gives it. One event keeps its place through all steps; disposition says where it ends.

    Lower-case operations, which the lenient rules accept, are turned to upper case, so that they take effect.
    """
    v = validate_first(raw, specs)
    own = v.withColumns({
        "source_file": logical_file_id(F.col("source_file")),
        "operation": F.when(F.col("quarantine_code").isNull(), F.upper(F.trim("operation"))).otherwise(F.col("operation")),
        "sequence_number": F.when(F.col("quarantine_code").isNull(), sequence()),
        "business_key_canonical": canonical_key(F.col("business_key")),
    })
    own = own.withColumn("entity_sequence_key", entity_key(F.col("table_name"), F.col("business_key_canonical")))
    # kept: every branch below would parse and judge all lines again, and each rule would be planned many times over
    own = own.withColumn("event_fingerprint", event_fingerprint()).persist()
    valid, bad = own.where("quarantine_code IS NULL"), own.where("quarantine_code IS NOT NULL")
    valid = flag_late(valid.withColumn("_at", F.try_to_timestamp("event_timestamp")), "ingestion_batch_id", "_at").drop("_at")
    valid = classify_duplicates(valid)
    kept = flag_sequence_collisions(valid.where("duplicate_class = 'KEEP'"))
    rest = valid.where("duplicate_class <> 'KEEP'").withColumn("sequence_conflict", F.lit(False))
    every = kept.unionByName(rest).withColumns({
        "quarantine_code": F.when(F.col("duplicate_class") == "CONFLICT", "DUPLICATE_EVENT_CONFLICT").when(F.col("sequence_conflict"), "SEQUENCE_CONFLICT"),
        "quarantine_reason": F.when(F.col("duplicate_class") == "CONFLICT", "one event_id with different contents").when(F.col("sequence_conflict"), "one sequence_number for several events"),
    }).unionByName(bad, allowMissingColumns=True)
    every = every.withColumn(
        "disposition",
        F.when(F.col("quarantine_code").isNotNull(), "QUARANTINED").when(F.col("duplicate_class") == "EXACT_DUPLICATE", "DUPLICATE").otherwise("ACCEPTED"),
    )
    accepted = every.where("disposition = 'ACCEPTED'").select(
        "event_id", "event_fingerprint", "table_name", "operation", "business_key", "business_key_canonical", "entity_sequence_key", "sequence_number",
        "event_timestamp", "source_commit_timestamp", "batch_id", "source_system",
        canonical_json(F.col("payload_json")).alias("payload_json"), canonical_json(F.col("before_payload_json")).alias("before_payload_json"),
        "source_file", "ingestion_batch_id", "ingestion_order", "is_late_arrival",
    )
    for c in ("payload_json", "before_payload_json"):
        accepted = accepted.withColumn(c, F.nullif(c, F.lit("")))
    quarantined = every.where("disposition = 'QUARANTINED'").select(
        "quarantine_code", "quarantine_reason", "raw_record", "event_id", "table_name", "source_file", "batch_id"
    )
    return Normalized(accepted, quarantined, every, (own,))


def run(spark: SparkSession, paths: list[str], out: str, specs: dict[str, TableSpec] = DOMAIN) -> dict:
    """Reads, normalises and writes processing_id= folders under accepted and quarantine; a replay writes the same bytes."""
    processing = processing_id(spark, *paths)
    n = normalize(read_events(spark, *paths), specs)
    n.events.persist()
    try:
        metrics = n.metrics()
        if metrics["accepted"]:
            write_normalized(n.accepted, f"{out}/accepted", processing, *AUTHORITATIVE)
        if metrics["quarantined"]:
            q = n.quarantined.withColumn("_h", F.sha2("raw_record", 256))
            q = q.orderBy("table_name", "event_id", "quarantine_code", "_h", "source_file").drop("_h")
            staging.replace(spark, f"{out}/quarantine/processing_id={processing}", q.write.json)
    finally:
        n.events.unpersist()
        n.release()
    return metrics | {"processing_id": processing}
