"""Ledger-protected merge of change events into versioned tables; a replay changes nothing, a crash is taken up again."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rivulet.errors import AppliedEventConflictError, AppliedSequenceConflictError, MergeAmbiguityError, MergeError, PendingRecoveryError, TargetAlreadyInitializedError
from rivulet.operators.ledger import Ledger
from rivulet.sources.vtable import VersionedTable
from rivulet.spec import DOMAIN, LINEAGE, TableSpec, conform, project_events

HARD, SOFT = "HARD", "SOFT"


def max_applied(ledger: DataFrame) -> DataFrame:
    return ledger.where("status = 'APPLIED'").groupBy("entity_sequence_key").agg(F.max("sequence_number").alias("max_sequence"))


def classify(events: DataFrame, ledger: DataFrame, processing: str | Column, maxima: DataFrame | None = None) -> DataFrame:
    """Adds class: what the ledger makes of each event. Two joins for any number of events. ledger needs to hold the rows
    with the events' ids, maxima (entity_sequence_key, max_sequence) their entities; by default they come from ledger."""
    own = ledger.select("event_id", F.col("event_fingerprint").alias("_f"), F.col("status").alias("_s"), F.col("processing_id").alias("_p"))
    out = events.join(own, "event_id", "left").join(max_applied(ledger) if maxima is None else maxima, "entity_sequence_key", "left")
    mine = F.lit(processing) if isinstance(processing, str) else processing
    found = F.col("_s").isNotNull()
    kind = (
        F.when(found & (F.col("_f") != F.col("event_fingerprint")), "EVENT_CONFLICT")
        .when(F.col("_s") == "APPLIED", "EXACT_REPLAY_APPLIED")
        .when(found & (F.col("_p") != mine), "PENDING_FOREIGN")
        .when(found, "RECOVERY_PENDING")
        .when(F.col("sequence_number") < F.col("max_sequence"), "STALE_SKIPPED")
        .when(F.col("sequence_number") == F.col("max_sequence"), "SEQUENCE_CONFLICT")
        .otherwise("FRESH")
    )
    return out.withColumn("class", kind).drop("_f", "_s", "_p", "max_sequence")


def pending_problems(events: DataFrame, ledger: DataFrame, processing: str) -> DataFrame:
    """(event_id, problem) of pending ledger rows that this run may not take up."""
    pending = ledger.where("status = 'PENDING'")
    foreign = pending.where(F.col("processing_id") != processing).select("event_id", F.lit("FOREIGN_PROCESSING_ID").alias("problem"))
    missing = pending.join(events.select("event_id"), "event_id", "left_anti").select("event_id", F.lit("MISSING_FROM_INPUT").alias("problem"))
    other = events.select("event_id", F.col("event_fingerprint").alias("_f"))
    differs = pending.join(other, "event_id").where(F.col("_f") != F.col("event_fingerprint")).select("event_id", F.lit("FINGERPRINT_DIFFERS").alias("problem"))
    return foreign.unionByName(missing).unionByName(differs)


def wave_groups(events: DataFrame, key: str = "business_key_canonical") -> DataFrame:
    """(table_name, sequence_number, events, ambiguous): events that apply together; ambiguous if a key has several."""
    per = events.groupBy("table_name", "sequence_number", key).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("table_name", "sequence_number").agg(F.sum("n").alias("events"), (F.max("n") > 1).alias("ambiguous"))


def fold(events: DataFrame, keys: list[str], seq: str, op: str, columns: list[str], policy: str, last: tuple[str, ...] = ()) -> DataFrame:
    """One row a key: what applying its events in order leads to. Has last_op, has_upsert and, for each column, the image
    of the latest event (HARD) or of the latest that isn't a DELETE (SOFT); with last, a struct _l of these columns of the
    latest event."""
    image = F.struct(*columns)
    live = F.when(F.col(op) != "DELETE", F.col(seq))
    best = F.max_by(image, live) if policy == SOFT else F.max_by(image, F.col(seq))
    out = events.groupBy(*keys).agg(best.alias("_i"), F.max_by(op, seq).alias("last_op"), F.max(seq).alias("last_sequence"), F.count(live).alias("upserts"), *([F.max_by(F.struct(*last), seq).alias("_l")] if last else []))
    return out.select(*keys, *[F.col(f"_i.{c}").alias(c) for c in columns], "last_op", "last_sequence", (F.col("upserts") > 0).alias("has_upsert"), *(["_l"] if last else []))


def apply_changes(target: DataFrame, events: DataFrame, key: str, columns: list[str], policy: str) -> tuple[DataFrame, DataFrame]:
    """(new content, change rows) of target under typed events with their lineage columns; one full outer join.

    HARD deletes remove rows. SOFT deletes keep the business columns and mark the row; deleting an absent key does
    nothing. An upsert inserts or updates, whatever its operation says, and clears a mark.
    """
    images = [c for c in columns if c != key]
    folded = fold(events, [key], "_last_sequence_number", "_last_operation", images, policy, tuple(LINEAGE))
    source = folded.select(F.col(key).alias("_k"), F.struct(*images, "last_op", "has_upsert").alias("_n"), "_l")
    old = target.select(F.col(key).alias("_ok"), F.struct(*target.columns).alias("_o"))
    both = old.join(source, F.col("_ok") == F.col("_k"), "full_outer")
    had, hit, deleted = F.col("_o").isNotNull(), F.col("_n").isNotNull(), F.col("_n.last_op") == "DELETE"
    if policy == SOFT:
        gone = ~had & ~F.col("_n.has_upsert")
        use_new = F.col("_n.has_upsert")
    else:
        gone, use_new = deleted, F.lit(True)
    value = {key: F.coalesce("_k", "_ok")} | {c: F.when(use_new, F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}")) for c in images}
    new = [value[c].alias(c) for c in columns]
    marks = [F.col(f"_l.{c}").alias(c) for c in LINEAGE]
    image = F.struct(*new, *marks)
    after = F.when(~hit, F.col("_o")).when(gone, F.lit(None)).otherwise(image)
    staged = both.select(F.col("_o").alias("before"), after.alias("after"), hit.alias("hit"))
    content = staged.where("after IS NOT NULL").select("after.*")
    kind = (
        F.when(F.col("before").isNull() & F.col("after").isNotNull(), F.array(F.struct(F.lit("insert").alias("t"), F.col("after").alias("r"))))
        .when(F.col("before").isNotNull() & F.col("after").isNull(), F.array(F.struct(F.lit("delete").alias("t"), F.col("before").alias("r"))))
        .when(F.col("after").isNotNull(), F.array(F.struct(F.lit("update_preimage").alias("t"), F.col("before").alias("r")), F.struct(F.lit("update_postimage").alias("t"), F.col("after").alias("r"))))
    )
    rows = staged.where("hit").select(F.explode(kind).alias("c")).select("c.r.*", F.col("c.t").alias("_change_type"))
    return content, rows


@dataclass
class MergePipeline:
    """Applies accepted events to one versioned table for each spec, with a ledger of what was applied.

    Each group of events (all new ones of a table, or with waves=True those of one sequence number) goes through three
    commits: PENDING in the ledger, the target, APPLIED in the ledger. A run that stops between them is taken up by a run
    with the same processing id. Tables have no common transaction. A run reads the part of the ledger that its events
    can meet (see Ledger, and there what slot is for) and rewrites the targets' buckets of its keys; a target's buckets are
    doubled once they hold more than most rows each.
    """

    spark: SparkSession
    root: str
    specs: dict[str, TableSpec] = field(default_factory=lambda: dict(DOMAIN))
    delete_policy: str = HARD
    waves: bool = False
    buckets: int = 8
    slot: Callable[[Column], Column] | None = None
    most: int = 4_000_000

    def target(self, table: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.root}/{table}", self.specs[table].key)

    @property
    def ledger(self) -> Ledger:
        return Ledger(self.spark, f"{self.root}/_ledger", self.slot, self.buckets, self.most)

    def initialize(self, snapshot: dict[str, DataFrame], overwrite: bool = False) -> None:
        """Targets from a snapshot; all are looked at before the first is written."""
        if not overwrite:
            for t in snapshot:
                if self.target(t).exists():
                    raise TargetAlreadyInitializedError(t)
        for t, df in snapshot.items():
            first = {
                "_last_sequence_number": F.lit(0), "_last_event_id": F.lit("snapshot_init"), "_last_operation": F.lit("SNAPSHOT"),
                "_last_event_fingerprint": F.lit("snapshot_init"),
                "_last_source_commit_timestamp": F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
                "_last_processing_id": F.lit("snapshot_bootstrap"), "_is_deleted": F.lit(False), "_deleted_at": F.lit(None),
            }
            own = conform(df, self.specs[t])
            self.target(t).create(own.select("*", *[first[c].cast(k).alias(c) for c, k in LINEAGE.items()]), self.buckets, overwrite)
        self.ledger.ready()

    def read(self, table: str, metadata: bool = True, deleted: bool = True, version: int | None = None) -> DataFrame:
        df = self.target(table).read(version)
        df = df if deleted else df.where(~F.col("_is_deleted"))
        return df if metadata else df.drop(*LINEAGE)

    def run(self, events: DataFrame, processing: str, fail_after_pending: bool = False, fail_after_target: bool = False) -> dict:
        if not processing:
            raise ValueError("a processing id is required")
        ledger = self.ledger
        ledger.ready()
        if bad := pending_problems(events, ledger.pending(), processing).groupBy("problem").agg(F.min("event_id").alias("e")).collect():
            kinds = {r["problem"]: r["e"] for r in bad}
            if "FINGERPRINT_DIFFERS" in kinds and len(kinds) == 1:
                raise AppliedEventConflictError(str(kinds))
            raise PendingRecoveryError(str(kinds))
        told = classify(events, ledger.look(events), processing, ledger.maxima(events)).persist()
        try:
            counts = {(r["class"], r["operation"]): r["n"] for r in told.groupBy("class", "operation").agg(F.count(F.lit(1)).alias("n")).collect()}
            by = lambda k: sum(n for (c, _), n in counts.items() if c == k)
            for kind, error in (("EVENT_CONFLICT", AppliedEventConflictError), ("PENDING_FOREIGN", PendingRecoveryError), ("SEQUENCE_CONFLICT", AppliedSequenceConflictError)):
                if by(kind):
                    raise error(f"{by(kind)} events")
            todo = told.where(F.col("class").isin("FRESH", "RECOVERY_PENDING"))
            groups = wave_groups(todo)
            if groups.where("ambiguous").limit(1).count():
                raise MergeAmbiguityError("several events for one key and sequence number")
            if self.waves:
                names = [(r["table_name"], r["sequence_number"]) for r in groups.orderBy("table_name", "sequence_number").toLocalIterator()]
            else:
                names = [(r["table_name"], None) for r in groups.select("table_name").distinct().orderBy("table_name").collect()]
            for table, seq in names:
                own = todo.where(F.col("table_name") == table)
                self._apply(table, own if seq is None else own.where(F.col("sequence_number") == seq), processing, fail_after_pending, fail_after_target)
            ops = {o: sum(n for (c, x), n in counts.items() if x == o and c in ("FRESH", "RECOVERY_PENDING")) for o in ("INSERT", "UPDATE", "DELETE")}
            skipped = by("EXACT_REPLAY_APPLIED") + by("STALE_SKIPPED")
            return {
                "status": "SUCCESS_WITH_SKIPS" if skipped else "SUCCESS", "applied": sum(ops.values()), "inserts": ops["INSERT"], "updates": ops["UPDATE"],
                "deletes": ops["DELETE"], "replayed": by("EXACT_REPLAY_APPLIED"), "stale": by("STALE_SKIPPED"), "recovered": by("RECOVERY_PENDING"), "skipped": skipped,
            }
        finally:
            told.unpersist()

    def run_from_path(self, path: str, **kw) -> dict:
        """path is a processing_id= folder of accepted events, which names the run."""
        m = re.search(r"processing_id=([^/\\]+)", path)
        if not m:
            raise MergeError(f"no processing id in {path}")
        events = self.spark.read.schema(ACCEPTED).json(path)
        return self.run(events, m[1], **kw)

    def _apply(self, table: str, events: DataFrame, processing: str, stop_pending: bool, stop_target: bool) -> None:
        own = events.withColumn("processing_id", F.lit(processing))
        new = own.where("class = 'FRESH'")
        if not new.isEmpty():
            self.ledger.open(new)
        if stop_pending:
            raise MergeError("stopped after the pending commit")
        spec, to = self.specs[table], self.target(table)
        typed = project_events(events, spec).withColumns({
            "_last_sequence_number": F.col("sequence_number"), "_last_event_id": F.col("event_id"), "_last_operation": F.col("operation"),
            "_last_event_fingerprint": F.col("event_fingerprint"), "_last_source_commit_timestamp": F.col("source_commit_timestamp"),
            "_last_processing_id": F.lit(processing), "_is_deleted": F.col("operation") == "DELETE",
            "_deleted_at": F.when(F.col("operation") == "DELETE", F.col("source_commit_timestamp")),
        }).select(*spec.columns, *LINEAGE)
        base, touched = to.version(), to.touched(typed)
        content, rows = apply_changes(to.read(base, touched), typed, spec.key, list(spec.columns), self.delete_policy)
        seen = Observation()
        to.replace(content.observe(seen, F.count(F.lit(1)).alias("n")), touched, "MERGE", rows, base=base)
        if seen.get["n"] > self.most * len(touched):
            to.rebucket(2 * int(to.properties()["buckets"]))
        if stop_target:
            raise MergeError("stopped after the target commit")
        self.ledger.close(own)


ACCEPTED = (
    "event_id string, event_fingerprint string, table_name string, operation string, business_key map<string,string>, business_key_canonical string,"
    " entity_sequence_key string, sequence_number long, event_timestamp string, source_commit_timestamp string, batch_id string, source_system string,"
    " payload_json string, before_payload_json string, source_file string, ingestion_batch_id string, ingestion_order long, is_late_arrival boolean"
)
