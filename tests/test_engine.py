"""The change-data engine on small event files: validation, merge, recovery, feeds, cursors."""

import json
from dataclasses import replace
from pathlib import Path

import billing as generator
import pytest
from pyspark.sql import functions as F

from rivulet.errors import (
    AppliedEventConflictError, AppliedSequenceConflictError, CDFInvalidRangeError, CommitConflictError, MergeAmbiguityError, MergeError, PendingRecoveryError,
    TargetAlreadyInitializedError, WatermarkConcurrencyError, WatermarkExtractionError,
)
from rivulet.operators import cdf, merge, mutation, normalize, reconcile, validate, watermark
from rivulet.plans import flows
from rivulet.sources.control import ControlStore
from rivulet.sources.events import QUARANTINED, processing_id, read_events, read_events_strict, read_normalized
from rivulet.sources.vtable import VersionedTable
from rivulet.spec import DOMAIN, conform, project_events

STAMP = "2026-09-01T00:00:00Z"


def account(i, status="ACTIVE"):
    return {"account_id": f"ACC-{i:04d}", "account_name": f"n{i}", "industry": "x", "country": "DE", "status": status, "created_at": STAMP, "updated_at": STAMP}


def event(eid, op, i, seq, status="ACTIVE", batch="b1", at=STAMP, **more):
    image = account(i, status)
    return {
        "event_id": eid, "table_name": "accounts", "operation": op, "business_key": {"account_id": image["account_id"]}, "sequence_number": seq, "event_timestamp": at,
        "source_commit_timestamp": at, "batch_id": batch, "source_system": "crm", "payload": None if op == "DELETE" else image, "before_payload": None if op == "INSERT" else image,
    } | more


def land(tmp_path, name, *events):
    p = tmp_path / "landing" / f"batch_id={name}"
    p.mkdir(parents=True, exist_ok=True)
    (p / "accounts.jsonl").write_text("\n".join(e if isinstance(e, str) else json.dumps(e) for e in events) + "\n\n")
    return str(p / "accounts.jsonl")


def accepted(spark, path):
    n = normalize.normalize(read_events(spark, path))
    return spark.createDataFrame(n.accepted.collect(), merge.ACCEPTED)


def pipeline(spark, tmp_path, **kw):
    p = merge.MergePipeline(spark, str(tmp_path / "lake"), buckets=2, **kw)
    rows = [tuple(account(i).values()) for i in (1, 2, 3)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in account(1)))
    p.initialize({"accounts": conform(df, DOMAIN["accounts"])})
    return p


def test_normalize_codes_and_counts(spark, tmp_path):
    ok = [event("e1", "INSERT", 9, 1), event("e1", "INSERT", 9, 1), event("e2", "update", 1, "5"), event("e3", "UPDATE", 2, 7), event("e4", "UPDATE", 2, 7)]
    bad = [
        event(" ", "INSERT", 9, 1), event("q1", "INSERT", 9, 1, table_name=""), event("q2", "TRUNCATE", 9, 1), event("q3", "INSERT", 9, 1, business_key={}),
        event("q4", "INSERT", 9, -5), event("q5", "INSERT", 9, None), event("q6", "INSERT", 9, 1, payload=None), event("q7", "DELETE", 9, 1, before_payload=None),
        event("q8", "INSERT", 9, 1, payload=account(8)), event("q9", "INSERT", 9, 1, event_timestamp="soon"), "NOT JSON", "[1]",
    ]
    n = normalize.normalize(read_events(spark, land(tmp_path, "b1", *ok, *bad)))
    m = n.metrics()
    assert (m["raw"], m["accepted"], m["duplicates"], m["quarantined"]) == (17, 2, 1, 14) and m["status"] == "SUCCESS_WITH_QUARANTINE"
    codes = sorted(r["quarantine_code"] for r in n.quarantined.collect())
    assert codes == sorted(
        "MISSING_EVENT_ID UNKNOWN_TABLE UNSUPPORTED_OPERATION MISSING_BUSINESS_KEY INVALID_SEQUENCE MISSING_SEQUENCE MISSING_PAYLOAD MISSING_BEFORE_IMAGE"
        " BUSINESS_KEY_PAYLOAD_MISMATCH INVALID_EVENT_TIMESTAMP MALFORMED_JSON MALFORMED_JSON SEQUENCE_CONFLICT SEQUENCE_CONFLICT".split()
    )
    assert {r["event_id"]: r["operation"] for r in n.accepted.collect()} == {"e1": "INSERT", "e2": "UPDATE"}


def test_conflict_late_and_strict(spark, tmp_path):
    a = land(tmp_path, "b1", event("e1", "UPDATE", 1, 1, at="2026-09-05T00:00:00Z"), event("e2", "UPDATE", 2, 1))
    b = land(tmp_path, "b2", event("e2", "UPDATE", 2, 1, "TRIAL", batch="b2"), event("e3", "UPDATE", 3, 1, batch="b2"))
    n = normalize.normalize(read_events(spark, a, b))
    assert {r["event_id"]: r["is_late_arrival"] for r in n.accepted.collect()} == {"e1": False, "e3": True}
    assert [r["quarantine_code"] for r in n.quarantined.collect()] == ["DUPLICATE_EVENT_CONFLICT"] * 2
    assert processing_id(spark, a, b) == processing_id(spark, b, a) != processing_id(spark, a)
    with pytest.raises(Exception, match="malformed event"):
        read_events_strict(spark, land(tmp_path, "b3", "oops")).collect()
    strict = validate.validate_all(read_events(spark, land(tmp_path, "b4", event("e1", "insert", 1, "5"))))
    assert strict.first()["errors"] == ["operation is unsupported", "sequence_number must be a positive integer"]


def test_replay_writes_the_same_bytes(spark, tmp_path):
    path = land(tmp_path, "b1", event("e2", "UPDATE", 2, 2), event("e1", "INSERT", 9, 1), "bad")
    m = [normalize.run(spark, [path], str(tmp_path / out)) for out in ("x", "y")]
    assert m[0] == m[1]
    files = [sorted(p.read_bytes() for p in Path(tmp_path / out).rglob("part-*.json")) for out in ("x", "y")]
    assert files[0] == files[1] and any(files[0])


def test_merge_replay_stale_and_errors(spark, tmp_path):
    p = pipeline(spark, tmp_path)
    with pytest.raises(TargetAlreadyInitializedError):
        p.initialize({"accounts": p.read("accounts", metadata=False)})
    e = accepted(spark, land(tmp_path, "b1", event("e1", "INSERT", 9, 1), event("e2", "UPDATE", 1, 102, "TRIAL"), event("e3", "UPDATE", 1, 101, "OLD"), event("e4", "DELETE", 2, 3)))
    with pytest.raises(ValueError):
        p.run(e, "")
    r = p.run(e, "p1")
    assert (r["applied"], r["inserts"], r["updates"], r["deletes"], r["status"]) == (4, 1, 2, 1, "SUCCESS")
    rows = {x["account_id"]: x for x in p.read("accounts").collect()}
    assert set(rows) == {"ACC-0001", "ACC-0003", "ACC-0009"} and rows["ACC-0001"]["status"] == "TRIAL" and rows["ACC-0001"]["_last_sequence_number"] == 102
    v = p.target("accounts").version(), p.ledger.version()
    again = p.run(e, "p2")
    assert (again["applied"], again["skipped"], again["status"]) == (0, 4, "SUCCESS_WITH_SKIPS") and v == (p.target("accounts").version(), p.ledger.version())
    assert {x["processing_id"] for x in p.ledger.read().collect()} == {"p1"} and {x["status"] for x in p.ledger.read().collect()} == {"APPLIED"}
    assert p.run(accepted(spark, land(tmp_path, "b2", event("e5", "INSERT", 2, 2))), "p3")["stale"] == 1  # the ledger outlives the deleted row
    with pytest.raises(AppliedSequenceConflictError):
        p.run(accepted(spark, land(tmp_path, "b3", event("e6", "UPDATE", 1, 102))), "p4")
    with pytest.raises(AppliedEventConflictError):
        p.run(accepted(spark, land(tmp_path, "b4", event("e2", "UPDATE", 1, 102, "ELSE"))), "p5")
    twice = accepted(spark, land(tmp_path, "b5", event("e7", "UPDATE", 3, 9))).withColumn("event_id", F.explode(F.array(F.lit("x1"), F.lit("x2"))))
    with pytest.raises(MergeAmbiguityError):
        p.run(twice, "p6")
    with pytest.raises(MergeError):
        p.run_from_path("/nowhere")
    assert p.read("accounts", version=0).count() == 3 and p.target("accounts").history()[0]["operation"] == "MERGE"


@pytest.mark.parametrize("stop", ["fail_after_pending", "fail_after_target"])
@pytest.mark.parametrize("waves", [False, True])
def test_merge_recovery(spark, tmp_path, stop, waves):
    p = pipeline(spark, tmp_path, waves=waves)
    e = accepted(spark, land(tmp_path, "b1", event("e1", "INSERT", 9, 1), event("e2", "DELETE", 2, 1)))
    with pytest.raises(MergeError):
        p.run(e, "p1", **{stop: True})
    with pytest.raises(PendingRecoveryError):
        p.run(e, "other")
    with pytest.raises(PendingRecoveryError):
        p.run(e.where("event_id = 'e2'").limit(0), "p1")
    assert p.run(e, "p1")["recovered"] == 2
    assert {x["account_id"] for x in p.read("accounts").collect()} == {"ACC-0001", "ACC-0003", "ACC-0009"}
    assert {x["status"] for x in p.ledger.read().collect()} == {"APPLIED"}


def test_soft_delete_and_feed(spark, tmp_path):
    p = pipeline(spark, tmp_path, delete_policy=merge.SOFT)
    store = ControlStore(str(tmp_path / "control.db"))
    t = p.target("accounts")
    c = cdf.Consumer(store, cdf.Archive(spark, str(tmp_path / "archive")), {"accounts": t})
    assert c.register("accounts")["done_version"] == 0 and t.version() == 1
    p.run(accepted(spark, land(tmp_path, "b1", event("e1", "DELETE", 2, 1), event("e2", "DELETE", 77, 1), event("e3", "INSERT", 9, 1))), "p1")
    assert p.read("accounts", deleted=False).count() == 3 and p.read("accounts").where("_is_deleted").first()["account_name"] == "n2"
    kinds = sorted(r["_change_type"] for r in t.changes(2).collect())
    assert kinds == ["insert", "update_postimage", "update_preimage"]

    def crash():
        raise RuntimeError

    with pytest.raises(RuntimeError):
        c.consume("accounts", before_checkpoint=crash)
    got = c.consume("accounts")
    assert got["archived"] == 0 and not got["no_op"] and c.archive.read("accounts").count() == 3 and c.consume("accounts")["no_op"]
    p.run(accepted(spark, land(tmp_path, "b2", event("e4", "INSERT", 2, 2))), "p2")
    assert p.read("accounts", deleted=False).count() == 4 and c.consume_all()[0]["archived"] == 2 and c.replay("accounts", 2, 2).count() == 3
    for bad in (lambda: t.changes(3, 2).count(), lambda: store.checkpoint("accounts", 0)):
        with pytest.raises(CDFInvalidRangeError):
            bad()
    with pytest.raises(CommitConflictError):
        t.replace(t.read(0), [0, 1], "LATE", base=0)


def test_extraction(spark, tmp_path):
    rows = [tuple(account(i).values())[:-1] + (f"2026-09-0{1 + i // 3}T00:00:00Z",) for i in range(1, 6)]
    raw = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in account(1)))
    df = conform(raw, DOMAIN["accounts"])
    store = ControlStore(str(tmp_path / "control.db"))
    x = watermark.Extractor(store, str(tmp_path / "landing"), {"accounts": (df, "account_id")})
    with pytest.raises(WatermarkExtractionError):
        x.run("accounts", fail_before_commit=True)
    r = x.run("accounts")
    assert (r["status"], r["rows"], r["recovered"]) == ("SUCCESS", 5, True) and x.run("accounts")["status"] == "NO_DATA"
    more = df.unionByName(df.where("account_id = 'ACC-0005'").withColumn("account_id", F.lit("ACC-0006")))  # the same time, a larger key
    x.tables["accounts"] = (more, "account_id")
    assert x.run("accounts")["rows"] == 1 and store.cursor("accounts")["version"] == 3
    with pytest.raises(WatermarkConcurrencyError):
        store.advance("accounts", 1, ("x", "y"))
    with pytest.raises(WatermarkExtractionError):
        x.run("nope")
    assert {s["state"] for s in store.attempts("accounts")} == {"FAILED", "SUCCESS", "NO_DATA"}


def test_reconcile(spark):
    snap = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    events = spark.createDataFrame([(1, "z", 1, "UPDATE"), (2, None, 1, "DELETE"), (4, "n", 1, "INSERT")], "k int, v string, seq long, op string")
    want = reconcile.expected_state(snap, events, "k", "seq", "op")
    assert {tuple(r) for r in want.collect()} == {(1, "z"), (3, None), (4, "n")}
    assert {(r[0], r[1]) for r in reconcile.reconcile(want, snap, "k").collect()} == {(1, "VALUE"), (2, "UNEXPECTED"), (4, "MISSING")}


def test_domain_pipeline(spark, tmp_path):
    """Snapshot and accepted events through all ten flows; the same files again change nothing."""
    shot = generator.Snapshot(spark)
    shot.write(str(tmp_path / "snapshot"))
    generator.write_scenario(spark, generator.scenario(shot.dicts()), str(tmp_path / "landing"))
    m = normalize.run(spark, [str(tmp_path / "landing/batch_id=*/table=*")], str(tmp_path / "normalized"))
    assert (m["accepted"], m["duplicates"], m["quarantined"]) == (12, 1, 7)
    own = {"snapshot": "snapshot", "events": "normalized/accepted", "target": "lake", "checkpoints": "checkpoints"}
    p = flows.domain_pipeline(flows.Settings.from_env({f"RIVULET_{k.upper()}": str(tmp_path / v) for k, v in own.items()}))
    assert (len(p.targets), len(p.views), len(p.flows), sum(f.once for f in p.flows.values())) == (5, 8, 10, 5)
    assert flows.parse_flows("\n".join(map(flows.to_sql, p.flows.values()))) == [
        replace(f, properties={}, tombstone_retention_seconds=604_800, ignore_null_updates=False) for f in p.flows.values()
    ]
    for _ in range(2):
        assert set(p.run(spark).values()) == {0}
        assert {t: p.read(spark, f"{t}_current").count() for t in DOMAIN} == {"accounts": 41, "subscriptions": 61, "invoices": 121, "payments": 90}
    a = p.read(spark, "accounts_current").where("account_id = 'ACC-0002'").first()
    assert a["status"] == "TRIAL" and a["latest_event_id"] == "evt_upd_acc_0002_102"
    assert p.runner(spark, "accounts_continuous_cdc").table.properties()["tombstone_retention_seconds"] == "604800"
    assert p.read(spark, "subscriptions_history").where("subscription_id = 'SUB-0001'").count() == 2
    assert sum(p.run(spark, F.current_timestamp() + F.expr("INTERVAL 30 DAYS")).values()) == 1  # the deleted payment's
    with pytest.raises(ValueError):
        p.flow(p.flows["accounts_continuous_cdc"])


def test_scenario_against_events_one_by_one(spark, tmp_path):
    """The change scenario through normalisation and merge, against its events applied one after the other."""
    shot = generator.Snapshot(spark)
    generator.write_scenario(spark, generator.scenario(shot.dicts()), str(tmp_path / "landing"))
    n = normalize.normalize(read_events(spark, str(tmp_path / "landing/batch_id=*/table=*")))
    assert {r["disposition"]: r["count"] for r in n.events.groupBy("disposition").count().collect()} == {"ACCEPTED": 12, "DUPLICATE": 1, "QUARANTINED": 7}
    m = normalize.run(spark, [str(tmp_path / "landing/batch_id=*/table=*")], str(tmp_path / "normalized"))
    p = merge.MergePipeline(spark, str(tmp_path / "lake"), buckets=2)
    p.initialize(shot.tables())
    events = read_normalized(spark, str(tmp_path / "normalized/accepted"), merge.ACCEPTED, m["processing_id"])
    p.run(events, m["processing_id"])
    expected = {}
    for t, spec in DOMAIN.items():
        expected[t] = mutation.Mutations(conform(shot.tables()[t], spec), project_events(events, spec), spec.key, ("event_id",)).records()
    got = reconcile.row_counts(expected, {t: p.read(t, metadata=False) for t in DOMAIN}).collect()
    assert {r["table_name"]: (r["expected"], r["actual"]) for r in got} == {"accounts": (41, 41), "subscriptions": (61, 61), "invoices": (121, 121), "payments": (90, 90)}


def test_readers_and_ids(spark, tmp_path):
    assert read_normalized(spark, str(tmp_path / "none"), QUARANTINED, "p").count() == 0
    path = land(tmp_path, "b1", event("e1", "INSERT", 9, 1), "bad")
    m = normalize.run(spark, [path], str(tmp_path / "out"))
    assert read_normalized(spark, str(tmp_path / "out/quarantine"), QUARANTINED).first()["quarantine_code"] == "MALFORMED_JSON"
    assert read_normalized(spark, str(tmp_path / "out/accepted"), merge.ACCEPTED, m["processing_id"]).count() == 1
    assert processing_id(spark, "b", "a", "a") == processing_id(spark, "a", "b") != processing_id(spark, "a")
    with pytest.raises(WatermarkExtractionError):
        watermark.read_landed(spark, str(tmp_path / "nothing"), "a int")


def test_commits_are_whole_and_appends_add_files(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "k")
    t.create(spark.range(10).withColumnRenamed("id", "k"), 2)
    t.append(spark.range(10, 20).withColumnRenamed("id", "k"))
    assert t.read().count() == 20 and max(len(x) for x in t.log()["buckets"].values()) == 2
    t.compact()
    assert t.read().count() == 20 and {len(x) for x in t.log()["buckets"].values()} == {1} and t.read(1).count() == 20
    (tmp_path / "t/_log/.left-by-a-crash").write_text("")
    assert t.versions() == [0, 1, 2]
    with pytest.raises(CommitConflictError):
        t.append(spark.range(1).withColumnRenamed("id", "k"), base=0)


def test_mutations(spark):
    snap = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    rows = [("e1", 1, "x", 5, "UPDATE", 1), ("e1", 1, "y", 9, "UPDATE", 2), ("e2", 1, "z", 4, "UPDATE", 3), ("e3", 7, None, 3, "DELETE", 4), ("e4", 7, "n", 2, "INSERT", 5), ("e5", 2, None, -1, "DELETE", 6)]
    events = spark.createDataFrame(rows, "event_id string, k int, v string, sequence_number long, operation string, n int")
    m = mutation.Mutations(snap, events, "k", ("n",), valid=F.col("sequence_number") > 0)
    assert m.counters() == {"applied": 2, "duplicate": 1, "stale": 2, "invalid": 1}
    assert m.record(1)["v"] == "x" and m.record(7) is None and m.row_count() == 2
