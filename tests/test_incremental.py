"""State kept up to date batch by batch: what is read and written doesn't grow with history."""

import random

import pytest
from pyspark.sql import functions as F

from rivulet.functions import canonical
from rivulet.operators import cdf, merge, normalize, reconcile, scd
from rivulet.operators.ledger import Ledger, id_ranges
from rivulet.operators.segments import hot_keys, segmented
from rivulet.plans import incremental, queries
from rivulet.sources import staging, vtable
from rivulet.spec import FlowSpec
from rivulet.streaming.auto_cdc import AutoCdc

ROW = "event_id string, event_fingerprint string, entity_sequence_key string, table_name string, business_key_canonical string, sequence_number long, operation string, source_commit_timestamp string, processing_id string, source_file string"


def rows(spark, *ids, entity=lambda i: i % 5):
    return spark.createDataFrame([(str(i), f"f{i}", f"t:{entity(i)}", "t", str(entity(i)), i, "UPDATE", "", "p", "") for i in ids], ROW)


def test_ledger_reads_what_a_batch_can_meet(spark, tmp_path):
    book = Ledger(spark, str(tmp_path / "l"), id_ranges(100), buckets=2)
    book.ready()
    seen = []
    for b in range(12):
        batch = rows(spark, *range(100 * b, 100 * b + 100))
        seen.append((len(book.look(batch).inputFiles()), len(book.maxima(batch).inputFiles())))
        book.record(batch)
    assert len(book.applied.read().inputFiles()) >= 12
    assert {f for f, _ in seen} == {0} and len({h for _, h in seen[2:]}) == 1
    # copies of old events are found where they are
    late = rows(spark, 150, 1199, 1200)
    assert len(book.look(late).inputFiles()) <= 4
    got = {r["event_id"]: r["class"] for r in merge.classify(late, book.look(late), "q", book.maxima(late)).collect()}
    assert got == {"150": "EXACT_REPLAY_APPLIED", "1199": "EXACT_REPLAY_APPLIED", "1200": "FRESH"}
    other = late.withColumn("event_fingerprint", F.lit("else"))
    assert {r["class"] for r in merge.classify(other, book.look(other), "q", book.maxima(other)).collect()} == {"EVENT_CONFLICT", "FRESH"}


def test_ledger_after_crashes(spark, tmp_path):
    book = Ledger(spark, str(tmp_path / "l"), buckets=2)
    book.ready()
    batch = rows(spark, 1, 2, 3)
    book.open(batch)
    assert {r["status"] for r in book.read().collect()} == {"PENDING"} and book.maxima(batch).count() == 0
    # applied, but the crash came before the events were taken out of the pending ones and the numbers moved
    book.record(batch, advance=False)
    assert book.pending().count() == 0 and {r["status"] for r in book.read().collect()} == {"APPLIED"} and book.read().count() == 3
    book.ready()
    assert sorted(r["max_sequence"] for r in book.highs.read().collect()) == [1, 2, 3]
    v = book.highs.version()
    book.advance()
    assert book.highs.version() == v


def test_buckets_grow_with_their_rows(spark, tmp_path):
    book = Ledger(spark, str(tmp_path / "l"), buckets=1, most=40)
    book.ready()
    for b in range(4):
        book.record(rows(spark, *range(30 * b, 30 * b + 30), entity=lambda i: i))
    assert int(book.highs.properties()["buckets"]) >= 4 and book.highs.read().count() == 120
    assert book.highs.history()[0]["metrics"] == {"through": book.applied.version()}
    one = rows(spark, 7, entity=lambda i: i)
    assert {r["max_sequence"] for r in book.maxima(one).where("entity_sequence_key = 't:7'").collect()} == {7}


@pytest.mark.parametrize("ids", [["a", "7", "-3", "99999999999999999999"]])
def test_slots_of_any_id(spark, tmp_path, ids):
    book = Ledger(spark, str(tmp_path / "l"), id_ranges(10))
    book.ready()
    batch = rows(spark, 1, 2, 3, 4).withColumn("event_id", F.element_at(F.array(*map(F.lit, ids)), F.col("sequence_number").cast("int")))
    book.record(batch)
    assert {r["class"] for r in merge.classify(batch, book.look(batch), "q", book.maxima(batch)).collect()} == {"EXACT_REPLAY_APPLIED"}


def test_a_batch_is_many_files_and_no_pending_rows_cost_no_job(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        own = incremental._dealt(spark.range(4000).select("id", (F.col("id") % 20).cast("int").alias("part")), str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [len(list(p.glob("*.parquet"))) for p in (tmp_path / "in").glob("part=*")]
    assert len(files) == 20 and sum(files) > 40
    assert sorted(r["id"] for r in own.where("part = 3").collect()) == list(range(3, 4000, 20))
    book = Ledger(spark, str(tmp_path / "l"), id_ranges(100), buckets=2)
    book.ready()
    book.record(rows(spark, *range(100)))
    try:
        spark.sparkContext.setJobGroup("pending", "")
        assert book.opened.empty() and "Union" not in plan(book.pending())
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("pending")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert "Union" not in plan(book.look(rows(spark, 5))) and book.look(rows(spark, 5)).count() == 100
    book.open(rows(spark, 7, 250))
    assert not book.opened.empty() and {r["event_id"] for r in book.pending().collect()} == {"250"}


# ---- history ----

FLOW = FlowSpec("t", ("k",), scd_type=2, track_history=("a",))
EVENT = "k int, sequence_number long, operation string, a string, b int"


def versions(df):
    return sorted((tuple(r) for r in df.select("k", "a", "b", scd.START_AT, scd.END_AT).collect()), key=str)


def whole(spark, rows):
    e = spark.createDataFrame(rows, EVENT)
    return versions(scd.scd2(e, ["k"], "sequence_number", ["a", "b"], ["a"], F.col("operation") == "DELETE"))


@pytest.mark.parametrize("seed", range(3))
def test_history_of_late_events(spark, tmp_path, seed):
    rnd = random.Random(seed)
    rows = [(k, s, rnd.choice(["UPDATE", "UPDATE", "INSERT", "DELETE"]), rnd.choice(["x", "y", None]), rnd.randint(0, 9)) for k in range(60) for s in rnd.sample(range(60), rnd.randint(1, 25))]
    rnd.shuffle(rows)
    cdc = AutoCdc(spark, str(tmp_path), FLOW, ("a", "b"), buckets=2)
    for i in range(0, len(rows), len(rows) // 5 + 1):
        batch = rows[i : i + len(rows) // 5 + 1]
        cdc.apply(spark.createDataFrame(batch + batch[:3], EVENT))
        assert versions(cdc.result()) == whole(spark, rows[: i + len(batch)])


def test_history_leaves_other_buckets_and_survives_a_crash(spark, tmp_path, monkeypatch):
    cdc = AutoCdc(spark, str(tmp_path), FLOW, ("a", "b"), buckets=8)
    rows = [(k, s, "UPDATE", "xyz"[(k + s) % 3], s) for k in range(64) for s in range(0, 50, 10)]
    cdc.apply(spark.createDataFrame(rows, EVENT))
    before = cdc.table.log()["buckets"]
    late = [(3, 15, "UPDATE", "late", 1)]
    cdc.apply(spark.createDataFrame(late, EVENT))
    after = cdc.table.log()["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1
    more = [(3, 25, "DELETE", None, None), (5, 1, "UPDATE", "y", 2)]

    def crash(*_):
        raise RuntimeError

    with monkeypatch.context() as m:
        m.setattr(type(cdc.table), "append", crash)
        with pytest.raises(RuntimeError):
            cdc.apply(spark.createDataFrame(more, EVENT))
    cdc.apply(spark.createDataFrame(more, EVENT))
    v = cdc.table.version()
    cdc.apply(spark.createDataFrame(more, EVENT))
    assert v == cdc.table.version() and versions(cdc.result()) == whole(spark, rows + late + more)


def test_late_events_are_sorted_not_joined_with_stretches(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(k, s, rnd.choice(["UPDATE", "UPDATE", "DELETE"]), rnd.choice(["x", "y", None]), s) for k in range(40) for s in rnd.sample(range(99), 30)]
    e = spark.createDataFrame(rows, EVENT).withColumn("_deleted", F.col("operation") == "DELETE")
    known, fresh = e.where("sequence_number % 3 > 0"), e.where("sequence_number % 3 = 0 AND k < 30")
    h = scd.scd2(known, ["k"], "sequence_number", ["a", "b"], ["a"], F.col("_deleted"))
    want = whole(spark, [r for r in rows if r[1] % 3 or r[0] < 30])
    for few in (False, True):
        out = scd.splice(h, known, fresh, ["k"], "sequence_number", ["a", "b"], ["a"], "_deleted", few)
        assert versions(out) == want and ">=" not in plan(out)
        assert plan(out).count("Join") == (2 if few else 0)
    # a batch is written once and read from there, not held by executors; all its buckets are made anew from their events
    cdc = AutoCdc(spark, str(tmp_path), FLOW, ("a", "b"), buckets=2, few=10)
    rnd.shuffle(rows)
    for i in range(0, len(rows), 500):
        cdc.apply(spark.createDataFrame(rows[i : i + 500] + rows[:3], EVENT))
    assert versions(cdc.result()) == whole(spark, rows) and cdc.events.read().count() == len(rows)
    assert sum(len(dirs) for dirs in cdc.events.log()["buckets"].values()) <= 2 * (1 + len(rows) // 500)


@pytest.mark.parametrize("few", [0, 100_000])
def test_streamed_history_after_hydration(spark, tmp_path, few):
    early = [(k, 0, "SNAPSHOT", "x", k) for k in range(9)]
    late = [(k, s, "DELETE" if s % 5 == 0 else "UPDATE", "xyz"[s * k % 3], s) for k in range(12) for s in range(1, 20)]
    for name, own, files in (("hydration", early, 1), ("stream", late, 4)):
        spark.createDataFrame(own, EVENT).repartition(files, "sequence_number").write.parquet(f"{tmp_path}/{name}-in")
        source = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/{name}-in")
        flow = FlowSpec("t", ("k",), scd_type=2, track_history=("a",), name=name, once=name == "hydration")
        cdc = AutoCdc(spark, str(tmp_path), flow, ("a", "b"), buckets=2, few=few)
        cdc.run(source, f"{tmp_path}/checkpoint-{name}")
    assert versions(cdc.result()) == whole(spark, early + late) and cdc.events.read().count() == len(early + late)


def test_a_snapshot_is_one_batch_and_the_stream_two_of_many_files(spark, monkeypatch):
    seen, apply = [], AutoCdc.apply

    def told(self, batch, _id=None):
        seen.append((self.flow.name, batch._jdf.rdd().getNumPartitions()))
        apply(self, batch, _id)

    monkeypatch.setattr(AutoCdc, "apply", told)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cdc = queries._hydrated(spark, "/root/testdata/sf0.01", scd_type=2, track_history=("event_type",))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [name for name, _ in seen] == ["hydration", "stream", "stream"]
    assert min(n for _, n in seen) >= spark.sparkContext.defaultParallelism and cdc.result().count() == 5212
    empty = vtable.no_rows(spark, cdc.table.read().schema)
    assert plan(empty).startswith("LocalRelation <empty>") and empty.dtypes == cdc.table.read().dtypes
    assert "Join" not in plan(cdc.table.read().join(empty, "user_id", "left_anti"))


def test_half_a_stream_is_many_tasks(spark, monkeypatch):
    seen, apply = [], AutoCdc.apply

    def told(self, batch, _id=None):
        seen.append((batch.count(), batch._jdf.rdd().getNumPartitions()))
        apply(self, batch, _id)

    monkeypatch.setattr(AutoCdc, "apply", told)
    out = queries.stream_scd2(spark, "/root/testdata/sf0.01")
    assert len(seen) == 2 and sum(n for n, _ in seen) == 10_000 and min(n for n, _ in seen) > 4_000
    assert min(tasks for _, tasks in seen) >= spark.sparkContext.defaultParallelism and out.count() == 6399


# ---- hot keys ----


def test_hot_keys_are_shared_by_many_windows(spark):
    rnd = random.Random(1)
    rows = [(1 if i % 10 else rnd.choice([2, 3, None]), i, rnd.choice(["UPDATE", "UPDATE", "DELETE"]), rnd.choice("xyz"), i % 7) for i in range(4000)]
    e = spark.createDataFrame(rows, EVENT)
    hot = hot_keys(e, ["k"], "sequence_number")
    assert [r["k"] for r in hot.select("k").collect()] == [1] and hot_keys(e.where("k = 2"), ["k"], "sequence_number", few=1) is None
    sizes = [r["count"] for r in segmented(e, hot, ["k"], "sequence_number").groupBy("k", "_seg").count().collect()]
    assert len(sizes) >= 16 and max(sizes) < 2 * 4000 / 16
    args = (["k"], "sequence_number", ["a", "b"], ["a"], F.col("operation") == "DELETE")
    h = scd.scd2(e, *args, hot)
    assert versions(h) == versions(scd.scd2(e, *args))
    facts = e.select("k", F.col("sequence_number").alias("at"), "b").unionByName(spark.createDataFrame([(1, -5, 0), (1, 9999, 0)], "k int, at long, b int"))
    told = lambda x: sorted(map(str, scd.as_of(h, facts, ["k"], "at", x).collect()))
    assert told(hot) == told(None)


def test_one_event_in_a_segment_and_equal_places(spark):
    rows = [(1, i // 3, "UPDATE", "ab"[i % 2], i) for i in range(60)]
    e = spark.createDataFrame(rows, EVENT).dropDuplicates(["k", "sequence_number"])
    hot = hot_keys(e, ["k"], "sequence_number", few=40)
    args = (["k"], "sequence_number", ["a", "b"], ["a"], F.col("operation") == "DELETE")
    e = e.persist()
    assert versions(scd.scd2(e, *args, hot)) == versions(scd.scd2(e, *args))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_splitters_are_searched_not_listed(spark):
    cuts = [1, 1, 3, 5, 8, 8, 13]
    hot = spark.createDataFrame([(1, cuts)], "k int, _cuts array<long>")
    e = spark.createDataFrame([(k, i) for k in (1, 2) for i in [*range(-1, 16), None]], "k int, s long")
    out = segmented(e, hot, ["k"], "s")
    assert {(r["k"], r["s"], r["_seg"]) for r in out.collect()} == {(k, s, 0 if k == 2 else 1 + sum(c < s for c in cuts if s is not None)) for k, s in map(tuple, e.collect())}
    assert " filter(" not in plan(out)


def test_history_is_one_window_over_its_events(spark):
    e = spark.createDataFrame([(1, 1, "UPDATE", "x", 1), (None, 2, "UPDATE", "x", 1), (None, 3, "DELETE", "x", 1), (1, None, "UPDATE", "x", 0), (1, 4, "UPDATE", "x", 2)], EVENT)
    args = (["k"], "sequence_number", ["a", "b"], ["a"], F.col("operation") == "DELETE")
    h = scd.scd2(e, *args)
    assert "Join" not in plan(h) and "Aggregate" not in plan(h)
    assert versions(h) == [(1, "x", 2, 1, None), (None, "x", 1, 2, 3)]
    hot = spark.createDataFrame([(1, [1, 2, 3]), (None, [1, 2, 3])], "k int, _cuts array<long>")
    assert versions(scd.scd2(e, *args, hot)) == versions(h)


def test_events_are_kept_once_and_judged_by_many_tasks(spark):
    n = normalize.normalize(queries._raw(spark, "/root/testdata/sf0.001"), queries._SPEC)
    try:
        kept = n.kept[-1]._jdf.queryExecution()
        assert "InMemoryRelation" not in kept.analyzed().toString() and len(n.kept) == 1
        assert "RepartitionByExpression" in kept.optimizedPlan().toString() or "RepartitionByExpression" in kept.analyzed().toString()
    finally:
        n.release()


# ---- reconciliation, archive, staged folders ----


def test_reconciliation_moves_the_leaves_that_differ(spark):
    a = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"), F.when(F.col("id") % 7 > 0, F.lit("x")).alias("w"))
    b = a.where("k <> 11").withColumn("v", F.when(F.col("k").isin(5, 77), F.lit(None)).otherwise(F.col("v"))).withColumn("w", F.when(F.col("k") == 700, F.lit("")).otherwise(F.col("w")))
    b = b.unionByName(spark.createDataFrame([(-1, 0, None)], "k long, v long, w string"))
    told = lambda df: sorted(map(str, df.collect()))
    assert told(reconcile.reconcile_hashed(a, b, "k", 512)) == told(reconcile.reconcile(a, b, "k")) != []
    cols = ["v", "w"]
    found = reconcile._differing(*[reconcile.digests(x, "k", cols, 512) for x in (a, b)])
    assert found.count() == 5
    assert reconcile.reconcile_hashed(a, a.repartition(7), "k").count() == 0
    twice = a.unionByName(a.where("k = 3"))
    assert reconcile._differing(*[reconcile.digests(x, "k", cols, 512) for x in (a, twice)]).count() == 1


def test_archive_reads_the_ranges_of_its_input(spark, tmp_path):
    def feed(low, high):
        v = spark.range(low * 10, high * 10).select("id", F.lit("insert").alias("_change_type"), F.floor(F.col("id") / 10).alias("_commit_version"))
        return v.withColumn("_commit_timestamp", F.lit("2026-01-01").cast("timestamp"))

    a = cdf.Archive(spark, str(tmp_path), span=5)
    for low in range(0, 50, 5):
        assert a.write("t", "id", feed(max(0, low - 1), low + 5)) == 50
    assert a.read("t").count() == 500
    one = len(a.versions("t", 47, 48).inputFiles())
    assert one <= len(a.versions("t", 2, 3).inputFiles()) and 4 * one < len(a.read("t").inputFiles())
    assert a.versions("t", 47, 48).count() == 20 and a.write("t", "id", feed(0, 50)) == 0


def test_a_folder_is_old_or_new(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table=t" / "batch_id=b")
    write = lambda n: staging.replace(spark, path, spark.range(n).write.json)
    count = lambda: spark.read.schema("id long").json(staging.resolve(spark, path)).count()
    write(3)
    done = staging._rename

    def stop(at):
        calls = []

        def rename(*args):
            calls.append(args)
            if len(calls) > at:
                raise KeyboardInterrupt
            done(*args)

        return rename

    for at in (0, 1):
        with monkeypatch.context() as m:
            m.setattr(staging, "_rename", stop(at))
            with pytest.raises(KeyboardInterrupt):
                write(5)
        assert count() == 3
    with pytest.raises(ValueError):
        staging.replace(spark, path, spark.range(9).write.json, lambda _: (_ for _ in ()).throw(ValueError()))
    assert count() == 3
    write(5)
    assert count() == 5 and [p.name for p in (tmp_path / "table=t").iterdir()] == ["batch_id=b"]


def test_manifest_of_many_files(spark):
    files = spark.range(100_000).select(F.col("id").cast("string").alias("logical_id"), F.sha2(F.col("id").cast("string"), 256).alias("content_sha256"))
    ids = {canonical.manifest_digest_wide(x).first()["id"] for x in (files, files.orderBy(F.rand(1)), files.unionByName(files.limit(9)))}
    assert len(ids) == 1 != canonical.manifest_digest_wide(files.limit(99_999)).first()["id"]
