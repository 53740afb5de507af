"""State that is kept up to date batch by batch, over the driver's tables, each query with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rivulet.functions import canonical
from rivulet.operators import cdf, merge, normalize, reconcile, scd
from rivulet.operators.ledger import Ledger, id_ranges
from rivulet.operators.segments import hot_keys
from rivulet.plans.queries import _HISTORY, _SPEC, LOG, _raw, _scratch, deleted, log, query, read
from rivulet.sources.events import read_events
from rivulet.spec import FlowSpec
from rivulet.streaming.auto_cdc import AutoCdc

#: Sequence numbers that doubles can't tell apart.
_FAR = 1 << 53


@query(f"""SELECT event_id AS event, event_id + {_FAR} AS sequence_number FROM log WHERE event_id % 13 <> 0 AND event_id % 17 <> 0 AND event_id % 19 <> 0 AND event_id % 29 <> 0
  AND event_id % 31 <> 0 AND (op = 'INSERT' OR event_id % 41 <> 0) AND (op = 'DELETE' OR event_id % 23 <> 0)""", LOG)
def sequence_exact(spark, d):
    """Log positions beyond 2^53 stay what they are, and neighbours don't collide."""
    raw = _raw(spark, d).withColumn("sequence_json", (F.col("ingestion_order") + _FAR).cast("string"))
    return normalize.normalize(raw, _SPEC).accepted.select(F.col("event_id").cast("long").alias("event"), "sequence_number")


# ---- the ledger, batch by batch ----

BATCHES = 20


def _dealt(df, root):
    """df in folders by part, read again: each part in as many files as tasks can read at once, so that no batch is one task's."""
    n = df.sparkSession.sparkContext.defaultParallelism
    df.repartition("part", F.pmod(F.xxhash64(*[c for c in df.columns if c != "part"]), F.lit(n))).write.partitionBy("part").parquet(f"{root}/in")
    return df.sparkSession.read.schema(df.schema).parquet(f"{root}/in")


#: Events come in 20 batches by id: most in their own; some a batch late, which makes them stale if their user has newer ones;
#: and some again a batch later.
_ARRIVALS = f"""parts AS (SELECT *, event_id * {BATCHES} // (max(event_id) OVER () + 1) + CASE WHEN event_id % 7 = 3 THEN 1 ELSE 0 END AS part FROM log),
 arrivals AS (SELECT event_id, user_id, op, least(part, {BATCHES - 1}) AS part, false AS again FROM parts UNION ALL
   SELECT event_id, user_id, op, part + 1, true FROM parts WHERE event_id % 10 = 0 AND part < {BATCHES - 1}),
 tops AS (SELECT user_id, part, max(event_id) AS top FROM arrivals GROUP BY 1, 2),
 before AS (SELECT a.event_id, a.part, max(t.top) AS top FROM arrivals a LEFT JOIN tops t ON t.user_id = a.user_id AND t.part < a.part GROUP BY 1, 2),
 firsts AS (SELECT a.*, b.top, a.again OR b.top IS NULL OR b.top < a.event_id AS x FROM arrivals a JOIN before b ON b.event_id = a.event_id AND b.part = a.part),
 fresh AS (SELECT event_id FROM firsts WHERE NOT again AND (top IS NULL OR top < event_id))"""


def arrivals(spark, d):
    e = log(spark, d)
    last = e.agg(F.max("event_id")).first()[0] or 0
    part = F.floor(F.col("event_id") * BATCHES / (last + 1)).cast("int") + (F.col("event_id") % 7 == 3).cast("int")
    e = e.withColumn("part", part)
    again = e.where((F.col("event_id") % 10 == 0) & (F.col("part") < BATCHES - 1)).withColumn("part", F.col("part") + 1)
    every = e.withColumn("part", F.least("part", F.lit(BATCHES - 1))).unionByName(again)
    i = F.col("event_id")
    return last, every.select(
        i.cast("string").alias("event_id"), F.sha2("event_type", 256).alias("event_fingerprint"), F.concat(F.lit("users:"), F.col("user_id").cast("string")).alias("entity_sequence_key"),
        F.lit("users").alias("table_name"), F.col("user_id").cast("string").alias("business_key_canonical"), i.alias("sequence_number"), F.col("op").alias("operation"),
        F.col("ts").cast("string").alias("source_commit_timestamp"), F.col("batch").alias("source_file"), "part",
    )


@query("""SELECT CAST(a.part AS INT) AS part, CAST(a.event_id AS VARCHAR) AS event_id, CASE WHEN a.again AND a.event_id IN (SELECT event_id FROM fresh) THEN 'EXACT_REPLAY_APPLIED'
  WHEN a.top > a.event_id THEN 'STALE_SKIPPED' ELSE 'FRESH' END AS class FROM firsts a""", LOG, _ARRIVALS)
def ledger_incremental(spark, d):
    """What becomes of events in 20 batches, each judged by the slots and buckets that it can meet, then applied."""
    root = _scratch(spark)
    last, every = arrivals(spark, d)
    every = _dealt(every, root)
    book = Ledger(spark, f"{root}/ledger", id_ranges(max(1, (last + 1) // BATCHES)), buckets=4)
    book.ready()
    for part in range(BATCHES):
        own = every.where(F.col("part") == part)
        told = merge.classify(own, book.look(own), f"p{part}", book.maxima(own))
        told.write.parquet(f"{root}/told/part={part}")
        fresh = spark.read.schema(told.schema).parquet(f"{root}/told/part={part}").where("class = 'FRESH'").withColumn("processing_id", F.lit(f"p{part}"))
        book.record(fresh)
    return spark.read.parquet(f"{root}/told").select("part", "event_id", "class")


# ---- history, batch by batch ----


@query("SELECT user_id, event_type, value, start_at, end_at FROM history", LOG, _HISTORY, value=True)
def scd2_incremental(spark, d):
    """Eight batches in no order of time: each makes anew the versions of its keys."""
    root, e = _scratch(spark), log(spark, d)
    own = e.select("user_id", F.col("event_id").alias("sequence_number"), F.col("op").alias("operation"), "event_type", "value", F.pmod(F.xxhash64("event_id"), F.lit(8)).alias("part"))
    own = _dealt(own, root)
    cdc = AutoCdc(spark, root, FlowSpec("users", ("user_id",), scd_type=2, track_history=("event_type",)), ("event_type", "value"), buckets=4)
    for part in range(8):
        cdc.apply(own.where(F.col("part") == part).drop("part"))
    out = cdc.result()
    return out.withColumns({"start_at": F.col(scd.START_AT).cast("string"), "end_at": F.col(scd.END_AT).cast("string")}).drop(scd.START_AT, scd.END_AT)


# ---- keys that hold most rows ----

#: Nine events of ten are one user's.
_HOT = "hot AS (SELECT * REPLACE (CASE WHEN event_id % 10 = 0 THEN user_id ELSE 1 END AS user_id) FROM log)"


def _hot(spark, d):
    e = log(spark, d).withColumn("user_id", F.when(F.col("event_id") % 10 == 0, F.col("user_id")).otherwise(F.lit(1)))
    return e, hot_keys(e, ["user_id"], "event_id")


def _hot_history(e, hot):
    return scd.scd2(e, ["user_id"], "event_id", ["event_type", "value"], ["event_type"], deleted(), hot)


@query("SELECT user_id, event_type, value, start_at, end_at FROM history", LOG, _HOT, _HISTORY.replace("FROM log", "FROM hot"), value=True)
def scd2_hot_key(spark, d):
    out = _hot_history(*_hot(spark, d))
    return out.withColumns({"start_at": F.col(scd.START_AT).cast("string"), "end_at": F.col(scd.END_AT).cast("string")}).drop(scd.START_AT, scd.END_AT)


@query("""SELECT l.event_id, l.user_id, h.event_type, h.start_at FROM hot l LEFT JOIN history h ON h.user_id = l.user_id AND CAST(h.start_at AS BIGINT) <= l.event_id
  AND (h.end_at IS NULL OR l.event_id < CAST(h.end_at AS BIGINT))""", LOG, _HOT, _HISTORY.replace("FROM log", "FROM hot"))  # fmt: skip
def as_of_hot_key(spark, d):
    e, hot = _hot(spark, d)
    facts = e.select("event_id", "user_id")
    found = scd.as_of(_hot_history(e, hot), facts, ["user_id"], "event_id", hot)
    return found.select("event_id", "user_id", "event_type", F.col(scd.START_AT).cast("string").alias("start_at"))


# ---- lines of large files ----


@query("""SELECT 'part=' || CAST(part AS VARCHAR) AS part, CAST(line - 1 AS BIGINT) AS ingestion_order, CAST(event_id AS VARCHAR) AS event_id, line % 50 = 0 AS malformed FROM
  (SELECT event_id, event_id % 3 AS part, row_number() OVER (PARTITION BY event_id % 3 ORDER BY event_id) AS line FROM events)""")
def lines_in_splits(spark, d):
    """Three files of JSON lines, every fiftieth line broken: each line is known by file and number."""
    root = _scratch(spark)
    w = Window.partitionBy("part").orderBy("event_id")
    e = read(spark, d, "events").select("event_id", (F.col("event_id") % 3).alias("part"), "props")
    e = e.withColumn("line", F.row_number().over(w))
    text = F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id"), F.col("props").alias("payload")))
    own = e.select("part", "line", F.when(F.col("line") % 50 == 0, F.concat(text, F.lit("}"))).otherwise(text).alias("value"))
    own.repartition("part").sortWithinPartitions("part", "line").select("part", "value").write.partitionBy("part").text(f"{root}/in")
    out = read_events(spark, f"{root}/in/part=*")
    number = F.coalesce("event_id", F.regexp_extract("raw_record", '"event_id":"([0-9]+)"', 1))
    return out.select(F.regexp_extract("source_file", "(part=[0-9]+)", 1).alias("part"), "ingestion_order", number.alias("event_id"), "malformed")


# ---- tables that are nearly the same, archives of many versions ----


@query("""SELECT o_orderkey, 'VALUE' AS mismatch, 'o_totalprice' AS "column" FROM orders WHERE o_orderkey % 997 = 0 AND o_orderkey % 991 <> 0
  UNION ALL SELECT o_orderkey, 'MISSING', NULL FROM orders WHERE o_orderkey % 991 = 0 UNION ALL SELECT -o_orderkey, 'UNEXPECTED', NULL FROM orders WHERE o_orderkey % 1009 = 0 AND o_orderkey > 0""")
def reconcile_hashed(spark, d):
    """A thousandth of the rows differs: only their leaves are moved."""
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    k = F.col("o_orderkey")
    actual = o.where(k % 991 != 0).withColumn("o_totalprice", F.when(k % 997 == 0, F.lit(None)).otherwise(F.col("o_totalprice")))
    extra = o.where((k % 1009 == 0) & (k > 0)).withColumn("o_orderkey", -k)
    return reconcile.reconcile_hashed(o, actual.unionByName(extra), "o_orderkey")


@query("SELECT CAST(event_id % 50 AS BIGINT) AS version, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS sum_key FROM events GROUP BY 1")
def archive_versions(spark, d):
    """Events as the feed of 50 versions, archived in five writes, each with the last version of the one before again."""
    e = read(spark, d, "events").select("event_id", "event_type", F.lit("insert").alias("_change_type"), (F.col("event_id") % 50).alias("_commit_version"))
    feed = e.withColumn("_commit_timestamp", F.lit("2026-01-01 00:00:00").cast("timestamp"))
    a = cdf.Archive(spark, _scratch(spark), span=10)
    for low in range(0, 50, 10):
        a.write("events", "event_id", feed.where(F.col("_commit_version").between(max(0, low - 1), low + 9)))
    return a.read("events").groupBy(F.col("_commit_version").alias("version")).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("sum_key"))


@query("""SELECT 'procw_' || substr(sha256(string_agg(d, '|' ORDER BY g)), 1, 16) AS id FROM (SELECT substr(sha256(k), 1, 3) AS g, sha256(string_agg(k || ':' || h, '|' ORDER BY k || ':' || h)) AS d
  FROM (SELECT DISTINCT 'orders/' || CAST(o_orderkey AS VARCHAR) AS k, sha256(o_orderpriority) AS h FROM orders) GROUP BY 1)""")
def manifest_wide(spark, d):
    files = read(spark, d, "orders").select(F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")).alias("logical_id"), F.sha2("o_orderpriority", 256).alias("content_sha256"))
    return canonical.manifest_digest_wide(files)
