"""The engine's operators over the driver's tables, each with its SQL.

events is read as a change log: key user_id, sequence event_id, signup an INSERT, error a DELETE, all else an UPDATE, dealt
to seven ingestion batches by event_id.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions import canonical
from rivulet.operators import cdf, merge, mutation, normalize, reconcile, scd, validate, watermark
from rivulet.sources.vtable import VersionedTable
from rivulet.spec import FlowSpec, TableSpec
from rivulet.streaming.auto_cdc import AutoCdc, snapshot_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

LOG = """log AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS op,
  event_type, CAST(value AS DECIMAL(18,2)) AS value, props, ts, 'batch_' || CAST(event_id % 7 AS VARCHAR) AS batch FROM events)"""


def query(sql: str, *ctes: str, value: bool = False):
    """Registers a query; value: it returns that column, as a double for comparison."""
    if value:
        sql = f"SELECT * REPLACE (CAST(value AS DOUBLE) AS value) FROM ({sql})"

    def add(f):
        name = f.__name__
        QUERIES[name] = (lambda spark, d: f(spark, d).withColumn("value", F.col("value").cast("double"))) if value else f
        ORACLE_SQL[name] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def log(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("event_type") == "signup", "INSERT").when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE")
    return read(spark, d, "events").select(
        "user_id", "event_id", op.alias("op"), "event_type", F.col("value").cast("decimal(18,2)").alias("value"), "props", "ts",
        F.concat(F.lit("batch_"), (F.col("event_id") % 7).cast("string")).alias("batch"),
    )


def with_copies(df: DataFrame) -> DataFrame:
    """A log with exact copies (every fifth event) and conflicting ones (every eleventh)."""
    again = df.where("event_id % 5 = 0").withColumn("arrival", F.lit(2))
    other = df.where("event_id % 11 = 0").withColumn("event_type", F.concat("event_type", F.lit("!"))).withColumn("arrival", F.lit(3))
    return df.withColumn("arrival", F.lit(1)).unionByName(again).unionByName(other)


COPIES = """copies AS (SELECT *, 1 AS arrival FROM log UNION ALL SELECT *, 2 FROM log WHERE event_id % 5 = 0
  UNION ALL SELECT user_id, event_id, op, event_type || '!', value, props, ts, batch, 3 FROM log WHERE event_id % 11 = 0)"""


def fp(df: DataFrame) -> DataFrame:
    return df.withColumn("fp", canonical.digest(*[F.col(c) for c in ("event_id", "user_id", "op", "event_type", "value", "props")]))


FP = """fps AS (SELECT *, sha256(concat_ws('|', CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR), op, coalesce(event_type, ''),
  coalesce(CAST(value AS VARCHAR), ''), coalesce(props, ''))) AS fp FROM copies)"""



def deleted():
    return F.col("op") == "DELETE"


LATEST = "SELECT user_id, arg_max(op, event_id) AS op, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM {} GROUP BY user_id"


# ---- cursors ----


@query("SELECT o_orderdate, o_orderkey FROM orders ORDER BY 1 DESC, 2 DESC LIMIT 1")
def wm_high(spark, d):
    return watermark.high_watermark(read(spark, d, "orders"), "o_orderdate", "o_orderkey")


_LOW, _HIGH = ("1995-03-01 00:00:00", 1000), ("1996-06-01 00:00:00", 9000)


def _cursor(w):
    return F.lit(w[0]).cast("timestamp_ntz"), F.lit(w[1])


@query(f"""SELECT o_orderkey, o_orderdate, o_custkey FROM orders
  WHERE (o_orderdate > TIMESTAMP '{_LOW[0]}' OR (o_orderdate = TIMESTAMP '{_LOW[0]}' AND o_orderkey > {_LOW[1]}))
    AND (o_orderdate < TIMESTAMP '{_HIGH[0]}' OR (o_orderdate = TIMESTAMP '{_HIGH[0]}' AND o_orderkey <= {_HIGH[1]}))""")  # fmt: skip
def wm_window(spark, d):
    out = watermark.bounded_window(read(spark, d, "orders"), "o_orderdate", "o_orderkey", _cursor(_LOW), _cursor(_HIGH))
    return out.select("o_orderkey", "o_orderdate", "o_custkey")


@query("""SELECT o_orderdate, count(*) AS ties, count(*) FILTER (WHERE o_orderkey > mid) AS left_by_key FROM
  (SELECT *, median_key AS mid FROM orders JOIN (SELECT o_orderdate AS dd, min(o_orderkey) AS median_key FROM orders GROUP BY 1) ON o_orderdate = dd)
  GROUP BY 1 HAVING count(*) > 1""")
def wm_collision_check(spark, d):
    """What a cursor on time alone would lose after stopping at the first key of a time."""
    o = read(spark, d, "orders")
    first = o.groupBy("o_orderdate").agg(F.min("o_orderkey").alias("k"))
    out = o.join(first, "o_orderdate").groupBy("o_orderdate").agg(F.count(F.lit(1)).alias("ties"), F.count_if(F.col("o_orderkey") > F.col("k")).alias("left_by_key"))
    return out.where("ties > 1")


_CUTS = ["1993-01-01 00:00:00", "1995-01-01 00:00:00", "1996-06-01 00:00:00", "2100-01-01 00:00:00"]


@query("SELECT CASE " + " ".join(f"WHEN o_orderdate <= TIMESTAMP '{c}' THEN {i}" for i, c in enumerate(_CUTS)) + " END AS batch, count(*) AS n, min(o_orderkey) AS first_key FROM orders GROUP BY 1")
def wm_batches_cover(spark, d):
    """Windows that follow each other take every row once."""
    o, low, out = read(spark, d, "orders"), watermark.START, None
    for i, c in enumerate(_CUTS):
        high = _cursor((c, 1 << 60))
        own = watermark.bounded_window(o, "o_orderdate", "o_orderkey", low, high).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"))
        own = own.where("n > 0").select(F.lit(i).alias("batch"), "n", "first_key")
        out, low = own if out is None else out.unionByName(own), high
    return out


@query("SELECT 'batch_orders_' || substr(sha256(concat_ws(':', 'orders', 'MIN', 'MIN', strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S'), CAST(arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS VARCHAR))), 1, 16) AS batch_id FROM orders")
def wm_batch_id(spark, d):
    top = watermark.high_watermark(read(spark, d, "orders"), "o_orderdate", "o_orderkey")
    row = top.select(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.col("o_orderkey").cast("string")).first()
    return spark.range(1).select(F.lit(canonical.watermark_batch_id("orders", watermark.START, tuple(row))).alias("batch_id"))


# ---- identity ----


@query("SELECT l_orderkey, l_linenumber, '{\"l_linenumber\":\"' || l_linenumber || '\",\"l_orderkey\":\"' || l_orderkey || '\"}' AS canonical_key FROM lineitem")
def canon_key(spark, d):
    s = lambda c: F.col(c).cast("string")
    key = F.create_map(F.lit("l_orderkey"), s("l_orderkey"), F.lit("l_linenumber"), s("l_linenumber"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", canonical.canonical_key(key).alias("canonical_key"))


@query("SELECT event_id, arrival, fp FROM fps", LOG, COPIES, FP)
def fingerprint(spark, d):
    return fp(with_copies(log(spark, d))).select("event_id", "arrival", "fp")


@query("""SELECT 'proc_' || substr(sha256(string_agg(id || ':' || h, '|' ORDER BY id || ':' || h)), 1, 16) AS processing_id FROM
  (SELECT 'customer/' || c_custkey AS id, sha256(c_name) AS h FROM customer)""")
def manifest_digest(spark, d):
    files = read(spark, d, "customer").select(F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias("logical_id"), F.sha2("c_name", 256).alias("content_sha256"))
    return files.agg(canonical.manifest_digest().alias("processing_id"))


# ---- normalisation ----

_CLASSES = """classes AS (SELECT *, CASE WHEN min(fp) OVER w <> max(fp) OVER w THEN 'CONFLICT'
  WHEN row_number() OVER (PARTITION BY event_id ORDER BY batch, arrival) = 1 THEN 'KEEP' ELSE 'EXACT_DUPLICATE' END AS class FROM fps WINDOW w AS (PARTITION BY event_id))"""


def _classes(spark, d):
    return normalize.classify_duplicates(fp(with_copies(log(spark, d))), "event_id", "fp", ("batch", "arrival"))


@query("SELECT event_id, user_id, fp FROM classes WHERE class = 'KEEP'", LOG, COPIES, FP, _CLASSES)
def dedupe_exact(spark, d):
    return _classes(spark, d).where("duplicate_class = 'KEEP'").select("event_id", "user_id", "fp")


@query("SELECT event_id, arrival FROM classes WHERE class = 'CONFLICT'", LOG, COPIES, FP, _CLASSES)
def conflict_ids(spark, d):
    return _classes(spark, d).where("duplicate_class = 'CONFLICT'").select("event_id", "arrival")


@query("""SELECT count(*) AS raw, count(*) FILTER (WHERE class = 'KEEP') AS accepted, count(*) FILTER (WHERE class = 'EXACT_DUPLICATE') AS duplicates,
  count(*) FILTER (WHERE class = 'CONFLICT') AS quarantined FROM classes""", LOG, COPIES, FP, _CLASSES)  # fmt: skip
def dedupe_metrics(spark, d):
    return normalize.duplicate_counts(_classes(spark, d))


@query("SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS sequence_conflict FROM lineitem)")
def seq_conflicts(spark, d):
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return normalize.flag_sequence_collisions(li, "l_orderkey", "l_linenumber")


@query("SELECT user_id, event_id, op, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position FROM log", LOG)
def ordered_accept(spark, d):
    return normalize.positions(log(spark, d).select("user_id", "event_id", "op"), ("user_id",), ("event_id",))


@query("""SELECT event_id, batch, coalesce(ts < prior, false) AS is_late_arrival FROM log JOIN
  (SELECT batch AS b, max(top) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM
    (SELECT batch, max(ts) AS top FROM log GROUP BY 1)) ON b = batch""", LOG)  # fmt: skip
def late_flags(spark, d):
    return normalize.flag_late(log(spark, d), "batch", "ts").select("event_id", "batch", "is_late_arrival")


_SPEC = {"users": TableSpec("users", "user_id", {"user_id": "string", "event_type": "string", "value": "decimal(18,2)"})}


def _raw(spark, d):
    """Events as the parsed lines would be, with defects by event_id. Rows are dealt to tasks while they are short: a split of
    the file holds many more than a task should parse and judge."""
    e, i = log(spark, d).repartition("event_id"), F.col("event_id")
    uid = F.col("user_id").cast("string")
    payload = F.to_json(F.struct(F.when(i % 23 == 0, F.lit("other")).otherwise(uid).alias("user_id"), "event_type", "value"))
    before = F.to_json(F.struct(uid.alias("user_id")))
    return e.select(
        i.cast("string").alias("raw_record"), F.lit("batch_id=b/users.jsonl").alias("source_file"), i.alias("ingestion_order"), F.lit(False).alias("malformed"),
        F.when(i % 13 == 0, F.lit(" ")).otherwise(i.cast("string")).alias("event_id"), F.when(i % 17 == 0, F.lit("nope")).otherwise(F.lit("users")).alias("table_name"),
        F.when(i % 19 == 0, F.lit("TRUNCATE")).when(i % 3 == 0, F.lower("op")).otherwise(F.col("op")).alias("operation"),
        F.when(i % 29 == 0, F.lit("yesterday")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("event_timestamp"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("source_commit_timestamp"), F.col("batch").alias("batch_id"),
        F.when(i % 31 == 0, F.lit(None)).otherwise(F.lit("crm")).alias("source_system"),
        F.when(i % 7 == 0, F.lit("-5")).when(i % 37 == 0, F.lit(None)).otherwise(i.cast("string")).alias("sequence_json"),
        before.alias("business_key_json"), F.create_map(F.lit("user_id"), uid).alias("business_key"),
        F.when(F.col("op") != "DELETE", payload).alias("payload_json"), F.when((F.col("op") != "INSERT") & (i % 41 != 0), before).alias("before_payload_json"),
        F.col("batch").alias("ingestion_batch_id"),
    )


_FIRST = """CASE WHEN event_id % 13 = 0 THEN 'MISSING_EVENT_ID' WHEN event_id % 17 = 0 THEN 'UNKNOWN_TABLE' WHEN event_id % 19 = 0 THEN 'UNSUPPORTED_OPERATION'
  WHEN event_id % 7 <> 0 AND event_id % 37 = 0 THEN 'MISSING_SEQUENCE' WHEN event_id % 7 = 0 OR event_id = 0 THEN 'INVALID_SEQUENCE'
  WHEN event_id % 29 = 0 THEN 'INVALID_EVENT_TIMESTAMP' WHEN event_id % 31 = 0 THEN 'MISSING_SOURCE_SYSTEM'
  WHEN op <> 'INSERT' AND event_id % 41 = 0 THEN 'MISSING_BEFORE_IMAGE' WHEN op <> 'DELETE' AND event_id % 23 = 0 THEN 'BUSINESS_KEY_PAYLOAD_MISMATCH' END"""


@query(f"SELECT event_id AS event, {_FIRST} AS quarantine_code FROM log", LOG)
def validate_codes(spark, d):
    return validate.validate_first(_raw(spark, d), _SPEC).select(F.col("ingestion_order").alias("event"), "quarantine_code")


@query("""SELECT event_id AS event, concat_ws('; ', CASE WHEN event_id % 13 = 0 THEN 'event_id is required' END,
  CASE WHEN event_id % 17 = 0 THEN 'table_name is unknown' END, CASE WHEN event_id % 19 = 0 OR event_id % 3 = 0 THEN 'operation is unsupported' END,
  CASE WHEN event_id % 17 = 0 THEN 'business_key lacks the table''s key' END,
  CASE WHEN event_id % 7 = 0 OR event_id % 37 = 0 OR event_id = 0 THEN 'sequence_number must be a positive integer' END,
  CASE WHEN event_id % 29 = 0 THEN 'event_timestamp is invalid' END, CASE WHEN event_id % 31 = 0 THEN 'source_system is required' END,
  CASE WHEN event_id % 19 <> 0 AND event_id % 3 <> 0 AND op <> 'INSERT' AND event_id % 41 = 0 THEN 'before image is required' END) AS errors FROM log""", LOG)  # fmt: skip
def validate_all_errors(spark, d):
    return validate.validate_all(_raw(spark, d), _SPEC).select(F.col("ingestion_order").alias("event"), F.array_join("errors", "; ").alias("errors"))


@query(f"SELECT event_id AS event, {_FIRST} AS quarantine_code FROM log WHERE {_FIRST} IS NOT NULL", LOG)
def quarantine_split(spark, d):
    return normalize.normalize(_raw(spark, d), _SPEC).quarantined.select(F.col("raw_record").cast("long").alias("event"), "quarantine_code")


@query(f"SELECT 'users' AS table_name, min(event_id) AS min_sequence, max(event_id) AS max_sequence, count(*) AS events FROM log WHERE {_FIRST} IS NULL", LOG)
def seq_min_max(spark, d):
    return normalize.normalize(_raw(spark, d), _SPEC).sequences()


# ---- state and history ----

_COLS = ["op", "event_type", "value"]


@query(f"SELECT user_id, event_type, value, event_id FROM ({LATEST.format('log')}) WHERE op <> 'DELETE'", LOG, value=True)
def scd1_current(spark, d):
    return scd.scd1(log(spark, d), ["user_id"], "event_id", ["event_type", "value"], deleted())


@query("""SELECT user_id, arg_max(event_type, event_id) FILTER (WHERE op <> 'DELETE') AS event_type, arg_max(value, event_id) FILTER (WHERE op <> 'DELETE') AS value,
  arg_max(op, event_id) = 'DELETE' AS is_deleted, max(event_id) AS event_id FROM log GROUP BY 1 HAVING count(*) FILTER (WHERE op <> 'DELETE') > 0""", LOG, value=True)  # fmt: skip
def scd1_soft_delete(spark, d):
    out = merge.fold(log(spark, d), ["user_id"], "event_id", "op", ["event_type", "value"], merge.SOFT)
    return out.where("has_upsert").select("user_id", "event_type", "value", (F.col("last_op") == "DELETE").alias("is_deleted"), F.col("last_sequence").alias("event_id"))


_HISTORY = """steps AS (SELECT *, op <> 'DELETE' AND (lag(op) OVER w IS NULL OR lag(op) OVER w = 'DELETE' OR lag(event_type) OVER w IS DISTINCT FROM event_type) AS opens FROM log
  WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
 numbered AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS v FROM steps),
 edges AS (SELECT *, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM numbered WHERE opens OR op = 'DELETE'),
 history AS (SELECT n.user_id, arg_max(n.event_type, n.event_id) AS event_type, arg_max(n.value, n.event_id) AS value, CAST(min(n.event_id) AS VARCHAR) AS start_at,
   CAST(any_value(e.nxt) AS VARCHAR) AS end_at FROM numbered n JOIN edges e ON e.user_id = n.user_id AND e.v = n.v AND e.opens WHERE n.op <> 'DELETE' GROUP BY n.user_id, n.v)"""


def _history(spark, d):
    return scd.scd2(log(spark, d), ["user_id"], "event_id", ["event_type", "value"], ["event_type"], deleted())


@query("SELECT user_id, event_type, value, start_at, end_at FROM history", LOG, _HISTORY, value=True)
def scd2_history(spark, d):
    return _history(spark, d).withColumns({"start_at": F.col(scd.START_AT).cast("string"), "end_at": F.col(scd.END_AT).cast("string")}).drop(scd.START_AT, scd.END_AT)


@query("""SELECT l.event_id, l.user_id, h.event_type, h.start_at FROM log l LEFT JOIN history h ON h.user_id = l.user_id AND CAST(h.start_at AS BIGINT) <= l.event_id
  AND (h.end_at IS NULL OR l.event_id < CAST(h.end_at AS BIGINT))""", LOG, _HISTORY)  # fmt: skip
def scd2_as_of(spark, d):
    facts = log(spark, d).select("event_id", "user_id")
    return scd.as_of(_history(spark, d), facts, ["user_id"], "event_id").select("event_id", "user_id", "event_type", F.col(scd.START_AT).cast("string").alias("start_at"))


@query("""SELECT user_id, arg_max(value, event_id) FILTER (WHERE value IS NOT NULL) AS value, arg_max(event_type, event_id) FILTER (WHERE event_type IS NOT NULL) AS event_type,
  max(event_id) AS event_id FROM (SELECT user_id, event_id, op, CASE WHEN event_id % 2 = 0 THEN value END AS value, CASE WHEN event_id % 3 = 0 THEN event_type END AS event_type,
  max(event_id) FILTER (WHERE op = 'DELETE') OVER (PARTITION BY user_id) AS cut FROM log) WHERE cut IS NULL OR event_id > cut GROUP BY 1""", LOG, value=True)  # fmt: skip
def ignore_nulls_update(spark, d):
    e = log(spark, d).withColumn("value", F.when(F.col("event_id") % 2 == 0, F.col("value"))).withColumn("event_type", F.when(F.col("event_id") % 3 == 0, F.col("event_type")))
    return scd.scd1(e, ["user_id"], "event_id", ["value", "event_type"], deleted(), ignore_nulls=True)


# ---- ledger and merge ----

_LEDGER = """ledger AS (SELECT CAST(event_id AS VARCHAR) AS event_id, sha256(event_type) AS event_fingerprint, 'users:' || user_id AS entity_sequence_key, event_id AS sequence_number,
  CASE WHEN event_id % 10 = 0 THEN 'PENDING' ELSE 'APPLIED' END AS status, CASE WHEN event_id % 20 = 0 THEN 'other' ELSE 'mine' END AS processing_id FROM log WHERE event_id % 2 = 0),
 incoming AS (SELECT CAST(event_id AS VARCHAR) AS event_id, sha256(CASE WHEN event_id % 26 = 0 THEN 'changed' ELSE event_type END) AS event_fingerprint,
  'users:' || user_id AS entity_sequence_key, event_id AS sequence_number, op AS operation FROM log WHERE event_id % 4 <> 2 OR event_id % 3 = 0)"""


def _ledger(spark, d):
    e, i = log(spark, d), F.col("event_id")
    return e.where("event_id % 2 = 0").select(
        i.cast("string").alias("event_id"), F.sha2("event_type", 256).alias("event_fingerprint"), F.concat(F.lit("users:"), F.col("user_id").cast("string")).alias("entity_sequence_key"),
        i.alias("sequence_number"), F.when(i % 10 == 0, "PENDING").otherwise("APPLIED").alias("status"), F.when(i % 20 == 0, "other").otherwise("mine").alias("processing_id"),
    )


def _incoming(spark, d):
    e, i = log(spark, d).where("event_id % 4 <> 2 OR event_id % 3 = 0"), F.col("event_id")
    return e.select(
        i.cast("string").alias("event_id"), F.sha2(F.when(i % 26 == 0, F.lit("changed")).otherwise(F.col("event_type")), 256).alias("event_fingerprint"),
        F.concat(F.lit("users:"), F.col("user_id").cast("string")).alias("entity_sequence_key"), i.alias("sequence_number"), F.col("op").alias("operation"),
    )


@query("SELECT entity_sequence_key, max(sequence_number) AS max_sequence FROM ledger WHERE status = 'APPLIED' GROUP BY 1", LOG, _LEDGER)
def ledger_max_seq(spark, d):
    return merge.max_applied(_ledger(spark, d))


@query("""SELECT i.event_id, CASE WHEN l.event_id IS NOT NULL AND l.event_fingerprint <> i.event_fingerprint THEN 'EVENT_CONFLICT' WHEN l.status = 'APPLIED' THEN 'EXACT_REPLAY_APPLIED'
  WHEN l.event_id IS NOT NULL AND l.processing_id <> 'mine' THEN 'PENDING_FOREIGN' WHEN l.event_id IS NOT NULL THEN 'RECOVERY_PENDING'
  WHEN i.sequence_number < m THEN 'STALE_SKIPPED' WHEN i.sequence_number = m THEN 'SEQUENCE_CONFLICT' ELSE 'FRESH' END AS class
  FROM incoming i LEFT JOIN ledger l ON l.event_id = i.event_id
  LEFT JOIN (SELECT entity_sequence_key AS k, max(sequence_number) AS m FROM ledger WHERE status = 'APPLIED' GROUP BY 1) ON k = i.entity_sequence_key""", LOG, _LEDGER)  # fmt: skip
def classify(spark, d):
    return merge.classify(_incoming(spark, d), _ledger(spark, d), "mine").select("event_id", "class")


@query("""SELECT event_id, 'FOREIGN_PROCESSING_ID' AS problem FROM ledger WHERE status = 'PENDING' AND processing_id <> 'mine'
  UNION ALL SELECT event_id, 'MISSING_FROM_INPUT' FROM ledger WHERE status = 'PENDING' AND event_id NOT IN (SELECT event_id FROM incoming)
  UNION ALL SELECT l.event_id, 'FINGERPRINT_DIFFERS' FROM ledger l JOIN incoming i ON i.event_id = l.event_id WHERE l.status = 'PENDING' AND i.event_fingerprint <> l.event_fingerprint""", LOG, _LEDGER)  # fmt: skip
def pending_guard(spark, d):
    return merge.pending_problems(_incoming(spark, d), _ledger(spark, d), "mine")


@query("""SELECT table_name, sequence_number, CAST(sum(n) AS BIGINT) AS events, max(n) > 1 AS ambiguous FROM (SELECT 'lines' AS table_name, CAST(l_linenumber AS BIGINT) AS sequence_number,
  l_orderkey, count(*) AS n FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def wave_groups(spark, d):
    li = read(spark, d, "lineitem").select(F.lit("lines").alias("table_name"), F.col("l_linenumber").cast("long").alias("sequence_number"), F.col("l_orderkey").alias("business_key_canonical"))
    return merge.wave_groups(li)


_HALVES = """early AS (SELECT * FROM log WHERE event_id % 2 = 0 OR event_id < 2000), late AS (SELECT * FROM log WHERE NOT (event_id % 2 = 0 OR event_id < 2000)),
 state AS (SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id, arg_max(op, event_id) AS op FROM early GROUP BY 1),
 live AS (SELECT * FROM state WHERE op <> 'DELETE')"""


def _halves(spark, d):
    e = log(spark, d)
    return e.where("event_id % 2 = 0 OR event_id < 2000"), e.where("NOT (event_id % 2 = 0 OR event_id < 2000)")


def _typed(e: DataFrame) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    return e.select(
        "user_id", "event_type", "value", F.col("event_id").alias("_last_sequence_number"), text("event_id").alias("_last_event_id"), F.col("op").alias("_last_operation"),
        F.sha2("event_type", 256).alias("_last_event_fingerprint"), text("ts").alias("_last_source_commit_timestamp"), F.lit("p").alias("_last_processing_id"),
        deleted().alias("_is_deleted"), F.when(deleted(), text("ts")).alias("_deleted_at"),
    )


def _merged(spark, d, policy):
    early, late = _halves(spark, d)
    cols = ["user_id", "event_type", "value"]
    none = spark.createDataFrame([], _typed(early).schema)
    first, _ = merge.apply_changes(none, _typed(early), "user_id", cols, policy)
    return merge.apply_changes(first, _typed(late), "user_id", cols, policy)


@query("""SELECT coalesce(n.user_id, o.user_id) AS user_id, CASE WHEN n.user_id IS NULL THEN o.event_type ELSE n.event_type END AS event_type,
  CASE WHEN n.user_id IS NULL THEN o.value ELSE n.value END AS value, coalesce(n.event_id, o.event_id) AS last_sequence FROM live o FULL JOIN
  (SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id, arg_max(op, event_id) AS op FROM late GROUP BY 1) n
  ON n.user_id = o.user_id WHERE n.op IS NULL OR n.op <> 'DELETE'""", LOG, _HALVES, value=True)  # fmt: skip
def merge_hard(spark, d):
    return _merged(spark, d, merge.HARD)[0].select("user_id", "event_type", "value", F.col("_last_sequence_number").alias("last_sequence"))


_SOFT = """two AS (SELECT *, event_id + CASE WHEN NOT (event_id % 2 = 0 OR event_id < 2000) THEN 1000000000 ELSE 0 END AS turn FROM log)"""


@query("""SELECT user_id, arg_max(event_type, turn) FILTER (WHERE op <> 'DELETE') AS event_type, arg_max(value, turn) FILTER (WHERE op <> 'DELETE') AS value,
  arg_max(op, turn) = 'DELETE' AS is_deleted, CASE WHEN arg_max(op, turn) = 'DELETE' THEN CAST(arg_max(ts, turn) AS VARCHAR) END AS deleted_at FROM two GROUP BY 1
  HAVING count(*) FILTER (WHERE op <> 'DELETE') > 0""", LOG, _SOFT, value=True)  # fmt: skip
def merge_soft(spark, d):
    return _merged(spark, d, merge.SOFT)[0].select("user_id", "event_type", "value", F.col("_is_deleted").alias("is_deleted"), F.col("_deleted_at").alias("deleted_at"))


@query("""SELECT CAST(l.event_id AS VARCHAR) AS event_id FROM late l JOIN state s ON s.user_id = l.user_id WHERE l.event_id < s.event_id""", LOG, _HALVES)
def stale_protection(spark, d):
    """Late events that the ledger holds off, those of deleted rows too."""
    early, late = _halves(spark, d)
    shape = lambda e: e.select(F.col("event_id").cast("string").alias("event_id"), F.sha2("event_type", 256).alias("event_fingerprint"), F.concat(F.lit("users:"), F.col("user_id").cast("string")).alias("entity_sequence_key"), F.col("event_id").alias("sequence_number"), F.col("op").alias("operation"))  # noqa: E731, E501
    ledger = shape(early).withColumn("status", F.lit("APPLIED")).withColumn("processing_id", F.lit("p"))
    return merge.classify(shape(late), ledger, "q").where("class = 'STALE_SKIPPED'").select("event_id")


# ---- change feeds ----

_STATES = """before AS (SELECT user_id, event_type, value FROM (SELECT user_id, arg_max(op, event_id) AS op, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value
   FROM log WHERE event_id % 100 < 60 GROUP BY 1) WHERE op <> 'DELETE'),
 after AS (SELECT user_id, event_type, value FROM (SELECT user_id, arg_max(op, event_id) AS op, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value
   FROM log GROUP BY 1) WHERE op <> 'DELETE'),
 feed AS (SELECT n.*, 'insert' AS change_type FROM after n WHERE user_id NOT IN (SELECT user_id FROM before)
  UNION ALL SELECT o.*, 'delete' FROM before o WHERE user_id NOT IN (SELECT user_id FROM after)
  UNION ALL SELECT o.*, 'update_preimage' FROM before o JOIN after n ON n.user_id = o.user_id WHERE (o.event_type, o.value) IS DISTINCT FROM (n.event_type, n.value)
  UNION ALL SELECT n.*, 'update_postimage' FROM before o JOIN after n ON n.user_id = o.user_id WHERE (o.event_type, o.value) IS DISTINCT FROM (n.event_type, n.value))"""


def _states(spark, d):
    cur = lambda e: scd.scd1(e, ["user_id"], "event_id", ["event_type", "value"], deleted()).drop("event_id")
    e = log(spark, d)
    return cur(e.where("event_id % 100 < 60")), cur(e)


@query("SELECT user_id, event_type, value, change_type FROM feed", LOG, _STATES, value=True)
def cdf_changes(spark, d):
    return cdf.diff(*_states(spark, d), "user_id").withColumnRenamed("_change_type", "change_type")


def _feed(spark, d):
    """Three commits of a versioned table, in a folder of its own."""
    t = VersionedTable(spark, f"{_scratch(spark)}/users", "user_id")
    old, new = _states(spark, d)
    t.create(old.limit(0), 4)
    t.enable_feed()
    t.append(old)
    base = t.version()
    t.replace(new, list(range(4)), "MERGE", cdf.diff(t.read(base), new, "user_id"), base=base)
    return t


def _scratch(spark: SparkSession) -> str:
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = root or tempfile.mkdtemp(prefix="rivulet-")  # of local mode alone
    return f"{root.rstrip('/')}/rivulet-{uuid.uuid4().hex}"


@query("SELECT user_id, change_type, CAST(3 AS BIGINT) AS version FROM feed UNION ALL SELECT user_id, 'insert', 2 FROM before", LOG, _STATES)
def cdf_bounded(spark, d):
    return _feed(spark, d).changes(2, 3).select("user_id", F.col("_change_type").alias("change_type"), F.col("_commit_version").alias("version"))


@query("""SELECT user_id, change_type, sha256(concat_ws('||', 'users', '3', change_type, CAST(user_id AS VARCHAR), change_type, '3', coalesce(event_type, '__NULL__'),
  CAST(user_id AS VARCHAR), coalesce(CAST(value AS VARCHAR), '__NULL__'))) AS change_id FROM feed""", LOG, _STATES)  # fmt: skip
def cdf_change_id(spark, d):
    f = cdf.diff(*_states(spark, d), "user_id").withColumn("_commit_version", F.lit(3))
    return f.select("user_id", F.col("_change_type").alias("change_type"), canonical.change_id("users", "user_id", f.columns).alias("change_id"))


@query("SELECT change_type, count(*) AS n FROM feed GROUP BY 1", LOG, _STATES)
def archive_idempotent(spark, d):
    """The feed written twice counts once."""
    f = cdf.diff(*_states(spark, d), "user_id").withColumn("_commit_version", F.lit(3)).withColumn("_commit_timestamp", F.lit("2026-01-01 00:00:00").cast("timestamp"))
    a = cdf.Archive(spark, _scratch(spark))
    a.write("users", "user_id", f)
    a.write("users", "user_id", f)
    return a.read("users").groupBy(F.col("_change_type").alias("change_type")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, 'VALUE' AS mismatch, 'o_totalprice' AS "column" FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 5 <> 0
  UNION ALL SELECT o_orderkey, 'MISSING', NULL FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT -o_orderkey, 'UNEXPECTED', NULL FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey > 0""")
def reconcile_tables(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    actual = o.where("o_orderkey % 5 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.lit(None)).otherwise(F.col("o_totalprice")))
    extra = o.where("o_orderkey % 11 = 0 AND o_orderkey > 0").withColumn("o_orderkey", -F.col("o_orderkey"))
    return reconcile.reconcile(o, actual.unionByName(extra), "o_orderkey")


@query("SELECT count(*) AS violations FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def fk_integrity(spark, d):
    return reconcile.orphans(read(spark, d, "orders"), read(spark, d, "customer"), "o_custkey", "c_custkey").agg(F.count(F.lit(1)).alias("violations"))


# ---- streams ----


def _changes(e):
    return e.select("user_id", F.col("event_id").alias("sequence_number"), F.col("op").alias("operation"), "event_type", "value")


def _landed(df, path, key, batches=2):
    """df as a stream of files, taken in so many batches. Each batch is as many files as tasks read at once, so that none is
    a few tasks' work; and more files don't make more batches, each of which would write the target's buckets again."""
    spark = df.sparkSession
    df.repartition(batches * spark.sparkContext.defaultParallelism, key).write.parquet(path)
    files = len(spark.read.schema(df.schema).parquet(path).inputFiles())
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(path)


def _streamed(spark, d, flow):
    root = _scratch(spark)
    cdc = AutoCdc(spark, root, flow, ("event_type", "value"), buckets=4)
    cdc.run(_landed(_changes(log(spark, d)), f"{root}/in", "sequence_number"), f"{root}/checkpoint")
    return cdc.result()


@query(f"SELECT user_id, event_type, value FROM ({LATEST.format('log')}) WHERE op <> 'DELETE'", LOG, value=True)
def stream_scd1(spark, d):
    return _streamed(spark, d, FlowSpec("users_scd1", ("user_id",)))


@query("SELECT user_id, event_type, value, start_at, end_at FROM history", LOG, _HISTORY, value=True)
def stream_scd2(spark, d):
    out = _streamed(spark, d, FlowSpec("users_scd2", ("user_id",), scd_type=2, track_history=("event_type",)))
    return out.withColumns({"start_at": F.col(scd.START_AT).cast("string"), "end_at": F.col(scd.END_AT).cast("string")}).drop(scd.START_AT, scd.END_AT)


# ---- what becomes of each event ----

_TOLD = """shifted AS (SELECT *, (event_id * 7919) % 1000003 AS arrival, event_id % 13 <> 0 AS fine, 'e' || CAST(event_id // 3 AS VARCHAR) AS id FROM log),
 firsts AS (SELECT *, fine AND row_number() OVER (PARTITION BY id, fine ORDER BY arrival, event_id) = 1 AS counts FROM shifted),
 told AS (SELECT *, CASE WHEN NOT fine THEN 'INVALID' WHEN NOT counts THEN 'DUPLICATE' WHEN event_id <= greatest(coalesce(max(CASE WHEN counts THEN event_id END)
   OVER (PARTITION BY user_id ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) THEN 'STALE' ELSE 'APPLIED' END AS outcome FROM firsts)"""


def _told(spark, d):
    i = F.col("event_id")
    e = log(spark, d).withColumns({"arrival": (i * 7919) % 1000003, "fine": i % 13 != 0, "id": F.concat(F.lit("e"), F.floor(i / 3).cast("string"))})
    return mutation.outcomes(e, ["user_id"], "event_id", "id", ["arrival", "event_id"], F.col("fine"))


@query("SELECT event_id, user_id, outcome FROM told", LOG, _TOLD)
def mutation_outcomes(spark, d):
    return _told(spark, d).select("event_id", "user_id", "outcome")


@query("""SELECT op, count(*) FILTER (WHERE outcome = 'APPLIED') AS applied, count(*) FILTER (WHERE outcome = 'DUPLICATE') AS duplicate,
  count(*) FILTER (WHERE outcome = 'STALE') AS stale, count(*) FILTER (WHERE outcome = 'INVALID') AS invalid FROM told GROUP BY 1""", LOG, _TOLD)
def mutation_counters(spark, d):
    return mutation.counters(_told(spark, d), ("op",))


@query("""SELECT user_id, arg_max(event_type, event_id) AS event_type FROM told WHERE outcome = 'APPLIED' GROUP BY 1 HAVING arg_max(op, event_id) <> 'DELETE'""", LOG, _TOLD)
def mutation_state(spark, d):
    own = _told(spark, d).where("outcome = 'APPLIED'").select("user_id", "event_type", "event_id", "op")
    return reconcile.expected_state(own.select("user_id", "event_type").limit(0), own, "user_id", "event_id", "op")


@query("""SELECT 'orders' AS table_name, count(*) AS expected, count(*) FILTER (WHERE o_orderstatus <> 'P') AS actual, count(*) = count(*) FILTER (WHERE o_orderstatus <> 'P') AS matches FROM orders
  UNION ALL SELECT 'customer', count(*), count(*), true FROM customer UNION ALL SELECT 'nation', 0, count(*), count(*) = 0 FROM nation""")
def reconcile_counts(spark, d):
    o, c, n = (read(spark, d, t) for t in ("orders", "customer", "nation"))
    return reconcile.row_counts({"orders": o, "customer": c}, {"orders": o.where("o_orderstatus <> 'P'"), "customer": c, "nation": n})


_EVENT = """ev AS (SELECT CAST(event_id AS VARCHAR) AS event_id, 'users' AS t, op, '{"user_id":"' || CAST(user_id AS VARCHAR) || '"}' AS k, CAST(event_id AS VARCHAR) AS s, props FROM log)"""


@query("""SELECT event_id, sha256(concat_ws('|', event_id, t, op, k, s, '2026-01-01T00:00:00Z', '2026-01-01T00:00:00Z', CASE WHEN op = 'DELETE' THEN '' ELSE replace(props, ' ', '') END,
  CASE WHEN op = 'INSERT' THEN '' ELSE replace(props, ' ', '') END, 'app')) AS event_fingerprint FROM ev""", LOG, _EVENT)
def event_fingerprint(spark, d):
    """The identity of events whose images are props."""
    e, at = log(spark, d), F.lit("2026-01-01T00:00:00Z")
    key = canonical.canonical_key(F.create_map(F.lit("user_id"), F.col("user_id").cast("string")))
    own = e.select(
        F.col("event_id").cast("string").alias("event_id"), F.lit("users").alias("table_name"), F.col("op").alias("operation"), key.alias("business_key_canonical"),
        F.col("event_id").alias("sequence_number"), at.alias("event_timestamp"), at.alias("source_commit_timestamp"), F.lit("app").alias("source_system"),
        F.when(F.col("op") != "DELETE", F.col("props")).alias("payload_json"), F.when(F.col("op") != "INSERT", F.col("props")).alias("before_payload_json"),
    )
    return own.select("event_id", canonical.event_fingerprint().alias("event_fingerprint"))


# ---- hydration, stream and retention ----


def _hydrated(spark, d, **kind):
    """A snapshot of early events and a stream of the others into one target."""
    root, e = _scratch(spark), log(spark, d)
    columns = ("event_type", "value")
    early = scd.scd1(e.where("event_id < 2000"), ["user_id"], "event_id", list(columns), deleted())
    snapshot = _landed(snapshot_events(early.select("user_id", *columns)), f"{root}/snapshot", "user_id", batches=1)
    later = _landed(_changes(e.where("event_id >= 2000")), f"{root}/in", "sequence_number")
    for name, source, once in (("hydration", snapshot, True), ("hydration", snapshot, True), ("stream", later, False)):
        cdc = AutoCdc(spark, root, FlowSpec("users", ("user_id",), name=name, once=once, **kind), columns, buckets=4)
        cdc.run(source, f"{root}/checkpoint-{name}")
    return cdc


_HYDRATED = """snap AS (SELECT user_id, event_type, value FROM (SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, arg_max(op, event_id) AS op
   FROM log WHERE event_id < 2000 GROUP BY 1) WHERE op <> 'DELETE'),
 fed AS (SELECT user_id, 0 AS event_id, 'SNAPSHOT' AS op, event_type, value FROM snap UNION ALL SELECT user_id, event_id, op, event_type, value FROM log WHERE event_id >= 2000)"""


@query(f"SELECT user_id, event_type, value FROM ({LATEST.format('fed')}) WHERE op <> 'DELETE'", LOG, _HYDRATED, value=True)
def stream_hydrated_scd1(spark, d):
    return _hydrated(spark, d).result()


@query("SELECT user_id, event_type, value, start_at, end_at FROM history", LOG, _HYDRATED, _HISTORY.replace("FROM log", "FROM fed"), value=True)
def stream_hydrated_scd2(spark, d):
    out = _hydrated(spark, d, scd_type=2, track_history=("event_type",)).result()
    return out.withColumns({"start_at": F.col(scd.START_AT).cast("string"), "end_at": F.col(scd.END_AT).cast("string")}).drop(scd.START_AT, scd.END_AT)


@query(f"SELECT user_id, op = 'DELETE' AS tombstone, 'before' AS stage FROM ({LATEST.format('fed')}) UNION ALL SELECT user_id, false, 'after' FROM ({LATEST.format('fed')}) WHERE op <> 'DELETE'", LOG, _HYDRATED)
def tombstone_purge(spark, d):
    """What a target holds before and after its tombstones' time is over."""
    cdc = _hydrated(spark, d, tombstone_retention_seconds=3600)
    base = cdc.table.version()
    cdc.purge()  # none is old enough
    cdc.purge(F.current_timestamp() + F.expr("INTERVAL 2 HOURS"))
    both = cdc.table.read(base).withColumn("stage", F.lit("before")).unionByName(cdc.table.read().withColumn("stage", F.lit("after")))
    return both.select("user_id", F.col("_deleted").alias("tombstone"), "stage")


from rivulet.plans import incremental  # noqa: E402, F401  registers its queries
